import random

import numpy as np

from strataweave.llm import subjects as S

TERMS = {"law": ["verdict", "statute", "contract clause", "Urteil"], "sport": ["home team", "league table", "referee", "Spieler"], "farming": ["orchard row", "grain silo", "calf tag", "Ernte"]}


def sentence(rnd, subject):
    a, b = rnd.sample(TERMS[subject], 2)
    return rnd.choice([f"The {a} form now accepts a {b}.", f"Without the {a} the {b} view is late.", f"Each {a} carries the id of its {b}.", f"We renamed the {a} because of the {b}."])


def corpus(n, seed):
    rnd, docs, labels = random.Random(seed), [], []
    for i in range(n):
        own = rnd.sample(sorted(TERMS), rnd.choice([1, 1, 1, 2]))
        parts = [sentence(rnd, s) for s in own for _ in range(rnd.choice([2, 3, 5]))] + ["Please rebase before merging."]
        if len(parts) > 5 and rnd.random() < 0.4:
            parts.append(sentence(rnd, rnd.choice([s for s in TERMS if s not in own])))
        rnd.shuffle(parts)
        docs.append((i, "# OrderMapper\n\n" + " ".join(parts)))
        labels += [(i, s) for s in own]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "s", "r") for d in docs], "doc_id long, text string, subject string, rule string"), spark.createDataFrame(labels, "doc_id long, subject string")


def test_held_out_accuracy_and_special_texts(spark):
    docs, labels = corpus(160, 1)
    more, truth = corpus(80, 2)
    special = [(9001, None), (9002, "  \n"), (9003, "Please rebase before merging."), (9004, "The verdict form now accepts a statute."), (9005, "verdict statute. " * 20_000), (9006, "Please rebase before merging. " * 9 + "The verdict form now accepts a statute."), (9004, "The verdict form now accepts a statute.")]
    known, ldf = frames(spark, docs, [*labels, *labels[:5], (None, "law"), (77777, "law"), (3, None)])
    model = S.train(known, ldf, rounds=25, parts=3)
    assert model.subjects == sorted(TERMS)
    df, _ = frames(spark, [(i + 1000, t) for i, t in more] + special, labels)
    got = {tuple(r) for r in S.score(df, model).collect()}
    want = {(i + 1000, s) for i, s in truth}
    found = {g for g in got if g[0] < 9000}
    assert len(found & want) >= 0.95 * len(want) and len(found & want) >= 0.95 * len(found)
    assert {g for g in got if g[0] >= 9000} == {(9004, "law"), (9005, "law")}
    for text in ("The verdict names the referee.", "The home team read the contract clause."):
        both = model.sentence_hits(S.sentences(text))[0]
        assert {model.subjects[k] for k in np.nonzero(both)[0]} == {"law", "sport"}
    parts = {r["subject"]: r["documents"] for r in S.composition(S.score(df, model), df).collect()}
    assert parts["(none)"] >= 3


def test_gradient_against_differences():
    sents = [["verdict", "statute"], ["referee"], ["verdict", "referee", "verdict"]]
    y = np.array([[1, 0], [0, 1], [1, 1]], dtype=np.float64)
    emb, out = (a.astype(np.float64) for a in S.init(2))
    batch = S.Batch.of(sents)

    def loss():
        z = batch.hidden(emb) @ out[:-1] + out[-1]
        return float((np.log1p(np.exp(z)) - y * z).sum())

    g, go = batch.gradient(emb, out, y)
    for a, grad, at in ((emb, g, (int(S.features("verdict")[0]), 3)), (emb, g, (int(S.features("referee")[1]), 0)), (out, go, (2, 1)), (out, go, (S.DIMS, 0))):
        a[at] += 1e-5
        up = loss()
        a[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grad[at]) < 1e-3
        a[at] += 1e-5


def test_sentences():
    assert S.sentences("---\ntitle: law\n---\nThe <b>calf&nbsp;tag</b> of LedgerWriter. x_y\n- Zähler | ab") == [["the", "calf", "tag", "of"], ["zähler"], ["ab"]]
    assert S.sentences(None) == S.sentences(" ") == S.sentences("12 !") == []


def test_no_labels_and_empty(spark):
    df, ldf = frames(spark, [(1, "The verdict.")], [(1, "law")])
    assert S.train(df, ldf.limit(0)) is None
    assert S.score(df, None).count() == 0
    model = S.train(df, ldf, rounds=3, parts=2)
    assert S.score(df.limit(0), model).count() == 0
    assert S.train(df.limit(0), ldf, rounds=2, parts=2) is not None
