"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A text is cut into sentences and lines.  A sentence is the mean of the embeddings of its words and of their hashed
character n-grams; one logistic output per subject scores it.  Training takes the sentences of labelled documents
with the document's labels: sentences without a subject of their own are spread over all subjects and learn
nothing, a subject's own words stand out.  Each round, every partition computes the gradient of its sentences and
the driver adds the partitions' gradients (a fixed number of buckets times dimensions, whatever the data) and
takes one step.

A document is about the subjects that enough of its sentences are about: how many, given how many of its
sentences have a subject at all, is read off the labelled documents (`fit_rule`), so that a sentence in passing in a longer
text does not count while a text of one sentence does.  Labelled documents all have a subject, so for a single sentence in
an otherwise general text the length decides (`LONE`).

Defined cases: null, blank and purely general texts have no subjects; identifiers, markup, front matter and entities
are no words; labels of unknown documents or null subjects are ignored, repeated ones count once; at most
`MAX_LABELLED` labelled documents are trained on (by hash of doc_id); without any usable label there is no subject;
repeated doc_ids are scored each and give each subject once; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.plans.cut import cut

#: Labelled documents that training takes at most.
MAX_LABELLED = 20_000
BUCKETS, DIMS = 2**15, 16
GRAMS = (4, 5)
ROUNDS, RATE = 30, 0.25
#: Partitions that compute gradients.
PARTS = 6
#: Probability from which a sentence is about a subject.
SURE = 0.4
#: Log-odds by which it must exceed the subject's share of the labelled documents, which general sentences come near.
LIFT = 1.0
#: How far, in log-odds, a subject of a sentence may lie below its likeliest one: a sentence on two subjects has both.
NEAR = 2.0
#: In a text of more sentences than this, one sentence alone makes no subject.
LONE = 6

_FRONT = re.compile(r"\A\s*---\r?\n[\s\S]*?\n---\s*(?:\n|\Z)")
_TAG = re.compile(r"<[^<>]{1,200}>|https?://\S+|!?\[([^\]]*)\]\([^)]*\)")
_IDENTIFIER = re.compile(r"\b[A-Za-z]+[a-z0-9][A-Z]\w*|\b\w*_\w+\b")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|[\r\n]+|\s+\|\s+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence that has any."""
    if not text or not text.strip():
        return []
    text = html.unescape(_FRONT.sub("", text))
    text = _IDENTIFIER.sub(" ", _TAG.sub(r" \1 ", text))
    return [w for w in (_WORD.findall(s.lower()) for s in _SENTENCE.split(text)) if w]


_words: dict[str, np.ndarray] = {}


def features(word: str) -> np.ndarray:
    """Buckets of the word and of its character n-grams."""
    got = _words.get(word)
    if got is None:
        marked = f"<{word}>"
        parts = {marked} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
        got = np.array(sorted(zlib.crc32(p.encode()) % BUCKETS for p in parts), dtype=np.int32)
        if len(_words) > 200_000:
            _words.clear()
        _words[word] = got
    return got


@dataclass
class Batch:
    """Sentences as flat arrays: each token's word, each word's buckets."""

    starts: np.ndarray
    tokens: np.ndarray
    word_starts: np.ndarray
    word_feats: np.ndarray
    by_word: np.ndarray = field(default=None)
    sent_of: np.ndarray = field(default=None)

    @staticmethod
    def of(sents: list[list[str]]) -> Batch:
        ids: dict[str, int] = {}
        tokens = np.array([ids.setdefault(w, len(ids)) for s in sents for w in s], dtype=np.int64)
        feats = [features(w) for w in ids]
        lengths = np.array([len(f) for f in feats], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sents])[:-1]]).astype(np.int64) if sents else np.zeros(0, np.int64)
        return Batch(starts, tokens, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if ids else np.zeros(0, np.int64), np.concatenate(feats) if ids else np.zeros(0, np.int32))

    def hidden(self, emb: np.ndarray) -> np.ndarray:
        """Mean embedding of each sentence; a word is the mean of its buckets."""
        words = np.add.reduceat(emb[self.word_feats], self.word_starts, axis=0)
        words /= np.diff(np.append(self.word_starts, len(self.word_feats)))[:, None]
        sums = np.add.reduceat(words[self.tokens], self.starts, axis=0)
        return sums / np.diff(np.append(self.starts, len(self.tokens)))[:, None]

    def gradient(self, emb: np.ndarray, out: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the logistic loss, by embeddings and by output weights (last row: bias)."""
        h = self.hidden(emb)
        err = 1 / (1 + np.exp(-(h @ out[:-1] + out[-1]))) - y
        g_out = np.vstack([h.T @ err, err.sum(0)])
        sizes = np.diff(np.append(self.starts, len(self.tokens)))
        g_h = (err @ out[:-1].T) / sizes[:, None]
        if self.by_word is None:
            self.by_word = np.argsort(self.tokens, kind="stable")
            self.sent_of = np.repeat(np.arange(len(self.starts)), sizes)[self.by_word]
        first = np.searchsorted(self.tokens[self.by_word], np.arange(len(self.word_starts)))
        g_words = np.add.reduceat(g_h[self.sent_of], first, axis=0)
        counts = np.diff(np.append(self.word_starts, len(self.word_feats)))
        g_words /= counts[:, None]
        g_emb = np.zeros_like(emb)
        np.add.at(g_emb, self.word_feats, np.repeat(g_words, counts, axis=0))
        return g_emb, g_out


@dataclass
class Model:
    subjects: list[str]
    emb: np.ndarray
    out: np.ndarray
    rule: np.ndarray | None = None
    shares: np.ndarray | None = None

    def sentence_hits(self, sents: list[list[str]]) -> np.ndarray:
        """For each sentence and subject, whether its output is sure and near to the likeliest."""
        z = Batch.of(sents).hidden(self.emb) @ self.out[:-1] + self.out[-1]
        least = np.log(SURE / (1 - SURE))
        if self.shares is not None:
            least = np.maximum(least, np.log(self.shares / (1 - self.shares)) + LIFT)
        return (z >= least) & (z >= z.max(1, keepdims=True) - NEAR)


#: Numbers of sentences are told apart up to this; beyond, the share of the sentences decides.
MOST = 8
SHARES = 40


def counts_of(hits: np.ndarray) -> tuple[np.ndarray, int]:
    """Sentences about each subject, and sentences about any."""
    return hits.sum(0), int(hits.any(1).sum())


def binned(k: int, n: int) -> tuple[int, int]:
    """(n, k) as the rule sees it: k itself up to MOST sentences, beyond that k's share in steps of 1/SHARES."""
    return (n, k) if n <= MOST else (MOST + 1, k * SHARES // n if k > 1 else 0)


def fit_rule(seen: dict[tuple[int, int, bool], int]) -> np.ndarray:
    """seen: how many labelled documents have (n, k) binned and the subject as label or not.

    rule[n]: from which k a subject counts where n sentences have a subject; the threshold with the fewest errors, of
    equally good ones the nearest to two sentences or a tenth.  Up to MOST it never falls with n."""
    rule = np.ones(MOST + 2, dtype=np.int64)
    for n in range(1, MOST + 2):
        near = [(k, y, c) for (m, k, y), c in seen.items() if m == n]
        usual = 1 if n < 3 else 2 if n <= MOST else SHARES // 10
        if near:
            errors = [(sum(c for k, y, c in near if (k >= t) != y), t) for t in range(1, (n if n <= MOST else SHARES) + 1)]
            best = [t for e, t in errors if e == min(errors)[0]]
            rule[n] = min(best, key=lambda t: abs(t - usual))
        elif n > MOST:
            rule[n] = usual
        if 1 < n <= MOST:
            rule[n] = max(rule[n], rule[n - 1])
    return rule


def decide(hits: np.ndarray, rule: np.ndarray) -> np.ndarray:
    per, n = counts_of(hits)
    if n == 1 and len(hits) > LONE:
        return np.zeros(0, dtype=np.int64)
    return np.array([i for i, k in enumerate(per) if k and (b := binned(int(k), n))[1] >= rule[b[0]]], dtype=np.int64)


def init(n_subjects: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32), np.vstack([rng.normal(0, 0.5, (DIMS, n_subjects)), np.full((1, n_subjects), -2.0)]).astype(np.float32)


class Adam:
    def __init__(self, *params: np.ndarray, rate: float = RATE):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, *grads: np.ndarray) -> None:
        self.t += 1
        for p, m, v, g in zip(self.params, self.m, self.v, grads):
            m *= 0.8
            m += 0.2 * g
            v *= 0.95
            v += 0.05 * g * g
            p -= self.rate * (m / (1 - 0.8**self.t)) / (np.sqrt(v / (1 - 0.95**self.t)) + 1e-8)


_parts: dict[tuple, tuple] = {}


def _part(key: tuple, rows: list[tuple[str, list[int]]], n_subjects: int) -> tuple[Batch, np.ndarray]:
    """A partition's sentences; a worker that meets the partition again need not split them again."""
    if key not in _parts:
        if len(_parts) > 4:
            _parts.clear()
        sents, y = [], []
        for text, labels in rows:
            for s in sentences(text):
                sents.append(s)
                y.append(labels)
        target = np.zeros((len(sents), n_subjects), dtype=np.float32)
        for i, ls in enumerate(y):
            target[i, ls] = 1
        _parts[key] = Batch.of(sents), target
    return _parts[key]


def train(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, parts: int = PARTS) -> Model | None:
    spark = documents.sparkSession
    clean = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    subjects = sorted(r[0] for r in clean.select("subject").distinct().collect())  # the list of subjects
    if not subjects:
        return None
    number = {s: i for i, s in enumerate(subjects)}
    per_doc = clean.groupBy("doc_id").agg(F.collect_set("subject").alias("s")).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    rows = documents.select("doc_id", "text").join(per_doc, "doc_id").where("text is not null")
    data = cut(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts))).select("part", "text", "s"), "labelled")
    emb, out = init(len(subjects))
    adam = Adam(emb, out)
    name = uuid.uuid4().hex
    grouped = data.repartition(parts, "part").groupBy("part")  # by number, so that small parts stay tasks of their own
    for _ in range(rounds):
        handle = spark.sparkContext.broadcast((emb, out))  # buckets times dimensions, whatever the data

        def gradient(key: tuple, t: pa.Table) -> pa.Table:
            e, o = handle.value
            batch, y = _part((name, key[0].as_py()), [(x, [number[s] for s in ls]) for x, ls in zip(t.column("text").to_pylist(), t.column("s").to_pylist())] if (name, key[0].as_py()) not in _parts else [], len(subjects))
            if not len(batch.starts):
                return pa.table({"g": pa.array([], pa.binary()), "o": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
            g, go = batch.gradient(e, o, y)
            touched = np.nonzero(g.any(1))[0].astype(np.int32)
            return pa.table({"g": [touched.tobytes() + g[touched].astype(np.float32).tobytes()], "o": [go.astype(np.float32).tobytes()], "n": [len(touched)]})

        g_emb, g_out = np.zeros_like(emb), np.zeros_like(out)
        for r in grouped.applyInArrow(gradient, "g binary, o binary, n long").collect():  # `parts` rows
            rows_at = np.frombuffer(r["g"], np.int32, r["n"])
            g_emb[rows_at] += np.frombuffer(r["g"], np.float32, offset=4 * r["n"]).reshape(-1, DIMS)
            g_out += np.frombuffer(r["o"], np.float32).reshape(out.shape)
        handle.destroy()
        adam.step(g_emb, g_out)
    tagged = {r["s"]: r["n"] for r in data.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}  # the list of subjects
    n_docs = max(1, data.count())
    model = Model(subjects, emb, out, shares=np.clip(np.array([tagged.get(s, 0) / n_docs for s in subjects]), 0.01, 0.9))
    handle = spark.sparkContext.broadcast(model)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, int, bool], int] = {}
            for text, ls in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sents = sentences(text)
                if sents:
                    per, n = counts_of(handle.value.sentence_hits(sents))
                    for i, k in enumerate(per):
                        if n:
                            key = (*binned(int(k), n), handle.value.subjects[i] in ls)
                            seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_pydict({"k": [k for _, k, _ in seen], "n": [n for n, _, _ in seen], "y": [y for _, _, y in seen], "c": list(seen.values())}, schema=pa.schema([("k", pa.int64()), ("n", pa.int64()), ("y", pa.bool_()), ("c", pa.int64())]))

    tallied = data.select("text", "s").mapInArrow(tally, "k long, n long, y boolean, c long").groupBy("k", "n", "y").agg(F.sum("c").alias("c")).collect()  # at most 2 * (MOST^2 + SHARES) rows
    model.rule = fit_rule({(r["n"], r["k"], r["y"]): r["c"] for r in tallied})
    return model


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, subject): every document's subjects."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    handle = documents.sparkSession.sparkContext.broadcast(model)

    def about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        for b in batches:
            split = [sentences(t) for t in b.column(1).to_pylist()] if m else []
            flat = [s for ss in split for s in ss]
            hits = m.sentence_hits(flat) if flat else None
            rows, names, at = [], [], 0
            for i, ss in enumerate(split):
                if ss:
                    for k in decide(hits[at : at + len(ss)], m.rule):
                        rows.append(i)
                        names.append(m.subjects[k])
                    at += len(ss)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string())], ["doc_id", "subject"])

    return documents.select("doc_id", "text").mapInArrow(about, f"doc_id {kind}, subject string").distinct()


def composition(scored: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and characters by subject; a document with several subjects counts for each."""
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    return sizes.join(scored, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("(none)")).alias("subject")).agg(F.count("*").alias("documents"), F.sum("chars").alias("characters"))
