import random
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.llm import splitting as S


def sound(text, words=S.MAX_WORDS, chars=S.MAX_CHARS, overlap=S.OVERLAP):
    spans = S.split(text, words, chars, overlap)
    assert "".join(text[s:e] for _, s, e in spans) == text
    for i, (o, s, e) in enumerate(spans):
        piece = text[o:e]
        assert len(piece) <= chars and len(S._WORD.findall(piece)) <= words
        if i:
            before = S._WORD.findall(text[o:s])
            assert len(before) <= overlap
    return spans


def test_round_trip_and_limits():
    rnd = random.Random(1)
    text = "".join(rnd.choice(["word", "a", "Longer,", "end.", "# Head"]) + rnd.choice([" ", " ", " ", "\n", "\n\n", "\r\n", " "]) for _ in range(5000))
    spans = sound(text)
    assert len(spans) > 9
    assert all(len(S._WORD.findall(text[o:s])) == 64 for o, s, _ in spans[1:])


def test_cuts_at_natural_boundaries():
    text = ("Some words stand here. " * 40 + "\n\n") * 6
    assert all(text[:s].endswith("\n\n") for _, s, _ in sound(text)[1:])


def test_limits_are_exact():
    assert len(S.split("w " * 512)) == 1 and len(S.split("w " * 513)) > 1
    assert len(S.split("x" * 4000)) == 1 and len(S.split("x" * 4001)) > 1 and len(S.split(" " * 4001)) > 1


def test_runs_without_white_space():
    sound("x" * 50_000)
    sound(("y" * 900 + " ") * 100)
    sound(" " * 9000 + "a" + "　" * 9000)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n #", max_size=400))
def test_any_text(text):
    sound(text, 20, 60, 4)


def test_rows(spark):
    d = datetime(2024, 1, 1)
    rows = [(1, 1, 0, "p", "w " * 600, d, 9), (1, 1, 0, "p", "w " * 600, d, 9), (1, 1, 1, None, None, d, 9), (1, 1, 2, "p", "", None, 9), (2, None, 0, "p", "old " * 900, d, 9), (2, None, 0, "p", "new", datetime(2024, 2, 1), 9)]
    df = spark.createDataFrame(rows, "page_id long, revision int, chunk_index int, section_path string, text string, updated_at timestamp, n_pieces int")
    got = {(r["page_id"], r["revision"], r["chunk_index"], r["piece_index"]): r for r in S.split_items(df).collect()}
    assert sorted(got, key=str) == sorted([(1, 1, 0, 0), (1, 1, 0, 1), (1, 1, 1, 0), (1, 1, 2, 0), (2, None, 0, 0)], key=str)
    assert got[1, 1, 1, 0]["text"] is None and got[1, 1, 2, 0]["text"] == "" and got[2, None, 0, 0]["text"] == "new" and got[1, 1, 0, 1]["overlap_chars"] == 128
    assert S.split_items(df.limit(0)).count() == 0
