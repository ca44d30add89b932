"""Vector, lexical and hybrid retrieval over text chunks."""

from __future__ import annotations

import string
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.plans.cut import cut

K1, B = 1.2, 0.75
WORD = r"[a-z0-9][a-z0-9_\-]*"


def dot(a: Column, b: Column) -> Column:
    """Products in single precision, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("float") * y.cast("float")), F.lit(0.0), lambda s, x: s + x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.coalesce(F.when(ok, dot(a, b) / norms), F.lit(0.0))


def similar(vectors: DataFrame, query: list[float], k: int, least: float = 0.5) -> DataFrame:
    """vectors: (key, embedding); query: one vector. The k nearest with at least that score."""
    scored = vectors.withColumn("score", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "key").limit(k).drop("embedding")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def _frequency(word: str) -> Column:
    return F.size(F.filter("t", lambda x: x == word))


def bm25(chunks: DataFrame, query: str, text: str = "text") -> DataFrame:
    """chunks: (key, <text>). (key, score) of every chunk with a query term.

    Term frequencies are counted inside each row; only document frequencies and the mean length are aggregated, to one
    row of numbers that the scores then hold as constants."""
    import re

    terms = list(dict.fromkeys(re.findall(WORD, query.lower())))
    if not terms:
        return chunks.select("key", F.lit(0.0).alias("score")).limit(0)
    t = chunks.select("key", tokens(F.col(text)).alias("t"))
    # A few numbers a row, written once: the statistics and the scores both read them.
    counted = cut(t.select("key", F.size("t").alias("len"), *[_frequency(w).alias(f"f{i}") for i, w in enumerate(terms)]), "counted")
    stats = counted.agg(F.greatest(F.avg("len"), F.lit(1.0)).alias("avg"), F.count("*").alias("n"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    joined = counted.where(" or ".join(f"f{i} > 0" for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"f{i}"), stats[f"d{i}"]
        idf = math.log(1 + (stats["n"] - d + 0.5) / (d + 0.5))
        score = score + F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("len") / (stats["avg"] or 1.0)))
    return joined.select("key", score.alias("score")).where("score > 0")


def hybrid(dense: DataFrame, lexical: DataFrame, titles: DataFrame, k: int) -> DataFrame:
    """0.65 of the dense score and 0.35 of the lexical one over its maximum; best first, then by title."""
    top = lexical.agg(F.max("score")).first()[0] or 1.0  # one number
    lex = lexical.select("key", (F.col("score") / top).alias("lex"))
    j = dense.select("key", F.greatest("score", F.lit(0.0)).alias("dense")).join(lex, "key", "full").fillna(0.0, ["dense", "lex"]).join(titles, "key")
    return j.select("key", "title", (0.65 * F.col("dense") + 0.35 * F.col("lex")).alias("score")).where("score > 0").orderBy(F.desc("score"), "title", "key").limit(k)


def excerpt(text: Column, terms: list[str]) -> Column:
    """360 characters from 120 before the first hit, white space of any kind collapsed and none at the ends."""
    # Lower case can be longer than its text (İ); for terms of ASCII, only ASCII letters need folding, place by place.
    ascii_lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    at = [F.instr(ascii_lower if t.isascii() else F.lower(text), t.lower()) for t in terms]
    hits = [F.when(i > 0, i - 1) for i in at]
    first = F.coalesce(F.array_min(F.array_compact(F.array(*hits))), F.lit(0))
    return F.trim(F.regexp_replace(F.substring(text, F.greatest(F.lit(0), first - 120) + 1, F.lit(360)), r"[\t-\r\x{85}\p{Z}]+", " "))


def windows(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, chunk_index, n_tokens, chunk): windows of tokens split at white space; the last one ends with the text."""
    w = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "")
    d = docs.select(key, w.alias("w")).where(F.size("w") > 0)
    step = size - overlap
    last = F.greatest(F.ceil((F.size("w") - overlap) / F.lit(step)) - 1, F.lit(0)).cast("int")
    each = d.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, F.lit(size))
    return each.select(key, "chunk_index", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk"))


def sections(text: str) -> list[tuple[str, str]]:
    """(breadcrumb, body) of a Markdown text: front matter left out, split at headings of levels 1 to 3, pure code left out."""
    import re

    body = re.sub(r"\A---\r?\n.*?\r?\n---\s*\r?\n", "", text or "", flags=re.S)
    out, trail, lines, fenced = [], [], [], False

    def flush() -> None:
        content = "\n".join(lines).strip()
        if re.sub(r"```.*?(```|\Z)", "", content, flags=re.S).strip():
            out.append((" > ".join(t for _, t in trail), content))

    for line in body.splitlines():
        fenced ^= line.strip().startswith("```")
        m = None if fenced else re.match(r"(#{1,3})\s+(.+?)\s*$", line)
        if m:
            flush()
            lines = []
            trail = [(k, t) for k, t in trail if k < len(m[1])] + [(len(m[1]), m[2])]
        else:
            lines.append(line)
    flush()
    return out
