"""Mixing sources to target weights.

Every document gets a hash-random key; documents of a source are sorted by key, and prefix sums of their tokens tell
exactly where the source's budget ends.  Keys are cut into ranges (buckets), whose sums are cumulated first, so a
source with a third of all rows is sorted and summed by many tasks.

The mix is the largest in which every source can supply its share: total = min over sources of
max_repeats * tokens / share; a smaller total can be asked for.  A source's budget is share * total: as many whole
epochs as fit, then the documents in key order that lie wholly within the rest, then, of those not taken, the ones in
key order that fit into what is left, and so on until no document fits: a source misses its budget by less than its
smallest document left, and max_repeats never.

Defined cases: targets that are null, not positive, or listed twice: null and non-positive ones are ignored, of
repeated ones the greatest counts; max_repeats null counts as 1; shares are taken relative to their sum; a target
without documents or tokens gets nothing and does not bound the total; documents of other sources and without tokens
take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.llm.tokens import VOCABULARY, token_count
from strataweave.plans.cut import cut

BUCKET_ROWS = 50_000


def budgets(targets: dict[str, tuple[float, int]], tokens: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens that each source has to supply."""
    live = {s: t for s, t in targets.items() if tokens.get(s)}
    weight = sum(share for share, _ in live.values())
    if not live:
        return {}
    most = min(repeats * tokens[s] / (share / weight) for s, (share, repeats) in live.items())
    size = most if total is None else min(total, most)
    return {s: min(round(share / weight * size), repeats * tokens[s]) for s, (share, repeats) in live.items()}


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds start: the tokens of the source's rows before in key order.  Ranges of the key are summed first, so that no source is one task's."""
    n = rows.count()
    n_buckets = max(1, -(-n // BUCKET_ROWS))
    # Ranges of the key: its distance from the least 64-bit number, divided into equal parts.
    ranged = rows.withColumn("b", F.floor((F.col("key") / 2.0**64 + 0.5) * n_buckets))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    carry = ranged.groupBy("source", "b").agg(F.sum("n_tokens").alias("s")).select("source", "b", F.coalesce(F.sum("s").over(before(W.partitionBy("source").orderBy("b"))), F.lit(0)).alias("carry"))
    within = F.coalesce(F.sum("n_tokens").over(before(W.partitionBy("source", "b").orderBy("key", "nth"))), F.lit(0))
    return ranged.withColumn("within", within).join(carry, ["source", "b"]).withColumn("start", F.col("within") + F.col("carry")).drop("b", "within", "carry")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): (doc_id, source, n_tokens, repeats) of the documents in the mix, and what each source reaches."""
    spark = documents.sparkSession
    wanted = {r["source"]: (r["share"], r["reps"]) for r in targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("reps")).collect()}  # one row per target
    listed = spark.createDataFrame([(s, float(a), int(r)) for s, (a, r) in wanted.items()], "source string, target_share double, max_repeats int")
    known = documents.join(F.broadcast(listed.select("source")), "source")  # a row per target, as stated by the caller
    sized = cut(known.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("key"), F.monotonically_increasing_id().alias("nth")).where("n_tokens > 0"), "sized")
    sums = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}  # a row per target
    budget = budgets(wanted, {s: t for s, (t, _) in sums.items()}, total)
    rows = [(s, wanted[s][0], wanted[s][1], sums.get(s, (0, 0))[0], budget.get(s, 0)) for s in wanted]
    facts = F.broadcast(spark.createDataFrame([(*r, r[4] // r[3] if r[3] else 0, r[4] % r[3] if r[3] else 0) for r in rows], "source string, target_share double, max_repeats int, available long, budget long, epochs long, rest long"))
    open_to = facts.where("rest > 0 and epochs < max_repeats").select("source", "rest")
    taken, left = None, {r["source"]: r["rest"] for r in open_to.collect()}  # a row per target
    pool = sized.select("doc_id", "source", "n_tokens", "key", "nth")
    while left:
        gaps = F.broadcast(spark.createDataFrame(sorted(left.items()), "source string, gap long"))  # a row per target
        pool = cut(pool.join(gaps, "source").where("n_tokens <= gap"), "fitting")
        now = cut(prefixes(pool).where("start + n_tokens <= gap").select("doc_id", "source", "n_tokens", "key", "nth"), "taken")
        got = {r["source"]: r["t"] for r in now.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row per target
        taken = now if taken is None else taken.unionByName(now)
        left = {s: left[s] - t for s, t in got.items() if left[s] > t}
        pool = pool.drop("gap").join(now.select("source", "nth"), ["source", "nth"], "left_anti")
    extra = taken.select("source", "nth", F.lit(1).cast("long").alias("extra")) if taken is not None else spark.createDataFrame([], "source string, nth long, extra long")
    mixed = sized.join(facts.select("source", "epochs"), "source").join(extra, ["source", "nth"], "left").withColumn("repeats", F.col("epochs") + F.coalesce("extra", F.lit(0))).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").alias("items"), F.max("repeats").alias("most_repeats"))
    every = W.partitionBy(F.lit(1))  # over one row per target
    weight = F.col("target_share") / F.sum("target_share").over(every)
    shares = facts.join(reached, "source", "left").fillna(0, ["tokens", "items", "most_repeats"]).select("source", F.round(weight, 6).alias("target_share"), "max_repeats", "available", "budget", "tokens", "items", "most_repeats", F.coalesce(F.round(F.try_divide("tokens", F.sum("tokens").over(every)), 6), F.lit(0.0)).alias("actual_share"))
    return mixed, shares
