"""Claims and entities of the memory graph.  Readers take rows of one user: `scoped` comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.operators.retrieval import cosine


def scoped(df: DataFrame, username: str) -> DataFrame:
    return df.where(F.col("username") == username)


def snake_case(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9_\s]", " "), "([a-z])([A-Z])", "$1 $2")
    return F.lower(F.regexp_replace(F.trim(plain), r"\s+", "_"))


def lookup_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{Nd}]+", "_"), "^_+|_+$", "")


def search_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]+", " "))


def _joined(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def claim_key(subject: Column, predicate: Column, obj: Column, value: Column, json: Column, text: Column) -> Column:
    return _joined(subject, predicate, obj, value, json, text)


def fact_key(subject: Column, predicate: Column, obj: Column, value: Column, json: Column) -> Column:
    return _joined(subject, predicate, obj, value, json)


def rebuild_groups(claims: DataFrame) -> DataFrame:
    """claims: (claim_id, fact_group, recorded_at, status) with status and supersedes anew.

    More than one conflicted claim in a group leaves all of them conflicted; else they form a chain whose last is active."""
    group = W.partitionBy("fact_group")
    along = group.orderBy("recorded_at", "claim_id")
    c = claims.withColumns({"conflicts": F.count_if(F.lower("status") == "conflicted").over(group), "prev": F.lag("claim_id").over(along), "next": F.lead("claim_id").over(along)})
    keep = F.col("conflicts") > 1
    return c.select("claim_id", "fact_group", F.when(keep, "conflicted").when(F.col("next").isNull(), "active").otherwise("superseded").alias("status"), F.when(~keep, F.col("prev")).alias("supersedes"))


def group_edges(claims: DataFrame) -> DataFrame:
    """(from_id, to_id, type): supersedes along the chains, conflicts_with between all pairs of a conflicted group, as its definition asks."""
    r = rebuild_groups(claims).join(claims.select("claim_id", "recorded_at"), "claim_id")
    chain = r.where("supersedes is not null").select(F.col("claim_id").alias("from_id"), F.col("supersedes").alias("to_id"), F.lit("supersedes").alias("type"))
    c = r.where("status = 'conflicted'")
    a, b = c.select("fact_group", F.col("claim_id").alias("from_id"), F.col("recorded_at").alias("ta")), c.select("fact_group", F.col("claim_id").alias("to_id"), F.col("recorded_at").alias("tb"))
    later = (F.col("ta") > F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("from_id") > F.col("to_id")))
    return chain.unionByName(a.join(b, "fact_group").where(later).select("from_id", "to_id", F.lit("conflicts_with").alias("type")))


def ingest(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """What each claim of a batch does against the stored claims (claims of one batch do not see each other).

    Rows: (claim_key, fact_group, subject, predicate, at). (claim_key, outcome, other): duplicate of a stored key; else
    supersedes the group's latest earlier claim, or is superseded by a later one; else conflicts with another active
    group of its subject and predicate; else new."""
    b = batch.dropDuplicates(["claim_key"])
    same = stored.select("claim_key", F.lit(True).alias("dup"))
    head = stored.groupBy("fact_group").agg(F.max(F.struct("at", "claim_key")).alias("h"))
    rival = stored.where("status in ('active', 'conflicted')").select("subject", "predicate", F.col("fact_group").alias("other_group"), F.col("claim_key").alias("rival"))
    clash = b.join(rival, ["subject", "predicate"]).where("other_group <> fact_group").groupBy("claim_key").agg(F.min("rival").alias("rival"))
    j = b.join(same, "claim_key", "left").join(head, "fact_group", "left").join(clash, "claim_key", "left")
    outcome = F.when(F.col("dup"), "duplicate").when(F.col("h").isNotNull() & (F.col("at") >= F.col("h.at")), "supersedes").when(F.col("h").isNotNull(), "superseded").when(F.col("rival").isNotNull(), "conflicts").otherwise("new")
    return j.select("claim_key", outcome.alias("outcome"), F.when(F.col("dup"), F.col("claim_key")).when(F.col("h").isNotNull(), F.col("h.claim_key")).otherwise(F.col("rival")).alias("other"))


def search_claims(claims: DataFrame, query: str, limit: int, vector: list[float] | None = None) -> DataFrame:
    """Exact id 100, text 60 (the latest `limit` of them), vector 40 + cosine; the best of each claim, then the latest."""
    live = claims.where("status <> 'superseded'")
    like = f"%{query.strip().lower()}%"
    hit = None
    for c in ("external_id", "normalized_text", "predicate", "value_text"):
        hit = F.lower(c).like(like) if hit is None else hit | F.lower(c).like(like)
    exact = live.where(F.col("external_id") == lookup_key(F.lit(query))).select("claim_id", "recorded_at", F.lit(100.0).alias("score"), F.lit("exact").alias("kind"))
    text = live.where(hit).orderBy(F.desc("recorded_at"), "claim_id").limit(limit).select("claim_id", "recorded_at", F.lit(60.0).alias("score"), F.lit("lexical").alias("kind"))
    found = exact.unionByName(text)
    if vector is not None:
        v = live.where("embedding is not null").select("claim_id", "recorded_at", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])).alias("c"))
        found = found.unionByName(v.where("c > 0").select("claim_id", "recorded_at", (F.col("c") + 40).alias("score"), F.lit("vector").alias("kind")))
    best = found.groupBy("claim_id", "recorded_at").agg(F.max(F.struct("score", "kind")).alias("m"))
    return best.select("claim_id", "recorded_at", "m.score", "m.kind").orderBy(F.desc("score"), F.desc("recorded_at"), "claim_id").limit(limit)


def entity_seeds(entities: DataFrame, query: str, limit: int, vector: list[float] | None = None) -> DataFrame:
    """Exact key 100, text hits 60 less their place, with a `vector` the nearest `limit` embeddings 40 + 20 * cosine; pruned to 80 and more where one is exact, else to 50 and more."""
    words = [w for w in dict.fromkeys(query.lower().split()) if w]
    text = search_text(F.concat_ws(" ", "external_id", "label", "canonical_name", "summary"))
    hit = F.lit(True)
    for w in words:
        hit = hit & text.contains(w)
    e = entities.select("id", "external_id", "label", hit.alias("hit"), (F.col("external_id") == lookup_key(F.lit(query))).alias("exact"))
    placed = e.where("hit and not exact").orderBy("label", "id").limit(limit).withColumn("i", F.row_number().over(W.orderBy("label", "id")) - 1)  # `limit` rows
    seeds = e.where("exact").select("id", F.lit(100).alias("score")).unionByName(placed.select("id", (60 - F.col("i")).alias("score")))
    if vector is not None:
        near = entities.where("embedding is not null").select("id", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])).alias("c"))
        seeds = seeds.unionByName(near.where("c > 0").orderBy(F.desc("c"), "id").limit(limit).select("id", (40 + 20 * F.col("c")).alias("score")))
    best = seeds.groupBy("id").agg(F.max("score").alias("score"))
    top = best.agg(F.max("score")).first()[0] or 0  # one number
    return best.where(F.col("score") >= (80 if top >= 100 else 50))


def merge_summary(old: Column, new: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(blank(old), new).when(blank(new), old).when(F.instr(F.lower(old), F.lower(new)) > 0, old).when(F.length(old) > 1000, new).otherwise(F.concat(old, F.lit(" | "), new))


def receipt_diagnostics(receipts: DataFrame, cutoff: Column) -> DataFrame:
    """All counts of the write receipts in one pass."""
    s, begun = F.col("status"), F.coalesce("processing_started_at", "updated_at")
    return receipts.agg(
        F.count_if(s == "queued").alias("queued"), F.count_if((s == "queued") & (F.col("submitted_at") < cutoff)).alias("stale_queued"), F.count_if(s == "processing").alias("processing"),
        F.count_if(s.isin("queued", "processing") & (F.col("retries") > 1)).alias("retrying"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"),
        F.count_if((s == "failed") & F.col("processing_started_at").isNull()).alias("submission_failures"), F.count_if((s == "failed") & F.col("processing_started_at").isNotNull()).alias("processing_failures"),
        F.count_if((s == "processing") & (begun < cutoff)).alias("stale_processing"), F.min(F.when(s == "queued", F.col("submitted_at"))).alias("oldest_queued"), F.min(F.when(s == "processing", begun)).alias("oldest_processing"),
    )


def cleanup_plan(claims: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """What deleting the claims of `doomed` (claim_id) entails: claims, groups to rebuild and entities that nothing refers to any more.

    claims: (claim_id, fact_group, subject, ...)."""
    dead = claims.join(doomed.select("claim_id").distinct(), "claim_id", "left_semi")
    kept = claims.join(doomed.select("claim_id").distinct(), "claim_id", "left_anti")
    groups = dead.select("fact_group").distinct()
    return {"claims": dead, "rebuild": kept.join(groups, "fact_group", "left_semi"), "entities": dead.select("subject").distinct().join(kept.select("subject").distinct(), "subject", "left_anti")}


def active_claims(claims: DataFrame) -> DataFrame:
    return claims.where(F.lower("status").isin("active", "conflicted"))


def latest_run(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order column of each key."""
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("m")).select(*keys, "m.*")


def resolve_entities(stored: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """stored: (external_id, label, type, canonical_name, aliases, summary, source); incoming: the same with `n`, the order in its batch, and a raw id as external_id.

    An incoming entity is the stored one with its normalised id: stored values stay, and only what is missing there is taken over (source always where
    given); otherwise it is made anew.  Of several in one batch the first counts.  Aliases are trimmed, not blank, and once whatever the case."""
    first = W.partitionBy("external_id").orderBy("n")
    new = incoming.withColumn("external_id", snake_case(F.col("external_id"))).withColumn("r", F.row_number().over(first)).where("r = 1")
    trimmed = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(trimmed, lambda x: F.lower(x))
    aliases = F.filter(trimmed, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    new = new.select("external_id", F.col("label").alias("l"), F.col("type").alias("t"), F.trim("canonical_name").alias("c"), aliases.alias("a"), F.col("summary").alias("s"), F.col("source").alias("o"), F.lit(True).alias("is_new"))
    j = stored.withColumn("is_old", F.lit(True)).join(new, "external_id", "full")
    old, none = F.col("is_old").isNotNull(), F.array().cast("array<string>")
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return j.select(
        "external_id", F.when(old, F.col("label")).otherwise(F.col("l")).alias("label"), F.when(old, F.col("type")).otherwise(F.col("t")).alias("type"), F.coalesce("canonical_name", "c").alias("canonical_name"),
        F.when(F.size(F.coalesce("aliases", none)) > 0, F.col("aliases")).otherwise(F.coalesce("a", none)).alias("aliases"),
        F.when(old & ~empty("summary"), F.col("summary")).when(empty("s"), F.coalesce("summary", F.lit(""))).otherwise(F.col("s")).alias("summary"),
        F.when(F.col("is_new").isNull(), F.col("source")).otherwise(F.coalesce("o", "source", F.lit(source))).alias("source"),
    )


def referred_entities(references: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """Entities to make for references (column reference) that no known external_id stands for: a concept labelled by its words."""
    ids = references.select(snake_case(F.col("reference")).alias("external_id")).distinct()
    missing = ids.join(known.select("external_id").distinct(), "external_id", "left_anti")
    return missing.select("external_id", F.initcap(F.replace("external_id", F.lit("_"), F.lit(" "))).alias("label"), F.lit("concept").alias("type"), F.lit("").alias("summary"), F.lit(source).alias("source"))
