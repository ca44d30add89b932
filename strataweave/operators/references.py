"""References to records that do not exist, from signed counts of change deltas.

Creations and deletions of the records of a key are deltas of +1 and -1.  Summed by key and time, and cumulated
along time, they give for each key the steps between which its number of living records is constant.  A reference
is a delta on the reference side; it falls into exactly one step of its key, and is an orphan where the step's
count is zero or the key has no step.  Keys are compared through two independent 64-bit hashes of
(project, name), so 16 bytes instead of long names are shuffled.

The step table has a row or two per record and is unique by (key, from); references of a hot key meet a few steps
each, in a join that adaptive execution can split.  Cumulation runs over the times of one key's records only,
after summing equal times.

The current report needs no history: `key_deltas` gives the signed changes of a period per key, `advance` adds them to a kept
state of one row per living or referred key, and `current_orphans` are the keys with positive references and no existence.
A state advanced period by period equals one made of everything at once.

Defined cases: null and blank references are no case; a reference without a time finds nothing alive, and is
`late` if the key is known; a record without created_at never lives but makes its key known; repeated rows of
a reference's id count once (the latest received counts, then the greatest name); repeated rows of a record's id
count once; an empty record table makes every reference `missing`; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.functions.text import is_blank, project_key

_START, _END = -(2**63), 2**63 - 1


def pair_key(*parts: Column) -> list[Column]:
    """k1, k2: 128 bits of hash over the parts; null parts never match, so they must be handled before."""
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(0x5BD1E995), *reversed(parts)).alias("k2")]


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def existence_steps(records: DataFrame) -> DataFrame:
    """records: (k1, k2, born, gone) once each -> (k1, k2, t_from, t_to, living, ended).

    living counts the records with born <= t < gone for t in [t_from, t_to), ended those with gone <= t."""
    lives = F.col("born").isNotNull() & (F.col("gone").isNull() | (F.col("gone") > F.col("born")))
    delta = lambda t, n, e: F.struct(t.alias("t"), n.cast("long").alias("n"), e.cast("long").alias("e"))
    deltas = records.select("k1", "k2", F.explode(F.array(
        delta(F.lit(_START), F.lit(0), F.lit(0)),
        delta(F.when(lives, F.col("born")), F.lit(1), F.lit(0)),
        delta(F.col("gone"), F.when(lives, -1).otherwise(0), F.lit(1)),
    )).alias("d")).where("d.t is not null")
    summed = deltas.groupBy("k1", "k2", F.col("d.t").alias("t_from")).agg(F.sum("d.n").alias("n"), F.sum("d.e").alias("e"))
    along = W.partitionBy("k1", "k2").orderBy("t_from")
    return summed.select("k1", "k2", "t_from", F.lead("t_from", 1, _END).over(along).alias("t_to"), F.sum("n").over(along).alias("living"), F.sum("e").over(along).alias("ended"))


def orphans(refs: DataFrame, steps: DataFrame) -> DataFrame:
    """refs: (k1, k2, at, ...) -> those without a living record at that time, with reason missing, deleted or late."""
    s = steps.withColumnsRenamed({"k1": "s1", "k2": "s2"})
    at = F.coalesce("at", F.lit(_START))
    joined = refs.join(s, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & (at >= F.col("t_from")) & (at < F.col("t_to")), "left")
    reason = F.when(F.col("s1").isNull(), "missing").when(F.col("ended") > 0, "deleted").otherwise("late")
    return joined.where("living is null or living <= 0").withColumn("reason", reason).drop("s1", "s2", "t_from", "t_to", "living", "ended")


def key_deltas(refs: DataFrame, records: DataFrame, after: int = _START, until: int = _END) -> DataFrame:
    """refs: (k1, k2, at), records: (k1, k2, born, gone), once each -> (k1, k2, references, existence): the signed changes with after < time <= until.

    References and records without a time count from the start; times are in microseconds."""
    lives = F.col("born").isNotNull() & (F.col("gone").isNull() | (F.col("gone") > F.col("born")))
    delta = lambda t, n: F.struct(t.cast("long").alias("t"), n.cast("long").alias("n"))
    made = refs.select("k1", "k2", F.coalesce("at", F.lit(_START + 1)).alias("t"), F.lit(1).cast("long").alias("references"), F.lit(0).cast("long").alias("existence"))
    alive = records.where(lives).select("k1", "k2", F.explode(F.array(delta(F.col("born"), F.lit(1)), delta(F.col("gone"), F.lit(-1)))).alias("d")).where("d.t is not null")
    both = made.unionByName(alive.select("k1", "k2", F.col("d.t").alias("t"), F.lit(0).cast("long").alias("references"), F.col("d.n").alias("existence")))
    return both.where((F.col("t") > after) & (F.col("t") <= until)).groupBy("k1", "k2").agg(F.sum("references").alias("references"), F.sum("existence").alias("existence"))


def advance(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The state (k1, k2, references, existence) after the deltas; keys that are neither referred to nor there leave it."""
    both = deltas if state is None else state.unionByName(deltas)
    return both.groupBy("k1", "k2").agg(F.sum("references").alias("references"), F.sum("existence").alias("existence")).where("references <> 0 or existence <> 0")


def current_orphans(state: DataFrame) -> DataFrame:
    return state.where("references > 0 and existence <= 0")


def node_steps(nodes: DataFrame) -> DataFrame:
    """Steps of (project, qualified name); the versions of a node share its life, so its id counts once."""
    return existence_steps(node_lives(nodes))


def node_lives(nodes: DataFrame) -> DataFrame:
    """(k1, k2, born, gone) of every node id."""
    rows = nodes.where(F.col("qualified_name").isNotNull() & F.col("project").isNotNull()).select("id", *pair_key(project_key(F.col("project")), F.col("qualified_name")), micros(F.col("created_at")).alias("born"), micros(F.col("deleted_at")).alias("gone"))
    return rows.groupBy("id", "k1", "k2").agg(F.min("born").alias("born"), F.max("gone").alias("gone")).drop("id")


def repository_steps(repositories: DataFrame) -> DataFrame:
    return existence_steps(repository_lives(repositories))


def repository_lives(repositories: DataFrame) -> DataFrame:
    rows = repositories.where(~is_blank(F.col("name"))).select(*pair_key(project_key(F.col("name"))), micros(F.col("created_at")).alias("born"), micros(F.col("deleted_at")).alias("gone"))
    return rows.distinct()


def edge_references(edges: DataFrame) -> DataFrame:
    """(ref_table, ref_id, ref_field, k1, k2, at) of both ends of every pending edge."""
    r = edges.select("pending_edge_id", "project", "received_at", "extracted_at", F.explode(F.array(
        F.struct(F.lit("source_qn").alias("f"), F.col("source_qn").alias("q")), F.struct(F.lit("target_qn").alias("f"), F.col("target_qn").alias("q")),
    )).alias("e")).where(~is_blank(F.col("e.q")))
    return r.select(F.lit("pending_edges").alias("ref_table"), F.col("pending_edge_id").alias("ref_id"), F.col("e.f").alias("ref_field"), *pair_key(F.coalesce(project_key(F.col("project")), F.lit("\0")), F.col("e.q")), micros(F.col("extracted_at")).alias("at"), micros(F.col("received_at")).alias("seen"))


def impact_references(impacts: DataFrame) -> DataFrame:
    r = impacts.where(~is_blank(F.col("target_project")))
    return r.select(F.lit("cross_repo_impacts").alias("ref_table"), F.col("impact_id").alias("ref_id"), F.lit("target_project").alias("ref_field"), *pair_key(project_key(F.col("target_project"))), micros(F.col("computed_at")).alias("at"), F.lit(0).cast("long").alias("seen"))


def once(refs: DataFrame) -> DataFrame:
    """Repeated rows of a reference's id and field count once: the latest seen."""
    top = F.max(F.struct("seen", "k1", "k2", "at")).alias("m")
    return refs.groupBy("ref_table", "ref_id", "ref_field").agg(top).select("ref_table", "ref_id", "ref_field", "m.k1", "m.k2", "m.at")


def orphan_references(edges: DataFrame, impacts: DataFrame, nodes: DataFrame, repositories: DataFrame) -> DataFrame:
    """(ref_table, ref_id, ref_field, at, reason) of every orphan reference."""
    found = orphans(once(edge_references(edges)), node_steps(nodes)).unionByName(orphans(once(impact_references(impacts)), repository_steps(repositories)))
    return found.select("ref_table", "ref_id", "ref_field", F.timestamp_micros("at").alias("at"), "reason")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans by table, field, month and reason."""
    return found.groupBy("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("orphans"))
