"""Filling fixed-capacity containers, planned on the histogram of lengths.

Best fit runs over counts: equal lengths are placed together into equally filled containers, so that the plan's
size depends on the capacity alone (at most a few groups per length), not on the number of documents.  The histogram
has at most `capacity` rows and is all that reaches the driver.  Documents then take planned slots by joining on
their rank within their length; ranks are prefix sums over hash buckets, so a length with a third of all documents
is numbered by many tasks.

Only an item larger than a container is split, into full containers and a rest that is placed like any other.

Defined cases: null and empty texts have no tokens and take no container (container_id null); repeated rows are items
of their own; equal lengths take slots in the order of a hash of doc_id; capacities that are null or below 1 are no
containers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.llm.tokens import VOCABULARY, token_count
from strataweave.plans.cut import cut

#: Items that one task numbers, about.
BUCKET_ROWS = 50_000


@dataclass
class Group:
    """`count` containers filled alike: parts lists (length, times) in order, `room` is what is left in each."""

    count: int
    room: int
    parts: tuple[tuple[int, int], ...]


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing over counts of lengths, all of them from 1 to capacity."""
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []  # sorted rooms with open groups
    from bisect import bisect_left, insort

    def put(g: Group) -> None:
        if g.count:
            if g.room not in by_room:
                by_room[g.room] = []
                insort(rooms, g.room)
            by_room[g.room].append(g)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                g = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[i]
            else:
                g = Group(-(-left // (capacity // size)), capacity, ())
            times = g.room // size
            full = min(g.count, left // times)
            put(Group(full, g.room - times * size, (*g.parts, (size, times))))
            left -= full * times
            rest = g.count - full
            if rest and left:
                put(Group(1, g.room - left * size, (*g.parts, (size, left))))
                rest, left = rest - 1, 0
            put(Group(rest, g.room, g.parts))
    return [g for room in sorted(by_room) for g in by_room[room]]


def slots(kind: str, groups: list[Group]) -> list[tuple]:
    """(kind, size, rank_from, rank_to, first container, times, offset): which ranks of a length go where."""
    out, ranks, base = [], {}, 0
    for g in groups:
        offset = 0
        for size, times in g.parts:
            a = ranks.get(size, 0)
            ranks[size] = a + g.count * times
            out.append((kind, size, a, ranks[size], base, times, offset))
            offset += size * times
        base += g.count
    return out


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, start_token, n_tokens, offset): the place of every piece."""
    spark = documents.sparkSession
    kinds = {r[0]: r[1] for r in containers.where("container_kind is not null and capacity_tokens >= 1").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c")).collect()}  # a handful of kinds
    sized = cut(documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("tokens"), F.xxhash64("doc_id", "text").alias("h")), "sized")
    caps = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("cap")) for k, c in kinds.items()]) if kinds else F.array().cast("array<struct<container_kind:string,cap:bigint>>")
    items = sized.withColumn("k", F.explode(caps)).select("doc_id", "h", "tokens", "k.container_kind", "k.cap")
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / F.col("cap")) - 1, F.lit(0)))))
    pieces = pieces.withColumn("start_token", F.col("piece") * F.col("cap")).withColumn("n_tokens", F.least(F.col("cap"), F.col("tokens") - F.col("start_token")))
    counts = pieces.groupBy("container_kind", "n_tokens").agg(F.count("*").alias("n")).collect()  # at most the sum of the capacities
    rows = [s for k, c in kinds.items() for s in slots(k, plan({r["n_tokens"]: r["n"] for r in counts if r["container_kind"] == k and r["n_tokens"] > 0}, c))]
    n_buckets = max(1, -(-sum(r["n"] for r in counts) // BUCKET_ROWS))
    planned = spark.createDataFrame(rows, "container_kind string, n_tokens long, rank_from long, rank_to long, base long, times long, at long")

    real = pieces.where("n_tokens > 0").withColumn("b", F.pmod("h", F.lit(n_buckets)))
    by = ["container_kind", "n_tokens"]
    carry = real.groupBy(*by, "b").agg(F.count("*").alias("n")).select(*by, "b", F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    ranked = real.withColumn("r", F.row_number().over(W.partitionBy(*by, "b").orderBy("h", "doc_id", "piece")) - 1).join(carry, [*by, "b"]).withColumn("rank", F.col("r") + F.col("carry"))
    # The plan's rows are bounded by the capacities, whatever the number of documents.
    placed = ranked.join(F.broadcast(planned), by).where("rank >= rank_from and rank < rank_to")
    k = F.col("rank") - F.col("rank_from")
    out = placed.select("container_kind", (F.col("base") + F.floor(k / F.col("times"))).alias("container_id"), "doc_id", "piece", "start_token", "n_tokens", (F.col("at") + k % F.col("times") * F.col("n_tokens")).alias("offset"))
    none = pieces.where("n_tokens <= 0").select("container_kind", F.lit(None).cast("long").alias("container_id"), "doc_id", "piece", "start_token", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("offset"))
    return out.unionByName(none)


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space that is filled, by kind."""
    caps = containers.groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity_tokens"))
    per = packed.where("container_id is not null").groupBy("container_kind").agg((F.max("container_id") + 1).alias("containers"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return per.join(caps, "container_kind").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
