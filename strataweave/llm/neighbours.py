"""Most similar vectors for every vector, with vantage-point trees per shard.

Vectors are scaled to length one and exact copies (same direction) become one class, of which a neighbour list can
need only its `K + 1` smallest ids.  Classes are spread over shards by hash; every pair of shards is one task: it
builds a vantage-point tree over one shard, runs the other's vectors through it in batches, and keeps for the
vectors of both sides their best `K + 1` so far.  A branch is left out for a query when the triangle inequality puts it
farther away than `factor` times the query's current radius (or that of any vector in the branch which still
gathers its own).  With factor 1 the search is exact; smaller factors leave out more and lose a little (the README has measured recall).
Leaves are compared as blocks of a matrix product.

No task sees more than two shards, nothing is collected, and lists are cut to K + 1 where they are found, so a dense
cluster of any size gives each vector K + 1 candidates per task.  Shard pairs copy each vector once per shard.

Defined cases: an entity counts with its latest updated_at (on a tie the greatest text); only arrays of exactly DIMS
finite numbers, not all zero, take part; scores are rounded to 10 places before ranking, equal ones rank by smaller
id; rows without id take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.plans.cut import cut

DIMS, K, MIN_COSINE = 64, 10, 0.85
#: Vectors of one shard, and points of one leaf.
SHARD, LEAF = 50_000, 256
CHUNK = 2048
#: Share of the query radius that the triangle inequality must leave; 1 is exact, less leaves out more.
FACTOR = 0.3
#: Places to which scores are rounded, and what a place in the order of ids weighs below them.
PLACES, STEP = 10, 4e-16


def parse_vector(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """The unit vector, or None if the text is no array of `dims` finite numbers, or all zero."""
    if not text:
        return None
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(v, list) or len(v) != dims or any(type(x) not in (int, float) for x in v):
        return None
    try:
        a = np.array(v, dtype=np.float64)
    except OverflowError:
        return None
    most = np.abs(a).max()
    if not math.isfinite(most) or most == 0:
        return None
    a = a / most
    return a / math.sqrt(float(a @ a))


def chord(cosine: np.ndarray | float) -> np.ndarray:
    """Euclidean distance of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.asarray(cosine)))


class Tree:
    """Vantage-point tree over unit vectors: nodes are (low, high, vantage point or None, radius, inside, outside)."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x, self.order, self.nodes = x, np.arange(len(x)), []
        rng = np.random.default_rng(seed)
        todo = [(0, len(x), None, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][4 + side] = at
            own = self.order[lo:hi]
            if hi - lo > LEAF:
                vp = x[own[rng.integers(len(own))]]
                d = chord(x[own] @ vp)
                radius = float(np.median(d))
                inside = d <= radius
                if 0 < inside.sum() < len(own):
                    self.order[lo:hi] = np.concatenate([own[inside], own[~inside]])
                    mid = lo + int(inside.sum())
                    self.nodes.append([lo, hi, vp, radius, None, None])
                    todo += [(mid, hi, at, 1), (lo, mid, at, 0)]
                    continue
            self.nodes.append([lo, hi, None, 0.0, None, None])
        self.sorted = x[self.order]


class Best:
    """The k best so far of each of n vectors, by score and then by place."""

    def __init__(self, n: int, k: int, least: float):
        self.key = np.full((n, k), least - 1e-11)
        self.who = np.full((n, k), -1, dtype=np.int64)
        self.least = self.key[:, 0].copy()

    def offer(self, rows: np.ndarray, scores: np.ndarray, who: np.ndarray) -> None:
        """scores: a line of scores against `who` for each of `rows`."""
        key = np.concatenate([self.key[rows], np.round(scores, PLACES) - who * STEP], axis=1)
        names = np.concatenate([self.who[rows], np.broadcast_to(who, scores.shape)], axis=1)
        k = self.key.shape[1]
        top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        self.key[rows] = np.take_along_axis(key, top, 1)
        self.who[rows] = np.take_along_axis(names, top, 1)
        self.least[rows] = self.key[rows].min(axis=1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, j = np.nonzero(self.who >= 0)
        return a, self.who[a, j], self.key[a, j] + self.who[a, j] * STEP


def search(points: np.ndarray, queries: np.ndarray, k: int, least: float, factor: float = 1.0, same: bool = False, both: bool = False) -> tuple[Best, Best | None]:
    """Best points of every query; with `both`, best queries of every point too; `same`: a vector is not its own neighbour."""
    tree, mine = Tree(points), Best(len(queries), k, least)
    theirs = Best(len(points), k, least) if both else None
    todo = [(0, np.arange(len(queries)))] if len(points) and len(queries) else []
    while todo:
        at, active = todo.pop()
        lo, hi, vp, radius, inside, outside = tree.nodes[at]
        if vp is not None:
            d = chord(queries[active] @ vp)
            reach = chord(np.minimum(mine.least[active], theirs.least[tree.order[lo:hi]].min()) if both else mine.least[active]) * factor + 1e-9
            for child, keep in ((outside, radius - d <= reach), (inside, d - radius <= reach)):
                if keep.any():
                    todo.append((child, active[keep]))
            continue
        block, names = tree.sorted[lo:hi], tree.order[lo:hi]
        for c in range(0, len(active), CHUNK):
            q = active[c : c + CHUNK]
            s = queries[q] @ block.T
            if same:
                s[names[None, :] == q[:, None]] = -2.0
            line = np.nonzero((s >= mine.least[q][:, None]).any(axis=1))[0]
            if len(line):
                mine.offer(q[line], s[line], names)
            if both:
                line = np.nonzero((s >= theirs.least[names][None, :]).any(axis=0))[0]
                if len(line):
                    theirs.offer(names[line], s[:, line].T, q)
    return mine, theirs


def vectors(entities: DataFrame, id_col: str = "id", text_col: str = "embedding_json", version_col: str = "updated_at") -> DataFrame:
    """(id, vec) of every usable entity; vec is the unit vector as bytes of doubles."""
    rows = entities.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.struct(F.col(version_col).alias("v"), F.col(text_col).alias("t"))).alias("m")).select("id", "m.t")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_vector(t) for t in b.column(1).to_pylist()]
            keep = [i for i, v in enumerate(got) if v is not None]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([got[i].tobytes() for i in keep], pa.binary()), pa.array([np.round(got[i], 12).tobytes() for i in keep], pa.binary())], ["id", "vec", "direction"])

    return rows.mapInArrow(parse, "id long, vec binary, direction binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), -1) if data else np.zeros((0, DIMS))


def _first_ids(members: DataFrame, most: int) -> DataFrame:
    """(cls, id): the smallest `most` ids of every class; a class of any size is cut down in parts first."""
    part = W.partitionBy("cls", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = members.select("cls", "id", F.row_number().over(part).alias("r")).where(F.col("r") <= most)
    return few.select("cls", "id", F.row_number().over(W.partitionBy("cls").orderBy("id")).alias("r")).where(F.col("r") <= most).drop("r")


def _lists(hits: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """hits: (a, b, s) between classes, from several tasks -> (a, id, s): the best k + 1 ids of each class a, its own among them."""
    near = hits.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("n"), F.col("b").alias("b")))), 1, k + 1).alias("l"))
    flat = near.select("a", F.explode("l").alias("x")).select("a", F.col("x.b").alias("cls"), (-F.col("x.n")).alias("s"))
    ids = flat.join(_first_ids(members, k + 1), "cls").select("a", "id", "s")
    best = ids.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("n"), F.col("id").alias("id")))), 1, k + 1).alias("l"))
    return best.select("a", F.explode("l").alias("x")).select("a", F.col("x.id").alias("id"), (-F.col("x.n")).alias("s"))


def neighbours(entities: DataFrame, k: int = K, least: float = MIN_COSINE, factor: float = FACTOR, asked: str | None = None) -> DataFrame:
    """(id_a, id_b, score, rank): for each entity its k most similar with at least that cosine.

    asked: a condition on `id`; only those entities are queries (against all), each shard a task for all of them."""
    parsed = cut(vectors(entities), "vectors")
    classes = cut(parsed.groupBy("direction").agg(F.min("id").alias("cls"), F.min_by("vec", "id").alias("vec")), "classes")
    members = cut(parsed.select("id", "direction").join(classes.select("direction", "cls"), "direction").select("cls", "id"), "members")
    n = classes.count()
    shards = max(1, -(-n // SHARD), min(4, n // 5000))
    shard = F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    one = asked is not None
    if one:
        queries = members.where(asked).select("cls").distinct().join(classes, "cls")
        blocks = classes.select(shard.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "cls", "vec").unionByName(queries.select(each.alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), "cls", "vec"))
    else:
        spread = classes.select(shard.alias("s"), "cls", "vec").withColumn("t", each)
        blocks = spread.select(F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), (F.col("s") > F.col("t")).cast("int").alias("side"), "cls", "vec")

    def block(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        side = t.column("side").to_numpy()
        names, x = t.column("cls").to_numpy(), _matrix(t.column("vec"))
        pn, qn, p, q = names[side == 0], names[side == 1], x[side == 0], x[side == 1]
        out = []
        if one:
            mine, _ = search(p, q, k + 1, least, factor)
            a, b, s = mine.rows()
            out.append((qn[a], pn[b], s))
        elif key[0].as_py() == key[1].as_py():
            mine, _ = search(p, p, k + 1, least, factor, same=True)
            a, b, s = mine.rows()
            out.append((pn[a], pn[b], s))
        else:
            mine, theirs = search(p, q, k + 1, least, factor, both=True)
            a, b, s = mine.rows()
            out.append((qn[a], pn[b], s))
            a, b, s = theirs.rows()
            out.append((pn[a], qn[b], s))
        a, b, s = (np.concatenate(c) for c in zip(*out))
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "s": np.round(s, PLACES)})

    tasks = 2 * (shards if one else shards * (shards + 1) // 2)
    hits = blocks.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(block, "a long, b long, s double").where("a <> b")
    own = (queries if one else classes).select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("s"))
    lists = _lists(hits.unionByName(own), members, k)
    who = members.where(asked) if one else members
    pairs = lists.join(who.select(F.col("cls").alias("a"), F.col("id").alias("id_a")), "a").where("id <> id_a")
    ranked = pairs.select("id_a", F.col("id").alias("id_b"), F.col("s").alias("score"), F.row_number().over(W.partitionBy("id_a").orderBy(F.desc("s"), "id")).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def similar_pairs(entities: DataFrame, k: int = K, least: float = MIN_COSINE, factor: float = FACTOR) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of which at least one is among the other's k most similar."""
    near = neighbours(entities, k, least, factor)
    return near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
