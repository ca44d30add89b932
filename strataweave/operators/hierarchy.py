"""Parent-child rows to full hierarchies, by heavy-path decomposition.

Only nodes with children take part in the rounds; a node without any hangs on its parent and follows from it.  Rounds of
pointer doubling find the subtree sizes (`log2(depth)` rounds, whatever the tree's shape); nodes whose pointer never runs
out lie on a ring or below one.  Sizes label heavy chains: each node continues the chain of its largest child with
children.  A chain is stored in blocks of at most `BLOCK` nodes, so no group grows with the data.  Root and depth are read
off the chains: the start of the topmost one, and the sum of the places at which each hangs on the one above.  A path is the
concatenation of the block segments above a node, and the descendants of a node are one interval of the numbering that
visits a chain's nodes one after another.

Hot parents (one node with a third of all rows as children) meet only partial aggregation, joins that adaptive
execution splits (`T` is unique on the other side), and prefix sums over hash buckets.

Defined cases: rows without an id are no nodes; of several rows of an id the one with the latest version counts,
on a tie the one with the greatest parent; a parent that is no row makes a root; a node that is its own parent
is a ring; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.plans.cut import Cut, Scope

#: Nodes in one stored block of a heavy chain.
BLOCK = 1024
#: Children of one parent are summed in buckets of a hash of their id.
SIBLING_BUCKETS = 4096


def latest_links(rows: DataFrame, id_col: str, parent_col: str, version_col: str | None) -> DataFrame:
    """(id, parent) once for each id."""
    picked = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.struct((F.col(version_col) if version_col else F.lit(0)).alias("v"), F.col(parent_col).cast("long").alias("p")).alias("s"),
    )
    return picked.groupBy("id").agg(F.max("s").alias("s")).select("id", F.col("s.p").alias("parent"))


def _climb(s: Scope, start: DataFrame, label: str, extra: dict[str, Callable[[Column, Column], Column]], sizes: bool = False) -> DataFrame:
    """Pointer doubling over (id, ptr, *extra[, size]).

    ptr is the 2^k-th ancestor, or null once the top is passed; extra maps a column to a function that combines the
    ancestor's value with the row's; sizes adds a row's size to its pointer's each round.  Stops when a round settles
    nothing: rows whose ptr is not null then never will be."""

    def written(df: DataFrame) -> tuple[Cut, int]:
        seen = Observation()
        t = Cut(df.observe(seen, F.count_if(F.col("ptr").isNotNull()).alias("left")), label)
        return t, seen.get["left"]

    state, active = written(start)
    s.tables.append(state)
    while active:
        t = state.df
        anc = t.select(F.col("id").alias("ptr"), F.col("ptr").alias("a_ptr"), *[F.col(c).alias(f"a_{c}") for c in extra])
        moved = t.where("ptr is not null").join(anc, "ptr").select("id", F.col("a_ptr").alias("ptr"), *[f(F.col(f"a_{c}"), F.col(c)).alias(c) for c, f in extra.items()], *(["size"] if sizes else []))
        nxt = t.where("ptr is null").select(*moved.columns).unionByName(moved)
        if sizes:
            add = t.where("ptr is not null").groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("add"))
            nxt = nxt.join(add, "id", "left").withColumn("size", F.col("size") + F.coalesce("add", F.lit(0))).drop("add")
        new, left = written(nxt)
        state.drop()
        s.tables.append(new)
        state = new
        if left == active:
            break
        active = left
    return state.df


def inner_nodes(s: Scope, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inner, sized): the ids with children, and (id, parent, size) of those on no ring and not below one, parent null where it is no row; size counts all below."""
    kids = links.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    # A parent that is a row has a child, so it is one of these.
    inner = s.cut(links.join(kids, "id"), "inner")
    known = inner.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    inner = inner.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), "n")
    inner = s.cut(inner, "known")
    within = inner.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("m"))
    start = inner.join(within, "id", "left").select("id", F.col("parent").alias("ptr"), (1 + F.col("n") - F.coalesce("m", F.lit(0))).alias("size"))
    state = _climb(s, start, "climb", {}, sizes=True)
    return inner.select("id"), s.cut(inner.join(state.where("ptr is null"), "id").select("id", "parent", "size"), "sized")


def heavy_chains(s: Scope, tree: DataFrame) -> DataFrame:
    """(id, parent, size) -> with heavy, head (first node of the heavy chain), pos (place in it) and start (first node of its block)."""
    heavy = tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", (-F.col("id")).alias("n"))).alias("m")).select((-F.col("m.n")).alias("id"), F.lit(True).alias("heavy"))
    tree = s.cut(tree.join(heavy, "id", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))), "heavy")
    start = tree.select("id", F.when(F.col("heavy"), F.col("parent")).alias("ptr"), F.col("id").alias("head"), F.col("heavy").cast("long").alias("pos"))
    state = _climb(s, start, "chain", {"head": lambda a, _: a, "pos": lambda a, b: a + b})
    chained = s.cut(tree.join(state.drop("ptr"), "id"), "chained")
    firsts = chained.where(F.col("pos") % BLOCK == 0).select("head", F.floor(F.col("pos") / BLOCK).alias("block"), F.col("id").alias("start"))
    return s.cut(chained.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(firsts, ["head", "block"]).drop("block"), "blocks")


def light_offsets(light: DataFrame, heavy: DataFrame) -> DataFrame:
    """(id, off): how far a light child is numbered after its parent: past the heavy subtree and earlier light siblings.

    Prefix sums in two levels, over hash buckets of a parent's light children."""
    light = light.select("id", "parent", "size", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS)).alias("b"))
    within = light.withColumn("before", F.sum("size").over(W.partitionBy("parent", "b").orderBy("id").rowsBetween(W.unboundedPreceding, -1)))
    sums = light.groupBy("parent", "b").agg(F.sum("size").alias("s"))
    carry = sums.select("parent", "b", F.sum("s").over(W.partitionBy("parent").orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    big = heavy.select("parent", F.col("size").alias("big"))
    return within.join(carry, ["parent", "b"]).join(big, "parent", "left").select("id", (1 + F.coalesce("big", F.lit(0)) + F.coalesce("before", F.lit(0)) + F.coalesce("carry", F.lit(0))).alias("off"))


def _tops(s: Scope, chained: DataFrame, extra: dict[str, tuple[Column, Column, Callable]], hung: DataFrame | None = None) -> DataFrame:
    """(start, top, *extra) of every block of a chain: the first block above all, and what is combined on the way.

    extra: the value of a block that hangs on nothing, of one that hangs (from columns at_up and of `hung`), and how they combine."""
    firsts = chained.where(F.col("pos") % BLOCK == 0).select("id", "parent")
    up = chained.select(F.col("id").alias("parent"), F.col("start").alias("ptr"), (F.col("pos") % BLOCK).alias("at_up"))
    tops = firsts.join(up, "parent", "left")
    if hung is not None:
        tops = tops.join(hung, "id", "left")
    start = tops.select("id", "ptr", F.col("id").alias("top"), *[F.when(F.col("ptr").isNull(), alone).otherwise(hangs).alias(c) for c, (alone, hangs, _) in extra.items()])
    state = _climb(s, start, "above", {"top": lambda a, _: a} | {c: f for c, (_, _, f) in extra.items()})
    return state.drop("ptr").withColumnRenamed("id", "start")


def _depths() -> dict[str, tuple[Column, Column, Callable]]:
    return {"hops": (F.lit(0).cast("long"), F.col("at_up") + 1, lambda a, b: a + b)}


def roots(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_node_id", version_col: str | None = "indexed_at") -> DataFrame:
    """(id, root_id, depth) of every node, read off the heavy chains; -1 on or below a ring."""
    with Scope() as s:
        links = s.cut(latest_links(rows, id_col, parent_col, version_col), "links")
        parents, sized = inner_nodes(s, links)
        chained = heavy_chains(s, sized)
        tops = _tops(s, chained, _depths())
        placed = chained.join(tops, "start").select("id", F.col("top").alias("root_id"), (F.col("hops") + F.col("pos") % BLOCK).alias("depth"))
        return s.keep(_hung(links, parents, placed).select("id", "root_id", "depth"), "roots")


def _hung(links: DataFrame, parents: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, parent, root_id, depth, inner) of every node: `placed` ones have theirs, others follow from their parent, and who has neither is below a ring."""
    own = placed.select("id", F.col("root_id").alias("r"), F.col("depth").alias("d"))
    up = placed.select(F.col("id").alias("parent"), F.col("root_id").alias("ur"), F.col("depth").alias("ud"))
    ids = links.join(own, "id", "left")
    state = parents.select(F.col("id").alias("parent"), F.lit(True).alias("row")).join(up, "parent", "left")
    j = ids.join(state, "parent", "left")
    alone = F.col("parent").isNull() | F.col("row").isNull()
    root = F.coalesce("r", F.when(alone, F.col("id")).otherwise(F.col("ur")), F.lit(-1))
    depth = F.coalesce("d", F.when(alone, F.lit(0)).otherwise(F.col("ud") + 1), F.lit(-1))
    return j.select("id", F.when(~alone, F.col("parent")).alias("parent"), root.cast("long").alias("root_id"), depth.cast("int").alias("depth"), F.col("r").isNotNull().alias("inner"))


def hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_node_id", version_col: str | None = "indexed_at", with_paths: bool = True) -> DataFrame:
    """(id, parent, root_id, depth, head, pos, n_descendants, first, last[, path]) of every node.

    The descendants of a node are the nodes of its root whose `first` lies in (first, last].  path lists the ids from
    the root to the node.  A node without children is a chain of its own.  On or below a ring root_id and depth are -1 and the rest is null."""
    with Scope() as s:
        links = s.cut(latest_links(rows, id_col, parent_col, version_col), "links")
        parents, sized = inner_nodes(s, links)
        chained = heavy_chains(s, sized)
        seg = s.cut(chained.select("id", "start", *([F.collect_list("id").over(W.partitionBy("start").orderBy("pos")).alias("seg")] if with_paths else [])), "segments")
        lone = links.join(chained.select("id"), "id", "left_anti").where("parent is not null").select("id", "parent", F.lit(1).cast("long").alias("size"))
        off = s.cut(light_offsets(chained.where("not heavy and parent is not null").select("id", "parent", "size").unionByName(lone), chained.where("heavy")), "offsets")
        hung = off if not with_paths else off.join(chained.select("id", F.col("parent").alias("p")), "id", "right").join(seg.select(F.col("id").alias("p"), "seg"), "p", "left").drop("p")
        # A light head is numbered `off` after its parent; a later block of the same chain one after it.
        extra = _depths() | {"num": (F.lit(0).cast("long"), F.col("at_up") + F.coalesce("off", F.lit(1)), lambda a, b: a + b)}
        if with_paths:
            extra |= {"pre": (F.array().cast("array<bigint>"), F.col("seg"), lambda a, b: F.concat(a, b))}
        tops = _tops(s, chained, extra, hung)
        at = F.col("pos") % BLOCK
        inner = chained.join(tops, "start").select("id", F.col("top").alias("root_id"), (F.col("hops") + at).alias("depth"), "head", "pos", "size", (F.col("num") + at).alias("num"), *(["pre"] if with_paths else []))
        if with_paths:
            inner = inner.join(seg.select("id", "seg"), "id").withColumn("path", F.concat("pre", "seg")).drop("pre", "seg")
        inner = s.cut(inner, "inner")
        every = _hung(links, parents, inner)
        own = inner.select("id", "head", "pos", "size", "num", *(["path"] if with_paths else []))
        up = inner.select(F.col("id").alias("parent"), F.col("num").alias("up"), *([F.col("path").alias("up_path")] if with_paths else []))
        j = every.join(own, "id", "left").join(off, "id", "left").join(up, "parent", "left")
        on_tree, first = F.col("depth") >= 0, F.when(F.col("inner"), F.col("num")).when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("up") + F.col("off"))
        size = F.coalesce("size", F.lit(1))
        path = F.when(F.col("inner"), F.col("path")).otherwise(F.concat(F.coalesce("up_path", F.array().cast("array<bigint>")), F.array("id"))) if with_paths else None
        return s.keep(j.select(
            "id", "parent", "root_id", "depth", F.when(on_tree, F.coalesce("head", "id")).alias("head"), F.when(on_tree, F.coalesce("pos", F.lit(0))).cast("long").alias("pos"),
            F.when(on_tree, size - 1).cast("long").alias("n_descendants"), F.when(on_tree, first).cast("long").alias("first"), F.when(on_tree, first + size - 1).cast("long").alias("last"),
            *([F.when(on_tree, path).alias("path")] if with_paths else []),
        ), "hierarchy")


def descendants(labels: DataFrame, of: DataFrame) -> DataFrame:
    """(id, descendant) for a stated set of node ids: an equi-join on the root, an interval on the numbering."""
    asked = of.select("id").distinct().join(labels.where("depth >= 0"), "id").select("id", "root_id", "first", "last")
    every = labels.where("depth >= 0").select("root_id", F.col("first").alias("n"), F.col("id").alias("descendant"))
    return asked.join(every, "root_id").where("n > first and n <= last").select("id", "descendant")


