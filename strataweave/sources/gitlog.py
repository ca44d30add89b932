"""`git log --numstat` as a source.  Lines: (line_no, value): a header `hash\\0author\\0date\\0subject`, then tab-separated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Lines of one task's window; headers are carried across blocks.
BLOCK = 100_000


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, touches).  The header is filled forward inside blocks of lines; a block without an own header takes the last of
    the blocks before, from one row per block."""
    head = F.when(F.instr("value", "\0") > 0, F.split("value", "\0"))
    rows = lines.select("line_no", "value", head.alias("h"), F.floor(F.col("line_no") / BLOCK).alias("b"))
    last = rows.groupBy("b").agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col("line_no"))).alias("last"))
    carry = last.select("b", F.last("last", ignorenulls=True).over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    within = F.last("h", ignorenulls=True).over(W.partitionBy("b").orderBy("line_no"))
    full = rows.withColumn("own", within).join(carry, "b").withColumn("c", F.coalesce("own", "carry"))
    commits = rows.where("h is not null").select(F.col("h")[0].alias("commit_id"), F.col("h")[1].alias("author"), F.to_timestamp(F.col("h")[2]).alias("author_date"), F.col("h")[3].alias("message"))
    cells = F.split("value", "\t")
    number = lambda i: F.coalesce(cells[i].try_cast("bigint"), F.lit(0))
    touches = full.where(F.col("h").isNull() & (F.size(cells) == 3) & F.col("c").isNotNull()).select(F.col("c")[0].alias("commit_id"), renamed(cells[2]).alias("path"), number(0).alias("added"), number(1).alias("removed"), F.col("line_no").alias("seq"))
    return commits, touches


def renamed(path):
    """`a/{b => c}/d` and `x => y` stand for the new name."""
    braces = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(braces, "^.* => ", ""), "//", "/")
