"""Logs, batches, wiki pages, retention and review targets."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.plans.cut import cut


def search_log(log: DataFrame, start: datetime, end: datetime, text: str | None = None, **equal: str) -> DataFrame:
    """Rows of a closed time range whose message, exception, source or properties contain the text; newest first."""
    out = log.where(F.col("logged_at").between(F.lit(start), F.lit(end)))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    if text:
        hit = F.lit(False)
        for c in ("message", "exception", "source", "properties"):
            if c in log.columns:
                hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        out = out.where(hit)
    return out.orderBy(F.desc("logged_at"), F.desc("id"))


def diagnostics_order(c: str = "severity") -> list[Column]:
    rank = F.when(F.col(c) == "error", 0).when(F.col(c) == "warning", 1).when(F.col(c) == "info", 2).when(F.col(c) == "suggestion", 3).otherwise(4)
    return [rank, F.col("file_path"), F.coalesce("line", F.lit(0)), F.col("id")]


def pending_batches(batches: DataFrame) -> DataFrame:
    return batches.where("status = 'submitted'").orderBy("submitted_at")


def expired_events(events: DataFrame, runs: DataFrame, before: datetime, most: int) -> DataFrame:
    """The oldest events of runs that ended before a time, at most `most` of them as the clean-up asks."""
    done = runs.where(F.col("status").isin("completed", "failed", "cancelled") & (F.col("ended_at") < F.lit(before))).select("run_id")
    return events.join(done, "run_id", "left_semi").orderBy("run_id", "sequence").limit(most)


def page_paths(pages: DataFrame) -> DataFrame:
    """(id, slug_path, depth) of wiki pages (id, parent_id, slug), as deep as they go; pages on rings, which no root reaches, are left out."""
    level = pages.where("parent_id is null").select("id", F.col("slug").alias("slug_path"), F.lit(0).alias("depth"))
    out, depth = level, 0
    while True:
        depth += 1
        up = level.select(F.col("id").alias("parent_id"), F.col("slug_path").alias("up"))
        level = cut(pages.join(up, "parent_id").select("id", F.concat_ws("/", "up", "slug").alias("slug_path"), F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def inspection_targets(scored: DataFrame, top: int) -> DataFrame:
    """scored: (path, score, reason) from several sources. The greatest sums, with the three strongest reasons."""
    reasons = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("score", "reason")), asc=False), 1, 3), lambda x: x["reason"]), "; ")
    return scored.groupBy("path").agg(F.sum("score").alias("score"), reasons.alias("reasons")).orderBy(F.desc("score"), "path").limit(top)


def support_status(projects: DataFrame, lifecycles: DataFrame, as_of: date) -> DataFrame:
    """projects: (project, framework); lifecycles: (framework, end_of_life). (project, status): supported, out_of_support, mixed or unknown."""
    ended = F.col("end_of_life") < F.lit(as_of)
    j = projects.join(lifecycles, F.lower(projects["framework"]) == F.lower(lifecycles["framework"]), "left").select("project", ended.alias("ended"), F.col("end_of_life").isNotNull().alias("known"))
    g = j.groupBy("project").agg(F.count_if("known").alias("n"), F.count_if(F.col("known") & F.col("ended")).alias("out"))
    return g.select("project", F.when(F.col("n") == 0, "unknown").when(F.col("out") == 0, "supported").when(F.col("out") == F.col("n"), "out_of_support").otherwise("mixed").alias("status"))


def penalised(health: Column, status: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), health - F.when(status == "out_of_support", 2.5).when(status == "mixed", 1.0).otherwise(0.0)))


def newest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def next_run(cron: str, after: datetime) -> datetime:
    """The first minute after a time that a five-field cron expression names (lists, ranges, steps; 7 is Sunday).

    As usual, where both day fields are restricted either of them is enough."""
    from datetime import timedelta

    limits = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
    parts = cron.split()
    if len(parts) != 5:
        raise ValueError("five fields are needed")

    def field(text: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            first, _, last = (f"{low}-{high}" if span == "*" else span).partition("-")
            stop = int(last) if last else high if step else int(first)
            if not low <= int(first) <= stop <= high:
                raise ValueError(f"out of range: {part}")
            out |= set(range(int(first), stop + 1, int(step or 1)))
        return out

    minute, hour, day, month, weekday = (field(p, *r) for p, r in zip(parts, limits))
    weekday = {d % 7 for d in weekday}
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = at + timedelta(days=366 * 8)
    while at < end:
        by_day, by_week = at.day in day, (at.weekday() + 1) % 7 in weekday
        on = by_day and by_week if "*" in (parts[2][:1], parts[4][:1]) else by_day or by_week
        if at.month not in month or not on:
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hour:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minute:
            at += timedelta(minutes=1)
        else:
            return at
    raise ValueError("no such time comes")
