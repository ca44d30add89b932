"""Git history to file metrics and health.  Commits: (commit_id, author, author_date, message); touches: (commit_id, path, added, removed, seq)."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.operators import cochange
from strataweave.plans.cut import Scope, cut

# Path segments of tests, words of repairs and of emergencies, extensions of sources.
TEST_SEGMENTS = ["test", "tests", "spec", "specs", "testing", ".tests", ".test"]
BUG_FIX = r"(?i)\b(fix|bug|broken|defect|patch)\b"
FIREFIGHTING = r"(?i)\b(hotfix|incident|urgent|emergency|rollback|revert)\b"
SOURCE_EXTENSIONS = r"(?i)\.(cs|ts|tsx|js|jsx|cfm|cfc|sql|vue|py|java)$"
#: Days of the longest window of a path's figures.
LONGEST = 730
#: Slices, at most, by commit and then by path, in which touches and figures are made, and the commits of one, at least: the shuffles of one are deleted before the next begins.
SLICES, LEAST = 4, 500_000


def age_days(as_of: datetime, at: Column) -> Column:
    return (F.lit(as_of).cast("timestamp").cast("double") - at.cast("double")) / 86400


def within(commits: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """The commits of the window; figures of no longer windows are the same over these and their touches."""
    return commits.where(age_days(as_of, F.col("author_date")) <= days)


def source_touches(commits: DataFrame, touches: DataFrame) -> DataFrame:
    """Source files only, the last touch of a path within a commit, with the commit's columns and `weight`.

    weight is the path's share of the commit's changed lines, or an equal share where nothing changed."""
    # One shuffle by commit serves all steps.
    last = touches.where(F.col("path").rlike(SOURCE_EXTENSIONS)).repartition("commit_id").groupBy("commit_id", F.lower("path").alias("k")).agg(F.max_by(F.struct("path", "added", "removed"), F.struct("seq", "added", "removed")).alias("m")).select("commit_id", "m.*")
    lines, whole = F.greatest("added", F.lit(0)) + F.greatest("removed", F.lit(0)), W.partitionBy("commit_id")
    shared = last.withColumns({"total": F.sum(lines).over(whole), "files": F.count("*").over(whole)}).withColumn("weight", F.when(F.col("total") > 0, lines / F.col("total")).otherwise(1 / F.col("files")))
    return shared.select("commit_id", "path", "added", "removed", "weight").join(commits, "commit_id")


def churn(st: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Changes, lines, authors (whatever the case) and last change of each path within the window."""
    recent = st.where(age_days(as_of, F.col("author_date")) <= days)
    return recent.groupBy("path").agg(F.count("*").alias("changes"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"), F.countDistinct(F.lower("author")).alias("authors"), F.max("author_date").alias("last_change"))


def weighted_churn(st: DataFrame, as_of: datetime) -> DataFrame:
    """Weighted touches within 30, 90 and 365 days, and the repairs among them, all in one aggregation."""
    age, w, fix = age_days(as_of, F.col("author_date")), F.col("weight"), F.col("message").rlike(BUG_FIX)
    part = lambda cond: F.round(F.sum(F.when(cond, w).otherwise(0.0)), 6)
    out = st.where(age <= 365).groupBy("path").agg(part(age <= 30).alias("churn30d"), part(age <= 90).alias("churn90d"), part(F.lit(True)).alias("churn365d"), part(fix).alias("fixes365d"))
    return out


def day_sets(st: DataFrame, as_of: datetime, days: int = 180, cap: int | None = None) -> DataFrame:
    """(path, n, days): on how many days each path changed, and on which of them it pairs up; with a `cap`, of a day only its first `cap` paths by name do."""
    daily, day = st.where(age_days(as_of, F.col("author_date")) <= days).select(F.unix_date(F.to_date("author_date")).alias("day"), "path"), F.col("day")
    if cap is not None:
        daily, day = daily.distinct().withColumn("r", F.row_number().over(W.partitionBy("day").orderBy("path"))), F.when(F.col("r") <= cap, F.col("day"))
    return daily.groupBy("path").agg(F.size(F.collect_set("day")).alias("n"), F.array_sort(F.collect_set(day)).alias("days"))


def cochange_pairs(st: DataFrame, as_of: datetime, days: int = 180, cap: int | None = None) -> DataFrame:
    """(a, b, days): on how many days both paths changed; `cap` as in day_sets."""
    return cochange.pairs(cut(day_sets(st, as_of, days, cap), "days"))


def coupling(st: DataFrame, as_of: datetime, days: int = 180, cap: int | None = None) -> DataFrame:
    """(path, strength, partners): the most frequent pair over the days of the path, at most 1; `cap` as in day_sets."""
    return coupled(cut(day_sets(st, as_of, days, cap), "days"))


def coupled(sets: DataFrame) -> DataFrame:
    """sets as day_sets gives them, written -> (path, strength, partners)."""
    met = cochange.partners(sets)
    return met.select("path", F.round(F.least(F.col("most") / F.col("n"), F.lit(1.0)), 6).alias("strength"), "partners")


def knowledge(st: DataFrame, as_of: datetime, days: int = LONGEST, top: int = 5) -> DataFrame:
    """(path, truck_factor, top_authors): fewest authors with more than half of the commits; the busiest five."""
    per = st.where(age_days(as_of, F.col("author_date")) <= days).groupBy("path", "author").agg(F.countDistinct("commit_id").alias("n"))
    return ranked(per, "n").groupBy("path").agg(*owners(top))


def ranked(per: DataFrame, n: str) -> DataFrame:
    """per: rows of (path, author), with `r`, the rank by commits, `before`, those of the busier authors, and `total`."""
    down, whole = W.partitionBy("path").orderBy(F.desc(n), "author"), W.partitionBy("path")
    return per.withColumns({"before": F.coalesce(F.sum(n).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum(n).over(whole), "r": F.row_number().over(down)})


def owners(top: int) -> list[Column]:
    """Of the ranked authors of a path: truck_factor and top_authors."""
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "author"))))
    return [F.count_if(F.col("before") <= 0.5 * F.col("total")).alias("truck_factor"), F.array_join(F.transform(first, lambda x: x["author"]), ",").alias("top_authors")]


def monthly_points(st: DataFrame, as_of: datetime, months: int = 12) -> DataFrame:
    """(month, commits) of the trailing months, zero-filled."""
    counted = st.select("commit_id", F.date_trunc("month", "author_date").alias("month")).distinct().groupBy("month").agg(F.count("*").alias("n"))
    end = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    spine = st.sparkSession.range(months).select(F.add_months(end.cast("date"), -F.col("id").cast("int")).cast("timestamp").alias("month"))
    return spine.join(counted, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("commits"))


def vitality(points: DataFrame) -> DataFrame:
    """One row over the trailing months: velocities, change, dormant months, longest inactive streak, recent silence.

    Islands of silent months are numbered by the count of active months before them."""
    along = W.partitionBy(F.lit(1)).orderBy("month")  # over a dozen months
    p = points.withColumns({"i": F.row_number().over(along), "active": (F.col("commits") > 0).cast("int")})
    p = p.withColumn("island", F.sum("active").over(along))
    p = p.withColumn("silent", F.count_if(F.col("active") == 0).over(W.partitionBy("island")))
    n = F.count("*")
    whole = p.agg(
        F.sum(F.when(F.col("i") > 6, F.col("commits")).otherwise(0)).alias("last6"), F.sum(F.when(F.col("i") <= 6, F.col("commits")).otherwise(0)).alias("prior6"), F.count_if(F.col("active") == 0).alias("dormant_months"),
        (n - F.coalesce(F.max(F.when(F.col("active") == 1, F.col("i"))), F.lit(0))).alias("silent_now"),
        F.coalesce(F.max("silent"), F.lit(0)).alias("max_inactive_streak"),
    )
    change = F.when(F.col("prior6") > 0, F.bround((F.col("last6") - F.col("prior6")) / F.col("prior6") * 100, 1)).when(F.col("last6") > 0, 100.0).otherwise(0.0)
    return whole.withColumn("velocity_change", change).withColumn("status", activity_status(F.col("silent_now"), F.col("dormant_months"), F.col("last6"), F.col("prior6")))


def activity_status(silent: Column, dormant: Column, last6: Column, prior6: Column) -> Column:
    change = F.when(prior6 > 0, F.abs((last6 - prior6) / prior6 * 100)).otherwise(0.0)
    return (
        F.when((silent >= 3) & (last6 <= F.greatest(F.lit(1), F.floor(prior6 / 4))), "PossiblyAbandoned").when(silent >= 2, "Dormant").when((dormant >= 2) & (prior6 > 0) & (last6 >= F.ceil(prior6 * 1.3)), "Revived")
        .when((prior6 > 0) & (last6 <= F.floor(prior6 * 0.7)), "Slowing").when(change <= 20, "Stable").otherwise("Active")
    )


def rates(st: DataFrame, as_of: datetime) -> DataFrame:
    """Shares of repairs and emergencies among the commits of 90 and 365 days, with the status they stand for."""
    c = st.select("commit_id", "message", age_days(as_of, F.col("author_date")).alias("age")).dropDuplicates(["commit_id"]).where("age <= 365")
    fire, fix = F.col("message").rlike(FIREFIGHTING), F.col("message").rlike(BUG_FIX)
    rate = lambda cond, within: F.coalesce(F.bround(F.try_divide(F.count_if(cond & (F.col("age") <= within)), F.count_if(F.col("age") <= within)), 3), F.lit(0.0))
    out = c.agg(rate(fire, 90).alias("fire90d"), rate(fire, 365).alias("fire365d"), rate(fix, 365).alias("fix365d"), F.count("*").alias("commits365d"))
    f = F.col("fire365d")
    return out.withColumn("status", F.when(f < 0.10, "Low").when(f < 0.25, "Moderate").when(f < 0.40, "High").otherwise("Critical"))


def maturity(first: Column, commits: Column, as_of: datetime) -> Column:
    age = age_days(as_of, first)
    return F.when((age < 180) | (commits < 100), "Young").when((age < 365) | (commits < 300), "Growing").otherwise("Mature")


def role(path: Column) -> Column:
    return F.when(F.arrays_overlap(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), F.array(*map(F.lit, TEST_SEGMENTS))), "test").otherwise("core")


def complexity_score(nesting: Column, deep_ratio: Column, functions: Column, lines: Column, branches: Column) -> Column:
    c = 35 * F.least(nesting / 8, F.lit(1.0)) + 25 * F.least(deep_ratio / 0.3, F.lit(1.0)) + 20 * F.least(functions / 200, F.lit(1.0)) + 10 * F.least(lines / 1000, F.lit(1.0)) + 10 * F.least(F.coalesce(F.try_divide(branches, functions), F.lit(0.0)) / 5, F.lit(1.0))
    return F.when(nesting <= 2, 0.0).otherwise(c)


def subscores(score: Column, changes: Column, strength: Column, partners: Column, truck: Column) -> dict[str, Column]:
    one = F.lit(1.0)
    return {
        "complexity": F.when(score <= 0, 10.0).otherwise(F.greatest(one, 10 - score * 0.09)), "churn": F.when(changes <= 0, 10.0).otherwise(F.greatest(one, 10 - changes * 0.18)),
        "coupling": F.greatest(one, 10 - strength * 5 - F.least(partners / 10, F.lit(4.0))), "knowledge": F.when(truck == 0, 7.0).when(truck == 1, 2.0).when(truck == 2, 5.0).when(truck == 3, 8.0).otherwise(F.least(F.lit(10.0), 8 + (truck - 3) * 0.5)),
    }


def health(sub: dict[str, Column], errors: Column, warnings: Column) -> Column:
    lint = F.greatest(F.lit(1.0), 10 - F.least(errors * 1.5, F.lit(9.0)) - F.least(warnings * 0.4, F.lit(3.0)))
    with_lint = 0.25 * sub["complexity"] + 0.25 * sub["churn"] + 0.20 * sub["coupling"] + 0.15 * sub["knowledge"] + 0.15 * lint
    plain = 0.30 * sub["complexity"] + 0.30 * sub["churn"] + 0.20 * sub["coupling"] + 0.20 * sub["knowledge"]
    raw = F.when((errors > 0) | (warnings > 0), with_lint).otherwise(plain)
    return F.bround(F.greatest(F.lit(1.0), F.least(F.lit(10.0), raw)), 1)


def trust(last_change: Column, changes: Column, errors: Column, warnings: Column, flagged: Column, as_of: datetime) -> Column:
    days = F.coalesce(age_days(as_of, last_change), F.lit(90.0))
    s = 0.7 + F.when(days >= 90, 0.15).when(days >= 30, 0.05).otherwise(0.0) - F.least(changes / 50, F.lit(0.4)) - F.when(days <= 7, 0.05).otherwise(0.0) - F.least(errors * 0.05, F.lit(0.3)) - F.least(warnings * 0.02, F.lit(0.1))
    return F.when(flagged, 0.1).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 2))


def risk_score(h: Column, changes: Column, file_role: Column, partners: Column) -> Column:
    return F.bround((10 - h) * changes * F.when(file_role == "test", 0.3).otherwise(1.0) * (1 + partners * 0.2), 1)


def recurring(c30: Column, c90: Column, c365: Column) -> Column:
    one = F.lit(1.0)
    return F.bround(0.2 * F.least(c30 / 10, one) + 0.3 * F.least(c90 / 25, one) + 0.5 * F.least(c365 / 100, one), 2)


def concern(h: Column, risk: Column, file_role: Column, rec: Column, fixes: Column, touches: Column) -> Column:
    ratio = F.when(touches > 0, F.bround(fixes / touches, 3)).otherwise(0.0)
    base = F.greatest(risk, (10 - h) * 2) + rec * 8 + F.least(ratio * 12, F.lit(8.0)) + F.least(fixes, F.lit(4.0))
    return F.bround(base * F.when(file_role == "test", 0.5).otherwise(1.0), 1)


def slices(key: str, n: int) -> list[Column]:
    """n conditions of which each row meets one, the same for equal keys."""
    return [F.pmod(F.xxhash64(key), F.lit(n)) == k for k in range(n)]


def figures(st: DataFrame, as_of: datetime, brief: bool = False) -> DataFrame:
    """All that churn, weighted_churn, day_sets and knowledge give, for every path touched within two years; the touches are shuffled by path, once.

    A brief one has truck_factor, changes, last_change, days and n alone, and reads the columns in BRIEF."""
    age, w, recent = age_days(as_of, F.col("author_date")), F.col("weight"), F.col("changes") > 0
    part = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    month = lambda c: F.when(age <= 90, c)
    more = [] if brief else ["added", "removed", "weight", F.col("message").rlike(BUG_FIX).alias("fix")]
    own = st.where(age <= LONGEST).select(*BRIEF, *more).repartition("path")
    per = [F.countDistinct("commit_id").alias("commits"), F.count(month(F.lit(1))).alias("changes"), F.max(month(F.col("author_date"))).alias("last_change"), F.collect_set(F.when(age <= 180, F.unix_date(F.to_date("author_date")))).alias("days")]
    total = lambda c: F.sum(c).alias(c)
    weighed = lambda c: F.round(F.sum(c), 6).alias(c)
    whole = [total("changes"), F.max("last_change").alias("last_change"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days")]
    truck, owner = owners(5)
    if not brief:
        per += [F.sum(month(F.col("added"))).alias("lines_added"), F.sum(month(F.col("removed"))).alias("lines_removed"), part(age <= 30).alias("churn30d"), part(age <= 90).alias("churn90d"), part(age <= 365).alias("churn365d"), part((age <= 365) & F.col("fix")).alias("fixes365d")]
        whole += [owner, total("lines_added"), total("lines_removed"), F.when(F.sum("changes") > 0, F.size(F.collect_set(F.when(recent, F.lower("author"))))).alias("authors"), *map(weighed, WEIGHED)]
    return ranked(own.groupBy("path", "author").agg(*per), "commits").groupBy("path").agg(truck, *whole).withColumn("n", F.size("days"))


#: The figures that only `recurring` and `concern` use, and the columns that a brief `figures` reads.
WEIGHED, BRIEF = ["churn30d", "churn90d", "churn365d", "fixes365d"], ["path", "author", "commit_id", "author_date"]


def file_metrics(commits: DataFrame, touches: DataFrame, as_of: datetime, cap: int | None = None, brief: bool = False) -> DataFrame:
    """Health, trust, risk, concern of every path touched within two years; no complexity or lint data; `cap` as in day_sets.

    A brief one has the figures behind health, trust and risk alone, so less is shuffled for it."""
    recent, union = within(commits, as_of, LONGEST), lambda tables: functools.reduce(DataFrame.unionByName, tables)
    n = max(1, min(SLICES, recent.count() // LEAST))
    with Scope() as s:
        made = [source_touches(recent.where(c), touches.where(c)) for c in slices("commit_id", n)]
        st = union([s.cut(t.select(*BRIEF) if brief else t, "touches") for t in made])
        own = union([cut(figures(st.where(c), as_of, brief), "figures") for c in slices("path", n)])
        sets = own.select("path", "n", "days") if cap is None else cut(day_sets(st, as_of, cap=cap), "days")
    j = own.drop("n", "days").join(coupled(sets), "path", "left")
    j = j.fillna(0, ["partners"]).fillna(0.0, ["strength"])
    zero = F.lit(0)
    sub = subscores(zero, F.col("changes"), F.col("strength"), F.col("partners"), F.col("truck_factor"))
    j = j.withColumns({"role": role(F.col("path")), "health": health(sub, zero, zero), "trust": trust(F.col("last_change"), F.col("changes"), zero, zero, F.lit(False), as_of)})
    j = j.withColumn("risk", risk_score(F.col("health"), F.col("changes"), F.col("role"), F.col("partners")))
    if brief:
        return j
    j = j.withColumn("recurring", recurring(F.col("churn30d"), F.col("churn90d"), F.col("churn365d")))
    return j.withColumn("concern", concern(F.col("health"), F.col("risk"), F.col("role"), F.col("recurring"), F.col("fixes365d"), F.col("churn365d")))


def health_summary(metrics: DataFrame, *keys: str) -> DataFrame:
    """Health weighted towards the sick files, hotspots and alerts, by the keys; nothing gives 5.0."""
    w = 11 - F.col("health")
    total = F.coalesce(F.bround(F.try_divide(F.sum(F.col("health") * w), F.sum(w)), 1), F.lit(5.0))
    return metrics.groupBy(*keys).agg(total.alias("health"), F.count("*").alias("files"), F.count_if(F.col("health") < 4.0).alias("hotspots"), F.count_if(F.col("health") < 2.5).alias("alerts"))


def blended(h: Column, security: Column) -> Column:
    return F.bround(0.8 * h + 0.2 * security, 1)
