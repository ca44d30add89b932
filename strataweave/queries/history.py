"""Queries over git history and telemetry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import history as H
from strataweave.operators import reports as R
from strataweave.plans.bind import cte
from strataweave.plans.bind import view as V
from strataweave.plans.sieve import sieve
from strataweave.sources.tables import table

AS_OF = datetime(2001, 8, 1)
FROM, TO = datetime(2024, 1, 3), datetime(2024, 1, 28)


def _history(s: SparkSession, d: str, days: int) -> tuple[DataFrame, DataFrame]:
    """The commits of the window and their touches; nearly all other lines are left out before they are shuffled."""
    recent = H.within(V(s, d, "h_commits"), AS_OF, days)
    return recent, V(s, d, "h_touches", lineitem=sieve(table(s, d, "lineitem"), "l_orderkey", recent.select("commit_id")))


def _st(s: SparkSession, d: str) -> DataFrame:
    return H.source_touches(V(s, d, "h_commits"), V(s, d, "h_touches"))


def churn_90d(s: SparkSession, d: str) -> DataFrame:
    return H.churn(_st(s, d), AS_OF)


def weighted_churn(s: SparkSession, d: str) -> DataFrame:
    return H.weighted_churn(_st(s, d), AS_OF)


def cochange_pairs(s: SparkSession, d: str) -> DataFrame:
    return H.cochange_pairs(H.source_touches(*_history(s, d, 180)), AS_OF)


def coupling(s: SparkSession, d: str) -> DataFrame:
    return H.coupling(H.source_touches(*_history(s, d, 180)), AS_OF)


def truck_factor(s: SparkSession, d: str) -> DataFrame:
    return H.knowledge(_st(s, d), AS_OF)


def monthly_points(s: SparkSession, d: str) -> DataFrame:
    return H.monthly_points(_st(s, d), AS_OF)


def activity_status(s: SparkSession, d: str) -> DataFrame:
    return H.vitality(H.monthly_points(_st(s, d), AS_OF))


def inactive_streak(s: SparkSession, d: str) -> DataFrame:
    return activity_status(s, d).select("max_inactive_streak", "dormant_months")


def firefighting(s: SparkSession, d: str) -> DataFrame:
    return H.rates(_st(s, d), AS_OF)


def history_maturity(s: SparkSession, d: str) -> DataFrame:
    a = V(s, d, "h_commits").groupBy("author").agg(F.min("author_date").alias("first"), F.count("*").alias("commits"))
    return a.select("author", "commits", H.maturity(F.col("first"), F.col("commits"), AS_OF).alias("maturity"))


def _metrics(s: SparkSession, d: str, brief: bool = True) -> DataFrame:
    return H.file_metrics(*_history(s, d, H.LONGEST), AS_OF, brief=brief)


def file_health(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d).select("path", "role", "health", "trust", "changes", "partners", "truck_factor")


def file_concern(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d, brief=False).select("path", "risk", "recurring", "concern")


def hotspots(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d).orderBy(F.desc("risk"), F.desc("health"), "path").limit(25).select("path", "risk", "health")


def health_summary(s: SparkSession, d: str) -> DataFrame:
    return H.health_summary(_metrics(s, d).withColumn("brand", F.split("path", "/")[1]), "brand")


def report_usage_series(s: SparkSession, d: str) -> DataFrame:
    return R.series(V(s, d, "t_tools"), FROM, TO, R.interval(FROM, TO), calls=F.count("*"), failures=F.count_if(~F.col("success")), duration_ms=F.sum("duration_ms"), users=F.countDistinct("username"), avg_ms=F.bround(F.avg("duration_ms"), 2))


def report_weeks(s: SparkSession, d: str) -> DataFrame:
    return R.series(V(s, d, "t_tools").where("tool_name = 'purchase'"), datetime(2023, 12, 20), datetime(2024, 3, 1), "week", calls=F.count("*"))


def report_breakdown(s: SparkSession, d: str) -> DataFrame:
    t = R.within(V(s, d, "t_tools"), FROM, TO).withColumn("tool_name", F.when(F.col("tool_name") == "signup", " ").otherwise(F.col("tool_name")))
    return R.breakdown(t, "tool_name", F.sum("duration_ms"))


def report_breakdown_series(s: SparkSession, d: str) -> DataFrame:
    return R.breakdown_series(V(s, d, "t_tools"), "tool_name", F.count("*"), FROM, TO, "day")


def report_facets(s: SparkSession, d: str) -> DataFrame:
    t = V(s, d, "t_tools")
    return R.facets(user=(t, "username"), tool=(t, "tool_name"))


def event_dedupe(s: SparkSession, d: str) -> DataFrame:
    t = V(s, d, "t_tools")
    again = t.where("event_id % 3 = 0").withColumn("created_at", F.col("created_at") + F.expr("interval 1 hour"))
    return R.once(t.unionByName(again)).select("event_id", "username", "created_at")


def event_normalise(s: SparkSession, d: str) -> DataFrame:
    raw = V(s, d, "t_tools").select("event_id", F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.upper("username")).alias("username"), (F.col("duration_ms") - 30).alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"), F.when(F.col("event_id") % 2 == 0, 7).cast("long").alias("total_tokens"))
    return R.normalise_usage(raw)


QUERIES = [
    churn_90d, weighted_churn, truck_factor, monthly_points, firefighting, history_maturity, report_usage_series,
    report_weeks, report_breakdown, report_breakdown_series, report_facets, event_dedupe, event_normalise,
    cochange_pairs, coupling, file_health, file_concern, hotspots, health_summary, activity_status, inactive_streak,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _st_sql() -> str:
    return f"""WITH {cte("h_commits", "h_touches")}, lt AS (SELECT commit_id, path, added, removed FROM h_touches QUALIFY row_number() OVER (PARTITION BY commit_id, lower(path) ORDER BY seq DESC, added DESC, removed DESC) = 1),
sw AS (SELECT commit_id, path, added, removed, CASE WHEN sum(added + removed) OVER c > 0 THEN (added + removed) / sum(added + removed) OVER c ELSE 1.0 / count(*) OVER c END AS weight FROM lt WINDOW c AS (PARTITION BY commit_id)),
st AS (SELECT sw.*, author, author_date, message, (epoch(TIMESTAMP '2001-08-01') - epoch(author_date)) / 86400 AS age FROM sw JOIN h_commits USING (commit_id))"""


_VITALITY = """, v AS (SELECT m.month, coalesce(n, 0) AS commits, row_number() OVER (ORDER BY m.month) AS i FROM (SELECT unnest(generate_series(TIMESTAMP '2000-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS month) m LEFT JOIN (SELECT date_trunc('month', author_date) AS month, count(DISTINCT commit_id) AS n FROM st WHERE {0} GROUP BY 1) q USING (month)),
k AS (SELECT *, sum(CAST(commits > 0 AS INT)) OVER (ORDER BY month) AS island FROM v), w AS (SELECT CAST(sum(commits) FILTER (WHERE i > 6) AS BIGINT) AS last6, CAST(sum(commits) FILTER (WHERE i <= 6) AS BIGINT) AS prior6, count(*) FILTER (WHERE commits = 0) AS dormant_months,
  12 - coalesce(max(i) FILTER (WHERE commits > 0), 0) AS silent_now, (SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM k WHERE commits = 0 GROUP BY island)) AS max_inactive_streak FROM v)
"""


def oracle_sql() -> dict[str, str]:
    st, t = _st_sql(), f"WITH {cte('t_tools')} "
    pairs = ", dd AS (SELECT DISTINCT CAST(author_date AS DATE) AS day, path FROM st WHERE age <= 180), cp AS (SELECT x.path AS a, y.path AS b, count(*) AS days FROM dd x JOIN dd y ON x.day = y.day AND x.path < y.path GROUP BY 1, 2)"
    coup = pairs + ", co AS (SELECT path, round(least(max(days) / (SELECT count(DISTINCT CAST(author_date AS DATE)) FROM st WHERE age <= 180 AND st.path = u.path), 1.0), 6) AS strength, count(*) AS partners FROM (SELECT a AS path, days FROM cp UNION ALL SELECT b, days FROM cp) u GROUP BY path)"
    know = ", pa AS (SELECT path, author, count(DISTINCT commit_id) AS n FROM st WHERE age <= 730 GROUP BY 1, 2), pr AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY path ORDER BY n DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY path) AS total, row_number() OVER (PARTITION BY path ORDER BY n DESC, author) AS r FROM pa), kn AS (SELECT path, count(*) FILTER (WHERE before <= 0.5 * total) AS truck_factor, string_agg(author, ',' ORDER BY r) FILTER (WHERE r <= 5) AS top_authors FROM pr GROUP BY 1)"
    ch = ", ch AS (SELECT path, count(*) AS changes, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(removed) AS BIGINT) AS lines_removed, count(DISTINCT lower(author)) AS authors, max(author_date) AS last_change FROM st WHERE age <= 90 GROUP BY 1)"
    wc = ", wc AS (SELECT path, round(sum(CASE WHEN age <= 30 THEN weight ELSE 0.0 END), 6) AS churn30d, round(sum(CASE WHEN age <= 90 THEN weight ELSE 0.0 END), 6) AS churn90d, round(sum(weight), 6) AS churn365d, round(sum(CASE WHEN regexp_matches(message, '(?i)\\b(fix|bug|broken|defect|patch)\\b') THEN weight ELSE 0.0 END), 6) AS fixes365d FROM st WHERE age <= 365 GROUP BY 1)"
    fm = st + coup + know + ch + wc + """, fa AS (SELECT p.path, CASE WHEN list_has_any(string_split(lower(p.path), '/'), ['test', 'tests', 'spec', 'specs', 'testing', '.tests', '.test']) THEN 'test' ELSE 'core' END AS role, coalesce(changes, 0) AS changes, coalesce(partners, 0) AS partners, coalesce(truck_factor, 0) AS truck_factor, coalesce(strength, 0.0) AS strength, last_change,
    coalesce(churn30d, 0.0) AS c30, coalesce(churn90d, 0.0) AS c90, coalesce(churn365d, 0.0) AS c365, coalesce(fixes365d, 0.0) AS fx FROM (SELECT DISTINCT path FROM st WHERE age <= 730) p LEFT JOIN ch USING (path) LEFT JOIN co USING (path) LEFT JOIN kn USING (path) LEFT JOIN wc USING (path)),
fb AS (SELECT *, round_even(CAST(greatest(1.0, least(10.0, 0.3 * 10.0 + 0.3 * CASE WHEN changes <= 0 THEN 10.0 ELSE greatest(1.0, 10 - changes * 0.18) END + 0.2 * greatest(1.0, 10 - strength * 5 - least(partners / 10, 4.0)) + 0.2 * CASE truck_factor WHEN 0 THEN 7.0 WHEN 1 THEN 2.0 WHEN 2 THEN 5.0 WHEN 3 THEN 8.0 ELSE least(10.0, 8 + (truck_factor - 3) * 0.5) END)) AS DOUBLE), 1) AS health,
    coalesce((epoch(TIMESTAMP '2001-08-01') - epoch(last_change)) / 86400, 90.0) AS days, round_even(CAST(0.2 * least(c30 / 10, 1.0) + 0.3 * least(c90 / 25, 1.0) + 0.5 * least(c365 / 100, 1.0) AS DOUBLE), 2) AS recurring FROM fa),
fc AS (SELECT *, round_even(CAST(greatest(0.0, least(1.0, 0.7 + CASE WHEN days >= 90 THEN 0.15 WHEN days >= 30 THEN 0.05 ELSE 0.0 END - least(changes / 50, 0.4) - CASE WHEN days <= 7 THEN 0.05 ELSE 0.0 END)) AS DOUBLE), 2) AS trust, round_even(CAST((10 - health) * changes * CASE role WHEN 'test' THEN 0.3 ELSE 1.0 END * (1 + partners * 0.2) AS DOUBLE), 1) AS risk FROM fb),
fm AS (SELECT *, round_even(CAST((greatest(risk, (10 - health) * 2) + recurring * 8 + least(CASE WHEN c365 > 0 THEN round_even(fx / c365, 3) ELSE 0.0 END * 12, 8.0) + least(fx, 4.0)) * CASE role WHEN 'test' THEN 0.5 ELSE 1.0 END AS DOUBLE), 1) AS concern FROM fc) """
    rng = "created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-28'"
    days = "sp AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-27', INTERVAL 1 DAY)) AS bucket)"
    fire, fix = "regexp_matches(message, '(?i)\\b(hotfix|incident|urgent|emergency|rollback|revert)\\b')", "regexp_matches(message, '(?i)\\b(fix|bug|broken|defect|patch)\\b')"
    sql = {
        "churn_90d": st + ch + " SELECT * FROM ch",
        "weighted_churn": st + wc + " SELECT * FROM wc",
        "cochange_pairs": st + pairs + " SELECT * FROM cp",
        "coupling": st + coup + " SELECT * FROM co",
        "truck_factor": st + know + " SELECT * FROM kn",
        "monthly_points": st + _VITALITY.format("true") + "SELECT month, commits FROM v",
        "activity_status": st + _VITALITY.format("true") + """SELECT w.*, CASE WHEN prior6 > 0 THEN round_even((last6 - prior6) / prior6 * 100, 1) WHEN last6 > 0 THEN 100.0 ELSE 0.0 END AS velocity_change,
  CASE WHEN silent_now >= 3 AND last6 <= greatest(1, prior6 // 4) THEN 'PossiblyAbandoned' WHEN silent_now >= 2 THEN 'Dormant' WHEN dormant_months >= 2 AND prior6 > 0 AND last6 >= ceil(prior6 * 1.3) THEN 'Revived' WHEN prior6 > 0 AND last6 <= floor(prior6 * 0.7) THEN 'Slowing'
    WHEN CASE WHEN prior6 > 0 THEN abs((last6 - prior6) / prior6 * 100) ELSE 0 END <= 20 THEN 'Stable' ELSE 'Active' END AS status FROM w""",
        "inactive_streak": st + _VITALITY.format("true") + "SELECT max_inactive_streak, dormant_months FROM w",
        "firefighting": st + f", cc AS (SELECT DISTINCT commit_id, message, age FROM st WHERE age <= 365), q AS (SELECT coalesce(round_even(count(*) FILTER (WHERE age <= 90 AND {fire}) / nullif(count(*) FILTER (WHERE age <= 90), 0), 3), 0) AS fire90d, round_even(count(*) FILTER (WHERE {fire}) / count(*), 3) AS fire365d, round_even(count(*) FILTER (WHERE {fix}) / count(*), 3) AS fix365d, count(*) AS commits365d FROM cc) SELECT *, CASE WHEN fire365d < 0.1 THEN 'Low' WHEN fire365d < 0.25 THEN 'Moderate' WHEN fire365d < 0.4 THEN 'High' ELSE 'Critical' END AS status FROM q",
        "history_maturity": f"WITH {cte('h_commits')}, a AS (SELECT author, (epoch(TIMESTAMP '2001-08-01') - epoch(min(author_date))) / 86400 AS age, count(*) AS commits FROM h_commits GROUP BY 1) SELECT author, commits, CASE WHEN age < 180 OR commits < 100 THEN 'Young' WHEN age < 365 OR commits < 300 THEN 'Growing' ELSE 'Mature' END AS maturity FROM a",
        "file_health": fm + "SELECT path, role, health, trust, changes, partners, truck_factor FROM fm",
        "file_concern": fm + "SELECT path, risk, recurring, concern FROM fm",
        "hotspots": fm + "SELECT path, risk, health FROM fm ORDER BY risk DESC, health DESC, path LIMIT 25",
        "health_summary": fm + "SELECT string_split(path, '/')[2] AS brand, round_even(sum(health * (11 - health)) / sum(11 - health), 1) AS health, count(*) AS files, count(*) FILTER (WHERE health < 4.0) AS hotspots, count(*) FILTER (WHERE health < 2.5) AS alerts FROM fm GROUP BY 1",
        "report_usage_series": t + f", {days} SELECT bucket, coalesce(n, 0) AS calls, coalesce(f, 0) AS failures, CAST(coalesce(dm, 0) AS BIGINT) AS duration_ms, coalesce(u, 0) AS users, coalesce(a, 0) AS avg_ms FROM sp LEFT JOIN (SELECT date_trunc('day', created_at) AS bucket, count(*) AS n, count(*) FILTER (WHERE NOT success) AS f, sum(duration_ms) AS dm, count(DISTINCT username) AS u, round_even(avg(duration_ms), 2) AS a FROM t_tools WHERE {rng} GROUP BY 1) USING (bucket)",
        "report_weeks": t + "SELECT bucket, coalesce(n, 0) AS calls FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-18', TIMESTAMP '2024-02-26', INTERVAL 7 DAY)) AS bucket) LEFT JOIN (SELECT date_trunc('week', created_at) AS bucket, count(*) AS n FROM t_tools WHERE tool_name = 'purchase' GROUP BY 1) USING (bucket)",
        "report_breakdown": t + f"SELECT CASE WHEN tool_name = 'signup' THEN '(unknown)' ELSE tool_name END AS label, CAST(sum(duration_ms) AS BIGINT) AS value FROM t_tools WHERE {rng} GROUP BY 1 HAVING sum(duration_ms) > 0",
        "report_breakdown_series": t + f", {days}, g AS (SELECT tool_name AS label, date_trunc('day', created_at) AS bucket, count(*) AS n FROM t_tools WHERE {rng} GROUP BY 1, 2) SELECT l.label, sp.bucket, coalesce(n, 0) AS value FROM (SELECT DISTINCT label FROM g) l CROSS JOIN sp LEFT JOIN g ON g.label = l.label AND g.bucket = sp.bucket",
        "report_facets": t + "SELECT DISTINCT 'user' AS facet, username AS value FROM t_tools UNION SELECT 'tool', tool_name FROM t_tools",
        "event_dedupe": t + "SELECT event_id, username, created_at FROM t_tools",
        "event_normalise": t + ", r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'system' ELSE lower(username) END AS username, greatest(duration_ms - 30, 0) AS input_tokens, event_id % 50 AS output_tokens FROM t_tools) SELECT event_id, username, input_tokens, output_tokens, CASE WHEN event_id % 2 = 0 THEN 7 ELSE input_tokens + output_tokens END AS total_tokens FROM r",
    }
    return sql
