"""The queries of the problems on texts, chats, source files and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataweave.functions.text import word_count
from strataweave.llm import authorship as A
from strataweave.llm import conversations as C
from strataweave.llm import mixing as M
from strataweave.llm import neighbours as N
from strataweave.llm import packing as P
from strataweave.llm import splitting as S
from strataweave.llm import subjects as U
from strataweave.llm import syntax as X
from strataweave.llm.tokens import token_count
from strataweave.plans.cut import cut
from strataweave.sources.tables import table

# The white space characters, for SQL's regular expressions.
_WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    judged, _ = C.conversations(table(spark, d, "assistant_chat_messages"))
    return judged.where("reason is not null").select("username", "chat_id")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    _, turns = C.conversations(table(spark, d, "assistant_chat_messages"))
    return turns.select("username", "chat_id", "turn", "role", "text")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    judged, _ = C.conversations(table(spark, d, "assistant_chat_messages"))
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("conversations"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = S.split_items(table(spark, d, "convention_chunks"))
    return pieces.where("piece_index = 0 and n_pieces > 1").select(*S.KEY)


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.split_items(table(spark, d, "convention_chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return X.parse_files(table(spark, d, "source_files")).where("error_at is not null").select("file_id")


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """Project, language and line of the first error of every invalid file."""
    return X.parse_files(table(spark, d, "source_files")).where("error_at is not null").select("file_id", "project", "language", F.col("error_at").alias("line"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return X.parse_rates(X.parse_files(table(spark, d, "source_files")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return A.classify(table(spark, d, "source_files")).where("foreign").select("file_id")


def p5_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return A.classify(table(spark, d, "source_files")).where("not foreign").select("file_id", "project", "dotnet_project")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return N.similar_pairs(table(spark, d, "memory_entities_v2"))


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar entities of every entity whose id is divisible by 100, however far, without relaxing."""
    return N.neighbours(table(spark, d, "memory_entities_v2"), least=-1.0, factor=1.0, asked="id % 100 = 0")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return P.pack(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "container_sizes")
    return P.packing_report(P.pack(table(spark, d, "documents"), sizes), sizes)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return U.score(docs, U.train(docs, table(spark, d, "subject_labels").join(table(spark, d, "subjects").select("subject"), "subject", "left_semi")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d)


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return U.composition(_subjects(spark, d), table(spark, d, "documents"))


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Of every item the digest of its pieces put together without their overlaps, and how many pieces exceed a limit."""
    pieces = S.split_items(table(spark, d, "convention_chunks")).where("text is not null")
    over = (F.length("text") > S.MAX_CHARS) | (word_count(F.col("text")) > S.MAX_WORDS)
    own = F.struct("piece_index", F.substring("text", F.col("overlap_chars") + 1, F.length("text")).alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "")  # the pieces of one item
    return pieces.groupBy(*S.KEY).agg(F.md5(whole).alias("digest"), F.count_if(over).alias("over"))


def p3_json(spark: SparkSession, d: str) -> DataFrame:
    """The invalid files of the one language that SQL can parse too."""
    return X.parse_files(table(spark, d, "source_files")).where("error_at is not null and language = 'JSON'").select("file_id")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """How many files the rates of each project and language are of, and whether a rate is not between 0 and 1."""
    return X.parse_rates(X.parse_files(table(spark, d, "source_files"))).select("project", "language", "files", (~F.col("rate").between(0, 1)).cast("int").alias("wrong"))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """By kind: documents in the packing, containers over capacity, places taken twice, documents that lost or gained tokens or were split though they fit."""
    docs, sizes = table(spark, d, "documents"), table(spark, d, "container_sizes")
    packed = cut(P.pack(docs, sizes), "packed")
    caps = sizes.select("container_kind", F.col("capacity_tokens").alias("cap")).distinct()
    at = W.partitionBy("container_kind", "container_id").orderBy("offset")  # one container's pieces
    placed = packed.where("container_id is not null").withColumn("twice", (F.lag(F.col("offset") + F.col("n_tokens")).over(at) > F.col("offset")).cast("int"))
    full = placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice"))
    full = full.join(caps, "container_kind").groupBy("container_kind").agg(F.count_if((F.col("n") > F.col("cap")) | (F.col("end") > F.col("cap"))).alias("overfull"), F.sum("twice").alias("twice"))
    per = packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces")).join(docs.select("doc_id", token_count(F.col("text")).alias("tokens")), "doc_id").join(caps, "container_kind")
    docs_of = per.groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.col("tokens")).alias("lost"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("cap"))).alias("split_though_fit"))
    return docs_of.join(full, "container_kind")


def p9_faults(spark: SparkSession, d: str) -> DataFrame:
    """By source: whether it is off its share by more than 0.005, and its documents that repeat too often."""
    mixed, shares = M.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    often = mixed.groupBy("source").agg(F.max("repeats").alias("most"))
    off = F.abs(F.col("actual_share") - F.col("target_share")) > 0.005
    return shares.join(often, "source", "left").select("source", "max_repeats", off.cast("int").alias("off_target"), F.coalesce((F.col("most") > F.col("max_repeats")).cast("int"), F.lit(0)).alias("too_often"))


_CHATS = f"""WITH m AS (SELECT username, chat_id, message_index AS i, origin,
    CASE lower(regexp_replace(role, '^[{_WS}]+|[{_WS}]+$', '', 'g')) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'customer' THEN 'user'
      WHEN 'assistant' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'bot' THEN 'assistant'
      WHEN 'system' THEN 'system' WHEN 'developer' THEN 'system' WHEN 'tool' THEN 'tool' WHEN 'function' THEN 'tool' ELSE '?' END AS r,
    coalesce(regexp_replace(content, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '') AS t FROM assistant_chat_messages),
s AS (SELECT DISTINCT username, chat_id, i, r, t FROM m WHERE origin = 'stored'),
ua AS (SELECT username, chat_id, r, row_number() OVER (PARTITION BY username, chat_id ORDER BY i) AS k, count(*) OVER (PARTITION BY username, chat_id) AS n FROM s WHERE r IN ('user', 'assistant')),
g AS (SELECT username, chat_id FROM s GROUP BY ALL HAVING min(i) = 0 AND max(i) = count(*) - 1 AND count(DISTINCT i) = count(*) AND count(i) = count(*) AND min(CASE WHEN t = '' OR r = '?' THEN 0 ELSE 1 END) = 1),
a AS (SELECT username, chat_id FROM ua GROUP BY ALL HAVING min(CASE WHEN (r = 'user') = (k % 2 = 1) THEN 1 ELSE 0 END) = 1 AND max(n) % 2 = 0),
x AS (SELECT username, chat_id FROM m WHERE origin = 'submitted' AND NOT EXISTS (SELECT 1 FROM s WHERE s.username = m.username AND s.chat_id = m.chat_id AND s.i = m.i AND s.r = m.r AND s.t = m.t)),
k AS (SELECT * FROM g INTERSECT SELECT * FROM a EXCEPT SELECT * FROM x)
"""


_VECTORS = """WITH e AS (SELECT id, arg_max(t, (u, t)) AS t FROM (SELECT id, coalesce(embedding_json, '') AS t, updated_at AS u FROM memory_entities_v2 WHERE id IS NOT NULL) GROUP BY id),
j AS (SELECT id, CAST(t AS JSON) AS j FROM e WHERE json_valid(t)), a AS (SELECT id, CAST(j AS JSON[]) AS j FROM j WHERE json_type(j) = 'ARRAY' AND json_array_length(j) = 64),
x AS (SELECT id, list_transform(j, lambda y: CAST(y AS DOUBLE)) AS v FROM a WHERE len(list_filter(j, lambda y: y IS NULL OR json_type(y) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT'))) = 0),
n AS (SELECT id, list_transform(v, lambda y: y / m) AS v FROM (SELECT id, v, list_max(list_transform(v, lambda y: abs(y))) AS m FROM x) WHERE m > 0 AND isfinite(m)),
u AS (SELECT id, list_transform(v, lambda y: y / sqrt(s)) AS v FROM (SELECT id, v, list_dot_product(v, v) AS s FROM n)), p AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 10) AS s FROM u a, u b WHERE a.id <> b.id{0})
"""

_REASONS = """, b AS (SELECT username, chat_id, min(i) <> 0 OR max(i) <> count(DISTINCT i) - 1 OR count(i) < count(*) AS gap, count(*) > count(DISTINCT i) AS forked, bool_or(t = '') AS blank, bool_or(r = '?') AS odd FROM s GROUP BY ALL),
w AS (SELECT username, chat_id, bool_and((r = 'user') = (k % 2 = 1)) AS alternate, max(n) % 2 = 0 AS replied FROM ua GROUP BY ALL), o AS (SELECT username, chat_id, true AS lost FROM x GROUP BY ALL), d AS (SELECT DISTINCT username, chat_id FROM m),
z AS (SELECT CASE WHEN gap IS NULL THEN 'nothing stored' WHEN gap THEN 'gap' WHEN forked THEN 'fork' WHEN blank THEN 'blank message' WHEN odd THEN 'unknown role' WHEN alternate IS NULL THEN 'no reply' WHEN NOT alternate THEN 'speakers do not alternate' WHEN NOT replied THEN 'no reply' WHEN lost THEN 'submitted history differs' ELSE 'kept' END AS reason
  FROM d LEFT JOIN b USING (username, chat_id) LEFT JOIN w USING (username, chat_id) LEFT JOIN o USING (username, chat_id)) SELECT reason, count(*) AS conversations FROM z GROUP BY 1"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_conversations, p1_reasons, p2_found, p2_pieces, p3_found, p3_errors, p3_rates, p5_found, p5_handwritten, p7_found, p7_neighbours, p8_packing, p8_report, p9_mix, p9_shares, p10_found, p10_composition, p2_rejoined, p3_json, p3_files, p8_faults, p9_faults)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CHATS + "SELECT DISTINCT username, chat_id FROM m EXCEPT SELECT * FROM k",
        "p1_conversations": _CHATS + "SELECT s.username, s.chat_id, s.i AS turn, s.r AS role, s.t AS text FROM s JOIN k ON s.username = k.username AND s.chat_id = k.chat_id",
        "p1_reasons": _CHATS + _REASONS,
        "p7_found": _VECTORS.format("") + ", r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p WHERE s >= 0.85) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 10",
        "p7_neighbours": _VECTORS.format(" AND a.id % 100 = 0") + "SELECT a AS id_a, b AS id_b, s AS score, CAST(row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS INT) AS rank FROM p QUALIFY rank <= 10",
        "p2_rejoined": "WITH c AS (SELECT page_id, revision, chunk_index, arg_max(t, (u, t)) AS t FROM (SELECT page_id, revision, chunk_index, updated_at AS u, coalesce(text, chr(1)) AS t FROM convention_chunks) GROUP BY ALL) SELECT page_id, revision, chunk_index, md5(t) AS digest, 0 AS over FROM c WHERE t <> chr(1)",
        "p3_json": "WITH f AS (SELECT file_id, arg_max(content, scanned_at) AS c FROM source_files WHERE lower(trim(file_path)) LIKE '%.json' AND content IS NOT NULL GROUP BY 1) SELECT file_id FROM f WHERE NOT json_valid(ltrim(c, chr(65279)))",
        "p3_files": """WITH f AS (SELECT file_id, arg_max(ROW(lower(trim(project, ' ' || chr(9) || chr(160))), lower(regexp_extract(trim(file_path), '\\.([A-Za-z]+)$', 1))), scanned_at) AS v FROM source_files GROUP BY 1)
SELECT v[1] AS project, CASE v[2] WHEN 'cs' THEN 'C#' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'py' THEN 'Python' WHEN 'sql' THEN 'SQL' WHEN 'rs' THEN 'Rust' WHEN 'json' THEN 'JSON' END AS language, count(*) AS files, 0 AS wrong FROM f GROUP BY ALL""",
        "p8_faults": "SELECT container_kind, count(DISTINCT doc_id) AS documents, 0 AS lost, 0 AS split_though_fit, 0 AS overfull, 0 AS twice FROM documents, (SELECT DISTINCT container_kind FROM container_sizes WHERE capacity_tokens >= 1) k GROUP BY 1",
        "p9_faults": "SELECT source, CAST(max(max_repeats) AS INT) AS max_repeats, 0 AS off_target, 0 AS too_often FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY 1",
        "p2_found": f"SELECT DISTINCT page_id, revision, chunk_index FROM convention_chunks WHERE length(text) > 4000 OR len(regexp_extract_all(text, '[^{_WS}]+')) > 512",
    }
