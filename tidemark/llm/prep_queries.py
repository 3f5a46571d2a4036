"""Queries and SQL of the filter audit, chat formatting and fill-in-the-middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import filter_audit
from tidemark.llm.chat_format import CHAT, conversation_digests, format_turns
from tidemark.llm.common import table
from tidemark.llm.fill_middle import MIDDLE, PREFIX, SEED, SUFFIX, SUFFIX_FIRST, TRANSFORMED, digests, fill_in_middle

#: A conversation whose texts look like the template's own marks.
PLANTED, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    planted = spark.createDataFrame(
        [(PLANTED, 0, "user", PLANTED_TEXT), (PLANTED, 1, "assistant", PLANTED_TEXT)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return conversation_digests(format_turns(given.unionByName(planted)))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return digests(fill_in_middle(table(spark, folder, "documents")))


#: Flags by regular expressions, first keys by a window over whole texts, every order one by one.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
  FROM d
), marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, f
), one AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM one a JOIN one b ON b.i <> a.i JOIN one c ON c.i NOT IN (a.i, b.i) JOIN one d ON d.i NOT IN (a.i, b.i, c.i)
    JOIN one e ON e.i NOT IN (a.i, b.i, c.i, d.i)
), steps AS (
  SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', CAST(x AS INT), 1)), '') AS filter_order, i AS step,
    o[i] AS own, o[1 : i - 1] AS before FROM orders, one
), run AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails,
    len(list_filter(before, lambda x: f[x])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS failed
  FROM masks, steps
), counted AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM run GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_escaped(text: str) -> str:
    sql = f"replace({text}, '\\', '\\\\')"
    for mark in CHAT.control:
        sql = f"replace({sql}, {_literal(mark)}, {_literal(mark[0] + CHAT.escape + mark[1:])})"
    return sql


def _sql_opening() -> str:
    known = " ".join(f"WHEN {_literal(r)} THEN {_literal(o)}" for r, o in CHAT.openings.items())
    return f"CASE role {known} ELSE {_literal(CHAT.other)} || {_sql_escaped('role')} || {_literal(CHAT.named)} END"


#: Roles in order: a turn may follow the role before it.
_FOLLOWS = ", ".join(f"({_literal(a if a != 'start' else '')}, {_literal(b)})" for a, b in CHAT.moves)

OP12_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED}, 0, 'user', {_literal(PLANTED_TEXT)}
  UNION ALL SELECT {PLANTED}, 1, 'assistant', {_literal(PLANTED_TEXT)}
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM given
), turns AS (
  SELECT conv_id, p, role, text, {_sql_opening()} || {_sql_escaped('text')} || {_literal(CHAT.end)} || chr(10) AS written,
    row(coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY p), ''), role) IN ({_FOLLOWS}) AS follows
  FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY p)) AS loss_sha256,
  CAST(sum(length(written)) AS BIGINT) AS formatted_chars,
  bool_and(follows) AND arg_max(role, p) IN ({', '.join(map(_literal, sorted(CHAT.finals)))}) AS in_order
FROM turns GROUP BY conv_id
"""

_H = ", ".join(f"CAST('0x' || substr(x, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents
), h AS (SELECT *, {_H} FROM d), cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR h3 % 100 >= {TRANSFORMED} OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
      THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM h
), parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

PREP_QUERIES = {
    "op11_filter_audit": (op11_filter_audit, OP11_SQL),
    "op12_chat_format": (op12_chat_format, OP12_SQL),
    "op13_fill_middle": (op13_fill_middle, OP13_SQL),
}
