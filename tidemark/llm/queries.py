"""Named queries of this folder and their SQL, added by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii, secrets, spans
from tidemark.llm.common import table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.html_extract import extract, labelled_pages, train
from tidemark.llm.lang_id import held_out_fold, identify, learn_profiles
from tidemark.llm.mixing import mix, selection
from tidemark.llm.neighbours import nearest
from tidemark.llm.prep_queries import PREP_QUERIES
from tidemark.llm.pretokens import vocabulary_path
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_shards import shard_documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    counts = [spans.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, *(c.alias(n) for n, c in spans.digest(pii.BASE).items()))


#: Target weights of the mixture of ``documents``; names which are not listed weigh 1.
DOMAINS = ("web", "books", "news", "forum")
WEIGHTS = {"web": 4, "books": 3, "news": 2, "forum": 1, "en": 5, "de": 2, "fr": 2, "es": 1}


def mixture_path() -> list[Column]:
    """Domain (dealt by source, as the table has none), language and source of a document."""
    number = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(len(DOMAINS)))
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (number + 1).cast("int"))
    return [domain, F.col("lang"), F.col("source")]


def mixture_weight(path: tuple[str, ...]) -> Fraction:
    return Fraction(WEIGHTS.get(path[-1], 1)) if len(path) < 3 else Fraction(1)


def op2_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(selection(table(spark, folder, "documents"), mixture_path(), mixture_weight, cut=True))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"), train(labelled_pages(spark)))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary_path())


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = held_out_fold(F.col("doc_id"))
    profiles = learn_profiles(docs.filter(~held_out))
    named = identify(docs.select("doc_id", "text"), profiles)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"), vocabulary_path())


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(table(spark, folder, "documents"))
    counts = [spans.count_of(kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select("doc_id", *counts, *(c.alias(n) for n, c in spans.digest(secrets.BASE).items()))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    judged = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.array_join(F.sort_array("items"), ",")
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), "contaminated",
    )


def _crc32(text: str) -> str:
    """The checksum of an ASCII string, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1),
      lambda i: CAST(ascii(substr({text}, CAST(i AS INT), 1)) AS BIGINT))), lambda c, b:
        list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END + z))),
      4294967295::BIGINT)"""


def _share(level: int, name: str, keys: str) -> str:
    """Budgets of the nodes of a level: children in order of what they hold by weight fill up one after another."""
    parents = ", ".join(keys.split(", ")[:-1])
    part = f"PARTITION BY {parents} " if parents else ""
    source = f"given{level - 1} JOIN" if level > 1 else "(SELECT sum(n) AS given0 FROM leaves) CROSS JOIN"
    using = f" USING ({parents})" if level > 1 else ""
    weight = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " ELSE 1 END" if level < 3 else "1"
    return f"""nodes{level} AS (
  SELECT {keys}, given{level - 1}, hold, weight,
    coalesce(sum(hold) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM {source} (SELECT {keys}, 4.0::DOUBLE * sum(n) AS hold, CAST({weight} AS DOUBLE) AS weight FROM leaves GROUP BY {keys}){using}
  WINDOW w AS ({part}ORDER BY hold / weight, {name})
), full{level} AS (SELECT *, hold * weights <= (given{level - 1} - lower) * weight AS is_full FROM nodes{level}),
given{level} AS (
  SELECT {keys}, CASE WHEN is_full THEN hold ELSE weight
      * (given{level - 1} - coalesce(sum(hold) FILTER (WHERE is_full) OVER p, 0))
      / (sum(weight) FILTER (WHERE NOT is_full) OVER p) END AS given{level}
  FROM full{level} WINDOW p AS ({part or "PARTITION BY 1"})
)"""


#: Budgets level by level, then whole leaves in the order of their next epoch; its last document is taken in part.
OP2_SQL = f"""
WITH items AS (
  SELECT doc_id, md5(coalesce(text, '')) AS h, {list(DOMAINS)}[{_crc32("coalesce(source, '')")} % {len(DOMAINS)} + 1] AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> '')) AS n_tokens, count(*) AS copies
  FROM documents GROUP BY ALL
), leaves AS (SELECT domain, lang, source, sum(n_tokens * copies) AS n FROM items GROUP BY ALL HAVING n > 0),
{_share(1, "domain", "domain")},
{_share(2, "lang", "domain, lang")},
{_share(3, "source", "domain, lang, source")},
plan AS (
  SELECT domain, lang, source, CAST(floor(given3 / n + 1e-9) AS INTEGER) AS whole,
    CAST(floor(given3 - floor(given3 / n + 1e-9) * n + 1e-6) AS BIGINT) AS rest
  FROM given3 JOIN leaves USING (domain, lang, source)
), placed AS (
  SELECT *, CAST(sum(n_tokens * copies) OVER (PARTITION BY domain, lang, source ORDER BY
    md5('1:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM items JOIN plan USING (domain, lang, source)
), chosen AS (
  SELECT *, unnest(range(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM placed
), ends AS (
  SELECT *, rest - (upto - n_tokens * copies) AS taken FROM placed WHERE rest < upto AND rest > upto - n_tokens * copies
)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens
FROM (SELECT *, unnest(range(copies)) AS copy FROM chosen)
UNION ALL
SELECT doc_id, domain, lang, source, whole, CAST(least(n_tokens, taken - copy * n_tokens) AS BIGINT)
FROM (SELECT *, unnest(range(CAST(ceil(taken / n_tokens) AS BIGINT))) AS copy FROM ends)
"""

#: Every query against every other row; sums run from the first component on.
OP6_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id,
    list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id, qe ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""

#: The checksum of a key bit by bit, n-grams word by word, profiles and distances by rank.
OP7_SQL = r"""
WITH folds AS (
  SELECT doc_id, row_number() OVER () AS rid, lang, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS words,
    coalesce({checksum} % 4 = 2, false) AS held_out
  FROM documents
), fenced AS (
  SELECT rid, lang, held_out, chr(1) || w || chr(1) AS f FROM (SELECT rid, lang, held_out, unnest(words) AS w FROM folds)
), grams AS (
  SELECT rid, lang, held_out, 1 AS kind, unnest(list_transform(range(2, length(f)), lambda i: substr(f, CAST(i AS INT), 1))) AS g FROM fenced
  UNION ALL
  SELECT rid, lang, held_out, 2, unnest(list_transform(range(1, length(f)), lambda i: substr(f, CAST(i AS INT), 2))) FROM fenced
  UNION ALL
  SELECT rid, lang, held_out, 3, unnest(list_transform(range(1, length(f) - 1), lambda i: substr(f, CAST(i AS INT), 3))) FROM fenced
), learned AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, kind <> 2, kind, g) - 1 AS rank
  FROM grams WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, kind, g
  QUALIFY rank < 400
), own AS (
  SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY count(*) DESC, kind = 2, kind, g) - 1 AS rank
  FROM grams GROUP BY rid, kind, g QUALIFY rank < 400
), sizes AS (SELECT rid, count(*) AS n FROM own GROUP BY rid),
profile AS (SELECT max(rank) + 1 AS size FROM learned),
near AS (
  SELECT o.rid, l.lang, sum(least(abs(o.rank - l.rank), size) - size) AS less
  FROM own o JOIN learned l USING (g), profile GROUP BY o.rid, l.lang
), scored AS (
  SELECT s.rid, p.lang, s.n, size, s.n * size + coalesce(less, 0) AS distance
  FROM sizes s CROSS JOIN (SELECT DISTINCT lang FROM learned) p CROSS JOIN profile
    LEFT JOIN near USING (rid, lang)
), best AS (
  SELECT rid, lang, 1.0::DOUBLE - CAST(distance AS DOUBLE) / CAST(n * size AS DOUBLE) AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, lang) = 1
)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score
FROM folds LEFT JOIN best b USING (rid)
""".replace("{checksum}", _crc32("CAST(doc_id AS VARCHAR)"))

#: Lower-cases A to Z alone, then looks for every item window at every place of every document.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM g), p AS (
  SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size
), o AS (
  SELECT rid, i, size, item_id FROM (SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM p) JOIN g USING (size, gram)
), hit AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS k FROM o) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_personal_data": (op1_personal_data, None),
    "op2_mixture": (op2_mixture, OP2_SQL),
    "op3_main_text": (op3_main_text, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_simhash": (op5_simhash, None),
    "op6_neighbours": (op6_neighbours, OP6_SQL),
    "op7_language": (op7_language, OP7_SQL),
    "op8_token_shards": (op8_token_shards, None),
    "op9_secret_scan": (op9_secret_scan, None),
    "op10_decontaminate": (op10_decontaminate, OP10_SQL),
    **PREP_QUERIES,
}
