"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame functions alone.

Windows of an item are its runs of ``WINDOW`` words (an item with fewer words, but not none, is
one window).  An occurrence must hold all words of a window, so by the prefix principle for
full containment one word is a sufficient prefix: the window's rarest, by its count over all
documents.  Document words join these prefix words; the positional bound (the window may not
begin before the text), the length bound (it must end within it) and the comparison word for
word stand in the join's condition.

One pass over the documents counts the benchmark's words, another one joins.  Both explode
words inside the scan and keep only those of a look-up table, so no words are shuffled.  The
table of prefixes is counted; beyond ``BLOCK`` rows it is cut into blocks of that size, each
broadcast to a pass of its own.  Words of the benchmark beyond that number are counted by an
ordinary aggregation instead.

A document is a pair of key and text hash.  A marker row behind its last word brings its
length and how often it repeats, so documents without hits and repeated rows stay.  Null or
empty texts have no words and are not contaminated.  Items without words have no window, equal
items share windows and are all named, an item without id marks words but is not named.  Items
are looked up by a join once a document's windows are known, so that a window which very many
items share is broadcast once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.plans.scan import null_safe_join
from tidemark.plans.staging import stage

#: Words of a window; rows of a look-up table which is sent to all tasks.
WINDOW, BLOCK = 13, 100_000
#: A document with so many hits is contaminated: one word in ``SHARE``.
SHARE = 20
#: Fixed value: what separates words, after lower-casing.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands behind the last word of a document; no word holds such a character.
_END = "\x01"


def cut_words(text: Column) -> Column:
    """The words of a text, with an empty string before or behind them where separators stand there."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN)


def count_words(cut: Column) -> Column:
    """Words in the result of ``cut_words``."""
    first = F.when(F.element_at(cut, 1) == "", 1).otherwise(0)
    last = F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)
    return (F.size(cut) - first - last).cast("bigint")


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """``item_id, gram`` (array of words) and ``g`` (a digest that names the gram) of each window of each item."""
    whole = F.filter(cut_words(F.col(text)), lambda w: w != "")
    items = benchmark.select(F.col(key).cast("string").alias("item_id"), whole.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    cut = items.select("item_id", "w", F.explode(starts).alias("at"))
    grams = cut.select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("gram")).distinct()
    return grams.withColumn("g", F.md5(F.array_join("gram", " ").cast("binary")))


def word_counts(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how often each word of the windows stands in the documents, if it does."""
    vocabulary = windows.select(F.explode("gram").alias("word")).distinct()
    corpus = docs.select(F.explode(cut_words(F.col(text))).alias("word"))
    if vocabulary.count() <= BLOCK:
        return corpus.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    return corpus.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct ``g, gram`` with ``word``, the rarest of the window, and ``place``, where it stands there.

    The earliest place wins a tie.  A window with a word that no document has cannot occur and is left out.
    """
    places = windows.select("g", "gram").distinct().select("g", "gram", F.posexplode("gram").alias("place", "word"))
    few = counts.count() <= BLOCK
    known = places.join(F.broadcast(counts) if few else counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = known.groupBy("g", "gram").agg(F.min(F.struct("n", "place", "word")).alias("best"))
    return best.filter("best.n > 0").select(
        "g", "gram", F.col("best.word").alias("word"), F.col("best.place").alias("place")
    )


def occurrences(docs: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each window found and one marker row (``g`` null) for each document."""
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = body.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), cut_words(F.col("text")).alias("w"))
    sized = cut.select("doc_id", "h", "w", count_words(F.col("w")).alias("n_words"))
    marked = sized.select("doc_id", "h", "w", "n_words", F.concat("w", F.array(F.lit(_END))).alias("marked"))
    found = marked.select("doc_id", "h", "w", "n_words", F.posexplode_outer("marked").alias("pos", "word"))
    start = F.col("pos") - F.col("place")
    there = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("gram")) == F.col("gram")
    held = F.col("gram").isNull() | ((start >= 0) & (start + F.size("gram") <= F.size("w")) & there)

    end = table.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("g"),
        F.lit(None).cast(table.schema["gram"].dataType).alias("gram"),
        F.lit(_END).alias("word"), F.lit(0).alias("place"),
    )
    blocks = max(1, -(-table.count() // BLOCK))
    block = F.pmod(F.xxhash64("word", "gram"), F.lit(blocks))
    union = None
    for b in range(blocks):
        part = table.filter(block == b) if blocks > 1 else table
        part = part.unionByName(end) if b == 0 else part
        hits = found.join(F.broadcast(part), "word").filter(held)
        rows = hits.select(
            "doc_id", "h", "n_words", "g", start.alias("start"), (start + F.size("gram")).alias("end")
        )
        union = rows if union is None else union.unionByName(rows)
    return union


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = WINDOW,
) -> DataFrame:
    """``doc_id, h, n_words, n_hit, items, contaminated`` of each row of ``docs``."""
    # written once: the windows are looked at several times, the counts cost a pass over all documents
    windows = stage(item_windows(benchmark, item, item_text, width), "item-windows")
    counts = stage(word_counts(docs, windows, text), "word-counts")
    table = stage(prefixes(windows, counts), "item-prefixes")
    span = F.when(F.col("g").isNotNull(), F.struct("start", "end"))
    # a document's spans and windows are no more than its words; written, as its windows are looked up once more
    rows = stage(
        occurrences(docs, table, key, text).groupBy("doc_id", "h").agg(
            F.max("n_words").alias("n_words"),
            F.count_if(F.col("g").isNull()).alias("copies"),
            F.collect_set(span).alias("spans"),
            F.collect_set("g").alias("grams"),
        ),
        "document-hits",
    )
    hit = rows.filter(F.size("grams") > 0).select("doc_id", "h", F.explode("grams").alias("g"))
    items = hit.join(windows.select("g", "item_id"), "g").groupBy("doc_id", "h").agg(F.collect_set("item_id").alias("items"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        F.sort_array("spans"),
        none,
        lambda a, s: F.struct(
            (a.n + F.greatest(s["end"] - F.greatest(s["start"], a.reach), F.lit(0))).alias("n"),
            F.greatest(a.reach, s["end"]).alias("reach"),
        ),
        lambda a: a.n.cast("bigint"),
    )
    named = null_safe_join(rows, items, ["doc_id", "h"])
    none_named = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    scored = named.select("doc_id", "h", "n_words", covered.alias("n_hit"), none_named, "copies")
    judged = scored.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
    every = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return every.drop("copy", "copies")
