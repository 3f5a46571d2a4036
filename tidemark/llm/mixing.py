"""Mixing sources to target weights over a tree of domains, languages and sources.

Budgets go down the tree in exact fractions: a node's tokens are shared among its children by
weight; a child that cannot use its share (its tokens times ``max_epochs``) gives the rest to
its siblings by their weights, and only what they cannot take either counts against the
parent, which is therefore never given more than its children can hold together.  So a
shortage is made good among siblings before it reaches an ancestor.

A leaf's tokens come from its epochs: each epoch holds all its documents in an order of its
own, by md5 of seed, epoch and key.  A leaf takes whole epochs as its budget allows, and of
the next one the longest prefix of documents which does not exceed it; with ``cut``, it also
takes the first words of the next document, so that its budget is met to the token (a fraction
of one is not dealt).  Where the prefix ends
is found without ordering a leaf: tokens are summed by the first digits of the hash, the digit
in which the prefix ends is looked at closer, and only its documents are ranked, so that a leaf with a
third of all rows is handled like any other.  Leaves and digits are small tables; only the
leaves' totals (``MAX_LEAVES`` at most) reach the driver.

A null name counts as the name ``""``.  Null or empty texts have no tokens, so they never end a
prefix; leaves without any tokens give no rows, nor does an empty table.  Rows equal in key,
text and leaf stand or fall together.  Children whose weights are all zero share alike what is
left to them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

MAX_LEAVES = 100_000
#: Hexadecimal digits of the hash which each closer look adds, and the number of looks.
DIGITS, LOOKS = 2, 3
LEVELS = ("domain", "lang", "source")
_WORD = re.compile(r"[^\t-\r ]+")


def word_tokens(text: Column) -> Column:
    """Words between white space."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r ]+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "))) + 1).cast("bigint")


def first_words(text: str, n: int) -> str:
    """``text`` up to the end of its word number ``n``."""
    end = 0
    for k, word in enumerate(_WORD.finditer(text)):
        if k == n:
            break
        end = word.end()
    return text[:end]


def share_out(budget: Fraction, children: Mapping[str, tuple[Fraction, Fraction]]) -> dict[str, Fraction]:
    """``budget`` among children (weight, capacity): by weight, what one cannot take goes to the others."""
    given = dict.fromkeys(children, Fraction(0))
    left = min(budget, sum((c for _, c in children.values()), Fraction(0)))
    open_children = {n for n, (_, c) in children.items() if c > 0}
    while left > 0 and open_children:
        weights = {n: children[n][0] for n in open_children}
        total = sum(weights.values())
        if not total:  # only children without weight are left: they share alike
            weights, total = dict.fromkeys(open_children, Fraction(1)), Fraction(len(open_children))
        full = {n for n in open_children if given[n] + left * weights[n] / total >= children[n][1]}
        if not full:
            for n in open_children:
                given[n] += left * weights[n] / total
            return given
        for n in full:
            left -= children[n][1] - given[n]
            given[n] = children[n][1]
        open_children -= full
    return given


def budgets(
    tokens: Mapping[tuple[str, ...], int],
    budget: int,
    weight: Callable[[tuple[str, ...]], Fraction],
    max_epochs: int,
) -> dict[tuple[str, ...], Fraction]:
    """Tokens for each leaf; ``weight`` is asked for a path from the root to a node."""
    depth = len(next(iter(tokens), ()))
    capacity: dict[tuple[str, ...], Fraction] = {}
    children: dict[tuple[str, ...], set] = {}
    for leaf, n in tokens.items():
        for k in range(depth + 1):
            capacity[leaf[:k]] = capacity.get(leaf[:k], Fraction(0)) + n * max_epochs
            if k:
                children.setdefault(leaf[: k - 1], set()).add(leaf[:k])
    given = {(): min(Fraction(budget), capacity.get((), Fraction(0)))}
    for level in range(depth):
        for node in [n for n in given if len(n) == level]:
            own = {c: (Fraction(weight(c)), capacity[c]) for c in sorted(children.get(node, ()))}
            given |= share_out(given[node], own)
    return {leaf: given[leaf] for leaf in tokens}


def _order(seed: int, whole: str = "whole", key: str = "doc_id", h: str = "h") -> Column:
    """Place of an item in the epoch ``whole``: md5 of seed, epoch, key and text hash."""
    parts = (F.lit(str(seed)), F.col(whole).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(h))
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _cut(rows: DataFrame, digits: int, before: str) -> DataFrame:
    """``leaf, at, left``: the digits in which each leaf's prefix ends, and the tokens left for it there."""
    sums = rows.groupBy("leaf", before, F.substring("place", 1, digits).alias("at")).agg(F.sum("size").alias("n"))
    running = F.sum("n").over(Window.partitionBy("leaf").orderBy("at"))  # at most 16**DIGITS rows a leaf
    ends = sums.withColumn("sum", running).filter((F.col("sum") > F.col(before)) & (F.col("sum") - F.col("n") <= F.col(before)))
    return ends.select("leaf", "at", (F.col(before) - F.col("sum") + F.col("n")).alias("left"))


def _prefix(rows: DataFrame, rest: str, cut: bool, level: int = 1) -> DataFrame:
    """The items of each leaf which stand in its prefix of ``rest`` tokens, by order of ``place``, and the tokens ``taken``.

    Only with ``cut`` an item is taken in part.
    After ``LOOKS`` closer looks of ``DIGITS`` digits each, one in 16**(LOOKS * DIGITS) items of a leaf is left to rank.
    """
    names = rows.columns
    if level > LOOKS:
        order = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        ranked = rows.withColumn("sum", F.sum("size").over(order))
        ranked = ranked.withColumn("taken", F.least("size", F.col(rest) - F.col("sum") + F.col("size")))
        inside = F.col("sum") <= F.col(rest)
        return ranked.filter(inside | (F.col("taken") > 0) if cut else inside).drop("sum")
    digits, left = level * DIGITS, f"rest{level}"
    ends = stage(_cut(rows, digits, rest), "prefix-ends").withColumnRenamed("left", left)
    placed = rows.join(F.broadcast(ends), "leaf", "left")  # a row a leaf
    own = F.substring("place", 1, digits)
    inside = placed.filter(F.col("at").isNull() | (own < F.col("at"))).select(*names, F.col("size").alias("taken"))
    closer = placed.filter(own == F.col("at")).drop("at")
    return inside.unionByName(_prefix(closer, left, cut, level + 1).select(*names, "taken"))


def selection(
    docs: DataFrame,
    path: list[Column],
    weight: Callable[[tuple[str, ...]], Fraction],
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 1,
    key: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
    cut: bool = False,
) -> DataFrame:
    """``doc_id, h, leaf, n_tokens, copies, whole, epochs`` of each selected document.

    With ``cut`` also ``part``: tokens of the document, all its copies together, which the leaf
    takes from the epoch after these.

    ``path``: the names from the root to a leaf.  ``budget``: all tokens of ``docs`` if not
    given.  ``epochs``: in how many epochs, from 0 on, the document stands in the mix.
    ``whole``: how many epochs its leaf takes as a whole.
    """
    if cut and tokens is not None:
        raise ValueError("documents are cut at words, so words must be counted")
    spark = docs.sparkSession
    names = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in path))
    counted = word_tokens(F.col(text)) if tokens is None else F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint"))
    body = docs.select(
        F.col(key).alias("doc_id"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("h"),
        names.alias("leaf"),
        counted.alias("n_tokens"),
    )
    items = stage(body.groupBy(*body.columns).agg(F.count("*").alias("copies")), "mix-items")
    size = (F.col("n_tokens") * F.col("copies")).alias("size")
    totals = items.groupBy("leaf").agg(F.sum(size).alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    by_leaf = {tuple(r.leaf): int(r.n) for r in totals if r.n}
    given = budgets(by_leaf, sum(by_leaf.values()) if budget is None else budget, weight, max_epochs)
    plan = [(list(leaf), int(b // by_leaf[leaf]), int(b % by_leaf[leaf])) for leaf, b in given.items()]
    schema = "leaf array<string>, whole int, rest bigint"
    planned = items.join(F.broadcast(spark.createDataFrame(plan, schema)), "leaf").withColumn("size", size)
    partial = planned.filter("rest > 0").withColumn("place", _order(seed))
    extra = _prefix(partial, "rest", cut).select(*planned.columns, "taken")
    full = F.col("taken") == F.col("size")
    extra = extra.withColumns({"epochs": F.when(full, 1).otherwise(0), "part": F.when(full, 0).otherwise(F.col("taken"))}).drop("taken")
    whole = planned.filter("whole > 0").withColumns({"epochs": F.col("whole"), "part": F.lit(0).cast("bigint")})
    sums = [F.sum("epochs").cast("int").alias("epochs"), F.sum("part").alias("part")]
    both = whole.unionByName(extra).groupBy("leaf", "doc_id", "h", "n_tokens", "copies", "whole").agg(*sums)
    return both.select("doc_id", "h", "leaf", "n_tokens", "copies", "whole", "epochs", *(["part"] if cut else []))


def _shares(part: str, n_tokens: str) -> Column:
    """Tokens of each copy of which ``part`` holds some."""
    copies = F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col(part) / F.col(n_tokens)))
    return F.transform(copies, lambda c: F.least(F.col(n_tokens), F.col(part) - (c - 1) * F.col(n_tokens)))


def _parts(selected: DataFrame) -> DataFrame:
    """A row for each copy of which ``part`` holds some tokens, with their number as ``taken``."""
    return selected.filter("part > 0").withColumn("taken", F.explode(_shares("part", "n_tokens")))


def mix(selected: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``doc_id``, the names of the path, ``epoch`` and ``n_tokens``: a row for each time a row, or a part of it, stands in the mix."""
    names = [F.col("leaf")[k].alias(level) for k, level in enumerate(levels)]
    each = selected.filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    every = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    rows = every.select("doc_id", *names, "epoch", "n_tokens")
    if "part" not in selected.columns:
        return rows
    return rows.unionByName(_parts(selected).select("doc_id", *names, F.col("epochs").alias("epoch"), F.col("taken").alias("n_tokens")))


def _ends(selected: DataFrame, seed: int) -> DataFrame:
    """A row a leaf: whole epochs, place of the last item taken once more, place and tokens of the item taken in part."""
    placed = selected.withColumn("place", _order(seed))
    once_more = F.max(F.when(F.col("epochs") > F.col("whole"), F.col("place")))
    found = [F.max("whole").alias("whole"), once_more.alias("last")]
    if "part" not in selected.columns:
        return placed.groupBy("leaf").agg(*found, F.lit(None).cast("string").alias("at"), F.array().cast("array<bigint>").alias("parts"))
    cut = F.max(F.when(F.col("part") > 0, F.struct("place", "part", "n_tokens"))).alias("cut")  # an item a leaf
    ends = placed.groupBy("leaf").agg(*found, cut)
    return ends.select("leaf", "whole", "last", F.col("cut.place").alias("at"), _shares("cut.part", "cut.n_tokens").alias("parts"))


def mixed_documents(
    docs: DataFrame, selected: DataFrame, path: list[Column], key: str = "doc_id", text: str = "text", seed: int = 1
) -> DataFrame:
    """The rows of ``docs`` which were selected, once for each epoch, and the first words of those taken in part.

    ``seed`` is that of the selection.  An epoch taken in part is a beginning of its order, so where it ends,
    a row a leaf, tells for each document whether it is in: texts stay where they are, and only the rows equal
    to the items which are cut, one a leaf, are exchanged.
    """
    own = {"leaf": "__leaf", "whole": "__whole", "last": "__last", "at": "__at", "parts": "__parts"}
    ends = stage(_ends(selected, seed), "mix-ends").withColumnsRenamed(own)  # MAX_LEAVES rows at most
    names = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in path))
    marked = docs.withColumns({"__h": F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), "__leaf": names})
    placed = marked.join(F.broadcast(ends), "__leaf").withColumn("__place", _order(seed, "__whole", key, "__h"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once_more = F.coalesce((F.col("__place") <= F.col("__last")).cast("int"), F.lit(0))
    times = placed.withColumn("__times", F.col("__whole") + once_more).filter("__times > 0")
    kept = times.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*columns)
    if "part" not in selected.columns:
        return kept
    # of rows equal in key, text and leaf any
    cut = placed.filter("__place = __at").dropDuplicates(["__leaf", "__place"]).withColumn("__taken", F.explode("__parts"))
    return kept.unionByName(cut.withColumn(text, F.udf(first_words, "string")(F.col(text), "__taken")).select(*columns))
