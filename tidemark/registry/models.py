"""Queries on learners, drift and whole experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import balance, bayes, closed_loop, drift, grid, hoeffding, metrics, running, trees
from tidemark.functions import text_measures as M
from tidemark.operators import lexicon as L
from tidemark.operators import ngrams as N
from tidemark.operators.tree_model import candidates_of, settings_of
from tidemark.plans.pipeline import balanced_features, text_features
from tidemark.plans.scan import with_position
from tidemark.plans.staging import new_path, stage
from tidemark.registry.common import (
    FEW_SHARDS,
    GRAMS,
    STREAM,
    STUMP,
    few_shards_sql,
    reviews,
    stream,
    texts,
    with_ctes,
)
from tidemark.registry.text import TAIL
from tidemark.schemas import ENTITIES, TEXT_MEASURES, running_columns
from tidemark.sources import tables

FEATURES = ("cents", "rating")
SHARDS = 20
FIXED = drift.DriftSettings(adaptive=False)


def prequential_nb(spark, d):
    return bayes.prequential(stream(spark, d), FEATURES)


def one_experiment(spark, d):
    made = bayes.prequential(stream(spark, d), FEATURES, keep=[])
    return metrics.summary(made)


def _shards(spark, d, n):
    return balance.split_shards(reviews(spark, d), n)


def shard_experiment(spark, d):
    made = bayes.prequential(_shards(spark, d, SHARDS), FEATURES, ["shard"], keep=[])
    return metrics.shard_metrics(made)


CANDIDATES = [
    bayes.Candidate(**setting)
    for setting in grid.combinations(
        {"var_floor": [bayes.VAR_FLOOR, 250_000.0], "features": [("cents",), ("rating",), ("cents", "rating")]}
    )
]


def grid_replay(spark, d):
    return bayes.replay(_shards(spark, d, SHARDS), CANDIDATES, ["shard"])


def best_candidate(spark, d):
    return bayes.best_candidate(grid_replay(spark, d), ["shard"])


def hoeffding_split(spark, d):
    bins = {
        "rating": F.col("rating"),
        "cents": F.least(F.floor(F.col("cents") / 500), F.lit(9)),
        "product_id": F.floor(F.col("product_id") / 10),
        "hour": F.hour("ts"),
    }
    made = hoeffding.split_decision(reviews(spark, d), bins)
    return made.select(
        "feature", "n", F.round("gain", 6).alias("gain"), F.round("bound", 6).alias("bound"), "split"
    )


# ---- drift -----------------------------------------------------------------------------


def drift_input(spark, d, shards=FEW_SHARDS):
    """Hits of the one-level rule and the n-grams of each review's text, per shard.

    Texts are shared between reviews here, so each is cut into n-grams once.
    """
    rows = _shards(spark, d, shards).select("shard", "pos", "doc_id", "label", "product_id", "cents", "rating")
    docs = texts(spark, d, "documents").select("doc_id", "text")
    first = rows.where(F.col("pos") < N.COLD_START).join(docs, "doc_id")
    vocab = N.vocabulary(first, group=["shard"])
    counts = N.vocabulary_counts(docs, vocab.select("term").distinct(), ["doc_id"])
    per_shard = rows.select("shard", "doc_id").distinct().join(counts, "doc_id")
    terms = drift.sparse_terms(per_shard, vocab, ["shard", "doc_id"], ["shard"])
    right = F.when((F.col("product_id") == 0) | (F.col("cents") < 1500), "nofake").otherwise("fake")
    hit = (F.col("label") == right).cast("int").alias("hit")
    hits = rows.select("shard", "pos", "doc_id", "label", "cents", "rating", hit)
    return hits.join(terms, ["shard", "doc_id"], "left"), vocab


_SHOWN = ["shard", "index", "acc_static", "acc_dynamic", "gap", "n_terms", "triggered"]


def _rounded(log):
    return log.select(
        *_SHOWN, F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value")
    )


def drift_fixed(spark, d):
    return _rounded(drift.drift_fixed(*drift_input(spark, d), FIXED))


def drift_adaptive(spark, d):
    return drift.drift_adaptive(*drift_input(spark, d))


def drift_log(spark, d):
    path = new_path(spark, "drift-log")
    tables.write_drift_log(drift.drift_fixed(*drift_input(spark, d), FIXED), path, "fixed")
    return _rounded(tables.read_drift_log(spark, path, "fixed"))


def model_epochs(spark, d):
    return drift.model_epochs(drift.drift_fixed(*drift_input(spark, d), FIXED))


# ---- incremental trees -----------------------------------------------------------------

USER_FEATURES = ["cents_avg_user", "cents_higher_user", "tweet_num_user", "tweet_freq_week_user"]


def _learner_rows(spark, d):
    made = running.entity_features(reviews(spark, d), ["user_id"], "user", ["cents"])
    columns = ["review_id", "ts", "doc_id", "label", "cents", "rating", *USER_FEATURES]
    return with_position(made.select(*columns), ["ts", "review_id"], label="learner-rows")


def _tree_run(spark, d, model, params, keep=()):
    features = ["cents", "rating", *USER_FEATURES]
    return trees.prequential(_learner_rows(spark, d), features, settings_of(model, params, len(features)), keep)


def prequential_block(spark, d):
    """An incremental tree over the whole stream."""
    made = _tree_run(spark, d, "htc", {"max_depth": 50, "tie_threshold": 0.5, "max_size": 50}, ["review_id"])
    return made.predictions.drop("shard")


def prequential_adaptive(spark, d):
    """An adaptive tree, whose subtrees are replaced where their errors rise."""
    made = _tree_run(spark, d, "hatc", {"max_depth": 50, "tie_threshold": 0.5, "max_size": 50}, ["review_id"])
    return made.predictions.drop("shard")


def prequential_forest(spark, d):
    """An adaptive forest; scores of the whole stream."""
    return metrics.summary(_tree_run(spark, d, "arfc", {"n_models": 10, "max_features": 3, "lambda_value": 6}).predictions.drop("shard"))


# ---- closed loop -----------------------------------------------------------------------


def _walked(spark, d, shards):
    rows, vocab = drift_input(spark, d, shards)
    return stage(closed_loop.walk(rows, vocab, FEATURES, CANDIDATES), "walked")


def drift_experiment(spark, d):
    """One stream: predictions, tests, retraining at the trigger; scores and number of drifts."""
    return metrics.shard_metrics(closed_loop.predictions(_walked(spark, d, 1)), F.col("triggered"))


def shard_drift_experiment(spark, d):
    """The same for all shards at once."""
    return metrics.shard_metrics(closed_loop.predictions(_walked(spark, d, FEW_SHARDS)), F.col("triggered"))


def closed_loop_log(spark, d):
    return closed_loop.drift_log(_walked(spark, d, FEW_SHARDS))


def closed_loop_epochs(spark, d):
    return closed_loop.epochs(_walked(spark, d, FEW_SHARDS))


def whole_candidates():
    """As many settings as the trees' grid has: parts of the features times variance floors."""
    parts = {"text": ("rating", "word_count", *TEXT_MEASURES), **{s: running_columns(s) for s in ENTITIES}}
    subsets = [
        tuple(f for name in chosen for f in parts[name])
        for chosen in (
            ("text",), ("user",), ("product",), ("rating",), ("text", "user"), ("text", "product"),
            ("user", "product"), tuple(parts),
        )
    ]
    floors = [10.0**-k for k in range(9)]
    return [bayes.Candidate(**c) for c in grid.combinations({"var_floor": floors, "features": subsets})]


WHOLE_FEATURES = ("rating", "word_count", *TEXT_MEASURES, *[c for s in ENTITIES for c in running_columns(s)])


def whole_rows(spark, d, shards):
    """From raw reviews to balanced shards with all 160 features; and the cleaned texts."""
    docs = texts(spark, d, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review"), M.word_count("text").alias("word_count")
    )
    measured = text_features(docs, L.default_lexicon(spark)).drop("review").withColumnRenamed("review_id", "doc_id")
    measured = stage(measured, "text-features")
    numbers = measured.select("doc_id", "word_count", *TEXT_MEASURES)
    rows = balanced_features(reviews(spark, d).join(numbers, "doc_id"), shards)
    return rows, measured.select("doc_id", F.coalesce("text_preprocessed", F.lit("")).alias("text"))


def whole_experiment(spark, d, shards=FEW_SHARDS):
    """From raw reviews to scores per shard: text stage, running features, balance, shards,
    null fill, variance selector, drift handling on n-grams of the cleaned text, 160 features."""
    rows, cleaned = whole_rows(spark, d, shards)
    first = rows.where(F.col("pos") < N.COLD_START).select("shard", "doc_id").join(cleaned, "doc_id")
    vocab = N.vocabulary(first, group=["shard"])
    counts = N.vocabulary_counts(cleaned, vocab.select("term").distinct(), ["doc_id"])
    per_shard = rows.select("shard", "doc_id").distinct().join(counts, "doc_id")
    terms = drift.sparse_terms(per_shard, vocab, ["shard", "doc_id"], ["shard"])
    walked = closed_loop.walk(rows.join(terms, ["shard", "doc_id"], "left"), vocab, WHOLE_FEATURES, whole_candidates())
    return metrics.shard_metrics(closed_loop.predictions(stage(walked, "walked")), F.col("triggered"))


#: A tree which may grow, of the grid's own values.
GROWING = {"max_depth": 50, "tie_threshold": 0.5, "max_size": 50, "remove_poor_attrs": True}


def tree_experiment(spark, d):
    """One stream of balanced reviews, all 160 features, a growing tree: scores of the stream."""
    rows, _ = whole_rows(spark, d, 1)
    made = trees.prequential(rows, WHOLE_FEATURES, settings_of("htc", GROWING, len(WHOLE_FEATURES)))
    return metrics.summary(made.predictions.drop("shard"))


def shard_tree_experiment(spark, d):
    """The same in 20 shards, each with a tree of its own: scores per shard and of all."""
    rows, _ = whole_rows(spark, d, SHARDS)
    made = trees.prequential(rows, WHOLE_FEATURES, settings_of("htc", GROWING, len(WHOLE_FEATURES)), first=100)
    return metrics.shard_metrics(made.predictions)


def tree_grid_replay(spark, d):
    """All 72 settings of the trees' grid, tested and trained side by side on 20 shards."""
    settings = candidates_of("htc", grid.combinations(grid.TREE_RANGES), 2 + len(USER_FEATURES))
    made = running.entity_features(reviews(spark, d), ["user_id"], "user", ["cents"])
    rows = balance.split_shards(made.select("review_id", "ts", "label", "cents", "rating", *USER_FEATURES), SHARDS)
    return trees.replay_grid(rows, ["cents", "rating", *USER_FEATURES], settings, first=100)


# ---- SQL -------------------------------------------------------------------------------


def _bayes_stats(source: str, group: str) -> str:
    sums = []
    for label in ("nofake", "fake"):
        sums.append(f"count(*) filter (where label = '{label}') over w as n_{label}")
        for f in FEATURES:
            sums.append(f"sum({f}) filter (where label = '{label}') over w as s_{f}_{label}")
            sums.append(f"sum({f}::hugeint * {f}) filter (where label = '{label}') over w as q_{f}_{label}")
    part = f"partition by {group} " if group else ""
    return f"""stats as (select *, {", ".join(sums)} from {source}
  window w as ({part}order by pos rows between unbounded preceding and 1 preceding))"""


def _score(label: str, features, floor: float) -> str:
    out = f"ln(n_{label}::double)"
    for f in features:
        mean = f"(s_{f}_{label}::double / n_{label})"
        n, s, q = f"n_{label}", f"s_{f}_{label}", f"q_{f}_{label}"
        m = f"floor({s}::double / {n})::hugeint"
        rest = f"(({s} - {n} * {m})::double / {n})"
        around = f"({q} - 2 * {s} * {m} + {n} * {m} * {m})::double / {n}"
        var = f"greatest({around} - {rest} * {rest}, {floor!r}::double)"
        out += f" - 0.5::double * ln({var}) - ({f} - {mean}) * ({f} - {mean}) / (2.0::double * {var})"
    return out


def _vote(features, floor: float = bayes.VAR_FLOOR) -> str:
    return (
        f"case when n_nofake > 0 and n_fake > 0 and {_score('fake', features, floor)} > "
        f"{_score('nofake', features, floor)} then 'fake' else 'nofake' end"
    )


def _summary(select: str, source: str, group: str = "") -> str:
    d = lambda a, b: f"coalesce(cast({a} as double) / nullif({b}, 0), 0)"
    pn, pf, rn, rf = d("nn", "(nn + fn)"), d("ff", "(ff + nf)"), d("nn", "(nn + nf)"), d("ff", "(ff + fn)")
    f1n, f1f = d("2 * nn", "(2 * nn + nf + fn)"), d("2 * ff", "(2 * ff + nf + fn)")
    return f"""cells as (
  select {select} count(*) as n, count(*) filter (where y = y_pred) as hits,
         count(*) filter (where y = 'nofake' and y_pred = 'nofake') as nn,
         count(*) filter (where y = 'nofake' and y_pred = 'fake') as nf,
         count(*) filter (where y = 'fake' and y_pred = 'nofake') as fn,
         count(*) filter (where y = 'fake' and y_pred = 'fake') as ff
  from {source} {group}),
scored as (select * exclude (nn, nf, fn, ff), nn as nofake_as_nofake, nf as nofake_as_fake,
  fn as fake_as_nofake, ff as fake_as_fake, nn + nf as true_nofake, fn + ff as true_fake,
  nn + fn as pred_nofake, nf + ff as pred_fake, {d("hits", "n")} as accuracy,
  {pn} as precision_nofake, {rn} as recall_nofake, {f1n} as f1_nofake,
  {pf} as precision_fake, {rf} as recall_fake, {f1f} as f1_fake, ({f1n} + {f1f}) / 2 as macro_f1
  from cells)"""


_PREDS = f"preds as (select *, label as y, {_vote(FEATURES)} as y_pred from stats)"

_REPLAY = (
    few_shards_sql(SHARDS),
    _bayes_stats("sharded", "shard"),
    "votes as ("
    + " union all ".join(
        f"select shard, {i} as grid_pos, count(*) filter (where label = {_vote(c.features, c.var_floor)}) as hits, "
        f"count(*) as n from stats group by shard"
        for i, c in enumerate(CANDIDATES)
    )
    + ")",
    "scores as (select *, hits::double / n as accuracy from votes)",
)

_DRIFT = (
    few_shards_sql(),
    GRAMS,
    f"""vocab as (
  select shard, term from sharded join counts using (doc_id) where pos < 500 group by all
  having count(*) >= 0.1 * 500 and count(*) <= 0.7 * 500)""",
    f"""hits as (
  select shard, pos, doc_id, case when label = {STUMP} then 1 else 0 end as hit from sharded)""",
    """grid as (
  select h.shard, h.pos, h.doc_id, v.term from hits h join vocab v on v.shard = h.shard)""",
    """cells as (
  select g.shard, g.pos, g.term, coalesce(c.cnt, 0) as cnt
  from grid g left join counts c on c.doc_id = g.doc_id and c.term = g.term)""",
    """base as (select shard, term, sum(cnt)::double as a from cells where pos < 500 group by all)""",
    """dynamic as (
  select shard, pos, term,
         sum(cnt) over (partition by shard, term order by pos rows between 499 preceding and current row)::double as b
  from cells)""",
    """usable as (
  select d.shard, d.pos, a, b from dynamic d join base s on s.shard = d.shard and s.term = d.term
  where d.pos >= 500 and a >= 6 and b >= 6)""",
    """margins as (select shard, pos, sum(a) as ta, sum(b) as tb, count(*) as m from usable group by all)""",
    """parts as (
  select shard, pos, m, (a + b) * ta / (ta + tb) as ea, (a + b) * tb / (ta + tb) as eb,
         abs(a - (a + b) * ta / (ta + tb)) as g
  from usable join margins using (shard, pos))""",
    """stats as (
  select shard, pos, any_value(m) as n_terms,
         sum((case when m = 2 then g - least(0.5, g) else g end) ** 2 / ea
           + (case when m = 2 then g - least(0.5, g) else g end) ** 2 / eb) as x
  from parts group by all)""",
    """accs as (
  select shard, pos, avg(hit) over (partition by shard order by pos rows between 499 preceding and current row)
         as acc_dynamic,
         avg(hit) filter (where pos < 500) over (partition by shard) as acc_static
  from hits)""",
    """joined as (
  select a.shard, a.pos + 1 as index, acc_static, acc_dynamic, abs(acc_static - acc_dynamic) as gap,
         coalesce(n_terms, 0) as n_terms, greatest(coalesce(n_terms, 0) - 1, 0) as k, coalesce(x, 0) as x
  from accs a left join stats s on s.shard = a.shard and s.pos = a.pos where a.pos >= 500)""",
    f"tested as (select *, {TAIL} as p from joined)",
    """logged as (
  select shard, index, acc_static, acc_dynamic, gap, n_terms, round(x, 6) as statistic, round(p, 6) as p_value,
         case when (gap >= 0.05 and p <= 0.05) or index = 501 then 1 else 0 end as triggered
  from tested)""",
)

_DRIFT_SQL = with_ctes(*_DRIFT, select="select * from logged")

_ENTROPY = (
    "(case when {p} > 0 then -({p}::double / {t}) * log2({p}::double / {t}) else 0 end + "
    "case when {t} - {p} > 0 then -(({t} - {p})::double / {t}) * log2(({t} - {p})::double / {t}) else 0 end)"
)

QUERIES = {
    "prequential_nb": (
        prequential_nb,
        with_ctes(STREAM, _bayes_stats("stream", ""), _PREDS, select="select review_id, pos, y, y_pred from preds"),
    ),
    "one_experiment": (
        one_experiment,
        with_ctes(STREAM, _bayes_stats("stream", ""), _PREDS, _summary("", "preds"), select="select * from scored"),
    ),
    "shard_experiment": (
        shard_experiment,
        with_ctes(
            few_shards_sql(SHARDS), _bayes_stats("sharded", "shard"), _PREDS,
            _summary("coalesce(shard, -1) as shard,", "preds", "group by rollup (shard)"),
            select="select * from scored",
        ),
    ),
    "grid_replay": (
        grid_replay, with_ctes(*_REPLAY, select="select shard, n, grid_pos, hits, accuracy from scores"),
    ),
    "best_candidate": (
        best_candidate,
        with_ctes(
            *_REPLAY,
            select="""select shard, n, grid_pos, hits, accuracy from scores
            qualify row_number() over (partition by shard order by hits desc, grid_pos) = 1""",
        ),
    ),
    "hoeffding_split": (
        hoeffding_split,
        f"""with {STREAM},
        long as (
          select label, 'rating' as feature, rating as bin from reviews
          union all select label, 'cents', least(cents // 500, 9) from reviews
          union all select label, 'product_id', product_id // 10 from reviews
          union all select label, 'hour', hour(ts) from reviews),
        bins as (select feature, bin, count(*) as t, count(*) filter (where label = 'fake') as p
                 from long group by all),
        sums as (select feature, sum(t) as n, sum(p) as np,
                        sum(t * {_ENTROPY.format(p='p', t='t')}) as within from bins group by feature),
        gains as (select feature, n, {_ENTROPY.format(p='np', t='n')} - within / n as gain,
                         sqrt(ln(1e7::double) / (2.0 * n)) as bound from sums),
        ranked as (select *, row_number() over (order by round(gain, 9) desc, feature) as r,
                          max(gain) over () as best from gains),
        two as (select *, coalesce(max(gain) filter (where r = 2) over (), 0) as second from ranked)
        select feature, n, round(gain, 6) as gain, round(bound, 6) as bound,
               r = 1 and (best - second > bound or bound < 0.05) as split from two""",
    ),
    "drift_fixed": (drift_fixed, _DRIFT_SQL),
    "drift_log": (drift_log, _DRIFT_SQL),
    "drift_adaptive": (drift_adaptive, None),
    "prequential_block": (prequential_block, None),
    "prequential_adaptive": (prequential_adaptive, None),
    "prequential_forest": (prequential_forest, None),
    "tree_experiment": (tree_experiment, None),
    "shard_tree_experiment": (shard_tree_experiment, None),
    "tree_grid_replay": (tree_grid_replay, None),
    "drift_experiment": (drift_experiment, None),
    "shard_drift_experiment": (shard_drift_experiment, None),
    "closed_loop_log": (closed_loop_log, None),
    "closed_loop_epochs": (closed_loop_epochs, None),
    "whole_experiment": (whole_experiment, None),
    "model_epochs": (
        model_epochs,
        with_ctes(
            *_DRIFT,
            select="""select shard, count(*) over w as version, index - 500 as train_from, index as train_to,
            lead(index) over (partition by shard order by index) as used_to
            from logged where triggered = 1
            window w as (partition by shard order by index rows unbounded preceding)""",
        ),
    ),
}
