"""Queries on rows: sources, filters, entities, balance, shards and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import date_to_epoch, date_year, year_week
from tidemark.functions.labels import decode_label, encode_label
from tidemark.functions.text_measures import polarity_deviation
from tidemark.operators import balance, filters, metrics, running, windows
from tidemark.plans.hot import hot_keys
from tidemark.plans.staging import new_path
from tidemark.registry.common import (
    DOC_MEASURES,
    REVIEWS,
    STREAM,
    STUMP,
    few_shards_sql,
    measured_reviews,
    reviews,
    stream,
    stump_predictions,
    table,
    with_ctes,
)
from tidemark.schemas import REVIEWS as REVIEWS_SCHEMA
from tidemark.sources import tables
from tidemark.sources.csv_records import read_csv_in_parallel
from pyspark.sql import types as T

SHARDS = 20
_COLUMNS = "review_id, user_id, product_id, rating, cents, label, doc_id"
_DAY = "year(ts) * 10000 + month(ts) * 100 + day(ts) as ymd"
_PLAIN = [c.strip() for c in _COLUMNS.split(",")]


def _ymd():
    return (F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")).alias("ymd")


def reviews_scan(spark, d):
    return reviews(spark, d).select(*_PLAIN, _ymd())


def csv_roundtrip(spark, d):
    path = new_path(spark, "csv")
    tables.write_csv(reviews(spark, d), path)
    return tables.read_csv(spark, path, REVIEWS_SCHEMA).select(*_PLAIN, _ymd())


def csv_line_breaks(spark, d):
    """Texts with line breaks and quotes through CSV, read in pieces; types as found in all rows."""
    path = new_path(spark, "csv-texts")
    tables.write_csv(table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text"), path)
    return read_csv_in_parallel(spark, path)


def _sharded(spark, d, shards=SHARDS):
    return balance.split_shards(reviews(spark, d), shards)


def shard_split(spark, d):
    return _sharded(spark, d).select("review_id", "shard", "pos")


def shard_read(spark, d):
    path = new_path(spark, "shards")
    tables.write_shards(_sharded(spark, d).select("review_id", "cents", "pos", "shard"), path)
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("review_id", "cents", "pos", "shard")]
    )
    return tables.read_shard(spark, path, schema, 3)


def feature_select(spark, d):
    flagged = reviews(spark, d).withColumn("is_fake", F.col("label") == "fake")
    return filters.select_features(flagged, ["rating", "cents", "is_fake"], ["review_id"])


def rating_filter(spark, d):
    r = reviews(spark, d)
    low = filters.rating_class(r, 4).select("review_id", "rating", F.lit(4).alias("mode"))
    return low.unionByName(filters.rating_class(r, 5).select("review_id", "rating", F.lit(5).alias("mode")))


def entity_filter(spark, d):
    return filters.of_entity(reviews(spark, d), {"product_id": 7, "rating": 3}).select(*_PLAIN)


def rating_domain(spark, d):
    # Made wrong on purpose for some rows: rating 6 and a missing product.
    r = reviews(spark, d).withColumns(
        {
            "rating": F.when(F.col("cents") % 10 == 0, 6).otherwise(F.col("rating")),
            "product_id": F.when(F.col("cents") % 10 != 1, F.col("product_id")),
        }
    )
    return running.usable_rows(r, ["product_id", "rating"]).select("review_id", "product_id", "rating")


def null_fill(spark, d):
    labels = table(spark, d, "labels")
    joined = table(spark, d, "documents").join(labels, "doc_id", "left")
    holed = joined.select(
        "doc_id", F.when(F.col("lang") != "en", F.col("source")).alias("source"), "quality", "toxic"
    )
    return filters.fill_missing(holed, ["source"])


def label_decode(spark, d):
    coded = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).alias("code")
    )
    return coded.select("doc_id", decode_label("code").alias("label"))


def label_encode(spark, d):
    named = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "fake").when(F.col("event_type") == "click", "nofake").alias("l"),
    )
    return named.select("event_id", encode_label("l").alias("label_num"))


def row_range(spark, d):
    return filters.row_range(stream(spark, d), 500, 1500).select("review_id", "pos")


def head_n(spark, d):
    return filters.first_rows(reviews(spark, d), 500).select("review_id")


def label_counts(spark, d):
    return balance.label_counts(reviews(spark, d))


def distinct_keys(spark, d):
    r = reviews(spark, d)
    users = r.select(F.lit("user").alias("entity"), F.col("user_id").alias("key"))
    products = r.select(F.lit("product").alias("entity"), F.col("product_id").cast("bigint").alias("key"))
    return users.unionByName(products).distinct()


def undersample(spark, d):
    return balance.undersample(reviews(spark, d), ["rating"]).select("review_id", "rating", "label")


def balanced_union(spark, d):
    return balance.balanced_union(reviews(spark, d)).select("review_id", "rating", "label")


def variance_filter(spark, d):
    r = reviews(spark, d).withColumn("constant", F.lit(3))
    return filters.varying_features(r, ["rating", "cents", "product_id", "constant"])


def _predictions(spark, d):
    return stump_predictions(reviews(spark, d))


def accuracy(spark, d):
    return metrics.accuracy(_predictions(spark, d))


def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_predictions(spark, d))


def class_metrics(spark, d):
    return metrics.class_metrics(_predictions(spark, d))


def macro_f1(spark, d):
    return metrics.macro_f1(_predictions(spark, d))


def shard_metrics(spark, d):
    return metrics.shard_metrics(stump_predictions(_sharded(spark, d), "shard"))


def report_line(spark, d):
    return metrics.report_line(_predictions(spark, d), "stump")


# ---- running features ------------------------------------------------------------------

_MEASURES = ("rating", "cents", "word_count", "char_counts")


def _user(spark, d, measures=("cents",), **kw):
    return running.entity_features(reviews(spark, d), ["user_id"], "user", measures, **kw)


def running_count(spark, d):
    return _user(spark, d).select("review_id", "tweet_num_user")


def running_fakes(spark, d):
    return running.running_totals(reviews(spark, d), ["user_id"], []).select(
        "review_id", F.col("_fakes").cast("bigint").alias("fakes")
    )


def was_spam(spark, d):
    return _user(spark, d, label_safe=True).select("review_id", "was_spam_user", "was_spam_prior_user")


def running_mean(spark, d):
    return _user(spark, d, ("cents", "rating")).select("review_id", "cents_avg_user", "rating_avg_user")


def running_higher(spark, d):
    return _user(spark, d).select("review_id", "cents_higher_user")


def running_weeks(spark, d):
    return _user(spark, d).select("review_id", "week_num_user")


def weekly_freq(spark, d):
    return _user(spark, d).select("review_id", "tweet_freq_week_user")


def _entity(keys, suffix, activity):
    def query(spark, d):
        # Looked for before the join with the texts, where it costs one narrow scan.
        hot = hot_keys(running.usable_rows(reviews(spark, d), keys), keys)
        made = running.entity_features(
            measured_reviews(spark, d), keys, suffix, _MEASURES, activity, hot=hot
        )
        return made.select("review_id", *[c for c in made.columns if c.endswith(f"_{suffix}")])

    return query


def running_variance(spark, d):
    s = stream(spark, d)
    return running.running_variance(s, ["rating", "cents", "product_id"]).select(
        "review_id", "keep_rating", "keep_cents", "keep_product_id"
    )


def sliding_accuracy(spark, d):
    s = stream(spark, d)
    predicted = F.coalesce(
        F.when(F.col("product_id") != 0, F.when(F.col("cents") >= 1500, "fake")), F.lit("nofake")
    )
    return windows.sliding_mean(s, F.col("label") == predicted, 500, "accuracy").select(
        "review_id", "pos", "accuracy"
    )


# ---- dates -----------------------------------------------------------------------------


def date_parse(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey",
        F.concat_ws("/", F.month("o_orderdate"), F.day("o_orderdate"), F.year("o_orderdate")).alias("text"),
    )
    return orders.select("o_orderkey", date_to_epoch("text").alias("epoch"), date_year("text").alias("year"))


def year_week_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", year_week("o_orderdate").alias("year_week"))


def deviation(spark, d):
    return reviews(spark, d).select(
        "review_id",
        polarity_deviation(F.col("cents").cast("double") / 100, "rating").alias("polarity_deviation"),
    )


_W = "partition by {k} order by ts, review_id rows between unbounded preceding and current row"
_WEEK = "cast(year(ts) as varchar) || cast(weekofyear(ts) as varchar)"


def _exact_sum(x: str) -> str:
    """The sum of doubles below 2**20 without rounding, as a whole number of units of 2**-72 in two parts."""
    upper = f"trunc({x} * 1048576.0::double)"
    lower = f"({x} - {upper} / 1048576.0::double) * 4722366482869645213696.0::double"
    return f"sum(cast({upper} as hugeint)) over w * 4503599627370496::hugeint + sum(cast({lower} as hugeint)) over w"


def entity_ctes(source: str, keys: str, suffix: str, measures, fractions=()) -> str:
    """SQL of the running columns of one entity, as CTEs ending in ``made_<suffix>``.

    Sums of ``fractions`` are exact; decimal digits are read as the nearest double.
    """
    totals = ", ".join(f"{_exact_sum(m) if m in fractions else f'sum({m}) over w'} as s_{m}" for m in measures)

    def total(m: str) -> str:
        if m in fractions:
            return f"(cast(cast(s_{m} as varchar) as double) / 4722366482869645213696.0::double)"
        return f"cast(s_{m} as double)"

    means = ", ".join(
        f"{total(m)} / n as {m}_avg_{suffix}, ({m} >= {total(m)} / n) as {m}_higher_{suffix}" for m in measures
    )
    extra = (
        f", n as tweet_num_{suffix}, case when fakes > 1 then 1 else 0 end as was_spam_{suffix}, "
        f"weeks as week_num_{suffix}, cast(n as double) / weeks as tweet_freq_week_{suffix}, "
        f"case when prior >= 1 then 1 else 0 end as was_spam_prior_{suffix}, fakes"
    )
    if "polarity_deviation" in measures:
        extra += f", polarity_deviation as polarity_deviation_{suffix}"
    return f"""flagged_{suffix} as (
  select *, case when row_number() over (partition by {keys}, {_WEEK} order by ts, review_id) = 1
            then 1 else 0 end as new_week
  from {source}),
totals_{suffix} as (
  select *, count(*) over w as n, {totals},
         sum(case when label = 'fake' then 1 else 0 end) over w as fakes,
         sum(case when label = 'fake' then 1 else 0 end) over w
           - case when label = 'fake' then 1 else 0 end as prior,
         sum(new_week) over w as weeks
  from flagged_{suffix} window w as ({_W.format(k=keys)})),
made_{suffix} as (select review_id, {means}{extra} from totals_{suffix})"""


def entity_sql(source: str, keys: str, suffix: str, measures, ctes: str, select: str) -> str:
    made = entity_ctes(source, keys, suffix, measures)
    return with_ctes(ctes, made, select=f"select {select} from made_{suffix}")


def _user_sql(select: str) -> str:
    return entity_sql("reviews", "user_id", "user", ("cents", "rating"), REVIEWS, select)


def _entity_columns(suffix: str, activity: bool) -> str:
    names = [f"{m}_{k}_{suffix}" for m in _MEASURES for k in ("avg", "higher")]
    if activity:
        names += [f"{a}_{suffix}" for a in running.ACTIVITY]
    return ", ".join(["review_id", *names])


def _balanced_sql(stratum: str) -> str:
    return with_ctes(
        REVIEWS,
        f"""drawn as (
  select *, row_number() over (partition by {stratum}, label
                               order by md5(cast(review_id as varchar) || '#1'), review_id) as rn
  from reviews),
sizes as (select {stratum} as stratum, label, count(*) as n from reviews group by all),
smallest as (select stratum, min(n) as target from sizes group by all)""",
        select=f"""select review_id, rating, label from drawn join smallest on smallest.stratum = ({stratum})
where rn <= target""",
    )


_CELLS = f"""preds as (select label as y, {STUMP} as y_pred from reviews),
cells as (
  select count(*) as n, count(*) filter (where y = y_pred) as hits,
         count(*) filter (where y = 'nofake' and y_pred = 'nofake') as nn,
         count(*) filter (where y = 'nofake' and y_pred = 'fake') as nf,
         count(*) filter (where y = 'fake' and y_pred = 'nofake') as fn,
         count(*) filter (where y = 'fake' and y_pred = 'fake') as ff
  from preds)"""


def _div(a: str, b: str) -> str:
    return f"coalesce(cast({a} as double) / nullif({b}, 0), 0)"


_F1N, _F1F = _div("2 * nn", "(2 * nn + nf + fn)"), _div("2 * ff", "(2 * ff + nf + fn)")
_PN, _PF = _div("nn", "(nn + fn)"), _div("ff", "(ff + nf)")
_RN, _RF = _div("nn", "(nn + nf)"), _div("ff", "(ff + fn)")
_ACC = _div("hits", "n")

QUERIES = {
    "reviews_scan": (reviews_scan, f"with {REVIEWS} select {_COLUMNS}, {_DAY} from reviews"),
    "csv_roundtrip": (csv_roundtrip, f"with {REVIEWS} select {_COLUMNS}, {_DAY} from reviews"),
    "shard_split": (
        shard_split,
        "with " + few_shards_sql(SHARDS) + " select review_id, shard, pos from sharded",
    ),
    "shard_read": (
        shard_read,
        "with " + few_shards_sql(SHARDS) + " select review_id, cents, pos, shard from sharded where shard = 3",
    ),
    "feature_select": (
        feature_select,
        f"""with {REVIEWS} select review_id, cast(rating as double) as rating, cast(cents as double) as cents,
        case when label = 'fake' then 1.0::double else 0.0::double end as is_fake from reviews""",
    ),
    "rating_filter": (
        rating_filter,
        f"with {REVIEWS} select review_id, rating, case when rating = 5 then 5 else 4 end as mode from reviews",
    ),
    "entity_filter": (
        entity_filter,
        f"with {REVIEWS} select {_COLUMNS} from reviews where product_id = 7 and rating = 3",
    ),
    "rating_domain": (
        rating_domain,
        f"""with {REVIEWS} select review_id, product_id, rating from reviews
        where cents % 10 not in (0, 1) and product_id is not null and rating between 1 and 5""",
    ),
    "null_fill": (
        null_fill,
        """select doc_id, case when lang <> 'en' then source else '' end as source,
        coalesce(quality, 0) as quality, coalesce(toxic, 0) as toxic
        from documents left join labels using (doc_id)""",
    ),
    "label_decode": (
        label_decode,
        """select doc_id, case when toxic = 1 then 'fake' when quality = 1 then 'nofake' end as label
        from labels""",
    ),
    "label_encode": (
        label_encode,
        """select event_id, case event_type when 'error' then 1 when 'click' then 0 end as label_num
        from events""",
    ),
    "row_range": (
        row_range,
        f"with {STREAM} select review_id, pos from stream where pos >= 500 and pos < 1500",
    ),
    "head_n": (
        head_n,
        f"with {REVIEWS} select review_id from reviews order by ts, review_id limit 500",
    ),
    "label_counts": (
        label_counts,
        f"with {REVIEWS} select label, count(*) as n from reviews group by label",
    ),
    "distinct_keys": (
        distinct_keys,
        f"""with {REVIEWS} select distinct 'user' as entity, user_id as key from reviews
        union all select distinct 'product', product_id from reviews""",
    ),
    "undersample": (undersample, _balanced_sql("rating")),
    "balanced_union": (balanced_union, _balanced_sql("rating = 5")),
    "variance_filter": (
        variance_filter,
        f"""with {REVIEWS} select 'rating' as feature, count(distinct rating) > 1 as kept from reviews
        union all select 'cents', count(distinct cents) > 1 from reviews
        union all select 'product_id', count(distinct product_id) > 1 from reviews
        union all select 'constant', false""",
    ),
    "accuracy": (accuracy, with_ctes(REVIEWS, _CELLS, select=f"select n, {_ACC} as accuracy from cells")),
    "confusion_matrix": (
        confusion_matrix,
        with_ctes(
            REVIEWS, _CELLS,
            select="""select 'nofake' as y, nn as pred_nofake, nf as pred_fake from cells
            union all select 'fake', fn, ff from cells""",
        ),
    ),
    "class_metrics": (
        class_metrics,
        with_ctes(
            REVIEWS, _CELLS,
            select=f"""select 'nofake' as label, {_PN} as precision, {_RN} as recall, {_F1N} as f1 from cells
            union all select 'fake', {_PF}, {_RF}, {_F1F} from cells""",
        ),
    ),
    "macro_f1": (
        macro_f1,
        with_ctes(
            REVIEWS, _CELLS,
            select=f"select round(({_F1N} + {_F1F}) / 2 * 100, 2) as macro_f1_pct from cells",
        ),
    ),
    "shard_metrics": (
        shard_metrics,
        "with " + few_shards_sql(SHARDS) + f""",
preds as (select shard, label as y, {STUMP} as y_pred from sharded),
cells as (
  select coalesce(shard, -1) as shard, count(*) as n, count(*) filter (where y = y_pred) as hits,
         count(*) filter (where y = 'nofake' and y_pred = 'nofake') as nn,
         count(*) filter (where y = 'nofake' and y_pred = 'fake') as nf,
         count(*) filter (where y = 'fake' and y_pred = 'nofake') as fn,
         count(*) filter (where y = 'fake' and y_pred = 'fake') as ff
  from preds group by rollup (shard))
select shard, n, hits, nn as nofake_as_nofake, nf as nofake_as_fake, fn as fake_as_nofake,
       ff as fake_as_fake, nn + nf as true_nofake, fn + ff as true_fake,
       nn + fn as pred_nofake, nf + ff as pred_fake, {_ACC} as accuracy,
       {_PN} as precision_nofake, {_RN} as recall_nofake, {_F1N} as f1_nofake,
       {_PF} as precision_fake, {_RF} as recall_fake, {_F1F} as f1_fake,
       ({_F1N} + {_F1F}) / 2 as macro_f1
from cells""",
    ),
    "report_line": (
        report_line,
        with_ctes(
            REVIEWS, _CELLS,
            select=f"""select '\\textsc{{stump}} & ' || printf('%.2f & %.2f & %.2f & %.2f',
              {_ACC} * 100, ({_F1N} + {_F1F}) / 2 * 100, {_F1N} * 100, {_F1F} * 100) || '\\\\' as latex,
              printf('n: %d, confusion: [[%d %d] [%d %d]], accuracy: %.4f, precision: [%.4f %.4f], '
                || 'recall: [%.4f %.4f], F1: [%.4f %.4f]', n, nn, nf, fn, ff, {_ACC}, {_PN}, {_PF},
                {_RN}, {_RF}, {_F1N}, {_F1F}) as text
            from cells""",
        ),
    ),
    "csv_line_breaks": (csv_line_breaks, "select doc_id, lang, n_chars, text from documents"),
    "running_count": (running_count, _user_sql("review_id, tweet_num_user")),
    "running_fakes": (running_fakes, _user_sql("review_id, fakes")),
    "was_spam": (was_spam, _user_sql("review_id, was_spam_user, was_spam_prior_user")),
    "running_mean": (running_mean, _user_sql("review_id, cents_avg_user, rating_avg_user")),
    "running_higher": (running_higher, _user_sql("review_id, cents_higher_user")),
    "running_weeks": (running_weeks, _user_sql("review_id, week_num_user")),
    "weekly_freq": (weekly_freq, _user_sql("review_id, tweet_freq_week_user")),
    "features_user": (
        _entity(["user_id"], "user", True),
        entity_sql("measured", "user_id", "user", _MEASURES, DOC_MEASURES, _entity_columns("user", True)),
    ),
    "features_product": (
        _entity(["product_id"], "product", False),
        entity_sql(
            "measured", "product_id", "product", _MEASURES, DOC_MEASURES,
            _entity_columns("product", False),
        ),
    ),
    "features_rating": (
        _entity(["product_id", "rating"], "rating", False),
        entity_sql(
            "measured", "product_id, rating", "rating", _MEASURES, DOC_MEASURES,
            _entity_columns("rating", False),
        ),
    ),
    "running_variance": (
        running_variance,
        f"""with {STREAM} select review_id,
        pos < 1 or min(rating) over w < max(rating) over w as keep_rating,
        pos < 1 or min(cents) over w < max(cents) over w as keep_cents,
        pos < 1 or min(product_id) over w < max(product_id) over w as keep_product_id
        from stream window w as (order by pos rows between unbounded preceding and current row)""",
    ),
    "sliding_accuracy": (
        sliding_accuracy,
        f"""with {STREAM} select review_id, pos,
        cast(sum(case when label = {STUMP} then 1 else 0 end) over w as double) / count(*) over w as accuracy
        from stream window w as (order by pos rows between 499 preceding and current row)""",
    ),
    "date_parse": (
        date_parse,
        """select o_orderkey, cast(epoch(date_trunc('day', o_orderdate)) as bigint) as epoch,
        cast(year(o_orderdate) as varchar) as year from orders""",
    ),
    "year_week": (
        year_week_key,
        """select o_orderkey, cast(year(o_orderdate) as varchar) || cast(weekofyear(o_orderdate) as varchar)
        as year_week from orders""",
    ),
    "polarity_deviation": (
        deviation,
        f"""with {REVIEWS} select review_id,
        abs(cast(cents as double) / 100 - (rating + 1) / 2.0::double * 5) as polarity_deviation from reviews""",
    ),
}
