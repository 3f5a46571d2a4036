"""Queries on texts: cleaning, measures, lexicons and n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import text_measures as M
from tidemark.functions import words as W
from tidemark.operators import lemma_rules as R
from tidemark.operators import lexicon as L
from tidemark.operators import ngrams as N
from tidemark.operators import tagger as G
from tidemark.plans.staging import stage
from tidemark.registry.common import GRAMS, document_places, table, texts, with_ctes

WINDOW = 250
STEP = 50


def _docs(spark, d):
    return texts(spark, d, "documents").select("doc_id", "text")


def word_count(spark, d):
    return _docs(spark, d).select(
        "doc_id", M.word_count("text").alias("word_count"), M.char_count("text").alias("char_counts")
    )


def url_count(spark, d):
    return texts(spark, d, "pages").select("page_id", M.url_count("html").alias("urls"))


def strip_links(spark, d):
    pages = texts(spark, d, "pages").select("page_id", X.strip_links("html").alias("stripped"))
    docs = _docs(spark, d).select((-F.col("doc_id") - 1).alias("page_id"), X.strip_links("text").alias("stripped"))
    return pages.unionByName(docs)


def strip_symbols(spark, d):
    return _docs(spark, d).select("doc_id", X.strip_symbols("text").alias("stripped"))


def stopwords(spark, d):
    return _docs(spark, d).select("doc_id", X.drop_stop_words("text").alias("kept"))


def lemma_map(spark, d):
    return _docs(spark, d).select("doc_id", X.lemmatize("text").alias("lemmas"))


def _forms(spark, d):
    """Forms among the words which occur twice or more; the others are left to the rules."""
    words = _docs(spark, d).select(F.explode(X.tokens("text")).alias("word")).groupBy("word")
    attested = words.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("word")
    return stage(R.forms_in(stage(attested, "vocabulary")), "forms")


def lemma_rules(spark, d):
    """Suffix rules learned from the vocabulary of the documents, whose own words are the lemmas."""
    return R.learn_rules(_forms(spark, d))


def lemma_learned(spark, d):
    """Words of each document under their learned lemmas."""
    forms = _forms(spark, d)
    rules = stage(R.learn_rules(forms), "lemma-rules")
    return R.lemma_counts(_docs(spark, d), rules, R.learn_exceptions(forms, rules), "doc_id")


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", X.clean_text("text").alias("text_preprocessed"))


def flesch(spark, d):
    counted = _docs(spark, d).select(
        "doc_id",
        M.lexical_words("text").alias("words"),
        M.sentences("text").alias("sentences"),
        M.syllables("text").alias("syllables"),
    )
    ease = M.flesch_reading_ease(F.col("words"), F.col("sentences"), F.col("syllables"))
    return counted.withColumn("flesch_reading_ease", ease)


def mcalpine(spark, d):
    counted = _docs(spark, d).select(
        "doc_id",
        M.lexical_words("text").alias("words"),
        M.short_words("text").alias("short_words"),
        M.sentences("text").alias("sentences"),
    )
    eflaw = M.mcalpine_eflaw(F.col("words"), F.col("short_words"), F.col("sentences"))
    return counted.withColumn("mcalpine_eflaw", eflaw)


def reading_time(spark, d):
    return _docs(spark, d).select("doc_id", M.reading_time("text").alias("reading_time"))


def difficult_words(spark, d):
    return L.difficult_word_rows(_docs(spark, d), "doc_id")


def lexicon_join(spark, d):
    matched = L.lexicon_matches(_docs(spark, d), L.default_lexicon(spark), "doc_id")
    return matched.select("doc_id", "word", "times", "score", "tag")


def _looked_up(spark, d):
    return L.text_lexicon_features(_docs(spark, d), L.default_lexicon(spark), "doc_id")


def emotion_share(spark, d):
    return _looked_up(spark, d).select("doc_id", *W.EMOTIONS)


def polarity(spark, d):
    return _looked_up(spark, d).select("doc_id", "polarity")


def pos_share(spark, d):
    return _looked_up(spark, d).select("doc_id", *[f"pos_prop_{t}" for t in W.TAGS])


def pos_decoded(spark, d):
    """Tags by best paths; the chain is learned from the look-up's tags of the same documents.

    ``n_same`` counts the words whose tag is that of the look-up.
    """
    lexicon = L.default_lexicon(spark)
    look_up = L.inline_counts(lexicon)["_tags"]
    names = F.array(*[F.lit(t) for t in W.TAGS])
    cut = _docs(spark, d).select("doc_id", X.tokens("text").alias("words"))
    coded = cut.withColumn("tags", F.transform(look_up(F.col("words")), lambda k: F.get(names, k)))
    tagged = stage(coded, "tagged")
    model = G.learn(tagged)
    decoded = tagged.withColumn("found", G.decode(model, "words"))
    same = F.filter(F.zip_with("tags", "found", lambda a, b: a == b), lambda x: x)
    counts = [G.times_found("found", t).alias(f"n_{t}") for t in W.TAGS if t != "punct"]
    return decoded.select("doc_id", F.size("words").alias("n_words"), F.size(same).alias("n_same"), *counts)


def tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.tokens("text"), " ").alias("tokens"))


def ngrams(spark, d):
    return N.term_rows(_docs(spark, d), ["doc_id"])


def _vocabulary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return N.vocabulary(docs.orderBy("doc_id").limit(N.COLD_START))


def ngram_vocab(spark, d):
    return _vocabulary(spark, d)


def _counts(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", "text")
    counts = N.vocabulary_counts(docs, _vocabulary(spark, d), ["doc_id"])
    return counts.join(document_places(spark, d), "doc_id")


def ngram_counts(spark, d):
    return _counts(spark, d).select("doc_id", "term", "cnt")


def ngram_window_sum(spark, d):
    return N.window_sums(_counts(spark, d), WINDOW)


def ngram_prefix(spark, d):
    return N.prefix_totals(_counts(spark, d), STEP).select("term", "step", "here", "prefix")


def chi2_stat(spark, d):
    # Read twice below: by every window, and as the window compared with.
    sums = stage(N.window_sums(_counts(spark, d), WINDOW), "window-sums")
    first = sums.where(F.col("win") == 0).select("term", F.col("total").alias("base"))
    cells = sums.join(first, "term", "left").withColumn("base", F.coalesce("base", F.lit(0)))
    tested = N.chi_square(cells, "base", "total", ["win"])
    return tested.select(
        "win", "n_terms", "dof", F.round("statistic", 6).alias("statistic"),
        F.round("p_value", 6).alias("p_value"),
    )


# ---- SQL -------------------------------------------------------------------------------

_B = r"\t-\r\x{1c}-\x{1f} \x{85}\p{Z}"
_WD = r"\p{L}\p{N}_"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {_lit(pattern)}, {_lit(by)}, 'g')"


def _list(words) -> str:
    return "(" + ", ".join(_lit(w) for w in words) + ")"


# ---- fixed values: a link, written out with nested repetition, which costs this engine nothing.
# Its word boundary is that of ASCII letters; the check holds for texts where no link follows
# an accented letter.
_URL = (
    rf"(?i)\b(?:https?:/|pic\.|www\d{{0,3}}[.]|[a-z0-9.\-]+[.][a-z]{{2,4}}/)"
    rf"(?:[^{_B}()<>]|\((?:[^{_B}()<>]+|\([^{_B}()<>]+\))*\))+"
    rf"(?:\((?:[^{_B}()<>]+|\([^{_B}()<>]+\))*\)|[^{_B}`!()\[\]{{}};:'\".,<>?«»“”‘’])"
)
# ---- end of fixed values


def _links(expr: str) -> str:
    out = _sub(expr, _URL, "")
    out = _sub(out, rf"[{_WD}][{_WD}|.=\-]*@[{_WD}|.\-]*[{_WD}]", "")
    out = _sub(out, rf"[{_WD}]+://[{_WD}\-]+(?:\.[{_WD}\-]+)*(?:/[^{_B}/]*)*", " ")
    return _sub(out, rf"(?:pic.|[{_WD}]+)?:[^{_B}]+", " ")


def _symbols(expr: str) -> str:
    out = _sub(expr, r'[*\[\]=()$"}{|+&€£º/]+', " ")
    out = _sub(out, rf"(?:[{_B}]+|\\n)+", " ")
    out = _sub(out, r"[,|.':;\-–]+", " ")
    out = _sub(out, r"\p{Nd}+[A-Za-z]*", " ")
    return _sub(out, r"""(?i)(?:\\n|[#@'´ºª°"{}<>;=_\-`~%/:*()|€\\&\[\],.?¿!¡])""", " ")


def _map_runs(expr: str, case: str) -> str:
    found = rf"regexp_extract_all({expr}, '[{_WD}]+|[^{_WD}]+')"
    return f"coalesce(list_aggregate(list_transform({found}, lambda x: {case}), 'string_agg', ''), '')"


_STOP = _list(sorted({w.lower() for w in W.STOP_WORDS}))


def _stop(expr: str) -> str:
    return _sub(_map_runs(expr, f"case when lower(x) in {_STOP} then ' ' else x end"), rf"[{_B}]+", " ")


def _lemma(expr: str) -> str:
    pairs = " ".join(f"when {_lit(k)} then {_lit(v)}" for k, v in W.LEMMAS.items())
    return _map_runs(expr, f"case lower(x) {pairs} else x end")


def _words(expr: str) -> str:
    kept = f"list_filter(regexp_extract_all({expr}, '[{_WD}]+'), lambda x: regexp_full_match(x, '[a-zA-Z]{{2,}}'))"
    return f"lower(coalesce(list_aggregate({kept}, 'string_agg', ' '), ''))"


def _n(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {_lit(pattern)}))"


def _plain(expr: str) -> str:
    return _sub(expr, rf"[^{_WD}{_B}']", "")


def _lexical(expr: str) -> str:
    return _n(_plain(expr), rf"[^{_B}]+")


_SENTENCES = (
    f"greatest(1, len(list_filter(regexp_extract_all(text, '[{_WD}][^.!?]*[.!?]*'), "
    f"lambda s: {_lexical('s')} > 2)))"
)
_SHORT = (
    f"len(list_filter(regexp_extract_all({_plain('text')}, '[^{_B}]+'), lambda w: length(w) <= 3))"
)
_READING = (
    f"floor((length({_sub('text', f'[{_B}]+', '')}) * 1469 + 500) / 1000) / 100"
)

_LEXICON_WORDS = sorted(set(W.POLARITY_WORDS).union(*W.EMOTION_WORDS.values(), *W.TAG_WORDS.values()))
_TAG_OF = {w: t for t, ws in W.TAG_WORDS.items() for w in ws}
_LEXICON = "lexicon(word, {e}, score, tag) as (values {v})".format(
    e=", ".join(W.EMOTIONS),
    v=", ".join(
        "({w}, {e}, {s}, {t})".format(
            w=_lit(w),
            e=", ".join(str(int(w in W.EMOTION_WORDS[e])) for e in W.EMOTIONS),
            s=f"{W.POLARITY_WORDS[w]}::double" if w in W.POLARITY_WORDS else "null::double",
            t=_lit(_TAG_OF[w]) if w in _TAG_OF else "null",
        )
        for w in _LEXICON_WORDS
    ),
)
_TOKENS = rf"""toks as (select doc_id, regexp_extract_all(lower(text), '[{_WD}]{{2,}}') as t,
         len(regexp_extract_all(text, '\p{{P}}')) as n_punct from documents),
words as (select doc_id, unnest(t) as word, unnest(list_prepend('', t)[:len(t)]) as previous from toks)"""
_FOUND = f"""found as (
  select doc_id, count(*) as n_words, {", ".join(f"sum({e}) as n_{e}" for e in W.EMOTIONS)},
         count(score) as n_scored,
         sum(case when previous in {_list(W.NEGATIONS)} then -score else score end) as score_sum,
         {", ".join(f"count(*) filter (where tagged = '{t}') as n_{t}" for t in W.TAGS if t != "punct")}
  from (select *, coalesce(tag, case when word like '%ly' then 'adv'
               when word like '%ing' or word like '%ed' then 'verb'
               when word like '%ble' or word like '%ous' or word like '%ful' then 'adj'
               else 'noun' end) as tagged
        from words left join lexicon using (word))
  group by doc_id)"""


def _lexicon_sql(select: str) -> str:
    return with_ctes(_LEXICON, _TOKENS, _FOUND, select=f"select doc_id, {select} from toks left join found using (doc_id)")


_ALL_EMOTIONS = " + ".join(f"n_{e}" for e in W.EMOTIONS)

_PLACED = """placed as (select doc_id, text, count(*) over (order by doc_id rows unbounded preceding) - 1 as pos from documents)"""
# The vocabulary comes first, so that only its terms are counted over all documents.
_VOCAB = """firsts as (select distinct doc_id, term from grams join placed using (doc_id) where pos < 500),
vocab as (
  select term, count(*) as df from firsts group by term
  having count(*) >= 0.1 * (select count(*) from placed where pos < 500)
     and count(*) <= 0.7 * (select count(*) from placed where pos < 500)),
used as (
  select doc_id, pos, term, count(*) as cnt from grams join vocab using (term) join placed using (doc_id)
  group by all)"""


def _grams_sql(*more: str, select: str) -> str:
    return with_ctes(GRAMS, _PLACED, _VOCAB, *more, select=select)


#: Upper tail of chi-square by the power series of the lower one; x and k are columns.
TAIL = """case when k < 1 or x <= 0 then 1.0 when x > 10 * k + 1000 then 0.0 else greatest(0.0, 1 - list_sum(list_transform(range(0, cast(x as bigint) + 400),
  lambda i: exp(-x / 2 + (k / 2.0 + i) * ln(x / 2) - lgamma(k / 2.0 + i + 1))))) end"""

# The lemma of a form is a beginning of the word here, so a rule only cuts.
_FORMS = (
    rf"tokens as (select doc_id, unnest(regexp_extract_all(lower(text), '[{_WD}]{{2,}}')) as word from documents)",
    "vocabulary as materialized (select word from tokens group by word having count(*) > 1)",
    """heads as (select word, word[:k] as head
      from (select word, unnest(range(greatest(4, length(word) - 3), length(word))) as k from vocabulary))""",
    """forms as materialized (select v.word, coalesce(h.lemma, v.word) as lemma from vocabulary v left join (
      select h.word, max_by(head, length(head)) as lemma from heads h join vocabulary k on k.word = head group by all) h
      on h.word = v.word)""",
    f"""ends as (select right(word, k) as suffix, cut from (
      select word, length(word) - length(lemma) as cut,
             unnest(range(length(word) - length(lemma), least({R.LONGEST}, length(word)) + 1)) as k from forms))""",
    "counted as (select suffix, cut, count(*) as support from ends group by all)",
    """best as materialized (select suffix, arg_min(cut, (-support, cut)) as cut, max(support) as support
      from counted group by all)""",
    """rules as materialized (select b.* from best b left join best p on b.suffix <> '' and p.suffix = b.suffix[2:]
      where p.cut is null or p.cut <> b.cut)""",
)

QUERIES = {
    "word_count": (
        word_count,
        f"select doc_id, {_n('text', f'[^{_B}]+')} as word_count, length(text) as char_counts from documents",
    ),
    "url_count": (url_count, f"select page_id, {_n('html', _URL)} as urls from pages"),
    "strip_links": (
        strip_links,
        f"""select page_id, {_links('html')} as stripped from pages
        union all select -doc_id - 1, {_links('text')} from documents""",
    ),
    "strip_symbols": (strip_symbols, f"select doc_id, {_symbols('text')} as stripped from documents"),
    "stopwords": (stopwords, f"select doc_id, {_stop('text')} as kept from documents"),
    "lemma_map": (lemma_map, f"select doc_id, {_lemma('text')} as lemmas from documents"),
    "lemma_rules": (lemma_rules, with_ctes(*_FORMS, select="select suffix, cut, '' as add, support from rules")),
    "lemma_learned": (
        # rules and exceptions together give every form of the table its lemma, other words go by the rules
        lemma_learned,
        with_ctes(
            *_FORMS,
            f"""rare as (select word, unnest(range(0, least({R.LONGEST}, length(word)) + 1)) as k
              from (select distinct word from tokens anti join forms using (word)))""",
            """ruled as (select word, arg_max(cut, k) as cut from rare join rules on suffix = right(word, k) group by word)""",
            """lemmas as (select word, lemma from forms union all
              select word, case when cut < length(word) then left(word, length(word) - cut) else word end from ruled)""",
            select="""select doc_id, coalesce(lemma, word) as lemma, count(*) as times
              from tokens left join lemmas using (word) group by all""",
        ),
    ),
    "clean_text": (
        clean_text,
        with_ctes(
            f"a as (select doc_id, {_links('text')} as t from documents)",
            f"b as (select doc_id, {_lemma('t')} as t from a)",
            f"c as (select doc_id, {_stop('t')} as t from b)",
            f"e as (select doc_id, {_symbols('t')} as t from c)",
            select=f"select doc_id, {_words('t')} as text_preprocessed from e",
        ),
    ),
    "flesch": (
        flesch,
        f"""with m as (select doc_id, {_lexical('text')} as words, {_SENTENCES} as sentences,
          {_n('lower(text)', '[aeiouy]+')} as syllables from documents)
        select *, 206.835::double - 1.015::double * (cast(words as double) / sentences)
          - 84.6::double * coalesce(cast(syllables as double) / nullif(words, 0), 0) as flesch_reading_ease
        from m""",
    ),
    "mcalpine": (
        mcalpine,
        f"""with m as (select doc_id, {_lexical('text')} as words, {_SHORT} as short_words,
          {_SENTENCES} as sentences from documents)
        select *, cast(words + short_words as double) / sentences as mcalpine_eflaw from m""",
    ),
    "reading_time": (reading_time, f"select doc_id, {_READING} as reading_time from documents"),
    "difficult_words": (
        difficult_words,
        f"""select doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[{_WD}]{{2,}}')),
          lambda w: w not in {_list(W.EASY_WORDS)} and {_n('w', '[aeiouy]+')} >= 2)) as difficult_words_count
        from documents""",
    ),
    "lexicon_join": (
        lexicon_join,
        with_ctes(
            _LEXICON, _TOKENS,
            "counted as (select doc_id, word, count(*) as times from words group by all)",
            select="select doc_id, word, times, score, tag from counted left join lexicon using (word)",
        ),
    ),
    "emotion_share": (
        emotion_share,
        _lexicon_sql(
            ", ".join(
                f"coalesce(cast(n_{e} as double) / nullif({_ALL_EMOTIONS}, 0), 0) as {e}" for e in W.EMOTIONS
            )
        ),
    ),
    "polarity": (
        polarity, _lexicon_sql("coalesce(score_sum / nullif(n_scored, 0), 0) as polarity"),
    ),
    "pos_share": (
        pos_share,
        _lexicon_sql(
            ", ".join(
                f"coalesce(cast(coalesce(n_{t}, 0) as double) / nullif(coalesce(n_words, 0) + n_punct, 0), 0) as pos_prop_{t}"
                for t in W.TAGS
            )
        ),
    ),
    "pos_decoded": (pos_decoded, None),
    "tokens": (
        tokens,
        rf"""select doc_id, coalesce(list_aggregate(regexp_extract_all(lower(text), '[{_WD}]{{2,}}'),
        'string_agg', ' '), '') as tokens from documents""",
    ),
    "ngrams": (ngrams, with_ctes(GRAMS, select="select doc_id, term, cnt from counts")),
    "ngram_vocab": (ngram_vocab, _grams_sql(select="select term, df from vocab")),
    "ngram_counts": (ngram_counts, _grams_sql(select="select doc_id, term, cnt from used")),
    "ngram_window_sum": (
        ngram_window_sum,
        _grams_sql(select=f"select pos // {WINDOW} as win, term, sum(cnt) as total from used group by all"),
    ),
    "ngram_prefix": (
        ngram_prefix,
        _grams_sql(
            f"steps as (select term, pos // {STEP} as step, sum(cnt) as here from used group by all)",
            select="select term, step, here, sum(here) over (partition by term order by step) as prefix from steps",
        ),
    ),
    "chi2_stat": (
        chi2_stat,
        _grams_sql(
            f"sums as (select pos // {WINDOW} as win, term, sum(cnt)::double as b from used group by all)",
            """cells as (select s.win, s.term, f.b as a, s.b as b from sums s
              left join sums f on f.term = s.term and f.win = 0)""",
            """usable as (select *, sum(a) over (partition by win) as ta, sum(b) over (partition by win) as tb,
              count(*) over (partition by win) as m from cells where a >= 6 and b >= 6)""",
            """gaps as (select *, (a + b) * ta / (ta + tb) as ea, (a + b) * tb / (ta + tb) as eb,
              abs(a - (a + b) * ta / (ta + tb)) as g from usable)""",
            """parts as (select win, m, case when m = 2 then g - least(0.5, g) else g end as g, ea, eb from gaps)""",
            """stats as (select w.win, coalesce(max(m), 0) as n_terms, coalesce(sum(g * g / ea + g * g / eb), 0) as x
              from (select distinct win from sums) w left join parts p on p.win = w.win group by w.win)""",
            "tested as (select win, n_terms, greatest(n_terms - 1, 0) as k, x from stats)",
            select=f"""select win, n_terms, k as dof, round(x, 6) as statistic, round({TAIL}, 6) as p_value
            from tested""",
        ),
    ),
}
