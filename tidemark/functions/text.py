"""Text cleaning as column expressions; each function takes and gives a text column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.functions.words import LEMMAS, STOP_WORDS


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, pattern, by)


def strip_links(text: Column | str) -> Column:
    """Remove links and mail addresses, then blank out schemes and ``word:rest``.

    A text with none of the marks below has nothing to remove, which a plain search tells at
    a fraction of the cost of the patterns.
    """
    whole = _c(text)
    low = F.lower(whole)
    marked = F.contains(low, F.lit("www")) | F.contains(low, F.lit("pic."))
    for mark in "/@:":
        marked = marked | F.contains(whole, F.lit(mark))
    return F.when(marked, _without_links(whole)).otherwise(whole)


def _without_links(text: Column) -> Column:
    out = _sub(text, P.LINK, "")
    out = _sub(out, P.MAIL, "")
    # The look-behind only spares attempts inside a word; such attempts cannot win.
    out = _sub(out, rf"(?<![{P.WORD}]){P.SCHEME}", " ")
    return _sub(out, rf"(?:pic.|(?<![{P.WORD}])[{P.WORD}]+)?:[^{P.BLANK}]+", " ")


def runs(text: Column | str) -> Column:
    """The text cut into word runs and the runs between them; nothing is lost."""
    return F.regexp_extract_all(_c(text), F.lit(P.RUN), F.lit(0))


def lemmatize(text: Column | str, lemmas: Mapping[str, str] = LEMMAS) -> Column:
    """Replace each listed word form by its lemma.

    The mapping is a literal, meant for an irregular-forms table; the set test skips the
    map look-up for the other words.
    """
    return F.array_join(F.transform(runs(text), lambda run: _lemma(run, lemmas)), "")


def _lemma(run: Column, lemmas: Mapping[str, str]) -> Column:
    if not lemmas:
        return run
    table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
    key = F.lower(run)
    return F.when(key.isin(*lemmas), F.try_element_at(table, key)).otherwise(run)


def drop_stop_words(
    text: Column | str,
    words: Sequence[str] = STOP_WORDS,
    lemmas: Mapping[str, str] | None = None,
) -> Column:
    """Blank out listed words, whatever their case; with ``lemmas``, replace forms first.

    Contractions need no entry of their own: their parts (``don`` and ``t``) are listed and
    the apostrophe goes with the punctuation.
    """
    listed = sorted({w.lower() for w in words})

    def one(run: Column) -> Column:
        form = _lemma(run, lemmas or {})
        return F.when(F.lower(form).isin(*listed), " ").otherwise(form)

    return squeeze(F.array_join(F.transform(runs(text), one), ""))


def squeeze(text: Column | str) -> Column:
    """One space for each stretch of blanks."""
    return _sub(_c(text), rf"[{P.BLANK}]+", " ")


def strip_symbols(text: Column | str) -> Column:
    """Blank out symbols, blanks, punctuation, numbers and listed characters, in this order."""
    out = _sub(_c(text), P.SYMBOLS, " ")
    out = _sub(out, P.BLANKS, " ")
    out = _sub(out, P.PUNCTUATION, " ")
    out = _sub(out, P.DIGITS, " ")
    return _sub(out, P.any_of(P.CHARACTERS), " ")


def keep_words(text: Column | str) -> Column:
    """Unaccented alphabetic words of two letters or more, joined by spaces, in lower case."""
    edge = rf"(?:(?<![{P.WORD}])(?=[{P.WORD}])|(?<=[{P.WORD}])(?![{P.WORD}]))"
    found = F.regexp_extract_all(_c(text), F.lit(rf"{edge}[a-zA-Z\-]{{2,}}{edge}"), F.lit(0))
    return F.lower(F.array_join(found, " "))


def clean_text(
    text: Column | str,
    stop_words: Sequence[str] = STOP_WORDS,
    lemmas: Mapping[str, str] | None = LEMMAS,
) -> Column:
    """The whole cleaning chain in its fixed order."""
    return keep_words(strip_symbols(drop_stop_words(strip_links(text), stop_words, lemmas)))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(P.TOKEN), F.lit(0))


def ngrams(words: Column | str) -> Column:
    """1-grams followed by 2-grams of a word array.

    The array is used several times over: give a column, not the expression which makes it.
    """
    w = _c(words)
    pairs = F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1),
        F.slice(w, F.lit(2), F.size(w) - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(F.size(w) < 2, w).otherwise(F.concat(w, pairs))
