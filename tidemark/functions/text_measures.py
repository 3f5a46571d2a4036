"""Numbers taken from a text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.functions.words import EASY_WORDS


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _found(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def word_count(text: Column | str) -> Column:
    """Stretches of non-blank characters."""
    return _found(_c(text), rf"{P.SOLID}+")


def char_count(text: Column | str) -> Column:
    return F.length(_c(text))


def url_count(text: Column | str) -> Column:
    """Links; a text with none of the marks which each link has is told by a plain search."""
    whole = _c(text)
    low = F.lower(whole)
    marked = F.contains(whole, F.lit("/")) | F.contains(low, F.lit("www")) | F.contains(low, F.lit("pic."))
    return F.when(~marked, F.lit(0)).otherwise(_found(whole, P.LINK))


def polarity_deviation(polarity: Column | str, rating: Column | str) -> Column:
    """``abs(polarity - (rating + 1) / 2 * 5)``: it is the rating which is scaled."""
    return F.abs(_c(polarity) - (_c(rating) + 1) / 2 * 5)


def plain_words(text: Column | str) -> Column:
    """Text without punctuation, apostrophes kept."""
    return F.regexp_replace(_c(text), rf"[^{P.WORD}{P.BLANK}']", "")


def lexical_words(text: Column | str) -> Column:
    """Number of words once the punctuation is gone."""
    return word_count(plain_words(text))


def short_words(text: Column | str) -> Column:
    """Words of at most three characters once the punctuation is gone."""
    words = F.regexp_extract_all(plain_words(text), F.lit(rf"{P.SOLID}+"), F.lit(0))
    return F.size(F.filter(words, lambda w: F.length(w) <= 3))


def sentences(text: Column | str) -> Column:
    """Sentences of more than two words; at least one."""
    found = F.regexp_extract_all(_c(text), F.lit(rf"[{P.WORD}][^.!?]*[.!?]*"), F.lit(0))
    long_enough = F.filter(found, lambda s: lexical_words(s) > 2)
    return F.greatest(F.lit(1), F.size(long_enough))


def syllables(text: Column | str) -> Column:
    """Vowel groups, a close stand-in for syllables in English."""
    return _found(F.lower(_c(text)), "[aeiouy]+")


def flesch_reading_ease(words: Column, sentence_count: Column, syllable_count: Column) -> Column:
    """206.835 - 1.015 words per sentence - 84.6 syllables per word."""
    per_sentence = words.cast("double") / sentence_count
    per_word = F.coalesce(F.try_divide(syllable_count.cast("double"), words), F.lit(0.0))
    return F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word


def mcalpine_eflaw(words: Column, short: Column, sentence_count: Column) -> Column:
    """(words + words of at most three letters) per sentence."""
    return (words + short).cast("double") / sentence_count


def reading_time(text: Column | str) -> Column:
    """Seconds at 14.69 ms per non-blank character, in hundredths, reckoned in integers."""
    return seconds_of(F.length(F.regexp_replace(_c(text), rf"[{P.BLANK}]+", "")).cast("bigint"))


def seconds_of(characters: Column) -> Column:
    return F.floor((characters * 1469 + 500) / 1000).cast("double") / 100


def difficult_words(words: Column | str, easy: Sequence[str] = EASY_WORDS) -> Column:
    """Different words with two or more vowel groups which are not on the easy list."""
    return F.filter(
        F.array_distinct(_c(words)),
        lambda w: (~w.isin(*easy)) & (_found(w, "[aeiouy]+") >= 2),
    )
