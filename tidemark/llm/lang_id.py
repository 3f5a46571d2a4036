"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 3 letters, words fenced by a
mark) in order of frequency.  A text's own most frequent n-grams are compared with each
profile by out-of-place distance: the sum over the text's n-grams of how far the ranks lie
apart, with the profile's length for n-grams which it lacks.  The nearest profile wins.

Profiles are counted over all training rows: each task sums its texts' n-grams with numpy and
hands on one row per language and n-gram met; those sums are added by one aggregation, ranked
with a top-k window (cut in each task before the exchange) and collected, ``PROFILE`` rows a
language.  ``MAX_LANGUAGES`` guards the driver: more distinct labels raise an error.

Case does not count.  Equal counts rank by code points, equal distances go to the language
first in order.  Text null or without letters: ``und`` with score 0; so is every text where
there is no labelled row to learn from.  Rows without key or repeated rows are predicted row
by row; a null key falls in no fold (not held out).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: N-grams of a profile, of a text; distinct labels that may be learned.
PROFILE, MAX_LANGUAGES = 400, 1000
#: Characters handled at once.
CHUNK = 2_000_000
UNKNOWN = "und"
_BITS = 21  # of a code point
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for what is no letter."""
    if not _LETTER:
        known = np.zeros(0x110000, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                known[k] = ord(low) if len(low) == 1 else k
        _LETTER.append(known)
    return _LETTER[0]


def _fenced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, words apart by single zeros, and each one's text number."""
    sizes = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()[points]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0  # the first mark behind a word
    return letters[keep], owner[keep]


def _grams(letters: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams, and the texts they are from.

    A mark ends each word and so stands before the next; texts never share an n-gram, as the
    mark behind the last word of a text is the last that it has.
    """
    one = letters.astype(np.uint64)
    shift = np.uint64(_BITS)
    before = np.concatenate([[0], one[:-1]]).astype(np.uint64)
    after = np.concatenate([one[1:], [0]]).astype(np.uint64)
    middle = one > 0
    unigrams = one[middle]
    # pairs end at a letter or at the mark behind one
    pairs = ((before << shift) | one) + np.uint64(1 << 63)
    paired = middle | (before > 0)
    triples = (before[middle] << (shift + shift)) | (unigrams << shift) | after[middle]
    codes = np.concatenate([unigrams, pairs[paired], triples])
    return codes, np.concatenate([owner[middle], owner[paired], owner[middle]])


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often, or with which weight, they occur."""
    if weights is None:
        ordered = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        ordered, weights = codes[order], weights[order]
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if weights is None:
        return ordered[first], np.diff(np.append(first, len(ordered)))
    return ordered[first], np.add.reduceat(weights, first)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` characters; a longer text stands alone."""
    low, held = 0, 0
    for k, t in enumerate(texts):
        if k > low and held + len(t) > CHUNK:
            yield low, k
            low, held = k, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)


def held_out_fold(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each non-null label, as codes in order of rank."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_label: dict[str, list[str]] = {}
            for t, label in zip(texts, labels, strict=True):
                by_label.setdefault(label, []).append(t)
            for label, own in by_label.items():
                for low, high in _chunks(own):
                    part = _counted(_grams(*_fenced(own[low:high]))[0])
                    old = sums.get(label)
                    if old is not None:
                        part = _counted(np.concatenate([old[0], part[0]]), np.concatenate([old[1], part[1]]))
                    sums[label] = part
        for label, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())],
                names=["label", "code", "n"],
            )

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("label")).dropna()
    sums = rows.mapInArrow(add_up, "label string, code bigint, n bigint").groupBy("label", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("label").orderBy(F.desc("n"), "code")
    ranked = sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in ranked.limit((MAX_LANGUAGES + 1) * size).collect():
        profiles.setdefault(row.label, []).append((row.rank, row.code))
    if len(profiles) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels")
    return {label: [c for _, c in sorted(profiles[label])] for label in sorted(profiles)}


class Ranker:
    """Out-of-place distances of texts to fixed profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = list(profiles)
        self.size = max([1, *map(len, profiles.values())])
        known = [np.array(profiles[n], np.int64).view(np.uint64) for n in self.names]
        self.codes = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        # one more row for n-grams of no profile
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, codes in enumerate(known):
            self.ranks[np.searchsorted(self.codes, codes), k] = np.arange(len(codes))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for low, high in _chunks(texts):
            out += self._some(texts[low:high])
        return out

    def _packed(self, letters: np.ndarray, alphabet: np.ndarray, bits: int) -> np.ndarray:
        """Places of the profiles' n-grams among the packed codes of this chunk, -1 for absent letters."""
        mask = np.uint64((1 << _BITS) - 1)
        pair = self.codes >> np.uint64(63)
        parts = [(self.codes >> np.uint64(s * _BITS)) & mask for s in (2, 1, 0)]
        parts[0] = np.where(pair > 0, 0, parts[0])
        at = [np.searchsorted(alphabet, p) for p in parts]
        there = np.all([alphabet[np.minimum(a, len(alphabet) - 1)] == p for a, p in zip(at, parts, strict=True)], axis=0)
        packed = (at[0] << (2 * bits)) | (at[1] << bits) | at[2] | (pair.astype(np.int64) << (3 * bits))
        return np.where(there, packed, -1)

    def _some(self, texts: list[str]) -> list[tuple[str, float]]:
        if not len(self.codes):
            return [(UNKNOWN, 0.0)] * len(texts)
        letters, owner = _fenced(texts)
        seen = np.zeros(0x110000, bool)
        seen[letters] = True
        seen[0] = True
        alphabet = np.flatnonzero(seen)
        bits = max(1, int(len(alphabet) - 1).bit_length())
        width = 3 * bits + 1
        if width + len(texts).bit_length() > 63:  # only for very many letters at once
            half = len(texts) // 2
            return self._some(texts[:half]) + self._some(texts[half:])
        small = np.zeros(0x110000, np.int64)
        small[alphabet] = np.arange(len(alphabet))
        one = small[letters] | (owner << width)  # the owner rides on the last letter
        own = (1 << width) - 1
        before = np.concatenate([[0], one[:-1] & own])
        after = np.concatenate([one[1:] & own, [0]])
        middle = letters > 0
        paired = middle | (before > 0)
        base = (owner << width)[middle]
        triples = base | (before[middle] << (2 * bits)) | ((one[middle] & own) << bits) | after[middle]
        pairs = (one | (before << bits) | (1 << (3 * bits)))[paired]
        both, counts = _counted(np.concatenate([one[middle], pairs, triples]))
        text_of, code_of = both >> width, both & own
        # within a text by falling count; equal counts stay in order of codes
        order = np.argsort((text_of << 32) - counts, kind="stable")
        text_of, code_of = text_of[order], code_of[order]
        starts = np.searchsorted(text_of, np.arange(len(texts) + 1))
        rank = np.arange(len(text_of)) - starts[text_of]
        top = rank < self.size
        text_of, code_of, rank = text_of[top], code_of[top], rank[top]
        packed = self._packed(letters, alphabet, bits)
        place = np.argsort(packed, kind="stable")
        at = np.minimum(np.searchsorted(packed[place], code_of), len(packed) - 1)
        row = np.where(packed[place][at] == code_of, place[at], len(packed))
        theirs = self.ranks[row]
        apart = np.where(theirs < 0, self.size, np.minimum(np.abs(theirs - rank[:, None]), self.size))
        sums = np.zeros((len(texts), len(self.names)), np.int64)
        lengths = np.bincount(text_of, minlength=len(texts))
        some = np.flatnonzero(lengths)
        if len(some):
            firsts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
            sums[some] = np.add.reduceat(apart, firsts, axis=0)
        best = sums.argmin(1)
        score = 1.0 - sums[np.arange(len(texts)), best] / np.maximum(lengths * self.size, 1)
        return [(self.names[b], float(s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best, score, lengths, strict=True)]


def identify(
    docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language and its score, as columns ``names``.

    Other columns are handed through untouched; columns of ``docs`` with one of these two names are replaced.
    """
    kept = docs.drop(*names)
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        for batch in batches:
            found = ranker.predict([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=schema.names,
            )

    return kept.mapInArrow(predict, schema)


def in_fold(key) -> bool:
    """The fold rule for one key, for tests."""
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2
