"""Fill-in-the-middle: a text is cut twice and its parts are put in another order behind marks.

Cuts are drawn by a hash of the key, so they repeat on any number of tasks.  Offsets of the cuts
come from a ``BoundarySet``.  A text which holds a mark stays plain, as do empty texts and the
stated share of all; so ``restore`` always gives the text back.  One pass without exchange.

Null text: empty.  Null key: drawn as if the key were the word "null".  Repeated rows give equal
rows.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.boundaries import BoundarySet
from tidemark.llm.common import keyed_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Percent of texts which are transformed, percent of these with the suffix first, and the seed.
TRANSFORMED, SUFFIX_FIRST, SEED = 90, 20, 1


def draws(key: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits for a key."""
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(key: int | None, text: str, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Units of the text, form, units of prefix and middle, output."""
    data = text.encode()
    units = BoundarySet.of_code_points(data)
    n, (h1, h2, h3, h4) = len(units), draws(key, seed)
    if not text or h3 % 100 >= TRANSFORMED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    low, high = units.select(first), units.select(second)
    prefix, middle, suffix = data[:low].decode(), data[low:high].decode(), data[high:].decode()
    if h4 % 100 < SUFFIX_FIRST:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, first, second - first, "".join(parts)


def restore(output: str, form: str) -> str:
    """The text, from output and form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


_ROW = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
     ("middle_chars", pa.int64()), ("output", pa.string())]
)


def fill_in_middle(docs: DataFrame, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            made = [transform(k, t, seed) for k, t in zip(keys, batch.column(1).to_pylist())]
            columns = list(zip(*made)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_ROW)[1:]))], schema=_ROW
            )

    return keyed_text(docs, key, text).mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def digests(made: DataFrame) -> DataFrame:
    """Hashes of the outputs of ``fill_in_middle`` and of the texts restored from them."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column("output").to_pylist(), batch.column("form").to_pylist()
            hashes = [[sha(o) for o in outputs], [sha(restore(o, f)) for o, f in zip(outputs, forms)]]
            kept = [batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(h, pa.string()) for h in hashes)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
            )

    return made.mapInArrow(
        run,
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
        "output_sha256 string, restored_sha256 string",
    )
