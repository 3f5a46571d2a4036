"""Spans found in texts: the shared shape and the digest columns of the queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
SPAN_DDL = "array<struct<kind:string, start:bigint, end:bigint, value:string>>"


def in_order(spans: list[tuple[str, int, int]], kinds: tuple[str, ...], text: str) -> list[dict]:
    """Sorted by start, then by kind as listed, then by end; a span found twice counts once."""
    rank = {kind: k for k, kind in enumerate(kinds)}
    ordered = sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2]))
    return [{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in ordered]


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def digest(base: tuple[str, ...]) -> dict[str, Column]:
    own = F.filter("spans", lambda s: s.kind.isin(*base))
    return {"base_sha256": F.sha2(listed(own), 256), "spans": listed(F.col("spans"))}
