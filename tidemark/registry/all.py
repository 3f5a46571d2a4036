"""All registered queries."""

from __future__ import annotations

from tidemark.registry import models, rows, streams, text, whole

QUERIES = {**rows.QUERIES, **text.QUERIES, **models.QUERIES, **streams.QUERIES, **whole.QUERIES}
