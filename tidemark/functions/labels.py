"""Label codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def decode_label(code: Column | str) -> Column:
    """-1 -> fake, 1 -> nofake, anything else -> null."""
    return F.when(_c(code) == -1, "fake").when(_c(code) == 1, "nofake")


def encode_label(name: Column | str) -> Column:
    """fake -> 1, nofake -> 0, anything else -> null."""
    return F.when(_c(name) == "fake", 1).when(_c(name) == "nofake", 0)


def default_prediction(predicted: Column | str) -> Column:
    """The stated class, or ``nofake`` where a model has none to offer."""
    return F.coalesce(_c(predicted), F.lit("nofake"))
