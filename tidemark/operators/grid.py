"""Hyperparameter grids, in the order in which the candidates are tried."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

# ---- fixed values: parameter ranges and starting values per model ---------------------
TREE_RANGES = {
    "max_depth": [1, 50, 100],
    "tie_threshold": [0.0005, 0.5, 10.0, 100.0],
    "max_size": [1, 50, 100],
    "remove_poor_attrs": [True, False],
}
FOREST_RANGES = {"n_models": [1, 50], "max_features": [10, 100], "lambda_value": [6, 100]}
RANGES = {"htc": TREE_RANGES, "hatc": TREE_RANGES, "arfc": FOREST_RANGES}
TREE_START = {"max_depth": 1, "tie_threshold": 0.0005, "max_size": 1, "remove_poor_attrs": True}
FOREST_START = {"n_models": 1, "max_features": 50, "lambda_value": 50}
START = {"htc": TREE_START, "hatc": TREE_START, "arfc": FOREST_START}
# ---------------------------------------------------------------------------------------


def combinations(ranges: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the last parameter changing fastest."""
    return [dict(zip(ranges, values)) for values in itertools.product(*ranges.values())]
