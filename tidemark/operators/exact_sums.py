"""Running sums of fractions without rounding, whatever the order or the split of the rows.

Every double is a whole multiple of a power of two, so sums are kept as whole numbers.  A ``Grid``
says where the bits of a column lie (one small aggregation finds out); each value is cut into
limbs of ``WIDTH`` bits, which windows and blocks add up as plain longs; the total is then
rounded once, to the nearest double, ties to even.  ``ExactSum`` is the same number kept as one
Python integer, for the state of a stream, and ends in the same bits.

Nulls and NaN add nothing.  Infinite values are counted apart: a sum over values of one sign is
infinite, over both signs NaN.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a limb.  A long holds the sum of 2**35 of them, with a bit to spare for the rounding.
WIDTH = 26

#: The fewest limbs; so many are rounded by long and double arithmetic alone.
NARROW = 3

#: The lowest bit of any double, and a step of scaling which cannot overflow.
_LOWEST, _STEP = -1074, 1000

_INFINITY = "cast('Infinity' as double)"


@dataclass(frozen=True)
class Grid:
    """The lowest bit of a column (a power of two), its limbs, and whether it has infinite values."""

    low: int
    limbs: int
    infinite: bool = False


#: Shares, means and other values below 2**14 which have no bits below 2**-64.
USUAL = Grid(-64, NARROW)


def grid_of(largest: float | None, smallest: float | None, infinite: bool = False) -> Grid:
    """The grid of values between two magnitudes.

    The usual grid serves wherever it holds all bits: columns and tables then share their
    generated code.
    """
    if not largest:
        return replace(USUAL, infinite=infinite)
    low, top = max(_LOWEST, math.frexp(smallest)[1] - 53), math.frexp(largest)[1]
    if low >= USUAL.low and top <= USUAL.low + WIDTH * USUAL.limbs:
        return replace(USUAL, infinite=infinite)
    return Grid(low, max(NARROW, -(-(top - low) // WIDTH)), infinite)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(x: float) -> str:
    return f"{x!r}D"


def fractions_of(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]


def grids(df: DataFrame, columns: Sequence[str]) -> dict[str, Grid]:
    """The grids of the float columns among ``columns``: one aggregation, one row."""
    names = fractions_of(df, columns)
    if not names:
        return {}
    wanted = []
    for c in names:
        size = f"abs(cast({quoted(c)} as double))"
        finite = f"not isnan({size}) and {size} < {_INFINITY}"
        wanted += [
            f"max({size}) filter (where {finite})", f"min({size}) filter (where {finite} and {size} > 0)",
            f"max({size} = {_INFINITY})",
        ]
    row = df.selectExpr(*[f"{w} as g{i}" for i, w in enumerate(wanted)]).first()
    return {c: grid_of(row[3 * i], row[3 * i + 1], bool(row[3 * i + 2])) for i, c in enumerate(names)}


def _scaled(x: str, power: int) -> str:
    """``x`` times a power of two, in steps which a double can hold."""
    while power:
        step = max(-_STEP, min(_STEP, power))
        x, power = f"{x} * {_number(math.ldexp(1.0, step))}", power - step
    return x


def limb_names(name: str, grid: Grid) -> list[str]:
    signs = [f"{name}_plus", f"{name}_minus"] if grid.infinite else []
    return [*(f"{name}_{i}" for i in range(grid.limbs)), *signs]


def with_limbs(df: DataFrame, columns: Mapping[str, tuple[str, Grid]]) -> DataFrame:
    """Add the limbs of columns: ``columns`` maps a name to (column, grid); see ``limb_names``.

    A limb is the value rounded to its place less the value rounded to the place above; the
    differences of the places add up to the value, and each of them is exact.  Expressions are
    written as SQL: a column object for each step of each limb would take seconds to build.
    """
    values, made = [], []
    for name, (column, grid) in columns.items():
        x, value = f"cast({quoted(column)} as double)", quoted(f"_value_{name}")
        values.append(f"case when not isnan({x}) and abs({x}) < {_INFINITY} then {x} end as {value}")
        for i, own_name in enumerate(limb_names(name, grid)[: grid.limbs]):
            at = grid.low + WIDTH * i
            own = f"rint({_scaled(value, -at)})"
            if i + 1 < grid.limbs:
                own = f"{own} - rint({_scaled(value, -at - WIDTH)}) * {_number(2.0**WIDTH)}"
                if at + 3 * WIDTH + 1 < 1024:  # a larger value has all its bits in higher places
                    own = f"case when abs({value}) < {_number(math.ldexp(1.0, at + 3 * WIDTH + 1))} then {own} else 0.0D end"
            made.append(f"cast({own} as bigint) as {quoted(own_name)}")
        if grid.infinite:
            made.append(f"cast({x} = {_INFINITY} as bigint) as {quoted(name + '_plus')}")
            made.append(f"cast({x} = -{_INFINITY} as bigint) as {quoted(name + '_minus')}")
    given = [quoted(c) for c in df.columns]
    return df.selectExpr("*", *values).selectExpr(*given, *made) if columns else df


def rounded(totals: Sequence[int], low: int) -> float:
    """The nearest double of a sum of limbs."""
    return ratio(sum(int(t) << (WIDTH * i) for i, t in enumerate(totals)), low)


def ratio(whole: int, power: int) -> float:
    try:
        return whole / (1 << -power) if power < 0 else float(whole << power)
    except OverflowError:
        return math.copysign(math.inf, whole)


def with_totals(df: DataFrame, columns: Mapping[str, tuple[str, Grid]]) -> DataFrame:
    """Add doubles from summed limbs: ``columns`` maps an output to (name of the limbs, grid).

    Limbs are dropped.  Up to three limbs the work stays in long and double expressions: carries
    go up, the lower 61 bits are rounded to odd (a lost bit sets the last one), which makes the
    single rounding of the final addition the right one.
    """
    if not columns:
        return df
    scratch = {p for name, grid in columns.values() for p in limb_names(name, grid)}
    given = [quoted(c) for c in df.columns if c not in scratch]
    middles, joined, made, wide = [], [], [], {}
    for out, (name, grid) in columns.items():
        own = [f"coalesce({quoted(p)}, 0L)" for p in limb_names(name, grid)]
        mask, low_nine = (1 << WIDTH) - 1, (1 << 9) - 1
        high, low, middle = (quoted(f"_{part}_{out}") for part in ("high", "low", "middle"))
        if grid.limbs == NARROW:
            middles.append(f"{own[1]} + shiftright({own[0]}, {WIDTH}) as {middle}")
            joined.append(f"{own[2]} + shiftright({middle}, {WIDTH}) as {high}")
            joined.append(f"shiftleft({middle} & {mask}L, {WIDTH}) + ({own[0]} & {mask}L) as {low}")
            odd = f"((shiftleft({high} & {low_nine}L, {2 * WIDTH}) + {low}) & -256L) | if(({low} & 255L) <> 0L, 256L, 0L)"
            value = _scaled(
                f"(case when abs({high}) < {(1 << 11) - 1}L then cast(shiftleft({high}, {2 * WIDTH}) + {low} as double) "
                f"else cast(shiftright({high}, 9) as double) * {_number(2.0**61)} + cast({odd} as double) end)",
                grid.low,
            )
        else:
            wide[out] = F.pandas_udf(lambda s, power=grid.low: s.map(lambda t: rounded(t, power)).astype("float64"), "double")(
                F.expr(f"array({', '.join(own[: grid.limbs])})")
            )
            value = quoted(f"_wide_{out}")
        if grid.infinite:
            plus, minus = (f"{x} > 0L" for x in own[-2:])
            value = (
                f"case when {plus} and {minus} then cast('NaN' as double) when {plus} then {_INFINITY} "
                f"when {minus} then -{_INFINITY} else {value} end"
            )
        made.append(f"{value} as {quoted(out)}")
    if wide:
        df = df.withColumns({f"_wide_{out}": c for out, c in wide.items()})
    # Three projections: each intermediate number is made once.
    return df.selectExpr("*", *middles).selectExpr("*", *joined).selectExpr(*[c for c in given], *made)


class ExactSum:
    """A sum of doubles as ``whole * 2**power``, with the signs of infinite values seen."""

    __slots__ = ("whole", "power", "plus", "minus")

    def __init__(self, whole: int = 0, power: int = 0, plus: bool = False, minus: bool = False):
        self.whole, self.power, self.plus, self.minus = whole, power, plus, minus

    def add(self, x: float) -> None:
        if math.isinf(x):
            self.plus, self.minus = self.plus or x > 0, self.minus or x < 0
            return
        top, bottom = x.as_integer_ratio()
        power = 1 - bottom.bit_length()
        if power < self.power:
            self.whole, self.power = self.whole << (self.power - power), power
        self.whole += top << (power - self.power)

    def value(self) -> float:
        if self.plus or self.minus:
            return math.nan if self.plus and self.minus else math.copysign(math.inf, 1 if self.plus else -1)
        return ratio(self.whole, self.power)

    def text(self) -> str:
        """For a state store: whole number, power, signs."""
        return f"{self.whole:x} {self.power} {int(self.plus)} {int(self.minus)}"

    @classmethod
    def of_text(cls, text: str) -> ExactSum:
        whole, power, plus, minus = text.split()
        return cls(int(whole, 16), int(power), plus == "1", minus == "1")


#: Whole numbers up to this size are added up as plain longs, of up to 2**20 rows at once.
_WHOLE = 2.0**41


def running_sums(values: np.ndarray, before: ExactSum) -> tuple[np.ndarray, ExactSum]:
    """The sums of ``before`` and the values up to each one, rounded once, and the last sum; NaN adds nothing.

    Whole numbers are added up as longs and what the usual grid holds as its limbs, as ``with_totals``
    does; all others one by one.
    """
    x = np.where(np.isnan(values), 0.0, values)
    size = np.abs(x).max(initial=0.0)
    plain = not before.plus and not before.minus and len(x) < 1 << 20
    if plain and before.power == 0 and size < _WHOLE and abs(before.whole) < 1 << 61 and (x == np.rint(x)).all():
        sums = before.whole + np.cumsum(x.astype(np.int64))
        return sums.astype(np.float64), ExactSum(int(sums[-1]) if len(sums) else before.whole)
    start = before.whole << (before.power - USUAL.low) if before.power >= USUAL.low else 0
    places = [x * math.ldexp(1.0, -USUAL.low - WIDTH * i) for i in range(NARROW)]
    fits = before.power >= USUAL.low and abs(start) < 1 << (2 * WIDTH + 60) and size < math.ldexp(1.0, USUAL.low + WIDTH * NARROW)
    if plain and fits and (places[0] == np.rint(places[0])).all():
        mask, top = (1 << WIDTH) - 1, [np.rint(p) for p in places]
        limbs = [(top[0] - top[1] * 2.0**WIDTH), (top[1] - top[2] * 2.0**WIDTH), top[2]]
        own = (start & mask, (start >> WIDTH) & mask, start >> (2 * WIDTH))
        t0, t1, t2 = (k + np.cumsum(limb.astype(np.int64)) for k, limb in zip(own, limbs))
        middle = t1 + (t0 >> WIDTH)
        high, low = t2 + (middle >> WIDTH), ((middle & mask) << WIDTH) + (t0 & mask)
        few = np.abs(high) < (1 << 11) - 1
        odd = ((((high & 511) << (2 * WIDTH)) + low) & -256) | np.where(low & 255, 256, 0)
        near = (np.where(few, high, 0) << (2 * WIDTH)) + low
        sums = np.where(few, near.astype(np.float64), (high >> 9).astype(np.float64) * 2.0**61 + odd.astype(np.float64))
        last = ExactSum(start if not len(x) else (int(t2[-1]) << (2 * WIDTH)) + (int(t1[-1]) << WIDTH) + int(t0[-1]), USUAL.low)
        return sums * math.ldexp(1.0, USUAL.low), last
    last, sums = ExactSum(before.whole, before.power, before.plus, before.minus), np.empty(len(x))
    for i, v in enumerate(values.tolist()):
        if not math.isnan(v):
            last.add(v)
        sums[i] = last.value()
    return sums, last
