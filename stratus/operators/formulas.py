"""Arithmetic formulas with conditions as columns: names and functions of a list only, everything else is refused when the plan is made.

Values are doubles of IEEE rules as in the formulas' own world: a division by zero is infinite, what is undefined is NaN and ends as
a missing value. A missing parameter enters a formula as the number ``nodata`` and a result equal to it is missing again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Constants by their names in formulas.
CONSTANTS = {"pi": math.pi, "e": math.e, "stdpress": 101325.0, "stdtemp": 288.15, "boltzmann": 5.670373e-8}
#: What formulas know of a place.
PLACE = ("altitude", "azimuth", "slope", "latitude", "longitude", "easting", "northing")
_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|meteo\(\s*(?P<param>\w+)\s*\)|(?P<name>[a-z][a-z0-9_]*)|(?P<sign>[-+*/%^(),]))")


@dataclass(frozen=True)
class Condition:
    """``expression op compare``: LT LE GT GE EQ NE between formulas, STRCMP STRBEG STREND STRINC between a text with stationid or stationname and a plain one."""

    expression: str
    op: str
    compare: str


def _if_known(x: Column, then: Column) -> Column:
    return F.when(F.isnan(x), NAN).otherwise(then)


def _quotient(a: Column, b: Column) -> Column:
    endless = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, endless).otherwise(F.try_divide(a, b))


def _logarithm(of):
    return lambda x: F.when(x > 0, of(x)).when(x == 0, -INF).otherwise(NAN)


def _whole(of):
    # beyond 2 ** 53, and where undefined, a double is its own floor
    return lambda x: F.when(F.abs(x) < 2.0**53, of(x).cast("double")).otherwise(x)


def _factorial(x: Column) -> Column:
    """n! of the whole part, infinite where 64 bits do not hold it."""
    small = F.factorial(F.least(F.greatest(x, F.lit(0.0)), F.lit(20.0)).cast("int")).cast("double")
    return _if_known(x, F.when(x < 0, NAN).when(x >= 21, INF).otherwise(small))


def _choices(n: Column, r: Column) -> Column:
    """n over r, undefined below 0 and for r above n, infinite where 64 bits do not hold it."""
    n, r = _whole(F.floor)(n), _whole(F.floor)(r)
    bad = F.isnan(n) | F.isnan(r) | (n < 0) | (r < 0) | (r > n)
    r = F.when(r > n / 2, n - r).otherwise(r)
    # a term beyond the 64th at least doubles what came before
    steps = F.least(F.greatest(r, F.lit(0.0)), F.lit(128.0)).cast("int")
    product = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda p, i: F.round(p * (n - r + i) / i, 0))
    return F.when(bad, NAN).when(product >= 2.0**64, INF).otherwise(product)


ONE = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": _whole(F.ceil), "cos": F.cos, "cosh": F.cosh, "exp": F.exp, "floor": _whole(F.floor), "ln": _logarithm(F.ln),
    "log": _logarithm(F.log10), "log10": _logarithm(F.log10), "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh, "fac": _factorial,
}
TWO = {"atan2": F.atan2, "pow": F.pow, "ncr": _choices, "npr": lambda n, r: _choices(n, r) * _factorial(r)}


class _Reader:
    """Sums of products of powers; powers go from left to right and signs bind closer than they do."""

    def __init__(self, text: str, names: Mapping[str, Column], nodata: float):
        self.text, self.names, self.nodata, self.tokens, at = text, names, nodata, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"formula {text!r} cannot be read at {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.reverse()

    def take(self, signs: str) -> str | None:
        if self.tokens and self.tokens[-1][0] == "sign" and self.tokens[-1][1] in signs:
            return self.tokens.pop()[1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"formula {self.text!r} lacks a {sign!r}")

    def whole(self) -> Column:
        out = self.sum()
        if self.tokens:
            raise ValueError(f"formula {self.text!r} goes on after its end with {self.tokens[-1][1]!r}")
        return out

    def sum(self) -> Column:
        out = self.product()
        while sign := self.take("+-"):
            out = out + self.product() if sign == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.powers()
        while sign := self.take("*/%"):
            b = self.powers()
            out = out * b if sign == "*" else _quotient(out, b) if sign == "/" else F.when(b == 0, NAN).otherwise(F.try_mod(out, b))
        return out

    def powers(self) -> Column:
        out = self.signed()
        while self.take("^"):
            out = F.pow(out, self.signed())
        return out

    def signed(self) -> Column:
        minus = False
        while sign := self.take("+-"):
            minus ^= sign == "-"
        return -self.single() if minus else self.single()

    def single(self) -> Column:
        if self.take("("):
            out = self.sum()
            self.need(")")
            return out
        if not self.tokens:
            raise ValueError(f"formula {self.text!r} ends too early")
        kind, word = self.tokens.pop()
        if kind == "number":
            return F.lit(float(word))
        if kind == "param":
            return self.names.get(f"meteo({word.lower()})", F.lit(float(self.nodata)))
        if kind == "name" and word in ONE:
            return F.coalesce(ONE[word](self.signed()), F.lit(NAN))
        if kind == "name" and word in TWO:
            self.need("(")
            a = self.sum()
            self.need(",")
            b = self.sum()
            self.need(")")
            return F.coalesce(TWO[word](a, b), F.lit(NAN))
        if kind == "name" and word in CONSTANTS:
            if self.take("("):
                self.need(")")
            return F.lit(CONSTANTS[word])
        if kind == "name" and word in self.names:
            return self.names[word]
        raise ValueError(f"formula {self.text!r} has the unknown {word!r}")


def _names(df: DataFrame, time: str | None, place: Mapping[str, str], nodata: float) -> dict[str, Column]:
    """What formulas may name: the frame's numbers as ``meteo(name)``, parts of the time in UTC (microseconds), the place's columns."""
    number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(nodata)))
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    out = {f"meteo({c.lower()})": number(c) for c in numeric}
    out |= {k: number(place[k]) if k in place else F.lit(float(nodata)) for k in PLACE} | {"nodata": F.lit(float(nodata))}
    if time:
        t = F.col(f"`{time}`")
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86_400_000_000).cast("int"))
        second = F.pmod(F.floor(t / 1_000_000).cast("long"), F.lit(86_400))
        parts = {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day), "hour": F.floor(second / 3600), "minute": F.floor(second / 60) % 60, "julian": t / 86_400_000_000 + 2_440_587.5}
        out |= {k: F.coalesce(c.cast("double"), F.lit(float(nodata))) for k, c in parts.items()}
    return out


def formula(df: DataFrame, text: str, time: str | None = None, place: Mapping[str, str] | None = None, nodata: float = -999.0) -> Column:
    """The column of a formula over the frame's rows, never null. Names of a time need ``time``; ValueError for what is not a formula."""
    return _Reader(text, _names(df, time, place or {}, nodata), nodata).whole()


def _texts(line: str, station: str | None, name: str | None) -> Column:
    known = {"stationid": station, "stationname": name}
    parts = [F.coalesce(F.col(f"`{known[p]}`").cast("string"), F.lit("")) if known.get(p) else F.lit(p) for p in re.split(r"(stationid|stationname)", line)]
    return F.concat(*parts)


def maths(
    df: DataFrame, param: str, text: str, otherwise: str | None = None, conditions: Sequence[Condition] = (), connective: str = "AND", assign: str | None = None, skip_nodata: bool = False,
    time: str | None = None, place: Mapping[str, str] | None = None, station: str | None = None, name: str | None = None, nodata: float = -999.0,
) -> DataFrame:
    """``param`` (or the column ``assign``) by ``text`` where all conditions hold, any with the connective OR; by ``otherwise`` elsewhere, or the value of ``param``.

    With ``skip_nodata`` rows whose ``param`` is missing stay as they are. A comparison with an undefined side does not hold, but NE does.
    """
    of = lambda s: formula(df, s, time, place, nodata)

    def holds(c: Condition) -> Column:
        if c.op.startswith("STR"):
            line, other = _texts(c.expression, station, name), F.lit(c.compare)
            test = {"STRCMP": lambda: line == other, "STRBEG": lambda: line.startswith(other), "STREND": lambda: line.endswith(other), "STRINC": lambda: line.contains(other)}
            if c.op not in test:
                raise ValueError(f"unknown operator {c.op!r}")
            return test[c.op]()
        a, b = of(c.expression), of(c.compare)
        both = ~F.isnan(a) & ~F.isnan(b)
        test = {"LT": both & (a < b), "LE": both & (a <= b), "GT": both & (a > b), "GE": both & (a >= b), "EQ": both & (a == b), "NE": ~both | (a != b)}
        if c.op not in test:
            raise ValueError(f"unknown operator {c.op!r}")
        return test[c.op]

    anyone, all_ = connective.upper() == "OR", F.lit(True)
    for k, c in enumerate(conditions):
        all_ = holds(c) if k == 0 else all_ | holds(c) if anyone else all_ & holds(c)
    own = F.coalesce(F.col(f"`{param}`").cast("double"), F.lit(float(nodata)))
    found = F.when(all_, of(text)).otherwise(own if otherwise is None else of(otherwise))
    out = F.when(~F.isnan(found) & (found != nodata), found)
    target = assign or param
    if skip_nodata:
        before = F.col(f"`{target}`").cast("double") if target.lower() in [c.lower() for c in df.columns] else F.lit(None).cast("double")
        out = F.when(own != nodata, out).otherwise(before)
    return df.withColumn(target, out)
