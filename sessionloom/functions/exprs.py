"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UTC_OFFSET_HOURS = 2
#: Event types and the names of the target events.
EVENTS = {0: "clicks", 1: "carts", 2: "orders"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(x: Column | str, y: Column | str) -> Column:
    """x / y; 0 for y = 0; null for a null numerator or denominator."""
    x, y = col(x).cast("double"), col(y).cast("double")
    return F.when(y == 0, F.when(x.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(x, y))


def recency_weight(position: Column | str, n: Column | str, start: float = 0.1) -> Column:
    """2^(s + (1-s) (i-1) / (n-1)) - 1 for position i of n and start s; 1 for n = 1."""
    i, n = col(position), col(n)
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), start + (1 - start) * F.try_divide((i - 1).cast("double"), (n - 1).cast("double"))) - 1)


def stable_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A 60-bit number from md5 of the columns as text: the same in any engine that has md5."""
    text = F.concat_ws("_", *(col(c).cast("string") for c in cols), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_fraction(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from ``stable_hash``."""
    return stable_hash(*cols, seed=seed) / float(1 << 60)


def type_weight(weights: dict[int, float], type_col: str = "type") -> Column:
    out = F.lit(None).cast("double")
    for t, w in weights.items():
        out = F.when(F.col(type_col) == t, F.lit(float(w))).otherwise(out)
    return out


def ts_parts(df: DataFrame, ts: str = "ts", offset_hours: int = UTC_OFFSET_HOURS) -> DataFrame:
    """Adds hour, weekday (Monday 0), date, datehour and datetime of epoch seconds at a fixed offset."""
    local = F.col(ts).cast("long") + offset_hours * 3600
    days = F.floor(local / 86400)
    hour = F.pmod(F.floor(local / 3600), F.lit(24)).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(hour), two(F.pmod(F.floor(local / 60), F.lit(60)).cast("int")), two(F.pmod(local, F.lit(60)).cast("int")))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")
    return df.withColumns(
        {
            "hour": hour,
            "weekday": F.pmod(days + 3, F.lit(7)).cast("int"),
            "date": day,
            "datehour": F.concat(day, F.lit(" "), two(hour), F.lit(":00:00")),
            "datetime": F.concat(day, F.lit(" "), clock),
        }
    )


def _half_gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): its asymptotic series (fixed coefficients) at a + 30, brought down
    step by step."""
    z = a + 30
    series = F.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z**2) + 5 / (1024 * z**3) - 21 / (32768 * z**4) - 399 / (262144 * z**5))
    return F.aggregate(F.sequence(F.lit(0), F.lit(29)), series, lambda acc, i: acc * (a + i) / (a + i + 0.5))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its far end; some multiple of
    sqrt(a + b) terms are enough for x below (a + 1) / (a + b + 2)."""

    def term(acc: Column, j: Column) -> Column:
        m = F.floor(j / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(j % 2 == 0, even).otherwise(odd) / acc

    terms = F.sequence((F.lit(60) + 2 * F.ceil(5 * F.sqrt(a + b))).cast("int"), F.lit(1), F.lit(-1))
    return 1 / F.aggregate(terms, F.lit(1.0), term)


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` of ``n`` pairs under independence: the regularised
    incomplete beta function I(1 - r^2; (n - 2) / 2, 1 / 2). Null for n < 3 or a null r."""
    a, half, x = (n - 2).cast("double") / 2, F.lit(0.5), 1 - r * r
    front = F.exp(a * F.log1p(-(r * r))) * F.abs(r) * _half_gamma_ratio(a) / math.sqrt(math.pi)
    low = front / a * _beta_fraction(a, half, x)
    high = 1 - front / half * _beta_fraction(half, a, r * r)
    p = F.when(F.abs(r) >= 1, 0.0).when(r == 0, 1.0).when(x < (a + 1) / (a + 2.5), low).otherwise(high)
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), p)
