"""Units, conventions, bins and labels as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corelode.functions.numbers import plain_number, strip

# Unit factors.
LENGTH = {"m": 1.0, "ft": 0.3048}
DENSITY = {"t_m3": 1.0, "g_cm3": 1.0, "lb_ft3": 0.0160184634}
GRADE = {"pct": 1e4, "ppm": 1.0, "gpt": 1.0, "oz_t": 34.2857142857}

UNKNOWN = "UNKNOWN"


def _scaled(value: Column, factor: float) -> Column:
    return value if factor == 1.0 else value * F.lit(factor)


def length_to_metres(value: Column, units: str) -> Column:
    return _scaled(value, LENGTH[units])


def density_to_t_m3(value: Column, units: str) -> Column:
    return _scaled(value, DENSITY[units])


def grade_to_ppm(value: Column, units: str) -> Column:
    return _scaled(value, GRADE[units])


def ppm_to_units(value: Column, units: str) -> Column:
    return value if GRADE[units] == 1.0 else value / F.lit(GRADE[units])


def dip_to_negative_down(value: Column, convention: str) -> Column:
    return -value if convention == "positive_down" else value


def azimuth_to_grid(value: Column, reference: str = "grid", declination: float = 0.0) -> Column:
    """In [0, 360). A true-north reference gets the declination added."""
    return F.pmod(value + F.lit(declination) if reference == "true" else value, F.lit(360.0))


def core_area(diameter_mm: Column) -> Column:
    """Square metres."""
    return F.lit(math.pi) * F.pow(diameter_mm / F.lit(2000.0), F.lit(2.0))


def core_mass(length_m: Column, diameter_mm: Column, density: Column, fraction: Column, loss: float) -> Column:
    """Kilograms."""
    return length_m * core_area(diameter_mm) * density * fraction * F.lit(1000.0) * F.lit(loss)


def _looked_up(key: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def period_weight(period: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    """The weight of the label, else that of its whole part, else the default. NaN, infinities and numbers beyond 18 digits have none."""
    if not weights:
        return F.lit(float(default))
    number = plain_number(period)
    whole = F.when(F.abs(number) < 1e18, F.floor(F.abs(number)) * F.signum(number).cast("bigint"))
    return F.coalesce(_looked_up(period, weights), _looked_up(whole.cast("string"), weights), F.lit(float(default)))


def period_order(period: Column) -> list[Column]:
    """Numbers first by value, then other labels, nulls last."""
    number = plain_number(period)
    return [period.isNull().asc(), number.isNull().asc(), number.asc(), period.asc()]


def grade_bin(value: Column, edges: Sequence[float], labels: Sequence[str], closed: bool = False) -> Column:
    """The label of [edge, next edge); null outside. `closed`: the last bin holds its upper edge too."""
    if len(edges) != len(labels) + 1 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must ascend and be one more than the labels")
    out = F.lit(None).cast("string")
    for k in reversed(range(len(labels))):
        upper = value <= F.lit(float(edges[k + 1])) if closed and k == len(labels) - 1 else value < F.lit(float(edges[k + 1]))
        out = F.when((value >= F.lit(float(edges[k]))) & upper, F.lit(labels[k])).otherwise(out)
    return out


def compose_label(parts: Sequence[Column]) -> Column:
    """Parts in upper case joined by '-', UNKNOWN for nulls."""
    return F.concat_ws("-", *(F.upper(F.coalesce(p, F.lit(UNKNOWN))) for p in parts))


def is_scheduled(period: Column, excluded: Sequence[str] = ()) -> Column:
    t = F.lower(strip(F.coalesce(period, F.lit(""))))
    return ~t.isin("", "nan", "none", "null", *(x.strip().lower() for x in excluded))

