"""Canonical column names, and the shape of issue and gap tables."""

from __future__ import annotations

from pyspark.sql import types as T

HOLE, FROM, TO, LENGTH = "hole_id", "from_m", "to_m", "length_m"
COORDS = tuple(f"{axis}_{end}" for end in ("from", "to", "mid") for axis in ("x", "y", "z"))
#: Differences of depth up to this much count as none.
TOLERANCE = 1e-6


def attribute(role: str) -> str:
    return f"attr_{role}"


def hole_attribute(role: str) -> str:
    return f"dh_attr_{role}"


def block_attribute(role: str) -> str:
    return f"bm_attr_{role}"


def element(name: str) -> str:
    return f"elem_{name}"


def block_element(name: str) -> str:
    return f"bm_elem_{name}"


def weighted(name: str) -> str:
    return f"wtd_{name}"


def key_column(key: str) -> str:
    """The column of a domaining key: the built-in ones name themselves, others are attributes."""
    return key if key in ("geomet_domain", "grade_bin", "period") else attribute(key)


ISSUES = T.StructType([
    T.StructField("severity", T.StringType()), T.StructField("check", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("hole_id", T.StringType()), T.StructField("count", T.LongType()), T.StructField("message", T.StringType()),
    T.StructField("detail", T.MapType(T.StringType(), T.StringType())),
])
GAPS = T.StructType([
    T.StructField("scope", T.StringType()), T.StructField("key", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("detail", T.MapType(T.StringType(), T.StringType())),
])
