"""Column functions of the partitioners and of error measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F


def hash_part(vertex, parts: int):
    return F.pmod(vertex, F.lit(parts))


def degree_bucket(degree, base: float):
    """floor(ln d / ln base), exact powers included."""
    return F.floor(F.ln(degree) / F.lit(math.log(base)) + F.lit(1e-9))


def parts_per_vertex(budget: int, join_vertices: int) -> int:
    return math.floor(budget ** (1 / join_vertices)) if join_vertices else 1


def q_error(estimate, true):
    return F.greatest(estimate / true, true / estimate)
