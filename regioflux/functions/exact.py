"""The side of a line on which a point lies, exact for any coordinates in double precision.

The determinant is first computed as usual. Only where its rounding error could reach its size is it summed again without any error, as a
list of numbers of falling size whose sum is the exact value. Products of coordinates must neither overflow nor underflow, so their sizes
should lie between 1e-140 and 1e140, or be 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rounding error of the determinant for 53 bits, rounded up, and the number that splits 53 bits into halves.
ROUNDING = 4e-16
SPLITTER = 134217729.0


def _two_product(t: Column) -> Column:
    """[p, e]: the rounded product of t.u and t.v and its exact error, by splitting both into halves."""
    u, v = t["u"], t["v"]
    head = lambda x: x * SPLITTER - (x * SPLITTER - x)
    uh, vh = head(u), head(v)
    ul, vl = u - uh, v - vh
    return F.array(u * v, ul * vl - (((u * v - uh * vh) - ul * vh) - uh * vl))


def _carry(state: Column, part: Column) -> Column:
    """Adds the number carried along to a part: the rounded sum is carried on, its exact error stays."""
    a, b = state["carried"], part
    total = a + b
    error = (a - (total - (total - a))) + (b - (total - a))
    return F.struct(total.alias("carried"), F.array_append(state["parts"], error).alias("parts"))


def _exact_sign(terms: Column) -> Column:
    """The sign of the exact sum of products u * v."""
    nothing = F.array().cast("array<double>")
    grown = F.aggregate(
        F.flatten(F.transform(terms, _two_product)),
        nothing,
        lambda parts, term: F.aggregate(
            parts,
            F.struct(term.alias("carried"), nothing.alias("parts")),
            _carry,
            lambda state: F.array_append(state["parts"], state["carried"]),
        ),
    )
    # The parts do not overlap and grow in size, so the last one that is not 0 has the sign of all.
    return F.aggregate(grown, F.lit(0.0), lambda sign, part: F.when(part != 0, F.signum(part)).otherwise(sign))


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """1.0, 0.0 or -1.0: c lies left of, on or right of the line from a to b, without rounding; null if a coordinate is."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    pairs = ((ax, by), (-ax, cy), (bx, cy), (-bx, ay), (cx, ay), (-cx, by))
    terms = F.array(*(F.struct(u.alias("u"), v.alias("v")) for u, v in pairs))
    sure = F.abs(left - right) >= (F.abs(left) + F.abs(right)) * ROUNDING
    return F.when(sure, F.signum(left - right)).when(~sure, _exact_sign(terms))
