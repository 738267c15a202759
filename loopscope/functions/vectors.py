"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A zero norm counts as 1, so a zero vector has cosine 0 with all."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def hashed_embedding(tokens: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed token counts by hash, L2-normalised."""
    code = lambda t: (F.pmod(F.xxhash64(t), F.lit(dims)) + 1) * F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1).otherwise(-1)
    once = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  a lambda's variable is evaluated once, an expression in it each time
    count = lambda cs, i: F.size(F.filter(cs, lambda c: c == i)).cast("double")
    raw = once(F.transform(tokens, code), lambda cs: F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: count(cs, i) - count(cs, -i)))
    both = once(raw, lambda r: F.struct(r.alias("r"), norm(r).alias("n")))
    return once(both, lambda b: F.transform(b["r"], lambda x: x / F.when(b["n"] == 0, 1.0).otherwise(b["n"])))
