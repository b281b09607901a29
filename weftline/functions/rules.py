"""Rule tables as expressions: counting hits, first reason, all reasons, weighted evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_hits(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns a text holds."""
    return sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in patterns), F.lit(0)).cast("bigint")


def first_match(text: Column, rules: Mapping[str, str]) -> Column:
    """Label of the first rule whose pattern fits, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules.items()])


def first_reason(checks: Sequence[tuple[str, Column, Column]]) -> Column:
    """struct<code, detail> of the first check (code, failed, detail) that failed, else null."""
    return F.coalesce(*[F.when(bad, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for code, bad, detail in checks])


def all_reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """Codes of every check (code, failed) that failed, in order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks]))


def evidence(text: Column, weights: Mapping[str, float]) -> Column:
    """Sum of the weights of the patterns that a text holds."""
    return sum((F.when(text.rlike(p), F.lit(float(w))).otherwise(0.0) for p, w in weights.items()), F.lit(0.0))


def ranked_terms(found: Column) -> Column:
    """Matches (array<struct<term, score>>) that score, best first, of equal ones the longer term, then by the alphabet."""
    key = lambda t: F.struct((-t["score"]).alias("a"), (-F.length(t["term"])).alias("b"), t["term"].alias("c"), t.alias("t"))
    return F.transform(F.array_sort(F.transform(F.filter(found, lambda t: t["score"] > 0), key)), lambda k: k["t"])
