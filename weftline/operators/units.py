"""One measured quantity stated in different units, periods, currencies and scales, in common units.

Texts are read once per distinct text. Numbers that come without a text may have been recorded on
another scale for a while (minor units, thousands): each source's history of log values is cut by an
exact penalised changepoint search, and segments that lie off their neighbours by a known factor (a scale, or a ratio of
two periods or currencies of the table of factors) are put back. The search runs on daily sums, pre-aggregated on the executors, so that its size is
a source's number of days whatever its number of rows.

Null, empty and unreadable texts state nothing; repeated rows each get their result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.pay import currency_code, listing_pay, period_code, read_pay
from weftline.plans.stages import materialize

#: Changes of scale that any number may undergo; those of period and currency follow from the table of factors.
SCALES = (100.0, 1000.0)
#: Smaller changes than this, as a natural logarithm, can't be told from a change of the values themselves.
LEAST_SHIFT = 1.0
#: Penalty of one more segment, in units of the noise's variance times the log of the number of days.
PENALTY = 3.0
#: How far a segment may lie from a factor's level: in standard errors, and at least as a natural logarithm.
ERRORS, TOLERANCE = 3.0, 0.2

_PAY = T.StructType().add("low", T.DoubleType()).add("high", T.DoubleType()).add("currency", T.StringType()).add("period", T.StringType()).add("stated", T.BooleanType())


@F.pandas_udf(_PAY)
def _read(texts: pd.Series) -> pd.DataFrame:
    found = [read_pay(x) for x in texts]
    none = (None, None, None, None)
    return pd.DataFrame([(*(x or none), x is not None) for x in found], columns=_PAY.names).astype({"low": "float64", "high": "float64"})


@F.pandas_udf(T.StringType())
def _currency(codes: pd.Series) -> pd.Series:
    return codes.map(currency_code)


@F.pandas_udf(T.StringType())
def _period(codes: pd.Series) -> pd.Series:
    return codes.map(period_code)


@F.pandas_udf(T.StructType().add("min", T.DoubleType()).add("max", T.DoubleType()).add("currency", T.StringType()).add("period", T.StringType()))
def listing_salary(texts: pd.Series) -> pd.DataFrame:
    """Structured pay of a listing's text."""
    found = [listing_pay(x) or (None, None, None, None) for x in texts]
    return pd.DataFrame(found, columns=["min", "max", "currency", "period"]).astype({"min": "float64", "max": "float64"})


def changepoints(n: list[float], sums: list[float], squares: list[float], noise: float, penalty: float) -> list[int]:
    """Starts of the segments that minimise squared error plus penalty, by pruned exact search (PELT).

    Point i stands for n[i] values with the given sum and sum of squares. Ties keep the earlier last change.
    """
    size = len(n)
    cn, cs, cq = [0.0], [0.0], [0.0]
    for a, b, c in zip(n, sums, squares):
        cn.append(cn[-1] + a)
        cs.append(cs[-1] + b)
        cq.append(cq[-1] + c)

    def cost(i: int, j: int) -> float:
        m = cn[j] - cn[i]
        return ((cq[j] - cq[i]) - (cs[j] - cs[i]) ** 2 / m) / noise if m else 0.0

    best, last, live = [-penalty] + [math.inf] * size, [0] * (size + 1), [0]
    for j in range(1, size + 1):
        for i in live:
            if (x := best[i] + cost(i, j) + penalty) < best[j] - 1e-12:
                best[j], last[j] = x, i
        live = [i for i in live if best[i] + cost(i, j) <= best[j] + 1e-9] + [j]
    starts, j = [], size
    while j > 0:
        starts.append(last[j])
        j = last[j]
    return starts[::-1]


_SEGMENT = T.StructType().add("source", T.StringType()).add("from_day", T.LongType()).add("to_day", T.LongType()).add("factor", T.DoubleType()).add("n", T.LongType()).add("level", T.DoubleType())


def known_shifts(unit_factors: DataFrame) -> list[float]:
    """Factors by which recorded values may be off: scales, ratios of two periods' factors or two currencies', and their inverses.

    unit_factors is a fixed table of few rows.
    """
    found = set(SCALES)
    for r in unit_factors.where("factor > 0").groupBy("kind").agg(F.collect_set("factor").alias("f")).collect():
        found |= {a / b for a in r.f for b in r.f}
    return sorted({x for f in found for x in (f, 1 / f) if abs(math.log(f)) >= LEAST_SHIFT})


def shift_of(off: float, error: float, known: list[float]) -> float:
    """The known factor whose logarithm is nearest to an offset between two segments, 1 where none is near enough."""
    if abs(off) < LEAST_SHIFT - TOLERANCE or abs(off) < ERRORS * error:
        return 1.0
    factor = min(known, key=lambda f: abs(off - math.log(f)), default=1.0)
    return factor if abs(off - math.log(factor)) <= max(TOLERANCE, ERRORS * error) and abs(off - math.log(factor)) < abs(off) / 2 else 1.0


def segments(values: DataFrame, level: float, noise: float, known: list[float]) -> DataFrame:
    """source, from_day, to_day (exclusive), factor, n, level of each source's segments.

    values: source, day (bigint), x (log of the value in common units). level and noise: mean and variance of x
    where the unit is certain. Of a source's segments the one nearest the common level (of several about as near, the
    largest) is taken to be recorded as stated; from it on, to either side, each segment is compared with its neighbour:
    a shift by a known factor changes the factor, any other change is one of the values. factor is what the segment's values
    are to be divided by. The first segment itself is off if it lies by a known factor off the common level.
    """
    daily = values.groupBy("source", "day").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))

    def cut(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("day")
        n, s, q, d = (days[c].tolist() for c in ("n", "s", "q", "day"))
        starts = changepoints(n, s, q, noise, PENALTY * math.log(max(2, len(n))))
        ends = [*starts[1:], len(n)]
        size = [sum(n[i:j]) for i, j in zip(starts, ends)]
        mean = [sum(s[i:j]) / m for i, j, m in zip(starts, ends, size)]
        near = min(abs(m - level) for m in mean)
        first = max((k for k, m in enumerate(mean) if abs(m - level) <= near + LEAST_SHIFT / 2), key=lambda k: size[k])
        factor = [1.0] * len(starts)
        factor[first] = shift_of(mean[first] - level, math.sqrt(noise / size[first] + noise), known)
        for step in (1, -1):
            for k in range(first + step, len(starts) if step > 0 else -1, step):
                before = k - step
                shift = shift_of(mean[k] - mean[before], math.sqrt(noise / size[k] + noise / size[before]), known)
                factor[k] = factor[before] * shift
                # a way back to the source's own scale isn't a product of two factors
                if abs(math.log(factor[k])) < LEAST_SHIFT:
                    factor[k] = 1.0
        rows = [(key[0], d[i], d[j] if j < len(n) else 1 << 60, f, int(m), x) for i, j, f, m, x in zip(starts, ends, factor, size, mean)]
        return pd.DataFrame(rows, columns=_SEGMENT.names)

    return daily.groupBy("source").applyInPandas(cut, _SEGMENT)


def _usd(amount: Column, rate: Column) -> Column:
    return F.coalesce(F.round(amount * rate).cast("bigint"), F.lit(-1).cast("bigint"))


def stated_pay(raw_jobs: DataFrame) -> DataFrame:
    """raw_id, source, fetchedAt, low, high, currency, period, from_text of rows that state an amount with both units."""
    texts = raw_jobs.where(F.col("salaryRaw").rlike(r"\d")).select("salaryRaw").distinct().withColumn("t", _read("salaryRaw")).where("t.stated")
    codes = raw_jobs.select(F.explode(F.array("salary.currency", "salary.period")).alias("code")).where("code is not null").distinct()
    codes = codes.withColumn("as_currency", _currency("code")).withColumn("as_period", _period("code"))
    kept = materialize(texts.select(F.lit("t").alias("kind"), F.col("salaryRaw").alias("key"), "t.low", "t.high", "t.currency", "t.period").unionByName(
        codes.select(F.lit("c").alias("kind"), F.col("code").alias("key"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("as_currency").alias("currency"), F.col("as_period").alias("period"))
    ), "pay-dictionary")
    said = kept.where("kind = 't'").select(F.col("key").alias("salaryRaw"), "low", "high", "currency", "period")
    money = kept.where("kind = 'c'").select(F.col("key").alias("__c"), F.col("currency").alias("s_currency"))
    spans = kept.where("kind = 'c'").select(F.col("key").alias("__p"), F.col("period").alias("s_period"))
    rows = raw_jobs.select("raw_id", "source", "fetchedAt", "salaryRaw", F.col("salary.min").alias("s_low"), F.col("salary.max").alias("s_high"), F.col("salary.currency").alias("__c"), F.col("salary.period").alias("__p"))
    rows = rows.where(F.col("salaryRaw").rlike(r"\d") | (F.col("salaryRaw").isNull() & (F.col("s_low").isNotNull() | F.col("s_high").isNotNull())))
    # a text common to many rows lies on one side once, so the join may be split where it is skewed
    full = rows.join(said, "salaryRaw", "left").join(money, "__c", "left").join(spans, "__p", "left")
    silent = F.col("salaryRaw").isNull()
    return (
        full.select(
            "raw_id",
            "source",
            "fetchedAt",
            F.when(silent, F.col("s_low")).otherwise(F.col("low")).alias("low"),
            F.when(silent, F.col("s_high")).otherwise(F.col("high")).alias("high"),
            F.coalesce("currency", "s_currency").alias("currency"),
            F.coalesce("period", "s_period").alias("period"),
            (~silent).alias("from_text"),
        )
        .where((F.col("low").isNotNull() | F.col("high").isNotNull()) & F.col("currency").isNotNull() & F.col("period").isNotNull())
    )


def yearly_pay(raw_jobs: DataFrame, unit_factors: DataFrame) -> DataFrame:
    """raw_id, min_usd_year, max_usd_year, factor of each row that states pay; -1 for an open bound.

    factor is the change of scale that was taken back, 1 where none was.
    """
    money = unit_factors.where("kind = 'currency'").select(F.col("code").alias("currency"), F.col("factor").alias("__m"))
    spans = unit_factors.where("kind = 'period'").select(F.col("code").alias("period"), F.col("factor").alias("__t"))
    stated = materialize(
        stated_pay(raw_jobs).join(money, "currency").join(spans, "period").withColumn("rate", F.col("__t") * F.col("__m")).drop("__m", "__t"), "pay-stated"
    )
    x = F.ln(F.when(F.coalesce("high", "low") > 0, F.coalesce("high", "low") * F.col("rate")))
    logs = stated.select("source", "from_text", F.unix_date(F.to_date(F.try_to_timestamp("fetchedAt"))).cast("bigint").alias("day"), x.alias("x")).where("x is not null and day is not null")
    # the common level: where the unit is written out; one row
    mean, var, n = logs.where("from_text").agg(F.avg("x"), F.var_pop("x"), F.count("x")).first() or (None, None, 0)
    if not n:
        return stated.select("raw_id", _usd(F.col("low"), F.col("rate")).alias("min_usd_year"), _usd(F.col("high"), F.col("rate")).alias("max_usd_year"), F.lit(1.0).alias("factor"))
    shifts = segments(logs.where("not from_text"), mean, max(var, 1e-6), known_shifts(unit_factors)).where("factor <> 1").select(F.col("source").alias("__s"), "from_day", "to_day", "factor")
    day = F.unix_date(F.to_date(F.try_to_timestamp("fetchedAt"))).cast("bigint")
    off = (F.col("source") == F.col("__s")) & ~F.col("from_text") & (day >= F.col("from_day")) & (day < F.col("to_day"))
    found = stated.join(shifts, off, "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    rate = F.col("rate") / F.col("factor")
    return found.select("raw_id", _usd(F.col("low"), rate).alias("min_usd_year"), _usd(F.col("high"), rate).alias("max_usd_year"), "factor")
