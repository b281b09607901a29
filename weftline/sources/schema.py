"""The wide listing schema that every source fills in part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HINTS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("detail", T.StringType()))
PAY = T.StructType().add("min", T.DoubleType()).add("max", T.DoubleType()).add("currency", T.StringType()).add("period", T.StringType())
RAW_JOB = (
    T.StructType()
    .add("source", T.StringType())
    .add("sourceJobId", T.StringType())
    .add("title", T.StringType())
    .add("company", T.StringType())
    .add("companyUrl", T.StringType())
    .add("location", T.StringType())
    .add("descriptionHtml", T.StringType())
    .add("descriptionText", T.StringType())
    .add("descriptionIsSnippet", T.BooleanType())
    .add("employmentType", T.StringType())
    .add("salaryRaw", T.StringType())
    .add("salary", PAY)
    .add("postedAt", T.StringType())
    .add("postedText", T.StringType())
    .add("fetchedAt", T.StringType())
    .add("jobUrl", T.StringType())
    .add("applyUrl", T.StringType())
    .add("tags", T.ArrayType(T.StringType()))
    .add("remoteHints", HINTS)
    .add("applicantLocations", T.ArrayType(T.StringType()))
    .add("countryHint", T.StringType())
    .add("originSite", T.StringType())
    .add("viaFlag", T.BooleanType())
)


def filled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows as RAW_JOB: given columns cast to the schema, all others null."""
    kinds = {f.name: f.dataType for f in RAW_JOB}
    return rows.select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def text_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def hint(kind: str, detail: str) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail")))


def pay(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Structured pay, null where both bounds are."""
    s = F.struct(low.cast("double").alias("min"), high.cast("double").alias("max"), currency.alias("currency"), period.alias("period"))
    return F.when(low.isNotNull() | high.isNotNull(), s)
