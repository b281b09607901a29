"""Outputs: spreadsheet lines, results as JSON, links of a title on every portal, padded reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import csv_cell, html_escape


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One `line` for each row, cells in the order of columns; missing columns are empty cells."""
    kinds = dict(rows.dtypes)
    cells = [csv_cell(F.col(c), kinds[c]) if c in kinds else F.lit("") for c in columns]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def write_csv(rows: DataFrame, columns: list[str], path: str, bom: bool = False) -> None:
    """Parts with CRLF lines; the header, with a byte order mark if asked, in a part of its own that sorts first."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(("﻿" if bom else "") + ",".join(columns),)], "line string").coalesce(1)
    head.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/0-header")
    csv_lines(rows, columns).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/1-rows")


def json_result(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


def portal_links(titles: DataFrame, portals: DataFrame) -> DataFrame:
    """title, source, url, html: every title on every portal. The portals are a fixed table of few rows, hence an array on each title, no cross join of two growing sides."""
    few = portals.agg(F.array_sort(F.collect_list(F.struct("source", "host"))).alias("p"))
    found = titles.join(F.broadcast(few)).select("title", F.inline("p"))
    url = F.concat(F.lit("https://"), F.col("host"), F.lit("/search?q="), F.url_encode("title"))
    html = F.concat(F.lit('<a href="'), html_escape(url), F.lit('">'), html_escape(F.col("title")), F.lit("</a>"))
    return found.select("title", "source", url.alias("url"), html.alias("html"))


def padded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Report lines: every column as wide as its longest value, numbers to the right. Widths are one aggregated row."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    wide = rows.agg(*[F.greatest(F.max(F.length(text(c))), F.lit(len(c))).alias(f"__{c}") for c in columns])
    numeric = {c for c in columns if kinds[c] in ("int", "bigint", "double", "float")}
    cell = lambda c: (F.lpad if c in numeric else F.rpad)(text(c), F.col(f"__{c}"), " ")
    return rows.join(F.broadcast(wide)).select(F.rtrim(F.concat_ws("  ", *[cell(c) for c in columns])).alias("line"))


# Columns of the listings file, in order.
LISTING_COLUMNS = (
    "source sources title company location remote_type remote_scope employment_type salary_raw salary_min salary_max salary_currency salary_period matched_keyword matched_keywords "
    "posted_at age_hours date_confidence description job_url apply_url via_indeed ats_provider listing_type canonical_url source_url company_domain keyword_category keyword_confidence "
    "medical_role_score remote_confidence quality_flags first_seen_at is_new reposted_at duplicate_count is_duplicate duplicate_of id"
).split()


def listing_lines(rows: DataFrame) -> DataFrame:
    """Lines of the listings file; the description is the plain text where there is one."""
    text = [c for c in ("description_text", "description") if c in rows.columns]
    return csv_lines(rows.withColumn("description", F.coalesce(*text)) if text else rows, LISTING_COLUMNS)


def status_summary(statuses: DataFrame) -> DataFrame:
    """attempted, succeeded, failed, skipped: one row over the sources' statuses."""
    is_in = lambda *x: F.count_if(F.col("status").isin(*x))
    return statuses.agg(F.count_if(F.col("status") != "SKIPPED").alias("attempted"), is_in("OK", "PARTIAL").alias("succeeded"), is_in("ERROR", "BLOCKED").alias("failed"), is_in("SKIPPED").alias("skipped"))


def with_duplicates(unique: DataFrame, duplicates: DataFrame, wanted: bool) -> DataFrame:
    """The listings of a result, with their duplicates where they are asked for."""
    return unique.unionByName(duplicates, allowMissingColumns=True) if wanted else unique


def split_accepted(rows: DataFrame, rejection: str = "rejection") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by a reason that is null or not."""
    return rows.where(F.col(rejection).isNull()), rows.where(F.col(rejection).isNotNull())
