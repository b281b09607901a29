"""Queries of the corpus operators, each over its whole tables, and SQL where SQL is able."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import encoding, fusion, names, neardup, packing, sentences, tokenize
from weftline.plans.stages import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.surviving_rows(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "feeds"))


def p1_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merged_records(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "feeds"))


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.source_report(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "feeds"))


def _p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_jobs").select(F.lit("raw_jobs").alias("tab"), F.col("raw_id").cast("string").alias("rec_key"), F.col("descriptionText").alias("text"))
    jobs = table(spark, sf_dir, "jobs").select(F.lit("jobs").alias("tab"), F.col("id").alias("rec_key"), F.col("title").alias("text"))
    return raw.unionByName(jobs)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.affected(_p2_values(spark, sf_dir), ["tab", "rec_key"])


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(_p2_values(spark, sf_dir), ["tab", "rec_key"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "raw_jobs").select("raw_id", "descriptionText")
    pairs = neardup.linked_pairs(spread(texts), "raw_id", "descriptionText", width=3, similarity=0.5, min_chars=300)
    return pairs.toDF("raw_id_a", "raw_id_b")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "raw_jobs").select("raw_id", "descriptionText")
    return neardup.groups(spread(texts), "raw_id", "descriptionText", width=3, similarity=0.5, min_chars=300)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select(F.col("id").alias("job_id"), "company")
    return names.variant_rows(jobs, "job_id", "company", table(spark, sf_dir, "companies"), "company_id", "name")


def p7_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.attribute(table(spark, sf_dir, "jobs"), "company", table(spark, sf_dir, "companies"), "company_id", "name")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tokenize.token_ids(docs, "text").alias("ids"))


def _p9_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.sizes(docs, tokenize.token_count(docs, "text"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_p9_sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = table(spark, sf_dir, "pack_sizes")
    return packing.containers(packing.packed(_p9_sizes(spark, sf_dir), packs), packs)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = table(spark, sf_dir, "pack_sizes")
    return packing.fill(packing.packed(_p9_sizes(spark, sf_dir), packs), packs)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sentences.sentences(docs).select("doc_id", "start_char", "end_char", "sentence")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_merged": p1_merged,
    "p1_sources": p1_sources,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p7_spellings": p7_spellings,
    "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
}
ORACLES: dict[str, str] = {
    "p1_found": """WITH many AS (SELECT canonical_url FROM jobs WHERE trim(canonical_url) <> '' GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT canonical_url, id, ats_provider, nullif(trim(apply_url), '') u, try_cast(posted_at AS TIMESTAMPTZ) t, CASE WHEN json_valid(data) THEN data END d FROM jobs SEMI JOIN many USING (canonical_url)),
f AS (SELECT *, nullif(json_extract_string(d, '$.description_text'), '') x, coalesce((json_extract(d, '$.description_is_snippet'))::BOOLEAN, true) sn,
 CASE json_extract_string(d, '$.date_confidence') WHEN 'exact' THEN 0 WHEN 'estimated' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END cf, lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) h FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY x IS NULL, sn, length(x) DESC, id) a, row_number() OVER (PARTITION BY canonical_url ORDER BY t IS NULL, cf, t, id) b,
 row_number() OVER (PARTITION BY canonical_url ORDER BY u IS NULL OR h IN (SELECT host FROM feeds), ats_provider IS NULL, id) c FROM f)
SELECT canonical_url, max(CASE WHEN a = 1 THEN CASE WHEN x IS NULL THEN '' ELSE id END END) AS data_id, max(CASE WHEN b = 1 THEN CASE WHEN t IS NULL THEN '' ELSE id END END) AS posted_id,
 max(CASE WHEN c = 1 THEN CASE WHEN u IS NULL OR h IN (SELECT host FROM feeds) THEN '' ELSE id END END) AS apply_id FROM o GROUP BY 1""",
}
