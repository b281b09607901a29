"""The core's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import history, instants, units
from weftline.plans import source_queries, table_queries, text_queries
from weftline.plans.stages import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay = units.yearly_pay(table(spark, sf_dir, "raw_jobs"), table(spark, sf_dir, "unit_factors"))
    return pay.select("raw_id", "min_usd_year", "max_usd_year")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.listing_times(*(table(spark, sf_dir, t) for t in ("raw_jobs", "jobright_items", "feeds")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.job_versions(table(spark, sf_dir, "job_snapshots"), table(spark, sf_dir, "scrape_runs"))


def p5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.job_ledger(table(spark, sf_dir, "job_snapshots"), table(spark, sf_dir, "scrape_runs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = text_queries.QUERIES | table_queries.QUERIES | source_queries.QUERIES | {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_ledger": p5_ledger,
}
_TIDY = "nullif(trim(regexp_replace({0}, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')), '')"
ORACLES: dict[str, str] = text_queries.ORACLES | table_queries.ORACLES | source_queries.ORACLES | {
    "p5_found": f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY started_at, id) no FROM scrape_runs),
c AS (SELECT s.job_id, r.no, s.run_id, s.loaded_at, ({', '.join(_TIDY.format(x) for x in history.WATCHED)}, coalesce(epoch_us(try_cast(trim(reposted_at) AS TIMESTAMPTZ))::VARCHAR, {_TIDY.format("reposted_at")})) st
 FROM job_snapshots s JOIN r ON s.run_id = r.id WHERE s.job_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id, no ORDER BY loaded_at DESC, st DESC) k FROM c),
l AS (SELECT *, lag(st) OVER w AS before, row_number() OVER w AS nth FROM o WHERE k = 1 WINDOW w AS (PARTITION BY job_id ORDER BY no)),
v AS (SELECT * FROM l WHERE nth = 1 OR before IS DISTINCT FROM st)
SELECT job_id, run_id AS from_run, coalesce(lead(run_id) OVER (PARTITION BY job_id ORDER BY no), '') AS to_run FROM v""",
}
FLAGSHIP = "listing_pipeline"
