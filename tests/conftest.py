import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftline.plans.stages import local_session  # noqa: E402

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SMALLEST):
        pytest.skip("no test tables here")
    return SMALLEST


def _copies(spark, sf, to, change):
    for f in sorted(os.listdir(sf)):
        df = change(f.removesuffix(".parquet"), spark.read.parquet(f"{sf}/{f}"))
        df.coalesce(1).write.mode("overwrite").parquet(f"{to}/{f}")
    return str(to)


@pytest.fixture(scope="session")
def empty_tables(spark, sf, tmp_path_factory):
    return _copies(spark, sf, tmp_path_factory.mktemp("empty"), lambda _, df: df.limit(0))


@pytest.fixture(scope="session")
def hostile_tables(spark, sf, tmp_path_factory):
    """Repeated rows, rows of nulls only, empty and very long texts, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    fixed = {"feeds", "unit_factors", "pack_sizes", "scrape_runs", "region", "nation"}
    clashing = ["word", "n", "node", "bucket", "value", "part", "piece", "bin", "spelling", "glued", "sentence", "label", "a", "b", "keys", "t", "__row", "__h"]

    def change(name, df):
        if name in fixed:
            return df
        blank = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        bare = df.limit(2).select(*[(F.lit("") if f.dataType.simpleString() == "string" else F.col(f.name)).alias(f.name) for f in df.schema])
        texts = [f.name for f in df.schema if f.name in ("text", "descriptionText", "title")]
        long = df.limit(1).withColumns({t: F.repeat(F.concat(F.coalesce(F.col(t), F.lit("x")), F.lit(". ")), 400) for t in texts}) if texts else df.limit(0)
        out = df.unionByName(df.limit(20)).unionByName(blank).unionByName(blank).unionByName(bare).unionByName(long)
        return out.withColumns({c: F.lit("?") for c in clashing if c not in df.columns})

    return _copies(spark, sf, tmp_path_factory.mktemp("hostile"), change)
