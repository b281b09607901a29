"""State that lasts across runs: keyed merges, reposts, lookups with an expiry, statuses."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import urls


def first_by_key(rows: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row a key, the first in order; a partial aggregate, so hot keys are reduced before the shuffle."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("r")).select(*key, "r.*")


def raw_dedupe(rows: DataFrame, key: list[str], order: str, keyword: str, keep: list[str]) -> DataFrame:
    """First row of each key, with the key's distinct keywords in order of first arrival."""
    firsts = rows.groupBy(*key, keyword).agg(F.min(order).alias("__o"))
    words = firsts.where(F.col(keyword).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__o", keyword))).alias("__w"))
    one = first_by_key(rows, key, [order], keep)
    same = reduce(lambda a, b: a & b, [F.equal_null(one[k], words[k]) for k in key])
    return one.join(words, same, "left").select(*[one[c] for c in one.columns], F.coalesce(F.transform("__w", lambda x: x[keyword]), F.array().cast("array<string>")).alias("found_by"))


def merge_by_key(state: DataFrame, incoming: DataFrame, key: list[str], columns: dict[str, Column]) -> DataFrame:
    """Full outer join of state (alias s) and incoming (alias i) on key; columns give the merged values. Keys are not null."""
    s, i = state.alias("s"), incoming.alias("i")
    on = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"i.{k}") for k in key])
    return s.join(i, on, "full").select(*[F.coalesce(f"s.{k}", f"i.{k}").alias(k) for k in key], *[c.alias(n) for n, c in columns.items()])


def reposted(posted: Column, original: Column, hours: float = 12.0) -> Column:
    """Whether a listing came out again: more than `hours` after its original time."""
    return F.coalesce((F.unix_millis(posted) - F.unix_millis(original)) > hours * 3_600_000, F.lit(False))


def with_expiry(rows: DataFrame, cache: DataFrame, key: list[str], expires: str, now: Column) -> DataFrame:
    """Left lookup into a cache, entries past their expiry not seen. Columns of the cache beside key and expires come along."""
    # of several entries of a key the one that expires last
    rest = [c for c in cache.columns if c not in (*key, expires)]
    last = cache.where(F.col(expires) >= now).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(expires, *rest)).alias("__r")).select(*key, "__r.*")
    return rows.join(last, key, "left")


def override(detail: dict[str, str]) -> dict[str, Column]:
    """{column: detail column} as coalesce(detail, own): a null never wipes a value."""
    return {c: F.coalesce(F.col(d), F.col(c)) for c, d in detail.items()}


def cascade(rows: DataFrame, row_id: str, dims: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """row_id, found, via: the id of the first dimension (name, keys + id, keys) that knows the row.

    A dimension is one row a key; rows whose key has a null don't meet it.
    """
    out = rows
    for n, (_, dim, keys) in enumerate(dims):
        out = out.join(dim.select(*keys, F.col("id").alias(f"__id{n}")), keys, "left")
    ids = [F.col(f"__id{n}") for n in range(len(dims))]
    via = F.coalesce(*[F.when(c.isNotNull(), F.lit(d[0])) for c, d in zip(ids, dims)])
    return out.select(row_id, F.coalesce(*ids).alias("found"), via.alias("via"))


def latest_with_ties(rows: DataFrame, key: str, at: str) -> DataFrame:
    """All rows of each key that bear its latest time."""
    top = rows.groupBy(F.col(key).alias("__k")).agg(F.max(at).alias("__t"))
    return rows.join(top, (F.col(key) == F.col("__k")) & (F.col(at) == F.col("__t"))).drop("__k", "__t")


def top_per_key(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key, with their place; the limit is the operator's purpose."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def stale_or_active(last_seen: Column, now: Column, hours: float = 48.0) -> Column:
    return F.when((F.unix_millis(now) - F.unix_millis(last_seen)) > hours * 3_600_000, "stale").otherwise("active")


def follow(hops: DataFrame, most: int = 6) -> DataFrame:
    """origin, target, hops of every address that redirects: its chain followed for at most `most` hops, loops cut.

    hops: src, dst with one row a src. Each round is one equi-join that doubles nothing: chains still open go on.
    """
    step = hops.groupBy("src").agg(F.min("dst").alias("dst"))
    out = step.select(F.col("src").alias("origin"), F.col("dst").alias("target"), F.lit(1).alias("hops"), F.array("src", "dst").alias("seen"))
    for _ in range(most - 1):
        more = step.withColumnRenamed("src", "__s").withColumnRenamed("dst", "__d")
        out = out.join(more, F.col("target") == F.col("__s"), "left")
        go = F.col("__d").isNotNull() & ~F.array_contains("seen", F.col("__d"))
        out = out.select(
            "origin",
            F.when(go, F.col("__d")).otherwise(F.col("target")).alias("target"),
            (F.col("hops") + go.cast("int")).alias("hops"),
            F.when(go, F.concat("seen", F.array("__d"))).otherwise(F.col("seen")).alias("seen"),
        )
    return out.select("origin", "target", F.col("hops").cast("bigint").alias("hops"))


def wants_detail(rows: DataFrame) -> Column:
    """Whether a listing's detail page is still worth asking for: no reason against it, and no full text yet. rows: rejection, detail_fetched, snippet, text."""
    open_text = F.coalesce("snippet", F.lit(True)) | (F.coalesce(F.col("text"), F.lit("")) == "")
    return F.col("rejection").isNull() & ~F.coalesce("detail_fetched", F.lit(False)) & open_text


def link_verdict(rows: DataFrame, refused_host: str) -> DataFrame:
    """rows with code and flag of what following their address told, and the address behind a counter in its place.

    rows: apply_url, canonical_url, status and final_url of the address followed (null where it wasn't).
    """
    gone = F.col("status").isin(404, 410)
    refused = urls.leads_to(F.col("final_url"), refused_host)
    moved = F.coalesce(urls.is_tracker(F.col("apply_url")) & ~urls.is_board(F.col("final_url")) & ~gone & ~refused, F.lit(False))
    return rows.withColumns(
        {
            "code": F.when(refused, "refused_host").when(gone, "low_quality"),
            "flag": F.when(gone & ~refused, "broken_apply_url"),
            "apply_url": F.when(moved, urls.strip_tracking(F.col("final_url"))).otherwise(F.col("apply_url")),
            "canonical_url": F.when(moved, urls.canonical(F.col("final_url"))).otherwise(F.col("canonical_url")),
        }
    )


# -- state kept as a table: versions of its buckets, and one pointer file that names those which hold

BUCKETS = 64
_POINTER = "_current.json"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, path: str) -> dict:
    """What the pointer file says; an empty state where there is none."""
    jvm, folder, files = _files(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(folder, _POINTER)
    if not files.exists(at):
        return {"batch": None, "parts": {}}
    stream = files.open(at)
    try:
        return json.loads(str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, said: dict) -> None:
    """Replaces the pointer file in one step, then removes versions that no bucket has any more."""
    jvm, folder, files = _files(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(folder, f"_fresh-{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(fresh), context.makeQualified(jvm.org.apache.hadoop.fs.Path(folder, _POINTER)), options)
    held = {p.split("/")[0] for p in said["parts"].values()}
    for x in files.listStatus(folder):
        name = x.getPath().getName()
        if name.startswith("v-") and name not in held:
            files.delete(x.getPath(), True)


def read_state(spark: SparkSession, path: str, buckets: set[int] | None = None) -> DataFrame | None:
    """The state's rows, of some buckets or all; None where there are none."""
    parts = _pointer(spark, path)["parts"]
    paths = [f"{path}/{p}" for b, p in parts.items() if buckets is None or int(b) in buckets]
    return spark.read.parquet(*paths) if paths else None


def last_batch(spark: SparkSession, path: str) -> int | None:
    return _pointer(spark, path)["batch"]


def bucket_of(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def write_state(df: DataFrame, path: str, key: list[str], buckets: set[int] | None = None, batch: int | None = None) -> None:
    """Replaces some buckets of a state, or all, by df's rows. A run that fails at any point leaves the state as it was."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.withColumn("__bucket", bucket_of(key)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{version}")
    said = _pointer(spark, path)
    kept = {} if buckets is None else {b: p for b, p in said["parts"].items() if int(b) not in buckets}
    jvm, folder, files = _files(spark, f"{path}/{version}")
    new = {x.getPath().getName().removeprefix("__bucket="): f"{version}/{x.getPath().getName()}" for x in files.listStatus(folder) if x.getPath().getName().startswith("__bucket=")}
    _point(spark, path, {"batch": batch if batch is not None else said["batch"], "parts": kept | new})


# -- listings of a run into the listings of all runs


def resolved(incoming: DataFrame, stored: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """row_id, found, via: the stored id of each incoming listing by the first key that knows it.

    Keys in order: source and its own id (sources: source, source_key, job_id), canonical_url, tracking system's id with
    the company, fingerprint of company and title (the oldest). incoming: row_id, canonical_url, ats_provider, ats_job_id,
    company, fingerprint, and source, source_key where sources are given. stored: id, canonical_url, ats_provider, ats_job_id,
    company, fingerprint, first_seen_at. An empty company or title makes no fingerprint.
    """
    least = lambda keys, rows: rows.groupBy(*keys).agg(F.min("id").alias("id"))
    ats = ["ats_provider", "ats_job_id", "company"]
    whole = F.col("fingerprint").rlike(r"^[^|]+\|[^|]+$")
    dims = [
        ("url", least(["canonical_url"], stored), ["canonical_url"]),
        ("ats", least(ats, stored.where("ats_provider <> '' and ats_job_id <> ''")), ats),
        ("fingerprint", stored.where(whole).groupBy("fingerprint").agg(F.min_by("id", F.struct("first_seen_at", "id")).alias("id")), ["fingerprint"]),
    ]
    if sources is not None:
        dims.insert(0, ("source", sources.groupBy("source", "source_key").agg(F.min("job_id").alias("id")), ["source", "source_key"]))
    return cascade(incoming, "row_id", dims)


def upserted(stored: DataFrame, incoming: DataFrame, found: DataFrame, now: str, hours: float = 12.0) -> DataFrame:
    """id, is_new, first_seen_at, last_seen_at, times_seen, posted_at, original_posted_at, reposted_at, ats_provider, ats_job_id of every listing.

    A new listing is first and last seen now. One that is known keeps its first_seen_at and original_posted_at and takes
    the values of the last of its incoming rows (by row_id), but a null never wipes a tracking system's id; it is reposted at a
    posted_at more than `hours` after the original. Unseen listings stay as they are, is_new null.
    stored: these columns but is_new. incoming: row_id, posted_at, ats_provider, ats_job_id. found: as of resolved.
    """
    came = incoming.join(found.select("row_id", "found"), "row_id").withColumn("id", F.coalesce("found", "row_id"))
    known = came.where("found is not null").join(stored.select("id", F.coalesce("original_posted_at", "posted_at").alias("__o")), "id")
    at = lambda c: F.unix_millis(F.try_to_timestamp(c))
    again = F.coalesce((at(F.col("posted_at")) - at(F.col("__o"))) > hours * 3_600_000, F.lit(False))
    last = lambda c, cond=None: F.max_by(c, "row_id") if cond is None else F.max_by(F.when(cond, F.col(c)), F.when(cond, F.col("row_id")))
    news = known.withColumn("__again", again).groupBy("id").agg(
        F.count(F.lit(1)).alias("k"), last("posted_at").alias("posted"), last("posted_at", F.col("__again")).alias("re"),
        last("ats_provider", F.col("ats_provider").isNotNull()).alias("ap"), last("ats_job_id", F.col("ats_job_id").isNotNull()).alias("aj"),
    )
    seen = F.col("k").isNotNull()
    old = stored.join(news, "id", "left").select(
        "id", F.when(seen, F.lit(False)).alias("is_new"), "first_seen_at", F.when(seen, F.lit(now)).otherwise(F.col("last_seen_at")).alias("last_seen_at"), (F.col("times_seen") + F.coalesce("k", F.lit(0))).alias("times_seen"),
        F.when(seen, F.col("posted")).otherwise(F.col("posted_at")).alias("posted_at"), "original_posted_at", F.coalesce("re", "reposted_at").alias("reposted_at"), F.coalesce("ap", "ats_provider").alias("ats_provider"), F.coalesce("aj", "ats_job_id").alias("ats_job_id"),
    )
    fresh = came.where("found is null").select(
        "id", F.lit(True).alias("is_new"), F.lit(now).alias("first_seen_at"), F.lit(now).alias("last_seen_at"), F.lit(1).cast("bigint").alias("times_seen"), "posted_at", F.col("posted_at").alias("original_posted_at"),
        F.lit(None).cast("string").alias("reposted_at"), "ats_provider", "ats_job_id",
    )
    return old.unionByName(fresh)


def repointed(duplicates: DataFrame, found: DataFrame) -> DataFrame:
    """Duplicates whose survivor (duplicate_of) was stored under another id point to that one."""
    ids = found.where("found is not null").select(F.col("row_id").alias("duplicate_of"), "found")
    return duplicates.join(ids, "duplicate_of", "left").withColumn("duplicate_of", F.coalesce("found", "duplicate_of")).drop("found")
