"""One surviving record for each group of duplicates: Bayesian fusion of field values with copy detection.

An item is a field of an opening, its values are claimed by sources. Source accuracies and the
dependence between sources are estimated in turns: two sources that share values thought false are
likely to copy, and a copied vote is discounted by the chance that it was copied. Each value gets the
log of its likelihood from the discounted votes plus the log of its prior; the value of the greatest
posterior survives, a last tie goes to the smallest row id.

A prior ranks the values of a field where it is stated which are trusted (full before snippet, exact before
estimated, ...): its steps are larger than any sum of votes, so that votes decide within a rank only. Fields without a
stated rank have equal priors, there the votes alone decide.

Pre-aggregation by (item, value) comes first: what is kept of a value is its best row and the set of
its sources, whose size is the number of sources, also for an opening that holds a third of all rows.
Accuracies and dependences are tables, so their number has no bound; nothing is collected.
Nulls and empty texts claim nothing; cut-off JSON claims nothing of its own fields; repeated rows count
once a source; rows with a null key stand for no opening.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.stages import materialize

#: Prior accuracy of a source, number of false values of an item, prior of dependence, share that a copier copies.
ACCURACY, FALSE_VALUES, DEPENDENT, COPIED = 0.8, 20.0, 0.1, 0.8
#: Turns of the estimate, and between which bounds an accuracy is kept.
ROUNDS, LEAST_ACCURACY, MOST_ACCURACY = 3, 0.05, 0.99
NO_SOURCE = "?"


def claims(rows: DataFrame, item: list[str], value: str, source: str, row_id: str, prior: list[Column]) -> DataFrame:
    """One row for each (item, value): its sources, its best row by prior then id. prior: columns, greater is better."""
    return (
        rows.where(F.col(value).isNotNull() & F.col(row_id).isNotNull())
        .withColumn("__rank", F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prior)]))
        .groupBy(*item, value)
        .agg(
            F.collect_set(F.coalesce(F.col(source), F.lit(NO_SOURCE))).alias("sources"),
            F.max("__rank").alias("rank"),
            F.min_by(F.col(row_id), F.struct(*[(-p).alias(f"p{i}") for i, p in enumerate(prior)], F.col(row_id).alias("r"))).alias("row_id"),
        )
    )


def votes(values: DataFrame, keys: list[str], accuracy: DataFrame, dependence: DataFrame | None) -> DataFrame:
    """keys, votes: log likelihood that a value claimed by its sources is true, copies discounted, the most accurate source first.

    values: keys, sources. accuracy: s, a. dependence: a < b, p. A value's sources meet each other, never its rows.
    """
    weight = F.ln(FALSE_VALUES * F.col("acc") / (1 - F.col("acc")))
    each = values.select(*keys, F.explode("sources").alias("s")).join(accuracy.select("s", F.col("a").alias("acc")), "s", "left").withColumn("acc", F.coalesce("acc", F.lit(ACCURACY)))
    if dependence is None:
        return each.groupBy(*keys).agg(F.sum(weight).alias("votes"))
    several = values.where(F.size("sources") > 1).select(*keys, F.explode("sources").alias("t")).join(accuracy.select(F.col("s").alias("t"), F.col("a").alias("tacc")), "t", "left")
    several = several.withColumn("tacc", F.coalesce("tacc", F.lit(ACCURACY)))
    before = (F.col("tacc") > F.col("acc")) | ((F.col("tacc") == F.col("acc")) & (F.col("t") < F.col("s")))
    met = each.join(several, keys).where(before).select(*keys, "s", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    copied = met.join(dependence, ["a", "b"]).groupBy(*keys, "s").agg(F.sum(F.log1p(-COPIED * F.col("p"))).alias("own"))
    return each.join(copied, [*keys, "s"], "left").groupBy(*keys).agg(F.sum(weight * F.exp(F.coalesce("own", F.lit(0.0)))).alias("votes"))


def dependence_of(a: Column, b: Column, true: Column, false: Column, different: Column) -> Column:
    """Posterior that one of two sources copies, from how many values they share that are true and false, and differ in."""
    t, f = a * b, (1 - a) * (1 - b) / FALSE_VALUES
    c, acc = COPIED, (a + b) / 2
    log_ratio = true * F.ln(t / (c * acc + (1 - c) * t)) + false * F.ln(f / (c * (1 - acc) + (1 - c) * f)) + different * F.lit(-1.0) * F.ln(F.lit(1.0 - c))
    bounded = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), log_ratio))
    return 1 / (1 + (1 - DEPENDENT) / DEPENDENT * F.exp(bounded))


def _pairs(column: str) -> Column:
    """All pairs a < b of a set of sources."""
    return F.expr(f"flatten(transform(array_sort({column}), (x, i) -> transform(slice(array_sort({column}), i + 2, size({column})), y -> struct(x as a, y as b))))")


def estimate(values: DataFrame, item: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(accuracies s, a; dependences a < b, p) after ROUNDS turns, as tables. values: as of claims, materialised."""
    keys = [*item, value]
    together = values.select(*item, F.explode("sources").alias("s")).distinct().groupBy(*item).agg(F.collect_set("s").alias("who")).where(F.size("who") > 1)
    both = materialize(together.select(F.explode(_pairs("who")).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")), "fusion-pairs")
    accuracy = values.select(F.explode("sources").alias("s")).distinct().select("s", F.lit(ACCURACY).alias("a"))
    dependence = None
    for _ in range(ROUNDS):
        voted = values.select(*keys, "sources").join(votes(values, keys, accuracy, dependence), keys)
        weight = F.exp(F.least("votes", F.lit(300.0)))
        total = voted.groupBy(*item).agg(F.max("votes").alias("top"), F.sum(weight).alias("z"), F.count(F.lit(1)).alias("n_values"))
        # values of an item that no source names share what is left of the false ones
        judged = voted.join(total, item).withColumn("p", weight / (F.col("z") + F.greatest(F.lit(FALSE_VALUES) + 1 - F.col("n_values"), F.lit(0.0))))
        judged = materialize(judged.select("sources", "p", (F.col("votes") == F.col("top")).alias("true")), "fusion-judged")
        found = judged.select(F.explode("sources").alias("s"), "p").groupBy("s").agg(F.avg("p").alias("a"))
        accuracy = materialize(found.select("s", F.greatest(F.lit(LEAST_ACCURACY), F.least(F.lit(MOST_ACCURACY), "a")).alias("a")), "fusion-accuracy")
        shared = judged.where(F.size("sources") > 1).select(F.explode(_pairs("sources")).alias("p"), "true").groupBy("p.a", "p.b").agg(F.count_if("true").alias("t"), F.count_if(~F.col("true")).alias("f"))
        side = lambda k: accuracy.select(F.col("s").alias(k), F.col("a").alias(f"acc_{k}"))
        counted = both.join(shared, ["a", "b"], "left").na.fill(0, ["t", "f"]).join(side("a"), "a").join(side("b"), "b")
        apart = F.greatest(F.lit(0), F.col("n") - F.col("t") - F.col("f"))
        dependence = materialize(counted.select("a", "b", dependence_of(F.col("acc_a"), F.col("acc_b"), F.col("t"), F.col("f"), apart).alias("p")), "fusion-dependence")
    return accuracy, dependence


def survivors(values: DataFrame, item: list[str], value: str, accuracy: DataFrame, dependence: DataFrame) -> DataFrame:
    """The value of the greatest posterior of each item: item, row_id, value, votes, n_values."""
    scored = values.join(votes(values, [*item, value], accuracy, dependence), [*item, value])
    return (
        scored.groupBy(*item)
        .agg(
            F.max_by(F.struct("row_id", F.col(value).alias("value"), "votes"), F.struct("rank", F.round("votes", 9), F.struct(value))).alias("m"),
            F.count(F.lit(1)).alias("n_values"),
        )
        .select(*item, "m.row_id", "m.value", "m.votes", "n_values")
    )


# -- openings ---------------------------------------------------------------------------------------------------

_CONFIDENCE = {"exact": 3, "estimated": 2, "unknown": 1}


#: Fields whose values have no stated rank: votes alone decide.
VOTED = ("title", "company", "location", "remote_type")


def opening_claims(jobs: DataFrame, feeds: DataFrame, voted: tuple[str, ...] = ()) -> DataFrame:
    """Claims on the fields data, posted_at and apply_url, and on the voted ones, of every canonical_url with two or more rows."""
    data = F.try_parse_json("data")
    text = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    rows = (
        jobs.where(F.trim("canonical_url") != "")
        .select("canonical_url", "id", "ats_provider", "apply_url", "posted_at", data.alias("v"), *[plain(f).alias(f"own_{f}") for f in voted])
        .select(
            "canonical_url",
            "id",
            text("source_id").alias("source"),
            F.nullif(text("description_text"), F.lit("")).alias("description"),
            text("description_is_snippet", "boolean").alias("snippet"),
            F.unix_micros(F.try_to_timestamp("posted_at")).alias("posted"),
            text("date_confidence").alias("confidence"),
            F.nullif(F.trim("apply_url"), F.lit("")).alias("apply"),
            F.nullif(F.trim("ats_provider"), F.lit("")).isNotNull().cast("bigint").alias("ats"),
            *[f"own_{f}" for f in voted],
        )
        .withColumn("host", F.lower(F.regexp_extract("apply", r"(?i)^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)))
    )
    many = rows.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("canonical_url")
    rows = rows.join(many, "canonical_url", "left_semi")
    boards = feeds.select(F.lower("host").alias("host")).where("host is not null").distinct().withColumn("board", F.lit(True))
    trust = F.coalesce(*[F.when(F.col("confidence") == k, F.lit(v)) for k, v in _CONFIDENCE.items()], F.lit(0))
    zero = F.lit(0).cast("bigint")

    def field(name: str, value: Column, has: Column, first: Column, then: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.alias("value"), has.alias("has"), first.alias("p0"), then.alias("p1"))

    fields = F.array(
        field("data", F.hex(F.xxhash64("description")), F.col("description").isNotNull(), (~F.coalesce("snippet", F.lit(True))).cast("bigint"), F.length("description").cast("bigint")),
        field("posted_at", F.col("posted").cast("string"), F.col("posted").isNotNull(), trust.cast("bigint"), -F.col("posted")),
        field("apply_url", F.col("apply"), F.col("apply").isNotNull() & F.col("board").isNull(), F.col("ats"), zero),
        *[field(f, F.col(f"own_{f}"), F.col(f"own_{f}").isNotNull(), zero, zero) for f in voted],
    )
    long = rows.join(boards, "host", "left").select("canonical_url", "id", "source", F.inline(fields)).where("has")
    return claims(long, ["canonical_url", "field"], "value", "source", "id", [F.col("p0"), F.col("p1")])


def surviving_fields(jobs: DataFrame, feeds: DataFrame, voted: tuple[str, ...] = ()) -> DataFrame:
    """canonical_url, field, row_id, value, votes, n_values of each field that survives."""
    values = materialize(opening_claims(jobs, feeds, voted), "fusion-claims")
    accuracy, dependence = estimate(values, ["canonical_url", "field"], "value")
    return survivors(values, ["canonical_url", "field"], "value", accuracy, dependence)


def _openings(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.trim("canonical_url") != "").groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("canonical_url")


def surviving_rows(jobs: DataFrame, feeds: DataFrame) -> DataFrame:
    """canonical_url, data_id, posted_id, apply_id of each opening of two or more rows; '' where no row has a value."""
    pick = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("row_id"))), F.lit(""))
    found = surviving_fields(jobs, feeds)
    return _openings(jobs).join(found, "canonical_url", "left").groupBy("canonical_url").agg(pick("data").alias("data_id"), pick("posted_at").alias("posted_id"), pick("apply_url").alias("apply_id"))


def merged_records(jobs: DataFrame, feeds: DataFrame) -> DataFrame:
    """The record of each opening: data, posted_at and apply_url from their surviving rows, the other fields as voted."""
    found = surviving_fields(jobs, feeds, VOTED)
    row = lambda f: F.max(F.when(F.col("field") == f, F.col("row_id"))).alias(f"{f}_row")
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    ids = _openings(jobs).join(found, "canonical_url", "left").groupBy("canonical_url").agg(*[row(f) for f in ("data", "posted_at", "apply_url")], *[value(f) for f in VOTED])
    data = jobs.select(F.col("id").alias("data_row"), "data")
    posted = jobs.select(F.col("id").alias("posted_at_row"), "posted_at")
    apply = jobs.select(F.col("id").alias("apply_url_row"), "apply_url", "ats_provider")
    return ids.join(data, "data_row", "left").join(posted, "posted_at_row", "left").join(apply, "apply_url_row", "left").withColumnsRenamed({"data_row": "data_id", "posted_at_row": "posted_id", "apply_url_row": "apply_id"})


def source_report(jobs: DataFrame, feeds: DataFrame) -> DataFrame:
    """source_a, source_b, accuracy_a, accuracy_b, dependence of every pair of sources that meet in an item."""
    values = materialize(opening_claims(jobs, feeds, VOTED), "fusion-claims")
    accuracy, dependence = estimate(values, ["canonical_url", "field"], "value")
    side = lambda k: accuracy.select(F.col("s").alias(k), F.col("a").alias(f"accuracy_{k}"))
    return dependence.join(side("a"), "a").join(side("b"), "b").select(F.col("a").alias("source_a"), F.col("b").alias("source_b"), "accuracy_a", "accuracy_b", F.col("p").alias("dependence"))
