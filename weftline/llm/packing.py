"""Packing of texts into containers of fixed capacity by harmonic classes.

An item of more than half a capacity is of class 1, of more than a third of class 2, and so on: class j
holds the items of which exactly j fit whatever their exact lengths. Workers fill each class's bins with
j items each, independently of one another, the items of a class taken longest first so that a bin's
items are alike. A bin of class 2 and above stays only if it leaves at most WASTE of the capacity
unused; the items of the others, those of at most 1/CLASSES of the capacity, and what a class leaves over
then go, longest first, into the room that bins still have, tightest first, and into own bins last. The
plain method would leave a tenth of the room unused on these lengths; this leaves less than a hundredth.

On the given lengths most items take the second way, since bins of like items seldom fill a container to the
hundredth: `fill` tells the share of items that bins of a fixed count hold (see the README for figures).

A text longer than the capacity is cut into full containers and one rest, which is an item; no other
text is split. Items are dealt to workers by a hash, so many that each packs about PER_WORKER of them, and a
worker takes them in a fixed order: the bins are the same whatever the cluster. A worker's last bins of all
classes are merged by the same fit, so at most a few bins a worker are less than filled. Null and empty texts
have no tokens, hence no container. Repeated texts are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.stages import materialize

#: Number of harmonic classes with a fixed count; shorter items fill what is left.
CLASSES = 12
#: Share of a capacity that a bin of two or more of a class may leave unused.
WASTE = 0.01
#: Items that one worker packs; the number of workers follows from the number of items.
PER_WORKER = 50_000


def pack(sizes: list[int], capacity: int, classes: int = CLASSES, waste: float = WASTE) -> tuple[list[int], list[bool]]:
    """Bin number of each item (0 < size <= capacity), and whether it is one of its class's fixed count in it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    by_class: dict[int, list[int]] = {}
    for i in order:
        by_class.setdefault(min(classes, capacity // sizes[i]), []).append(i)
    out, counted, bins, loose = [0] * len(sizes), [False] * len(sizes), 0, []
    room: list[tuple[int, int]] = []
    for j, items in sorted(by_class.items()):
        if j >= classes:
            loose += items
            continue
        whole = len(items) // j * j
        for at in range(0, whole, j):
            left = capacity - sum(sizes[i] for i in items[at : at + j])
            if j > 1 and left > waste * capacity:
                loose += items[at : at + j]
                continue
            for i in items[at : at + j]:
                out[i], counted[i] = bins, True
            if left:
                insort(room, (left, bins))
            bins += 1
        loose += items[whole:]
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, bins
            bins += 1
        out[i] = b
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))
    return out, counted


_OUT = (
    T.StructType()
    .add("pack_id", T.LongType())
    .add("doc_id", T.LongType())
    .add("piece", T.IntegerType())
    .add("n_tokens", T.LongType())
    .add("worker", T.LongType())
    .add("bin", T.LongType())
    .add("by_count", T.BooleanType())
)


def pieces(sized: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, capacity_tokens, doc_id, piece, n_tokens: each text as one item, or its full containers and its rest."""
    real = packs.where(F.col("capacity_tokens") > 0).dropDuplicates(["pack_id"])
    caps = [(r.pack_id, r.capacity_tokens) for r in real.select("pack_id", "capacity_tokens").collect()]  # a fixed table of few rows
    each = F.array(*[F.struct(F.lit(a).cast("bigint").alias("pack_id"), F.lit(b).cast("bigint").alias("capacity_tokens")) for a, b in caps])
    if not caps:
        return sized.sparkSession.createDataFrame([], "pack_id bigint, capacity_tokens bigint, doc_id bigint, piece int, n_tokens bigint")
    items = sized.where("n_tokens > 0").select("doc_id", "n_tokens", F.inline(each))
    no = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity_tokens")).cast("int"))).alias("piece")
    cut = items.select("pack_id", "capacity_tokens", "doc_id", "n_tokens", no)
    return cut.withColumn("n_tokens", F.least(F.col("capacity_tokens"), F.col("n_tokens") - F.col("capacity_tokens") * F.col("piece")))


def packed(sized: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, doc_id, piece, n_tokens, worker, bin, by_count: a container is (pack_id, worker, bin). sized: doc_id, n_tokens.

    Items are spread over the workers by a hash, so that each has the same mix of lengths. by_count tells the items that
    are in a bin of their class's fixed count; the others were fitted into the room left.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []

        def flush() -> pd.DataFrame:
            bins, counted = pack([r[2] for r in rows], key[2])
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "n_tokens"]).assign(pack_id=key[1], worker=key[0], bin=bins, by_count=counted)
            return frame[_OUT.names]

        for batch in batches:
            for w, p, c, d, piece, n in batch.itertuples(index=False, name=None):
                if (w, p, c) != key:
                    if rows:
                        yield flush()
                    key, rows = (w, p, c), []
                rows.append((d, piece, n))
        if rows:
            yield flush()

    items = pieces(sized, packs)
    workers = max(1, -(-items.count() // PER_WORKER))
    dealt = items.withColumn("worker", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(workers)))
    return (
        dealt.repartition(workers, "worker", "pack_id")
        .sortWithinPartitions("worker", "pack_id", F.desc("n_tokens"), "doc_id", "piece")
        .select("worker", "pack_id", "capacity_tokens", "doc_id", "piece", "n_tokens")
        .mapInPandas(run, _OUT)
    )


def containers(packing: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, worker, bin, items, used, capacity_tokens of each container."""
    filled = packing.groupBy("pack_id", "worker", "bin").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("used"))
    return filled.join(packs.select("pack_id", "capacity_tokens"), "pack_id")


def fill(packing: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, capacity_tokens, items, counted_items (in bins of a fixed count), containers, used_tokens, filled (share of the room that is used)."""
    by_bin = packing.groupBy("pack_id", "worker", "bin").agg(F.count(F.lit(1)).alias("items"), F.count_if("by_count").alias("counted"), F.sum("n_tokens").alias("used"))
    total = by_bin.groupBy("pack_id").agg(F.sum("items").alias("items"), F.sum("counted").alias("counted_items"), F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used_tokens"))
    own = packs.select("pack_id", "capacity_tokens").dropDuplicates(["pack_id"])
    return total.join(own, "pack_id").select("pack_id", "capacity_tokens", "items", "counted_items", "containers", "used_tokens", (F.col("used_tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def sizes(docs: DataFrame, counted) -> DataFrame:
    """doc_id, n_tokens as a table: the texts are tokenised once for all capacities."""
    return materialize(docs.select("doc_id", counted.alias("n_tokens")), "packing-sizes")
