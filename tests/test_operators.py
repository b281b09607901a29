import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import history, instants, linkage, sinks, state, units
from weftline.plans.graph import components


def brute_changepoints(x, penalty):
    best = (math.inf, None)
    for k in range(len(x)):
        for cuts in itertools.combinations(range(1, len(x)), k):
            edges = [0, *cuts, len(x)]
            cost = sum(sum((v - sum(x[a:b]) / (b - a)) ** 2 for v in x[a:b]) for a, b in zip(edges, edges[1:])) + penalty * k
            best = min(best, (cost, edges[:-1]))
    return best


def test_changepoints_are_optimal():
    rng = random.Random(5)
    for _ in range(20):
        x = [rng.gauss(0 if i < 4 else 4.6 if i < 8 else 0.5, 0.7) for i in range(10)]
        starts = units.changepoints([1] * 10, x, [v * v for v in x], 1.0, 2.0)
        edges = [*starts, len(x)]
        cost = sum(sum((v - sum(x[a:b]) / (b - a)) ** 2 for v in x[a:b]) for a, b in zip(edges, edges[1:])) + 2.0 * (len(starts) - 1)
        assert cost == pytest.approx(brute_changepoints(x, 2.0)[0])


PAY_ROW = "raw_id bigint, source string, fetchedAt string, salaryRaw string, salary struct<min: double, max: double, currency: string, period: string>"


def test_change_of_scale_is_taken_back(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        day = (datetime(2026, 1, 1) + timedelta(days=i)).isoformat() + "Z"
        v = round(60000 * math.exp(rng.gauss(0, 0.2)))
        shifted = "a" if i >= 200 else "b"
        rows.append((i, "s", day, None, (float(v * 100 if shifted == "a" else v), None, "usd", "YEARLY")))
        rows.append((1000 + i, "t", day, f"${v:,} a year", None))
    factors = spark.createDataFrame([("period", "year", 1.0), ("currency", "USD", 1.0)], "kind string, code string, factor double")
    got = {r.raw_id: r for r in units.yearly_pay(spark.createDataFrame(rows, PAY_ROW), factors).collect()}
    assert len(got) == 600
    assert all(got[i].factor == (100.0 if i >= 200 else 1.0) for i in range(300))
    assert all(20_000 < got[i].min_usd_year < 200_000 for i in range(300))
    assert all(got[i].max_usd_year == -1 for i in range(300))


def test_pay_without_any_stated_unit(spark):
    factors = spark.createDataFrame([("period", "year", 1.0), ("currency", "USD", 1.0)], "kind string, code string, factor double")
    rows = [(1, "s", "2026-01-01T00:00:00Z", None, (5.0, 6.0, "usd", "year")), (2, "s", None, "", None), (3, "s", None, "$5", None), (None, None, None, None, None)]
    got = units.yearly_pay(spark.createDataFrame(rows, PAY_ROW), factors).collect()
    assert [(r.raw_id, r.min_usd_year, r.max_usd_year) for r in got] == [(1, 5, 6)]


def replay(events):
    """The ledger by asking, after each event, what every valid time says."""
    seen, out = {}, []
    for i, (valid, recorded, value) in enumerate(events):
        seen[valid] = value
        keys = sorted(seen)
        out.append({(k, keys[j + 1] if j + 1 < len(keys) else None, seen[k]) for j, k in enumerate(keys)})
    return out


def ledger_of(events):
    """The ledger of one entity in Python: what the windows, the sweep and the join give."""
    sweep, firsts, rows = history.Sweep(), {}, []
    said = {}
    for v, r, s in events:
        if v not in said or said[v][-1][1] != s:
            said.setdefault(v, []).append((r, s))
        firsts.setdefault(v, r)
    spans = [x for v, r in firsts.items() if (x := sweep.add(v, r))] + sweep.open_rows()
    for v, to, since, until in spans:
        for (at, s), nxt in zip(said[v], [x[0] for x in said[v][1:]] + [None]):
            began, ended = max(at, since), min((x for x in (nxt, until) if x is not None), default=None)
            if ended is None or began < ended:
                rows.append((v, to, began, ended, s))
    return rows


def test_ledger_tells_every_past_state():
    rng = random.Random(3)
    for _ in range(50):
        events = [(rng.randrange(6), t, rng.choice("abc")) for t in range(12)]
        rows = ledger_of(events)
        for t, expected in enumerate(replay(events)):
            at = {(a, b, s) for a, b, since, until, s in rows if since <= t and (until is None or until > t)}
            assert at == expected


def test_ledger_splits_a_covering_interval(spark):
    day = lambda d: datetime(2026, 1, d)
    rows = [("j", 1, day(1), "x"), ("j", 3, day(3), "y"), ("j", 2, day(9), "z"), ("j", 3, day(10), "y"), (None, 1, day(1), "x"), ("k", None, day(1), "x"), ("k", 1, day(2), None)]
    got = history.ledger(spark.createDataFrame(rows, "e string, v int, r timestamp, s string"), "e", "v", "r", "s").collect()
    found = {(r.e, r.valid_from, r.valid_to, r.recorded_from.day, r.recorded_to and r.recorded_to.day, r.s) for r in got}
    assert found == {("j", 1, None, 1, 3, "x"), ("j", 1, 3, 3, 9, "x"), ("j", 1, 2, 9, None, "x"), ("j", 2, 3, 9, None, "z"), ("j", 3, None, 3, None, "y"), ("k", 1, None, 2, None, None)}


def test_dictionary_grows_by_what_is_new(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "d")
    first = spark.createDataFrame([("2026-01-01", "UTC", "mdy"), ("5 days ago", None, None)], "text string, zone string, date_order string")
    more = first.unionByName(spark.createDataFrame([("2026-01-02", "UTC", "mdy"), ("", "UTC", "mdy"), (None, None, None)], first.schema))
    assert instants.extend_dictionary(first, store).count() == 2
    assert instants.extend_dictionary(more, store).count() == 3 == spark.read.parquet(store).count()
    assert {(r.text, r.back_s) for r in spark.read.parquet(store).collect() if r.back_s} == {("5 days ago", 432000)}
    # a second run over the same notations parses nothing
    refuse = F.udf(lambda *x: 1 / 0, "struct<at_us: bigint, back_s: bigint>")
    monkeypatch.setattr(instants, "_read", refuse)
    assert instants.extend_dictionary(more, store).count() == 3 == spark.read.parquet(store).count()


def test_change_of_period_is_taken_back(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        day = (datetime(2026, 1, 1) + timedelta(days=i)).isoformat() + "Z"
        hourly = 30 * math.exp(rng.gauss(0, 0.2))
        # for a while a source records yearly amounts under its hourly unit
        value = hourly * 2080 if 120 <= i < 260 else hourly
        rows.append((i, "s", day, None, (float(value), None, "usd", "hour")))
        rows.append((1000 + i, "t", day, f"${hourly * 2080:,.0f} a year", None))
        # another pays four times as much from a day on: that is no change of unit
        rows.append((2000 + i, "u", day, None, (float(hourly * (3.3 if i > 200 else 1)), None, "usd", "hour")))
    factors = spark.createDataFrame([("period", "year", 1.0), ("period", "hour", 2080.0), ("period", "month", 12.0), ("period", "week", 52.0), ("currency", "USD", 1.0), ("currency", "INR", 0.012)], "kind string, code string, factor double")
    got = {r.raw_id: r for r in units.yearly_pay(spark.createDataFrame(rows, PAY_ROW), factors).collect()}
    assert {i for i in range(400) if got[i].factor != 1.0} == set(range(120, 260)) and got[130].factor == 2080.0
    assert all(20_000 < got[i].min_usd_year < 200_000 for i in range(400))
    assert all(got[2000 + i].factor == 1.0 for i in range(400))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 3), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert components(links.limit(0)).count() == 0


def test_rank_is_one_to_n_over_partitions(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = linkage.ranked(rows, [F.desc("k"), F.asc("id")]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 1001))
    assert [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_star_links_skip_nulls(spark):
    rows = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", None), ("d", None), ("e", "z")], "node string, key string")
    assert [(r.a, r.b) for r in linkage.star_links(rows, "node", ["key"]).collect()] == [("a", "b")]


def test_similar_titles_need_similar_texts(spark):
    body = " ".join(f"word{i} is here" for i in range(60))
    other = " ".join(f"term{i} was there" for i in range(60))
    rows = [("a", "acme", "medical coder", body, False), ("b", "acme", "medical coder", body + " now", False), ("c", "acme", "medical coder", other, False), ("d", "other", "medical coder", body, False), ("e", "acme", "driver", body, False), ("f", "acme", "medical coder", body, True)]
    got = linkage.similar_title_links(spark.createDataFrame(rows, "node string, company string, title_key string, text string, snippet boolean")).collect()
    assert [(r.a, r.b) for r in got] == [("a", "b")]


def test_raw_dedupe_keeps_the_order_of_words(spark):
    rows = spark.createDataFrame([("s", "1", 2, "b", "B"), ("s", "1", 1, "a", "A"), ("s", "1", 3, "b", "C"), ("s", None, 4, None, "D")], "s string, k string, o int, w string, t string")
    got = {r.k: (r.t, r.found_by) for r in state.raw_dedupe(rows, ["s", "k"], "o", "w", ["t"]).collect()}
    assert got == {"1": ("A", ["a", "b"]), None: ("D", [])}


def test_expired_entries_are_not_seen(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    cache = spark.createDataFrame([("a", 5, "x"), ("b", 1, "y")], "k string, until int, v string")
    assert {r.k: r.v for r in state.with_expiry(rows, cache, ["k"], "until", F.lit(3)).collect()} == {"a": "x", "b": None}


def test_swap_replaces_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    state.write_state(spark.range(3), path, ["id"])
    state.write_state(spark.range(5), path, ["id"])
    assert state.read_state(spark, path).count() == 5


def test_csv_file_has_mark_and_crlf(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", None), ("=x", 2)], "t string, n int")
    sinks.write_csv(rows.coalesce(1), ["t", "n"], str(tmp_path / "o"), bom=True)
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "o").rglob("part-*")))
    assert body.decode() == '﻿t,n\r\n"a,b",\r\n\'=x,2\r\n'
