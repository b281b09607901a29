from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from weftline.functions import listing, text, urls
from weftline.functions.pay import number, read_pay
from weftline.functions.timeparse import read_time


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def at(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    "said,zone,order,expected",
    [
        ("2025-08-29T19:31:52Z", "UTC", "mdy", at(2025, 8, 29, 19, 31, 52)),
        ("2025-08-29", "Asia/Kolkata", "mdy", at(2025, 8, 29, 12)),
        ("09/01/2025 6:37 PM", "America/Chicago", "mdy", at(2025, 9, 1, 23, 37)),
        ("24/08/2025 08:07", "Asia/Kolkata", "dmy", at(2025, 8, 24, 2, 37)),
        ("2025-09-20 04:49:42 America/Los_Angeles", "UTC", "mdy", at(2025, 9, 20, 11, 49, 42)),
        ("2025-11-02 01:30:00", "America/New_York", "mdy", at(2025, 11, 2, 5, 30)),  # happens twice: the first
        ("1756457812152", "UTC", "mdy", 1756457812152000),
        ("1756729623.922", "UTC", "mdy", 1756729623922000),
        ("20250829T210200Z", "UTC", "mdy", at(2025, 8, 29, 21, 2)),
        ("Tue, 26 Aug 2025 19:25:58 EDT", "UTC", "mdy", at(2025, 8, 26, 23, 25, 58)),
        ("9. September 2025, 09:32 Uhr", "Europe/Berlin", "dmy", at(2025, 9, 9, 7, 32)),
        ("7 février 2026 à 20h17", "America/Toronto", "dmy", at(2026, 2, 8, 1, 17)),
        ("19 de septiembre de 2025, 21:07", "Europe/Madrid", "dmy", at(2025, 9, 19, 19, 7)),
        ("Posted on September 2, 2025", "UTC", "mdy", at(2025, 9, 2, 12)),
    ],
)
def test_absolute_times(said, zone, order, expected):
    assert read_time(said, zone, order) == (expected, None)


@pytest.mark.parametrize(
    "said,seconds",
    [("30+ days ago", 30 * 86400), ("vor 10 Tagen", 864000), ("il y a 1 heure", 3600), ("hace 2 semanas", 1209600), ("Reposted 26 hours ago", 93600), ("6d", 518400), ("an hour ago", 3600), ("aujourd’hui", 43200), ("Yesterday", 129600), ("Just posted", 0), ("3日前", 259200)],
)
def test_relative_times(said, seconds):
    assert read_time(said) == (None, seconds)


@pytest.mark.parametrize("said", [None, "", "  ", "TBD", "rolling", "2026-02-30", "0000-00-00 00:00:00", "this season", "N/A"])
def test_no_time(said):
    assert read_time(said, "UTC", "mdy") == (None, None)


@pytest.mark.parametrize(
    "said,expected",
    [
        ("$50-65k", (50000, 65000, "USD", None)),
        ("Up to $60,000 a year", (None, 60000, "USD", "year")),
        ("401(k) matching up to 5%", None),
        ("37.000 a 45.000 € al año", (37000, 45000, "EUR", "year")),
        ("47 000 à 57 000 € brut par an", (47000, 57000, "EUR", "year")),
        ("₹ 1,56,000 — ₹ 1,69,000/mo gross", (156000, 169000, "INR", "month")),
        ("₹12.9-13.1 lakhs p.a.", (1290000, 1310000, "INR", "year")),
        ("$83,000 - $102000/yr (+ $1,200 yearly stipend)", (83000, 102000, "USD", "year")),
        ("$20.50 hourly, 3 days a week", (20.5, 20.5, "USD", "hour")),
        ("à partir de EUR 17,50 de l’heure", (17.5, None, "EUR", "hour")),
        ("25 days paid leave", None),
        ("DOE", None),
        (None, None),
    ],
)
def test_pay(said, expected):
    assert read_pay(said) == expected


@pytest.mark.parametrize("said,value", [("1,06,000", 106000), ("17,50", 17.5), ("83,000.00", 83000), ("37.000", 37000), ("1.234,5", 1234.5)])
def test_numbers(said, value):
    assert number(said) == value


def test_texts(spark):
    assert one(spark, " a  b​\nc ", text.collapse_ws) == "a b c"
    assert one(spark, "Crème  “BRÛLÉE” – ‘x’", text.norm_match) == "creme “brulee” - 'x'"
    assert one(spark, "&lt;p&gt;A &amp;amp; B&lt;/p&gt;", text.html_to_text) == "A & B"
    assert one(spark, "<ul><li>One</li><li>Two</li></ul><script>x</script><p>End&nbsp;&#33; &nope;</p>", text.html_to_text) == "• One\n\n• Two\n\nEnd ! &nope;"
    assert one(spark, None, text.html_to_text) == ""
    assert one(spark, "=1+1", text.csv_cell) == "'=1+1"
    assert one(spark, 'a "b", c', text.csv_cell) == '"a ""b"", c"'
    assert one(spark, "-5", text.csv_cell) == "-5"
    assert one(spark, "see https://me:pw@example.org/?q=1&API_KEY=abc https://jooble.org/api/k9/x", text.redact) == "see https://***:***@example.org/?q=1&API_KEY=*** https://jooble.org/api/***/x"
    assert one(spark, "<title>Just a moment...</title>", lambda c: text.refusal(c, F.lit(403))) == "Cloudflare managed challenge"
    assert one(spark, "120", lambda c: text.retry_after_ms(c, F.current_timestamp())) == 120_000.0


def test_addresses(spark):
    assert one(spark, "http://WWW.Example.org:80/Jobs/7/?b=2&utm_source=x&a=1#top", urls.canonical) == "https://example.org/Jobs/7/?a=1&b=2"
    assert one(spark, "https://example.org/jobs/7/", urls.canonical) == "https://example.org/jobs/7"
    assert one(spark, "nonsense ", urls.canonical) == "nonsense"
    assert one(spark, "https://example.org/x?gclid=1&k=2#f", urls.strip_tracking) == "https://example.org/x?k=2#f"
    assert one(spark, "https://careers.example.co.uk/x", urls.registrable_domain) == "example.co.uk"
    assert one(spark, "http://10.1.2.3/", urls.registrable_domain) is None
    via = lambda c: urls.leads_to(c, r"(^|\.)board\.example$")
    assert one(spark, "https://a.example/r?url=https%3A%2F%2Fwww.board.example%2Fx", via) is True
    assert one(spark, "https://a.example/r?url=x", via) is False
    assert one(spark, "https://a.example/redirect/x", urls.is_tracker) is True


def test_listing_keys(spark):
    assert one(spark, "Medical Coder II - Remote", listing.title_key) == "medical coder 2"
    assert one(spark, "Billing & Collections Rep", listing.title_key) == "billing and collections representative"
    assert one(spark, "REMOTE Sr. Coder (Texas) – TX", listing.title_key) == "senior coder"
    assert one(spark, "ABC Health Care, LLC", listing.company_key) == "abc healthcare"
    assert one(spark, "n/a", listing.is_placeholder_company) is True
    assert one(spark, "FULL_TIME", listing.employment_type) == "Full-time"
    assert one(spark, "seasonal work", listing.employment_type) == "Seasonal Work"
    assert one(spark, "x", lambda c: listing.day_bucket(F.lit(48), (1, 5, 10, 30))) == 5


def test_search_parameters():
    from weftline.plans.params import SearchParams

    p = SearchParams.parse({"titles": ["Medical  Coder", "medical coder", "Biller"], "hours_old": 48})
    assert p.titles == ("Medical Coder", "Biller") and p.hours_old == 48 and p.max_pages == 3
    for body in ({}, {"titles": []}, {"titles": ["x"]}, {"titles": ["a<b>"]}, {"titles": ["ok"], "hours_old": 0}, {"titles": ["ok"], "what": 1}, {"titles": ["ok"], "remote_only": "yes"}, {"titles": ["ok"] * 51}):
        with pytest.raises(ValueError):
            SearchParams.parse(body)


def test_posted_time_is_the_surer_one():
    from weftline.functions.timeparse import resolve_posted

    now = 1_790_607_600 * 1_000_000  # 2026-09-28T15:00:00Z
    hour = 3600 * 1_000_000
    assert resolve_posted("2026-09-28T10:00:00Z", "2 hours ago", now) == (now - 5 * hour, "exact")
    assert resolve_posted("2026-09-28", "16 minutes ago", now) == (now - hour * 16 // 60, "exact")
    assert resolve_posted("2026-09-28", "2 days ago", now) == (now - 3 * hour, "estimated")
    assert resolve_posted(None, "an hour ago", now) == (now - hour, "estimated")
    assert resolve_posted(None, "today", now) == (now - 12 * hour, "estimated")
    assert resolve_posted(None, "2026-09-27T15:00:00Z", now) == (now - 24 * hour, "exact")
    assert resolve_posted("2026-09-29T10:00:00Z", None, now) == (now, "exact")
    assert resolve_posted("2026-10-05T10:00:00Z", None, now) == resolve_posted("1999-01-01", "soon", now) == resolve_posted(None, None, now) == (None, "unknown")


def test_period_is_told_from_plain_amounts_only():
    from weftline.functions.pay import listing_pay

    assert listing_pay("$25")[3] == "hour" and listing_pay("$60,000")[3] == "year" and listing_pay("$5,000")[3] is None and listing_pay("$50k per month")[3] == "month" and listing_pay("soon") is None


def test_states_and_countries(spark):
    from weftline.functions import listing

    df = spark.createDataFrame([(1, "Austin, TX"), (2, "Washington, DC"), (3, "Remote - CA / New  York"), (4, "(FL), GA"), (5, "IN the office"), (6, "us"), (7, "contact us now"), (8, "Anywhere in Europe"), (9, "Worldwide")], "k int, t string")
    got = {r.k: r for r in df.select("k", listing.states_found(F.col("t")).alias("s"), listing.names_country(F.col("t")).alias("u"), listing.names_wide_region(F.col("t")).alias("w")).collect()}
    assert [got[k].s for k in (1, 2, 3, 4, 5)] == [["TX"], ["DC"], ["NY", "CA"], ["FL", "GA"], []]
    assert got[6].u and not got[1].u and got[9].w and not got[8].w
