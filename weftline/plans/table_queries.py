"""Registered queries of the table operators (linkage, state, ranking, reports, sources), with the SQL that tells the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import listing, rules, text, urls
from weftline.operators import instants, linkage, sinks, state, units
from weftline.plans.graph import components
from weftline.plans.stages import materialize, spread, table
from weftline.plans.text_queries import NOW, sql_collapse, sql_company, sql_title, sql_words
from weftline.sources import json_boards
from weftline.streaming import counts_by_window, sessions

c = F.col
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SQL_COMPANY = sql_company("company")
SQL_TITLE = sql_title("title")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- flagship: clean, check, deduplicate, rank


@query(f"""WITH k AS (SELECT raw_id, source, {sql_collapse("coalesce(title, '')")} t, {SQL_COMPANY} ck, coalesce(length(descriptionText), 0) n, coalesce(descriptionIsSnippet, true) sn, fetchedAt f,
 coalesce(sourceJobId, jobUrl) sk FROM raw_jobs),
r AS (SELECT *, CASE WHEN t = '' THEN 'no_title' WHEN ck = '' THEN 'no_company' WHEN n < 40 THEN 'short' END code FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY source, sk ORDER BY sn, n DESC, raw_id) d FROM r WHERE code IS NULL)
SELECT raw_id, source, t AS title, ck AS company_k, n::BIGINT AS chars, row_number() OVER (ORDER BY f DESC, raw_id)::BIGINT AS position FROM o WHERE d = 1""")
def listing_pipeline(spark, sf):
    listed = table(spark, sf, "raw_jobs").select("raw_id", "source", "title", "company", "descriptionText", "descriptionIsSnippet", "fetchedAt", "sourceJobId", "jobUrl")
    rows = listed.select(
        "raw_id", "source", text.collapse_ws(F.coalesce("title", F.lit(""))).alias("title"), listing.company_key(c("company")).alias("company_k"), F.coalesce(F.length("descriptionText"), F.lit(0)).cast("bigint").alias("chars"),
        F.coalesce("descriptionIsSnippet", F.lit(True)).alias("snippet"), "fetchedAt", F.coalesce("sourceJobId", "jobUrl").alias("source_key"),
    )
    failed = rules.first_reason([("no_title", c("title") == "", F.lit("")), ("no_company", c("company_k") == "", F.lit("")), ("short", c("chars") < 40, c("chars"))])
    fine = rows.where(failed.isNull())
    keep = ["raw_id", "title", "company_k", "chars", "fetchedAt"]
    one = fine.groupBy("source", "source_key").agg(F.min_by(F.struct(*keep), F.struct("snippet", -c("chars"), "raw_id")).alias("r")).select("source", "r.*")
    return linkage.ranked(one, [F.desc("fetchedAt"), F.asc("raw_id")]).select("raw_id", "source", "title", "company_k", "chars", c("position").cast("bigint").alias("position"))


# -- reports


@query("SELECT event_type AS code, count(*) AS n, count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def run_metrics(spark, sf):
    return table(spark, sf, "events").rollup(c("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"))


@query("""WITH t AS (SELECT source, CASE WHEN company IS NULL THEN 'no_company' WHEN applyUrl IS NULL THEN 'no_apply' ELSE 'accepted' END code, coalesce(sourceJobId, jobUrl) k FROM raw_jobs),
g AS (SELECT source, code, count(*) n FROM t GROUP BY ALL)
SELECT s.source, s.raw, s.uniq, (SELECT string_agg(code || '=' || n, ';' ORDER BY code) FROM g WHERE g.source = s.source) AS codes FROM (SELECT source, count(*) raw, count(DISTINCT k) uniq FROM t GROUP BY 1) s""")
def source_report(spark, sf):
    code = F.when(c("company").isNull(), "no_company").when(c("applyUrl").isNull(), "no_apply").otherwise("accepted")
    rows = table(spark, sf, "raw_jobs").select("source", code.alias("code"), F.coalesce("sourceJobId", "jobUrl").alias("k"))
    counts = rows.groupBy("source", "code").agg(F.count(F.lit(1)).alias("n"))
    codes = counts.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("m"), F.sum("n").alias("raw"))
    uniq = rows.groupBy("source").agg(F.count_distinct("k").alias("uniq"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return codes.join(uniq, "source").select("source", "raw", "uniq", shown.alias("codes"))


@query("""SELECT source, CASE WHEN count(*) FILTER (company IS NOT NULL) = 0 THEN 'ERROR' WHEN count(*) FILTER (company IS NULL) > 0 THEN 'PARTIAL' ELSE 'OK' END AS status FROM raw_jobs GROUP BY source""")
def source_status(spark, sf):
    named, missing = F.count_if(c("company").isNotNull()), F.count_if(c("company").isNull())
    return table(spark, sf, "raw_jobs").groupBy("source").agg(F.when(named == 0, "ERROR").when(missing > 0, "PARTIAL").otherwise("OK").alias("status"))


@query("SELECT id, json_extract_string(params, '$.country') AS country, (json_extract(params, '$.hoursOld'))::BIGINT AS hours, json_array_length(params, '$.titles')::BIGINT AS titles, (json_extract(metrics, '$.too_old'))::BIGINT AS too_old FROM scrape_runs")
def json_columns(spark, sf):
    p = F.from_json("params", "titles array<string>, country string, hoursOld bigint")
    m = F.from_json("metrics", "too_old bigint")
    return table(spark, sf, "scrape_runs").select("id", p["country"].alias("country"), p["hoursOld"].alias("hours"), F.size(p["titles"]).cast("bigint").alias("titles"), m["too_old"].alias("too_old"))


@query("SELECT rpad(source, greatest((SELECT max(length(source)) FROM feeds), 6)::INT, ' ') || '  ' || rpad(zone_name, greatest((SELECT max(length(zone_name)) FROM feeds), 9)::INT, ' ') AS l FROM feeds".replace("AS l FROM", "AS line FROM").replace("SELECT rpad(source", "SELECT rtrim(rpad(source", 1).replace("' ') AS line", "' ')) AS line"))
def padded_report(spark, sf):
    return sinks.padded(table(spark, sf, "feeds"), ["source", "zone_name"])


# -- keyed state


@query("""WITH f AS (SELECT source, coalesce(sourceJobId, jobUrl) k, unnest(foundBy) w, raw_id FROM raw_jobs), g AS (SELECT source, k, w, min(raw_id) o FROM f WHERE w IS NOT NULL GROUP BY ALL),
l AS (SELECT source, k, string_agg(w, ';' ORDER BY o, w) ws FROM g GROUP BY ALL), o AS (SELECT source, coalesce(sourceJobId, jobUrl) k, min(raw_id) raw_id, arg_min(title, raw_id) title FROM raw_jobs GROUP BY ALL)
SELECT o.source, o.k AS source_key, o.raw_id, o.title, coalesce(l.ws, '') AS found_by FROM o LEFT JOIN l USING (source, k)""")
def raw_dedupe(spark, sf):
    rows = table(spark, sf, "raw_jobs").select("source", F.coalesce("sourceJobId", "jobUrl").alias("source_key"), "raw_id", "title", F.explode_outer("foundBy").alias("word"))
    one = state.raw_dedupe(rows, ["source", "source_key"], "raw_id", "word", ["raw_id", "title"])
    return one.select("source", "source_key", "raw_id", F.coalesce("title", F.lit(None)).alias("title"), F.array_join("found_by", ";").alias("found_by"))


@query("SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN (SELECT user_id, max(ts) t FROM events GROUP BY 1) m ON e.user_id = m.user_id AND e.ts = m.t")
def latest_status(spark, sf):
    return state.latest_with_ties(table(spark, sf, "events"), "user_id", "ts").select("user_id", "event_id", "event_type")


CUT = "2024-01-15"


@query(f"""WITH a AS (SELECT user_id, min(ts) f, max(ts) l, count(*) n FROM events WHERE ts < '{CUT}' GROUP BY 1), b AS (SELECT user_id, min(ts) f, max(ts) l, count(*) n FROM events WHERE ts >= '{CUT}' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.f, b.f) AS first_seen, coalesce(b.l, a.l) AS last_seen, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS times_seen, a.user_id IS NULL AS is_new FROM a FULL JOIN b ON a.user_id = b.user_id""")
def upsert_state(spark, sf):
    ev = table(spark, sf, "events")
    side = lambda cond: ev.where(cond).groupBy("user_id").agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    cols = {
        "first_seen": F.coalesce("s.f", "i.f"), "last_seen": F.coalesce("i.l", "s.l"), "times_seen": F.coalesce("s.n", zero) + F.coalesce("i.n", zero), "is_new": c("s.user_id").isNull(),
    }
    return state.merge_by_key(side(c("ts") < CUT), side(c("ts") >= CUT), ["user_id"], cols)


@query("""WITH f AS (SELECT unnest(foundBy) keyword, fetchedAt FROM raw_jobs), a AS (SELECT keyword, min(fetchedAt) f, max(fetchedAt) l, count(*) n FROM f WHERE fetchedAt < '2026-03-01' GROUP BY 1),
b AS (SELECT keyword, min(fetchedAt) f, max(fetchedAt) l, count(*) n FROM f WHERE fetchedAt >= '2026-03-01' GROUP BY 1)
SELECT coalesce(a.keyword, b.keyword) AS keyword, coalesce(a.f, b.f) AS first_used_at, coalesce(b.l, a.l) AS last_used_at, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS times_used FROM a FULL JOIN b ON a.keyword = b.keyword""")
def keyword_upsert(spark, sf):
    words = table(spark, sf, "raw_jobs").select(F.explode("foundBy").alias("keyword"), "fetchedAt").where("keyword is not null")
    side = lambda cond: words.where(cond).groupBy("keyword").agg(F.min("fetchedAt").alias("f"), F.max("fetchedAt").alias("l"), F.count(F.lit(1)).alias("n"))
    cut, zero = "2026-03-01", F.lit(0)
    cols = {"first_used_at": F.coalesce("s.f", "i.f"), "last_used_at": F.coalesce("i.l", "s.l"), "times_used": F.coalesce("s.n", zero) + F.coalesce("i.n", zero)}
    return state.merge_by_key(side(c("fetchedAt") < cut), side(c("fetchedAt") >= cut), ["keyword"], cols)


@query("SELECT id, coalesce(date_diff('millisecond', coalesce(original_posted_at, posted_at)::TIMESTAMPTZ, posted_at::TIMESTAMPTZ) > 12 * 3600000, false) AS again FROM jobs")
def repost(spark, sf):
    return table(spark, sf, "jobs").select("id", state.reposted(F.to_timestamp("posted_at"), F.to_timestamp(F.coalesce("original_posted_at", "posted_at"))).alias("again"))


@query(f"SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE ts < '{CUT}') THEN 'seen' ELSE 'new' END AS status FROM (SELECT DISTINCT user_id FROM events WHERE ts >= '{CUT}')")
def new_vs_seen(spark, sf):
    ev = table(spark, sf, "events")
    now, old = ev.where(c("ts") >= CUT).select("user_id").distinct(), ev.where(c("ts") < CUT).select("user_id")
    return now.join(old, "user_id", "left_semi").withColumn("status", F.lit("seen")).unionByName(now.join(old, "user_id", "left_anti").withColumn("status", F.lit("new")))


@query(f"""SELECT id, last_seen_at, CASE WHEN date_diff('millisecond', last_seen_at::TIMESTAMPTZ, '{NOW}'::TIMESTAMPTZ) > 48 * 3600000 THEN 'stale' ELSE 'active' END AS status FROM jobs WHERE last_seen_at::TIMESTAMPTZ >= '{NOW}'::TIMESTAMPTZ - INTERVAL 720 HOUR""")
def stored_jobs(spark, sf):
    seen = F.to_timestamp("last_seen_at")
    now = F.to_timestamp(F.lit(NOW))
    rows = table(spark, sf, "jobs").where(seen >= now - F.expr("INTERVAL 720 HOURS"))
    return rows.select("id", "last_seen_at", state.stale_or_active(seen, now).alias("status"))


@query(f"""WITH r AS (SELECT raw_id, source, coalesce(sourceJobId, jobUrl) source_key, applyUrl canonical_url, {SQL_COMPANY} || '|' || {SQL_TITLE} fingerprint FROM raw_jobs WHERE title IS NOT NULL),
u AS (SELECT canonical_url, min(id) id FROM jobs GROUP BY 1), p AS (SELECT fingerprint, arg_min(id, first_seen_at || id) id FROM jobs GROUP BY 1)
SELECT r.raw_id, coalesce(s.job_id, u.id, p.id) AS found, CASE WHEN s.job_id IS NOT NULL THEN 'source' WHEN u.id IS NOT NULL THEN 'url' WHEN p.id IS NOT NULL THEN 'fingerprint' END AS via
FROM r LEFT JOIN job_sources s ON r.source = s.source AND r.source_key = s.source_key LEFT JOIN u ON r.canonical_url = u.canonical_url LEFT JOIN p ON r.fingerprint = p.fingerprint""")
def match_cascade(spark, sf):
    rows = table(spark, sf, "raw_jobs").where("title is not null").select(
        "raw_id", "source", F.coalesce("sourceJobId", "jobUrl").alias("source_key"), c("applyUrl").alias("canonical_url"), listing.fingerprint(c("company"), c("title")).alias("fingerprint")
    )
    jobs = table(spark, sf, "jobs")
    dims = [
        ("source", table(spark, sf, "job_sources").select("source", "source_key", c("job_id").alias("id")), ["source", "source_key"]),
        ("url", jobs.groupBy("canonical_url").agg(F.min("id").alias("id")), ["canonical_url"]),
        ("fingerprint", jobs.groupBy("fingerprint").agg(F.min_by("id", F.concat("first_seen_at", "id")).alias("id")), ["fingerprint"]),
    ]
    return state.cascade(rows, "raw_id", dims)


@query("""WITH d AS (SELECT source, source_key, job_url, posted_at FROM job_sources WHERE last_seen_at >= '2026-03-01')
SELECT r.raw_id, coalesce(d.posted_at, r.postedAt) AS posted_at, d.job_url FROM raw_jobs r LEFT JOIN d ON r.source = d.source AND r.sourceJobId = d.source_key""")
def detail_lookup_merge(spark, sf):
    rows = table(spark, sf, "raw_jobs").select("raw_id", "source", c("sourceJobId").alias("source_key"), "postedAt")
    cache = table(spark, sf, "job_sources").select("source", "source_key", "job_url", c("posted_at").alias("d_posted"), "last_seen_at")
    found = state.with_expiry(rows, cache, ["source", "source_key"], "last_seen_at", F.lit("2026-03-01"))
    return found.select("raw_id", state.override({"postedAt": "d_posted"})["postedAt"].alias("posted_at"), "job_url")


# Hops of addresses that redirect, among them a loop.
HOPS = (("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("m", "n"))


@query("""WITH RECURSIVE h(src, dst) AS (VALUES ('a','b'), ('b','c'), ('c','d'), ('x','y'), ('y','x'), ('m','n')),
w AS (SELECT src origin, dst target, 1 hops, [src, dst] seen FROM h UNION ALL SELECT w.origin, h.dst, w.hops + 1, list_append(w.seen, h.dst) FROM w JOIN h ON w.target = h.src WHERE NOT list_contains(w.seen, h.dst) AND w.hops < 6)
SELECT origin, arg_max(target, hops) AS target, max(hops)::BIGINT AS hops FROM w GROUP BY origin""")
def redirect_chain(spark, sf):
    return state.follow(spark.createDataFrame(HOPS, "src string, dst string"))


# -- ranking and limits


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, floor(o_totalprice / 1000) DESC, o_orderdate DESC, o_orderkey) AS position FROM orders""")
def rank_rows(spark, sf):
    keys = [F.asc("o_orderpriority"), F.desc(F.floor(c("o_totalprice") / 1000)), F.desc("o_orderdate"), F.asc("o_orderkey")]
    return linkage.ranked(table(spark, sf, "orders"), keys).select("o_orderkey", "position")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) place FROM orders) SELECT * FROM r WHERE place <= 3""")
def topk_per_key(spark, sf):
    return state.top_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).drop("o_totalprice")


@query("SELECT id, started_at FROM scrape_runs ORDER BY started_at DESC, id LIMIT 10")
def recent_runs(spark, sf):
    return table(spark, sf, "scrape_runs").select("id", "started_at").orderBy(F.desc("started_at"), "id").limit(10)


# -- linkage


@query("SELECT text_id, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, substr(sha1(text), 1, 16) text_id FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", text.sha1_id(c("text")).alias("text_id"))
    return docs.groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _rows(spark, sf):
    # keys are made once: the links read them several times
    v = c("v")
    jobs = spread(table(spark, sf, "jobs").select("id", "canonical_url", "ats_provider", "ats_job_id", "company", "title", "remote_scope", "data")).withColumn("v", F.try_parse_json("data"))
    rows = jobs.select(
        c("id").alias("node"), "canonical_url", "ats_provider", "ats_job_id", listing.company_key(c("company")).alias("company"), listing.title_key(c("title")).alias("title_key"), c("remote_scope").alias("scope"),
        F.try_variant_get(v, "$.description_text", "string").alias("text"), F.coalesce(F.try_variant_get(v, "$.description_is_snippet", "boolean"), F.lit(True)).alias("snippet"),
    )
    return materialize(rows, "linkage-keys")


SQL_LINKS = f"""k AS (SELECT id, nullif(canonical_url, '') u, nullif(ats_provider, '') p, nullif(ats_job_id, '') j, {SQL_COMPANY} ck, {SQL_TITLE} tk, coalesce(remote_scope, '') sc,
 CASE WHEN json_valid(data) THEN data END d FROM jobs),
x AS (SELECT *, json_extract_string(d, '$.description_text') tx, coalesce((json_extract(d, '$.description_is_snippet'))::BOOLEAN, true) sn FROM k),
y AS (SELECT *, NOT sn AND coalesce(length(tx), 0) >= 400 l4, NOT sn AND coalesce(length(tx), 0) >= 300 l3, list_distinct(list_filter({sql_words("tk")}, lambda w: length(w) > 1)) tt, list_slice({sql_words("coalesce(tx, '')")}, 1, 600) w FROM x),
z AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN generate_series(1, len(w) - 2)]) ELSE [] END s FROM y),
q AS (SELECT a.id a, b.id b, a.tk = b.tk same, NOT (a.l4 AND b.l4 AND a.sc <> b.sc) near, a.l3 AND b.l3 long, len(list_intersect(a.tt, b.tt)) ti, len(a.tt) + len(b.tt) tn, CASE WHEN a.l3 AND b.l3 THEN len(list_intersect(a.s, b.s)) ELSE 0 END si, len(a.s) + len(b.s) n
 FROM z a JOIN z b ON a.ck = b.ck AND a.id < b.id WHERE a.ck <> '' AND a.tk <> '' AND b.tk <> ''),
e AS (SELECT min(id) OVER (PARTITION BY u) a, id b FROM k WHERE u IS NOT NULL UNION SELECT min(id) OVER (PARTITION BY p, j, ck), id FROM k WHERE p IS NOT NULL AND j IS NOT NULL
 UNION SELECT a, b FROM q WHERE same AND (near OR si >= 0.2 * (n - si)) UNION SELECT a, b FROM q WHERE NOT same AND long AND ti >= 0.6 * (tn - ti) AND si >= 0.75 * (n - si))"""
SQL_GROUPS = f"""{SQL_LINKS}, b2 AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), w AS (SELECT a AS node, a AS l FROM b2 UNION SELECT b2.b, w.l FROM w JOIN b2 ON w.node = b2.a WHERE w.l < b2.b)"""


@query()
def listing_links(spark, sf):
    return linkage.listing_links(_rows(spark, sf))


@query(f"WITH RECURSIVE {SQL_GROUPS} SELECT k.id AS node, least(k.id, coalesce(min(w.l), k.id)) AS grp FROM k LEFT JOIN w ON w.node = k.id GROUP BY k.id")
def dup_components(spark, sf):
    rows = _rows(spark, sf)
    return linkage.groups(rows, linkage.listing_links(rows))


def _merge_rows(spark, sf):
    jobs = spread(table(spark, sf, "jobs")).withColumn("v", F.try_parse_json("data"))
    v = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    return jobs.select(
        "canonical_url", c("id").alias("node"), "title", "company", v("source_id").alias("source"), "ats_provider", "ats_job_id", "apply_url", "posted_at", v("date_confidence").alias("date_confidence"),
        v("detail_fetched", "boolean").alias("detail_fetched"), v("description_is_snippet", "boolean").alias("snippet"), v("description_text").alias("text"), v("remote_confidence", "double").alias("remote_confidence"),
        v("found_by", "array<string>").alias("found_by"), v("quality_flags", "array<string>").alias("quality_flags"), "company_domain", v("employment_type").alias("employment_type"),
        F.struct(v("salary_min", "double").alias("min"), v("salary_max", "double").alias("max"), v("salary_currency").alias("currency"), v("salary_period").alias("period")).alias("salary"),
    )


_SQL_ROWS = """x AS (SELECT *, lower(regexp_extract(apply_url, '^https?://([^/:?#]+)', 1)) h, regexp_extract(apply_url, '^https?://[^/?#]+([^?#]*)', 1) pa, CASE WHEN json_valid(data) THEN data END d FROM jobs),
y AS (SELECT *, json_extract_string(d, '$.source_id') src, json_extract_string(d, '$.date_confidence') cf, coalesce((json_extract(d, '$.detail_fetched'))::BOOLEAN, false) df, coalesce((json_extract(d, '$.description_is_snippet'))::BOOLEAN, true) sn,
 json_extract_string(d, '$.description_text') tx, (json_extract(d, '$.remote_confidence'))::DOUBLE rc, (json_extract(d, '$.salary_min'))::DOUBLE s1, (json_extract(d, '$.salary_max'))::DOUBLE s2, json_extract_string(d, '$.employment_type') et,
 regexp_matches(apply_url, '^https?://') AND NOT regexp_matches(h, '(^|[.])(linkedin|dice|remoteok|remotive|jobicy|simplyhired|ziprecruiter|monster|careerbuilder|builtin|wellfound|flexjobs|weworkremotely|talent|lensa|jobgether|jobviewtrack)[.]com$|(^|[.])(jooble[.]org|jobbank[.]gc[.]ca|jobright[.]ai|himalayas[.]app)$|(^|[.])(careerjet|glassdoor|adzuna)[.][a-z.]+$')
  AND NOT regexp_matches(pa, '(?i)/(away|redirect|out|clk|click|rc/clk)($|[^a-z0-9_])') emp FROM x),
z AS (SELECT *, CASE WHEN ats_provider <> '' THEN 100 ELSE 0 END + CASE WHEN emp THEN 50 ELSE 0 END + CASE cf WHEN 'exact' THEN 20 WHEN 'estimated' THEN 10 ELSE 0 END + CASE WHEN df THEN 10 ELSE 0 END + CASE WHEN sn THEN 0 ELSE least(20.0, coalesce(length(tx), 0) / 500.0) END
 + CASE src WHEN 'linkedin' THEN 6 WHEN 'dice' THEN 6 WHEN 'remotive' THEN 5 WHEN 'jobicy' THEN 5 WHEN 'remoteok' THEN 5 WHEN 'simplyhired' THEN 3 WHEN 'canada_job_bank' THEN 3 WHEN 'careerjet' THEN 2 WHEN 'jooble' THEN 2 ELSE 1 END sc FROM y)"""


@query(f"""WITH {_SQL_ROWS} SELECT canonical_url, first(id ORDER BY sc DESC, id) AS node, (count(*) - 1)::BIGINT AS duplicate_count, max(rc) AS remote_confidence,
coalesce(first(posted_at ORDER BY CASE cf WHEN 'exact' THEN 0 WHEN 'estimated' THEN 1 ELSE 2 END, try_cast(posted_at AS TIMESTAMPTZ), sc DESC, id) FILTER (posted_at IS NOT NULL), '') AS posted_at,
coalesce(first(apply_url ORDER BY CASE WHEN ats_provider <> '' THEN 0 ELSE 1 END, sc DESC, id) FILTER (emp), first(apply_url ORDER BY sc DESC, id), '') AS apply_url,
coalesce(CASE WHEN first(sn OR coalesce(tx, '') = '' ORDER BY sc DESC, id) THEN first(length(tx) ORDER BY length(tx) DESC, sc DESC, id) FILTER (NOT sn AND tx <> '') END, first(length(tx) ORDER BY sc DESC, id))::BIGINT AS chars,
coalesce(CASE WHEN first(s1 IS NULL AND s2 IS NULL ORDER BY sc DESC, id) THEN first(coalesce(s2, s1) ORDER BY sc DESC, id) FILTER (s1 IS NOT NULL OR s2 IS NOT NULL) END, first(coalesce(s2, s1) ORDER BY sc DESC, id)) AS pay,
first(company_domain ORDER BY sc DESC, id) FILTER (company_domain IS NOT NULL) AS company_domain, first(et ORDER BY sc DESC, id) FILTER (et IS NOT NULL) AS employment_type FROM z GROUP BY canonical_url""")
def merge_listings(spark, sf):
    rows = _merge_rows(spark, sf).withColumn("__u", c("canonical_url"))
    found = linkage.merged_groups(rows, "__u").drop("canonical_url")
    pay = F.coalesce("salary.max", "salary.min")
    return found.select("__u", "node", "duplicate_count", "remote_confidence", F.coalesce("posted_at", F.lit("")).alias("posted_at"), F.coalesce("apply_url", F.lit("")).alias("apply_url"), F.length("text").cast("bigint").alias("chars"), pay.alias("pay"), "company_domain", "employment_type").withColumnRenamed("__u", "canonical_url")


@query(f"""WITH {_SQL_ROWS}, r AS (SELECT id, title, CASE WHEN posted_at IS NOT NULL THEN greatest(floor(date_diff('millisecond', try_cast(posted_at AS TIMESTAMPTZ), '{NOW}'::TIMESTAMPTZ) / 3600000.0 * 10 + 0.5) / 10, 0.0) END age, coalesce(rc, 0) rc, times_seen, CASE WHEN ats_provider <> '' THEN 2 WHEN emp THEN 1 ELSE 0 END er FROM z)
SELECT id, row_number() OVER (ORDER BY age IS NULL, floor(age), rc DESC, times_seen DESC, er DESC, age, coalesce(title, ''), id)::BIGINT AS position FROM r""")
def rank_listings(spark, sf):
    jobs = table(spark, sf, "jobs").withColumn("v", F.try_parse_json("data"))
    age = listing.age_hours(F.try_to_timestamp("posted_at"), F.to_timestamp(F.lit(NOW)))
    employer = F.when(c("ats_provider") != "", 2).when(urls.is_employer(c("apply_url")), 1).otherwise(0)
    rows = jobs.select("id", F.when(c("posted_at").isNotNull(), age).alias("age"), F.coalesce(F.try_variant_get("v", "$.remote_confidence", "double"), F.lit(0.0)).alias("remote"), "times_seen", employer.alias("employer"), F.coalesce("title", F.lit("")).alias("t"))
    keys = linkage.rank_keys(c("age"), c("remote"), c("times_seen"), c("employer"), c("t"))
    return linkage.ranked(rows, [*keys, F.asc("id")]).select("id", c("position").cast("bigint").alias("position"))


SPLIT = "2026-03-01"


@query(f"""WITH s AS (SELECT * FROM jobs WHERE first_seen_at < '{SPLIT}'), i AS (SELECT * FROM jobs WHERE first_seen_at >= '{SPLIT}'),
u AS (SELECT canonical_url, min(id) f FROM s GROUP BY 1), a AS (SELECT ats_provider, ats_job_id, norm_company, min(id) f FROM s WHERE ats_provider <> '' AND ats_job_id <> '' GROUP BY ALL),
p AS (SELECT fingerprint, arg_min(id, first_seen_at || id) f FROM s WHERE regexp_matches(fingerprint, '^[^|]+[|][^|]+$') GROUP BY 1),
m AS (SELECT i.*, coalesce(u.f, a.f, p.f) f FROM i LEFT JOIN u ON i.canonical_url = u.canonical_url LEFT JOIN a ON i.ats_provider = a.ats_provider AND i.ats_job_id = a.ats_job_id AND i.norm_company = a.norm_company LEFT JOIN p ON i.fingerprint = p.fingerprint),
n AS (SELECT s.id, count(*) k, last(m.posted_at ORDER BY m.id) po, last(m.posted_at ORDER BY m.id) FILTER (date_diff('millisecond', try_cast(coalesce(s.original_posted_at, s.posted_at) AS TIMESTAMPTZ), try_cast(m.posted_at AS TIMESTAMPTZ)) > 43200000) re,
 last(m.ats_provider ORDER BY m.id) FILTER (m.ats_provider IS NOT NULL) ap, last(m.ats_job_id ORDER BY m.id) FILTER (m.ats_job_id IS NOT NULL) aj FROM m JOIN s ON m.f = s.id GROUP BY s.id)
SELECT s.id, CASE WHEN k IS NOT NULL THEN false END AS is_new, s.first_seen_at, CASE WHEN k IS NOT NULL THEN '{NOW}' ELSE s.last_seen_at END AS last_seen_at, (s.times_seen + coalesce(k, 0))::BIGINT AS times_seen, CASE WHEN k IS NOT NULL THEN po ELSE s.posted_at END AS posted_at,
 s.original_posted_at, coalesce(re, s.reposted_at) AS reposted_at, coalesce(ap, s.ats_provider) AS ats_provider, coalesce(aj, s.ats_job_id) AS ats_job_id FROM s LEFT JOIN n USING (id)
UNION ALL SELECT id, true, '{NOW}', '{NOW}', 1, posted_at, posted_at, NULL, ats_provider, ats_job_id FROM m WHERE f IS NULL""")
def upsert_listings(spark, sf):
    jobs = table(spark, sf, "jobs").withColumn("company", c("norm_company"))
    stored, came = jobs.where(c("first_seen_at") < SPLIT), jobs.where(c("first_seen_at") >= SPLIT).withColumnRenamed("id", "row_id")
    found = materialize(state.resolved(came, stored), "upsert-resolved")
    return state.upserted(stored, came.select("row_id", "posted_at", "ats_provider", "ats_job_id"), found, NOW)


@query("""WITH t AS (SELECT id, canonical_url, row_number() OVER w AS rnk, first_value(id) OVER w AS top, count(*) OVER (PARTITION BY canonical_url) n FROM jobs WINDOW w AS (PARTITION BY canonical_url ORDER BY (ats_provider IS NOT NULL) DESC, times_seen DESC, id))
SELECT id, canonical_url, rnk::INTEGER AS rank, CASE WHEN rnk > 1 THEN top END AS duplicate_of, rnk > 1 AS is_duplicate, (n - 1)::BIGINT AS duplicate_count FROM t""")
def merge_survivors(spark, sf):
    rows = table(spark, sf, "jobs").select("id", "canonical_url", "ats_provider", "times_seen")
    found = linkage.survivors(rows, "canonical_url", [F.desc(c("ats_provider").isNotNull()), F.desc("times_seen")], "id")
    return found.drop("ats_provider", "times_seen")


@query()
def similar_titles(spark, sf):
    return linkage.similar_title_links(_rows(spark, sf))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_partkey a, l_suppkey + 1000000 b FROM lineitem), q AS (SELECT a, b FROM p UNION SELECT b, a FROM p), m AS (SELECT min(a) l FROM q),
w AS (SELECT l AS node, l FROM m UNION SELECT q.b, w.l FROM w JOIN q ON w.node = q.a) SELECT n.node, coalesce(w.l, n.node) AS label FROM (SELECT DISTINCT a node FROM q) n LEFT JOIN w USING (node)""")
def component_nodes(spark, sf):
    pairs = table(spark, sf, "lineitem").select(c("l_partkey").alias("a"), (c("l_suppkey") + 1_000_000).alias("b")).distinct()
    return components(pairs)


# -- sources and sinks


@query("""SELECT jobId AS "sourceJobId", trim(regexp_replace(jobTitle, '\\s+', ' ', 'g')) AS title, nullif(trim(companyName), '') AS company,
CASE WHEN regexp_matches(trim(publishTime), '^\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}(:\\d{2})?$') THEN regexp_replace(trim(publishTime), '^(\\d{4}-\\d{2}-\\d{2})[ T](.*)$', '\\1T\\2Z') END AS "postedAt",
CASE WHEN regexp_matches(coalesce(workModel, ''), '(?i)hybrid') THEN 'structured_hybrid' WHEN regexp_matches(coalesce(workModel, ''), '(?i)on-?site') THEN 'structured_onsite' WHEN regexp_matches(coalesce(workModel, ''), '(?i)remote') OR isRemote THEN 'structured_remote' END AS hint
FROM jobright_items WHERE jobId <> '' AND jobTitle <> ''""")
def jobright_listings(spark, sf):
    rows = json_boards.jobright_rows(table(spark, sf, "jobright_items"))
    return rows.select("sourceJobId", "title", "company", "postedAt", F.get("remoteHints", F.lit(0))["kind"].alias("hint"))


@query("""SELECT t.title, f.source, 'https://' || f.host || '/search?q=' || replace(url_encode(t.title), '%20', '+') AS url FROM (SELECT DISTINCT unnest(from_json(params, '{"titles": ["VARCHAR"]}').titles) title FROM scrape_runs) t CROSS JOIN feeds f""")
def title_portal_links(spark, sf):
    titles = table(spark, sf, "scrape_runs").select(F.explode(F.from_json("params", "titles array<string>")["titles"]).alias("title")).distinct()
    return sinks.portal_links(titles, table(spark, sf, "feeds")).drop("html")


@query("""SELECT company_id || ',' || CASE WHEN regexp_matches(name, '[",\\n\\r]') THEN '"' || replace(name, '"', '""') || '"' ELSE name END || ',' || coalesce(domain, '') || ',' AS line FROM companies""")
def csv_lines(spark, sf):
    return sinks.csv_lines(table(spark, sf, "companies"), ["company_id", "name", "domain", "missing"])


@query("SELECT r_regionkey AS k, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_lines(spark, sf):
    rows = table(spark, sf, "region").select("r_regionkey", "r_name")
    return rows.select(c("r_regionkey").alias("k"), F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))


@query("""WITH t AS (SELECT source, CASE WHEN count(*) FILTER (company IS NOT NULL) = 0 THEN 'ERROR' WHEN count(*) FILTER (company IS NULL) > 0 THEN 'PARTIAL' ELSE 'OK' END st FROM raw_jobs GROUP BY 1), f AS (SELECT coalesce(st, 'SKIPPED') st FROM feeds LEFT JOIN t USING (source))
SELECT count(*) FILTER (st <> 'SKIPPED') AS attempted, count(*) FILTER (st IN ('OK', 'PARTIAL')) AS succeeded, count(*) FILTER (st IN ('ERROR', 'BLOCKED')) AS failed, count(*) FILTER (st = 'SKIPPED') AS skipped FROM f""")
def status_summary(spark, sf):
    every = table(spark, sf, "feeds").select("source").join(source_status(spark, sf), "source", "left").withColumn("status", F.coalesce("status", F.lit("SKIPPED")))
    return sinks.status_summary(every)


@query("""SELECT id, CASE WHEN id <> m THEN m END AS duplicate_of FROM (SELECT id, min(id) OVER (PARTITION BY canonical_url) m FROM jobs)""")
def with_duplicates(spark, sf):
    jobs = table(spark, sf, "jobs").select("id", "canonical_url")
    least = jobs.groupBy("canonical_url").agg(F.min("id").alias("m"))
    rows = jobs.join(least, "canonical_url").select("id", F.when(c("id") != c("m"), c("m")).alias("duplicate_of"))
    return sinks.with_duplicates(rows.where("duplicate_of is null"), rows.where("duplicate_of is not null"), True)


@query("""WITH t AS (SELECT id, CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9_])coder($|[^a-z0-9_])') THEN 3 ELSE 0 END a, CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9_])specialist($|[^a-z0-9_])') THEN 3 ELSE 0 END b, CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9_])remote($|[^a-z0-9_])') THEN 1 ELSE 0 END r FROM jobs),
u AS (SELECT id, unnest([{'k': 'coder', 's': a}, {'k': 'specialist', 's': b}, {'k': 'remote', 's': r}], recursive := true) FROM t)
SELECT id, coalesce(string_agg(k, ';' ORDER BY s DESC, length(k) DESC, k) FILTER (s > 0), '') AS terms FROM u GROUP BY id""")
def term_matches(spark, sf):
    title = F.coalesce(F.lower("title"), F.lit(""))
    found = F.array(*[F.struct(F.lit(k).alias("term"), F.when(title.rlike(rf"(?<![a-z0-9_]){k}(?![a-z0-9_])"), n).otherwise(0).alias("score")) for k, n in (("coder", 3), ("specialist", 3), ("remote", 1))])
    return table(spark, sf, "jobs").select("id", F.array_join(F.transform(rules.ranked_terms(found), lambda t: t["term"]), ";").alias("terms"))


@query("""WITH t AS (SELECT id, apply_url, canonical_url, CASE WHEN times_seen % 5 = 0 THEN 404 ELSE 200 END st FROM jobs WHERE apply_url IS NOT NULL)
SELECT id, CASE WHEN st = 404 THEN 'low_quality' END AS code, CASE WHEN st = 404 THEN 'broken_apply_url' END AS flag, apply_url FROM t""")
def checked_links(spark, sf):
    jobs = table(spark, sf, "jobs").where("apply_url is not null").select("id", "apply_url", "canonical_url", "times_seen")
    answers = jobs.groupBy("apply_url").agg(F.max("times_seen")).select(c("apply_url").alias("url"), c("apply_url").alias("final_url"))
    told = jobs.join(answers, c("apply_url") == c("url")).withColumn("status", F.when(c("times_seen") % 5 == 0, 404).otherwise(200))
    return state.link_verdict(told, r"(^|\.)refused\.example$").select("id", "code", "flag", "apply_url")


@query()
def posted_resolved(spark, sf):
    rows = table(spark, sf, "raw_jobs").select("raw_id", instants.posted_at(c("postedAt"), c("postedText"), c("fetchedAt")).alias("p"))
    return rows.select("raw_id", F.date_format(F.timestamp_micros("p.at_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("posted_at"), c("p.confidence").alias("confidence"))


@query()
def salary_parsed(spark, sf):
    return spread(table(spark, sf, "raw_jobs").select("raw_id", "salaryRaw")).select("raw_id", units.listing_salary(c("salaryRaw")).alias("s")).select("raw_id", "s.*")


@query("SELECT source, count(*) AS n FROM (SELECT source, postedAt t FROM raw_jobs UNION ALL SELECT 'jobright', publishTime FROM jobright_items) GROUP BY source")
def union_sources(spark, sf):
    a = table(spark, sf, "raw_jobs").select("source", c("postedAt").alias("t"))
    b = table(spark, sf, "jobright_items").select(F.lit("jobright").alias("source"), c("publishTime").alias("t"))
    return a.unionByName(b).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source FROM feeds WHERE source NOT IN (SELECT DISTINCT source FROM raw_jobs)")
def idle_sources(spark, sf):
    return table(spark, sf, "feeds").select("source").join(table(spark, sf, "raw_jobs").select("source"), "source", "left_anti")


# -- windows over event time, an extension


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return counts_by_window(table(spark, sf, "events"), "ts", "1 hour", None, ["event_type"]).select(c("w.start").alias("start"), "event_type", "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) no FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, no""")
def event_sessions(spark, sf):
    return sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", c("w.start").alias("start"), "n")


@query("SELECT lower(regexp_extract(apply_url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, count(*) AS n FROM jobs WHERE apply_url IS NOT NULL GROUP BY 1")
def hosts(spark, sf):
    return table(spark, sf, "jobs").where("apply_url is not null").groupBy(urls.host(c("apply_url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS total FROM orders o JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1".replace("floor(sum(o_totalprice) * 100 + 0.5) / 100", "sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::BIGINT"))
def order_totals(spark, sf):
    o, k = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_mktsegment is not null")
    cents = F.floor(c("o_totalprice") * 100 + 0.5).cast("bigint")
    return o.join(k, c("o_custkey") == c("c_custkey")).groupBy(c("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("total"))


@query("SELECT job_id, min(run_no)::INTEGER AS first_no, count(*) AS captures FROM job_snapshots s JOIN (SELECT id, row_number() OVER (ORDER BY started_at, id) run_no FROM scrape_runs) r ON s.run_id = r.id GROUP BY job_id")
def capture_counts(spark, sf):
    order = table(spark, sf, "scrape_runs").select("id", F.row_number().over(Window.orderBy("started_at", "id")).alias("run_no"))
    return table(spark, sf, "job_snapshots").join(order, c("run_id") == c("id")).groupBy("job_id").agg(F.min("run_no").alias("first_no"), F.count(F.lit(1)).alias("captures"))


# -- runs, registries, caps


@query("""WITH f AS (SELECT source, unnest(foundBy) w, coalesce(sourceJobId, jobUrl) k, raw_id FROM raw_jobs), t AS (SELECT source, w, k, min(raw_id) o FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, w ORDER BY o, k) n FROM t WHERE w IS NOT NULL)
SELECT source, w AS keyword, k AS source_key FROM r WHERE n <= 100""")
def capped_per_keyword(spark, sf):
    rows = table(spark, sf, "raw_jobs").select("source", F.explode("foundBy").alias("keyword"), F.coalesce("sourceJobId", "jobUrl").alias("source_key"), "raw_id").where("keyword is not null")
    firsts = rows.groupBy("source", "keyword", "source_key").agg(F.min("raw_id").alias("o")).withColumn("k", F.struct("source", "keyword"))
    return state.top_per_key(firsts, "k", [F.asc("o"), F.asc("source_key")], 100).select("source", "keyword", "source_key")


@query("SELECT f.source, f.zone_name, m.last_at, coalesce(m.n, 0)::BIGINT AS listings FROM feeds f LEFT JOIN (SELECT source, max(fetchedAt) last_at, count(*) n FROM raw_jobs GROUP BY 1) m USING (source)")
def registry_status(spark, sf):
    last = table(spark, sf, "raw_jobs").groupBy("source").agg(F.max("fetchedAt").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "feeds").join(last, "source", "left").select("source", "zone_name", "last_at", F.coalesce("n", F.lit(0)).alias("listings"))


@query("""WITH s AS (SELECT last_run_id id, remote_type t, count(*) n FROM jobs GROUP BY ALL)
SELECT r.id, r.status, coalesce((SELECT string_agg(coalesce(t, '-') || ':' || n, ' ' ORDER BY coalesce(t, '-')) FROM s WHERE s.id = r.id), '') AS nested FROM scrape_runs r""")
def run_with_rows(spark, sf):
    counts = table(spark, sf, "jobs").groupBy(c("last_run_id").alias("id"), F.coalesce("remote_type", F.lit("-")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    nested = counts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("rows"))
    shown = F.array_join(F.transform("rows", lambda r: F.concat(r["t"], F.lit(":"), r["n"])), " ")
    return table(spark, sf, "scrape_runs").join(nested, "id", "left").select("id", "status", F.coalesce(shown, F.lit("")).alias("nested"))


@query("""WITH u AS (SELECT run_id, job_id, snap_id, loaded_at FROM job_snapshots), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, job_id ORDER BY loaded_at DESC, snap_id DESC) n FROM u)
SELECT run_id, job_id, snap_id FROM r WHERE n = 1""")
def replace_by_key(spark, sf):
    rows = table(spark, sf, "job_snapshots").select("run_id", "job_id", "snap_id", "loaded_at")
    return rows.groupBy("run_id", "job_id").agg(F.max_by("snap_id", F.struct("loaded_at", "snap_id")).alias("snap_id"))


@query("""SELECT source, source_key FROM job_sources WHERE last_seen_at >= '2026-06-01'""")
def live_entries(spark, sf):
    return table(spark, sf, "job_sources").where(c("last_seen_at") >= "2026-06-01").select("source", "source_key")


@query("SELECT lower(string_split(p, '=')[1]) LIKE 'utm\\_%' ESCAPE '\\' OR lower(string_split(p, '=')[1]) IN ('{0}') AS tracks, count(*) AS n FROM (SELECT unnest(string_split(regexp_extract(applyUrl, '\\?([^#]*)', 1), '&')) p FROM raw_jobs WHERE applyUrl IS NOT NULL) WHERE p <> '' GROUP BY 1".replace("{0}", "', '".join(urls.TRACKING)))
def tracking_params(spark, sf):
    pairs = table(spark, sf, "raw_jobs").where("applyUrl is not null").select(F.explode(F.split(F.try_parse_url("applyUrl", F.lit("QUERY")), "&")).alias("p")).where("p <> ''")
    return pairs.groupBy(urls.is_tracking(F.split_part("p", F.lit("="), F.lit(1))).alias("tracks")).agg(F.count(F.lit(1)).alias("n"))
