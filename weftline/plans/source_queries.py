"""Registered queries of the boards' parsers: every listing is written as the board would answer, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import html_escape
from weftline.plans.stages import spread, table
from weftline.plans.text_queries import sql_collapse
from weftline.sources import json_boards, markup_boards

c = F.col
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_SHOWN = ("sourceJobId", "title", "company", "location")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _sql(title: str, job: str = "raw_id::VARCHAR", location: str = "nullif(trim(location), '')", company: str = "nullif(trim(company), '')", where: str = "title <> ''") -> str:
    return f"""SELECT {job} AS "sourceJobId", {title} AS title, {company} AS company, {location} AS location FROM raw_jobs WHERE {where}"""


def _read(parse, spark, sf, body):
    """What a parser gives of a payload for each listing. body: Column of the payload over raw_jobs."""
    rows = spread(table(spark, sf, "raw_jobs").select("raw_id", "title", "company", "location", "postedAt"))
    return parse(rows.select(body.alias("body"), F.lit("2026-09-28T15:00:00Z").alias("fetchedAt"))).select(*_SHOWN)


def _jobs(**fields):
    return F.to_json(F.struct(F.array(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("jobs")))


def _url():
    return F.concat(F.lit("https://x.example/"), F.col("raw_id").cast("string"))


@query(_sql("trim(title)"))
def board_remotive(spark, sf):
    return _read(json_boards.remotive, spark, sf, _jobs(id=c("raw_id"), url=_url(), title=c("title"), company_name=c("company"), candidate_required_location=c("location")))


@query(_sql("trim(title)"))
def board_remoteok(spark, sf):
    notice = F.struct(F.lit("legal").alias("slug"))
    item = F.struct(c("raw_id").cast("string").alias("id"), c("title").alias("position"), "company", "location", _url().alias("url"))
    return _read(json_boards.remoteok, spark, sf, F.concat(F.lit("["), F.to_json(notice), F.lit(","), F.to_json(item), F.lit("]")))


@query(_sql("trim(title)"))
def board_jobicy(spark, sf):
    return _read(json_boards.jobicy, spark, sf, _jobs(id=c("raw_id"), url=_url(), jobTitle=c("title"), companyName=c("company"), jobGeo=c("location")))


@query(_sql("trim(title)", "substr(sha1(title || '|' || coalesce(company, '') || '|' || coalesce(location, '') || '|' || coalesce(\"postedAt\", '')), 1, 16)"))
def board_careerjet(spark, sf):
    return _read(json_boards.careerjet, spark, sf, _jobs(url=_url(), title=c("title"), company=c("company"), locations=c("location"), date=c("postedAt")))


@query(_sql(sql_collapse("title")))
def board_jooble(spark, sf):
    return _read(json_boards.jooble, spark, sf, _jobs(id=c("raw_id").cast("string"), link=_url(), title=F.concat(F.lit("<b>"), html_escape(c("title")), F.lit("</b>")), company=c("company"), location=c("location"))).where("title <> ''")


@query(_sql(sql_collapse("title"), "'g' || raw_id"))
def board_himalayas(spark, sf):
    return _read(json_boards.himalayas, spark, sf, _jobs(guid=F.concat(F.lit("g"), "raw_id"), title=c("title"), companyName=c("company"), locationRestrictions=F.array_compact(F.array("location"))))


@query(_sql("title", "'k' || raw_id", where="true"))
def board_simplyhired(spark, sf):
    data = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("k"), "raw_id").alias("jobKey"), "title", "company", "location")).alias("jobs")).alias("pageProps")).alias("props")))
    return _read(json_boards.simplyhired, spark, sf, F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>")))


def _element(tag: str, value, **attributes):
    told = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in attributes.items())
    return F.concat(F.lit(f"<{tag}{told}>"), html_escape(F.coalesce(value, F.lit(""))), F.lit(f"</{tag}>"))


_PLAIN = {"location": f"nullif({sql_collapse('location')}, '')", "company": f"nullif({sql_collapse('company')}, '')", "where": f"{sql_collapse('title')} <> ''"}


@query(_sql(sql_collapse("title"), "'1' || lpad(raw_id::VARCHAR, 8, '0')", **_PLAIN))
def board_linkedin(spark, sf):
    number = F.concat(F.lit("1"), F.lpad(c("raw_id").cast("string"), 8, "0"))
    card = {"class": "base-search-card"}
    parts = [_element("h3", c("title"), **{"class": card["class"] + "__title"}), _element("h4", c("company"), **{"class": card["class"] + "__subtitle"}), _element("span", c("location"), **{"class": "base-search-card__location"})]
    return _read(markup_boards.linkedin, spark, sf, F.concat(F.lit('<ul><li><div class="base-search-card" data-entity-urn="urn:li:jobPosting:'), number, F.lit('"><a href="#">x</a>'), *parts, F.lit("</div></li></ul>")))


@query(_sql(sql_collapse("title"), location="NULL::VARCHAR", company=f"nullif({sql_collapse('company')}, '')", where="trim(title) <> '' AND trim(company) <> '' AND NOT contains(company, ':') AND NOT contains(title, ':') AND NOT regexp_matches(company || title, '[\\x{0}-\\x{1F}]')"))
def board_weworkremotely(spark, sf):
    rows = spread(table(spark, sf, "raw_jobs").where(r"trim(title) <> '' and trim(company) <> '' and not contains(company, ':') and not contains(title, ':') and not concat(company, title) rlike '[\\x{0}-\\x{1F}]'"))
    title = html_escape(html_escape(F.concat("company", F.lit(": "), "title")))
    body = F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>https://weworkremotely.com/remote-jobs/"), c("raw_id"), F.lit("</link></item></channel></rss>"))
    return markup_boards.weworkremotely(rows.select(body.alias("body"), F.lit("2026-09-28T15:00:00Z").alias("fetchedAt"))).select(*_SHOWN)


@query(_sql(sql_collapse("title"), "'d' || raw_id", location="nullif(trim(string_split(" + sql_collapse("location || ' • Today'") + ", '•')[1]), '')", company=_PLAIN["company"], where=_PLAIN["where"] + " AND location IS NOT NULL AND NOT contains(location, '•')"))
def board_dice(spark, sf):
    rows = spread(table(spark, sf, "raw_jobs").where("location is not null and not contains(location, '•')"))
    parts = [_element("a", c("title"), data_testid="job-detail-link", href="/job-detail/x"), _element("p", c("company"), data_testid="job-card-company-name"), _element("p", F.concat("location", F.lit(" • Today")))]
    body = F.concat(F.lit('<div data-testid="job-card" data-job-guid="d'), c("raw_id"), F.lit('">'), *parts, F.lit("</div>"))
    return markup_boards.dice(rows.select(body.alias("body"), F.lit("2026-09-28T15:00:00Z").alias("fetchedAt"))).select(*_SHOWN)


@query(_sql(sql_collapse("title"), "(5000 + raw_id)::VARCHAR", location=_PLAIN["location"], company=_PLAIN["company"], where=_PLAIN["where"] + " AND NOT regexp_matches(concat(company, title, location), '[\\x{0}-\\x{1F}]')"))
def board_canada_job_bank(spark, sf):
    rows = spread(table(spark, sf, "raw_jobs").where(r"not concat(coalesce(company, ''), coalesce(title, ''), coalesce(location, '')) rlike '[\\x{0}-\\x{1F}]'"))
    field = lambda label, x: F.when(F.trim(x) != "", F.concat(F.lit(f"{label}: "), html_escape(html_escape(c(x)))))
    told = F.concat_ws("&lt;br/&gt;", field("Employer", "company"), field("Location", "location"))
    link = F.concat(F.lit('<link href="https://jobs.example/jobposting/'), 5000 + c("raw_id"), F.lit(';jsession=1"/>'))
    body = F.concat(F.lit("<feed><entry><title>"), html_escape(html_escape(c("title"))), F.lit("</title>"), link, F.lit("<summary>"), told, F.lit("</summary></entry></feed>"))
    found = markup_boards.canada_job_bank(rows.select(body.alias("body"), F.lit("2026-09-28T15:00:00Z").alias("fetchedAt"))).select(*_SHOWN)
    return found.where("title <> ''")
