"""Boards that answer in XML feeds or HTML pages, and schema.org postings inside pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.listing import period_code
from weftline.functions.text import WS, collapse_ws, decode_entities, html_to_text
from weftline.sources.schema import filled, hint, pay, text_or_null

c = F.col


def weworkremotely(payloads: DataFrame) -> DataFrame:
    """RSS items titled 'Company: Role'; of one link in several feeds the last payload's item holds (payloads: body, fetchedAt)."""
    item = "struct<title: string, region: string, country: string, state: string, skills: string, category: string, type: string, description: string, pubDate: string, guid: string, link: string>"
    read = F.from_xml(F.col("body"), f"channel struct<item: array<{item}>>", {"rowTag": "rss"})
    rows = payloads.select("fetchedAt", F.inline(read["channel"]["item"]))
    url = F.trim(F.coalesce(F.nullif("link", F.lit("")), c("guid")))
    rows = rows.withColumn("url", url).withColumn("full", collapse_ws(decode_entities(c("title")))).where("url <> '' and full <> ''")
    rows = rows.groupBy("url").agg(F.max_by(F.struct(*rows.columns), F.struct("fetchedAt", F.xxhash64("full"))).alias("r")).select("r.*")
    company, role = F.regexp_extract("full", r"^(.+?)\s*:\s+(.+)$", 1), F.regexp_extract("full", r"^(.+?)\s*:\s+(.+)$", 2)
    nation = collapse_ws(F.regexp_replace(F.coalesce("country", F.lit("")), r"[^\p{L}\p{N}\s,.'()&-]", ""))
    skills = F.transform(F.split(F.concat_ws(",", F.coalesce("category", F.lit("")), F.coalesce("skills", F.lit(""))), ","), lambda x: F.trim(x))
    return filled(
        rows, source=F.lit("weworkremotely"), sourceJobId=F.regexp_replace("url", r"^https?://[^/]+/remote-jobs/", ""), title=F.coalesce(F.nullif(role, F.lit("")), c("full")), company=F.nullif(company, F.lit("")),
        location=F.nullif(F.array_join(F.filter(F.array(collapse_ws(F.coalesce("state", F.lit(""))), nation), lambda x: x != ""), ", "), F.lit("")), descriptionHtml=text_or_null(c("description")),
        employmentType=text_or_null(c("type")), postedAt=text_or_null(c("pubDate")), fetchedAt=c("fetchedAt"), jobUrl=c("url"), tags=F.filter(skills, lambda x: x != ""),
        remoteHints=hint("remote_only_board", "We Work Remotely lists remote jobs only"), applicantLocations=F.array_compact(F.array(text_or_null(c("region")))),
    )


def canada_job_bank(payloads: DataFrame) -> DataFrame:
    """Atom entries whose summary holds labelled fields."""
    entry = "struct<title: string, link: struct<_href: string>, id: string, updated: string, summary: string>"
    rows = payloads.select("fetchedAt", F.inline(F.from_xml(F.col("body"), f"entry array<{entry}>", {"rowTag": "feed"})["entry"]))
    rows = rows.withColumn("url", c("link._href")).where("url <> '' and title <> ''").withColumn("told", html_to_text(F.regexp_replace("summary", r"(?i)<br\s*/?>", "\n")))
    field = lambda label: F.nullif(collapse_ws(F.regexp_extract("told", rf"(?i){label}:\s*([^\n]+)", 1)), F.lit(""))
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"jobposting/(\d+)", 1), F.lit("")), field("Job number"), F.nullif(F.regexp_extract("id", r"id=(\d+)", 1), F.lit("")))
    return filled(
        rows, source=F.lit("canada_job_bank"), sourceJobId=number, title=collapse_ws(decode_entities(c("title"))), company=field("Employer"), location=field("Location"), descriptionText=c("told"),
        descriptionIsSnippet=F.lit(True), salaryRaw=field("Salary"), postedAt=text_or_null(c("updated")), fetchedAt=c("fetchedAt"), jobUrl=F.substring_index("url", ";", 1), countryHint=F.lit("CA"),
    )


# Signs that JSON in a page must not hold, and tags without an end.
_VOID = {"br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Cards(HTMLParser):
    """Cards of a page: for each element that starts a card, the texts of the marked elements in it, and first attributes."""

    def __init__(self, is_card, marks):
        super().__init__(convert_charrefs=True)
        self.is_card, self.marks = is_card, marks
        self.cards, self.path = [], []
        self.depth_of_card = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth_of_card is None and self.is_card(tag, a):
            self.depth_of_card = len(self.path)
            self.cards.append({"_attrs": a})
        open_marks = []
        if self.depth_of_card is not None:
            card = self.cards[-1]
            for name, fits in self.marks.items():
                if fits(tag, a) and f"{name}.done" not in card:
                    card.setdefault(name, "")
                    card.setdefault(f"{name}.attrs", a)
                    open_marks.append(name)
        if tag not in _VOID:
            self.path.append((tag, open_marks))

    def handle_endtag(self, tag):
        while self.path:
            name, marks = self.path.pop()
            if self.cards:
                for m in marks:
                    self.cards[-1][f"{m}.done"] = True
            if self.depth_of_card is not None and len(self.path) <= self.depth_of_card:
                self.depth_of_card = None
            if name == tag:
                return

    def handle_data(self, data):
        if self.depth_of_card is not None:
            for _, marks in self.path:
                for m in marks:
                    self.cards[-1][m] += data


def _cls(ending):
    """Elements with a class of that ending, whatever the page's design puts before it."""
    return lambda tag, a: any(k.endswith(ending) for k in (a.get("class") or "").split())


_CARD = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "href", "title", "company", "company_url", "location", "posted", "posted_text", "type", "pay")]))


@F.pandas_udf(_CARD)
def _linkedin_cards(pages: pd.Series) -> pd.Series:
    marks = {
        "link": lambda t, a: t == "a", "title": _cls("-card__title"), "company": _cls("-card__subtitle"), "location": _cls("-card__location"),
        "time": lambda t, a: t == "time", "pay": _cls("-card__salary-info"),
    }

    def one(page: str | None) -> list[dict]:
        is_card = _cls("-search-card")
        p = _Cards(lambda t, a: is_card(t, a) or "jobPosting" in (a.get("data-entity-urn") or ""), marks)
        p.feed(page or "")
        return [
            {"id": k["_attrs"].get("data-entity-urn"), "href": k.get("link.attrs", {}).get("href"), "title": k.get("title"), "company": k.get("company"), "company_url": None, "location": k.get("location"), "posted": k.get("time.attrs", {}).get("datetime"), "posted_text": k.get("time"), "type": None, "pay": k.get("pay")}
            for k in p.cards
        ]

    return pages.map(one)


def linkedin(payloads: DataFrame) -> DataFrame:
    """Search cards; of cards with one id the first of a page holds."""
    rows = payloads.select("fetchedAt", F.posexplode(_linkedin_cards("body")).alias("no", "k")).select("fetchedAt", "no", "k.*")
    found = F.coalesce(*[F.nullif(F.regexp_extract(a, p, 1), F.lit("")) for a, p in (("id", r"jobPosting:(\d+)"), ("href", r"-(\d{6,})(?:\?|$)"), ("href", r"/view/(\d+)"))])
    rows = rows.withColumn("job", found).withColumn("name", collapse_ws(F.coalesce("title", F.lit("")))).where("job is not null and name <> ''")
    rows = rows.groupBy("fetchedAt", "job").agg(F.min_by(F.struct(*[x for x in rows.columns if x not in ("job", "fetchedAt")]), "no").alias("r")).select("fetchedAt", "job", "r.*")
    clean = lambda x: F.nullif(collapse_ws(c(x)), F.lit(""))
    return filled(
        rows, source=F.lit("linkedin"), sourceJobId=c("job"), title=c("name"), company=clean("company"), location=clean("location"), salaryRaw=clean("pay"), postedAt=c("posted"), postedText=clean("posted_text"),
        fetchedAt=c("fetchedAt"), jobUrl=F.concat(F.lit("https://www.linkedin.com/jobs/view/"), c("job")), countryHint=F.lit("US"),
    )


@F.pandas_udf(_CARD)
def _dice_cards(pages: pd.Series) -> pd.Series:
    by = lambda key, value: lambda t, a: a.get(key) == value
    marks = {
        "link": lambda t, a: (a.get("data-testid") or "").endswith("job-detail-link"), "company": by("data-testid", "job-card-company-name"), "place": lambda t, a: t == "p" and "company" not in (a.get("data-testid") or "") and "label" not in (a.get("id") or ""),
        "type": by("id", "employmentType-label"), "pay": by("id", "salary-label"),
    }

    def one(page: str | None) -> list[dict]:
        p = _Cards(by("data-testid", "job-card"), marks)
        p.feed(page or "")
        return [
            {"id": k["_attrs"].get("data-job-guid"), "href": k.get("link.attrs", {}).get("href"), "title": k.get("link") or k.get("link.attrs", {}).get("aria-label"), "company": k.get("company"), "company_url": None, "location": k.get("place"), "posted": None, "posted_text": None, "type": k.get("type"), "pay": k.get("pay")}
            for k in p.cards
        ]

    return pages.map(one)


def dice(payloads: DataFrame) -> DataFrame:
    """Search cards with 'place • age' in one line; of cards with one id the first of a page holds."""
    rows = payloads.select("fetchedAt", F.posexplode(_dice_cards("body")).alias("no", "k")).select("fetchedAt", "no", "k.*")
    rows = rows.withColumn("job", F.coalesce("id", F.nullif(F.regexp_extract("href", r"/job-detail/([\w-]+)", 1), F.lit("")))).withColumn("name", collapse_ws(F.coalesce("title", F.lit("")))).where("job is not null and name <> ''")
    rows = rows.groupBy("fetchedAt", "job").agg(F.min_by(F.struct(*[x for x in rows.columns if x not in ("job", "fetchedAt")]), "no").alias("r")).select("fetchedAt", "job", "r.*")
    clean = lambda x: F.nullif(collapse_ws(x), F.lit(""))
    both = c("location").contains("•")
    return filled(
        rows, source=F.lit("dice"), sourceJobId=c("job"), title=c("name"), company=clean(c("company")), location=F.when(both, clean(F.split_part("location", F.lit("•"), F.lit(1)))), postedText=F.when(both, clean(F.split_part("location", F.lit("•"), F.lit(2)))),
        employmentType=clean(c("type")), salaryRaw=clean(c("pay")), fetchedAt=c("fetchedAt"), jobUrl=F.concat(F.lit("https://www.dice.com/job-detail/"), c("job")),
    )


_PLACE = "struct<address: string, name: string>"


def jsonld_posting(pages: DataFrame) -> DataFrame:
    """The first schema.org JobPosting of each page (body, fetchedAt, source, jobUrl), control characters repaired."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    one = "`@type` string, title string, description string, datePosted string, employmentType string, jobLocationType string, url string, hiringOrganization string, jobLocation string, applicantLocationRequirements string, baseSalary string, `@graph` string"
    rows = pages.withColumn("__id", F.monotonically_increasing_id()).select("__id", "fetchedAt", "source", "jobUrl", F.posexplode(blocks).alias("no", "block"))
    rows = rows.withColumn("block", F.regexp_replace(F.trim("block"), "[\\x{00}-\\x{1f}]+", " "))
    as_list = lambda x: F.from_json(F.when(x.startswith("["), x).otherwise(F.concat(F.lit("["), x, F.lit("]"))), f"array<struct<{one}>>")
    top = rows.select(*[x for x in rows.columns if x != "block"], F.posexplode(as_list(c("block"))).alias("at", "ld"))
    inner = top.where("ld.`@graph` is not null").select(*[x for x in top.columns if x not in ("ld", "at")], "at", F.posexplode(as_list(c("ld.`@graph`"))).alias("deep", "ld"))
    every = top.withColumn("deep", F.lit(-1)).unionByName(inner).where(F.col("ld.`@type`").rlike(r'(^|")JobPosting("|$)'))
    first = every.groupBy("__id").agg(F.min_by(F.struct("fetchedAt", "source", "jobUrl", "ld"), F.struct("no", "at", "deep")).alias("r")).select("r.fetchedAt", "r.source", "r.jobUrl", "r.ld.*")
    obj = lambda x, path: F.get_json_object(x, f"$.{path}")
    name = lambda x: F.coalesce(obj(c(x), "name"), F.when(~c(x).rlike(r"^[{\[]"), c(x)))
    address = lambda key: obj(c("jobLocation"), f"address.{key}")
    place = F.nullif(F.concat_ws(", ", address("addressLocality"), address("addressRegion"), F.coalesce(address("addressCountry.name"), address("addressCountry"))), F.lit(""))
    number = lambda path: F.expr(f"try_cast(get_json_object(baseSalary, '$.{path}') as double)")
    single = F.coalesce(number("value.value"), number("value"))
    unit = F.coalesce(obj(c("baseSalary"), "value.unitText"), obj(c("baseSalary"), "unitText"))
    return filled(
        first, source=c("source"), title=decode_entities(c("title")), company=decode_entities(name("hiringOrganization")), location=F.coalesce(place, obj(c("jobLocation"), "name")), descriptionHtml=decode_entities(c("description")),
        employmentType=F.array_join(F.coalesce(F.from_json("employmentType", "array<string>"), F.array("employmentType")), ", "), postedAt=c("datePosted"), fetchedAt=c("fetchedAt"), jobUrl=c("jobUrl"), applyUrl=c("url"),
        salary=pay(F.coalesce(number("value.minValue"), single), F.coalesce(number("value.maxValue"), single), obj(c("baseSalary"), "currency"), period_code(unit)),
        remoteHints=F.when(c("jobLocationType").rlike("(?i)telecommute"), hint("structured_remote", "schema.org jobLocationType=TELECOMMUTE")), applicantLocations=F.array_compact(F.array(name("applicantLocationRequirements"))),
    )


def title_list(lines: DataFrame) -> DataFrame:
    """Titles of a file, one a line (column value); blank lines and comments left out."""
    return lines.select(F.regexp_replace("value", f"^[{WS}]+|[{WS}]+$", "").alias("title")).where("title <> '' and not startswith(title, '#')")
