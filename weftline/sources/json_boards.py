"""Boards that answer in JSON. payloads: a DataFrame with the answer in `body` and its time in `fetchedAt`; broken answers give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.listing import period_code
from weftline.functions.text import collapse_ws, html_to_text, sha1_id
from weftline.sources.schema import filled, hint, pay, text_or_null

c = F.col


def _items(payloads: DataFrame, schema: str, path: str = "jobs") -> DataFrame:
    read = F.from_json("body", f"struct<{path}: array<struct<{schema}>>>" if path else f"array<struct<{schema}>>")
    return payloads.select("fetchedAt", F.inline(read[path] if path else read))


def _list(value: str):
    """A field that is a list or a single text, as a list."""
    return F.coalesce(F.from_json(value, "array<string>"), F.when(text_or_null(c(value)).isNotNull(), F.array(c(value))), F.array().cast("array<string>"))


def remotive(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "id bigint, url string, title string, company_name string, category string, tags array<string>, job_type string, publication_date string, candidate_required_location string, salary string, description string")
    rows = rows.where("id is not null and title <> '' and url <> ''")
    place = text_or_null(c("candidate_required_location"))
    return filled(
        rows, source=F.lit("remotive"), sourceJobId=c("id").cast("string"), title=F.trim("title"), company=text_or_null(c("company_name")), location=place,
        descriptionHtml=c("description"), employmentType=c("job_type"), salaryRaw=text_or_null(c("salary")), postedAt=c("publication_date"), fetchedAt=c("fetchedAt"),
        jobUrl=c("url"), tags=F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array_compact(F.array("category"))),
        remoteHints=hint("remote_only_board", "Remotive lists remote jobs only"), applicantLocations=F.array_compact(F.array(place)),
    )


def remoteok(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "id string, slug string, epoch string, date string, company string, position string, tags array<string>, description string, location string, apply_url string, url string, salary_min double, salary_max double", "")
    rows = rows.where("id <> '' and position <> ''")
    secure = lambda x: F.regexp_replace(x, r"(?i)^https?://remoteok\.com", "https://remoteok.com")
    url = F.coalesce(secure(c("url")), F.concat(F.lit("https://remoteok.com/remote-jobs/"), F.coalesce("slug", "id")))
    paid = (F.coalesce("salary_min", F.lit(0)) > 0) | (F.coalesce("salary_max", F.lit(0)) > 0)
    place = text_or_null(c("location"))
    return filled(
        rows, source=F.lit("remoteok"), sourceJobId=c("id"), title=F.trim("position"), company=text_or_null(c("company")), location=place, descriptionHtml=c("description"),
        postedAt=F.coalesce("epoch", "date"), fetchedAt=c("fetchedAt"), jobUrl=url, applyUrl=F.nullif(secure(c("apply_url")), url), tags=F.coalesce("tags", F.array().cast("array<string>")),
        salary=F.when(paid, pay(F.nullif("salary_min", F.lit(0.0)), F.nullif("salary_max", F.lit(0.0)), F.lit("USD"), F.lit("year"))),
        remoteHints=hint("remote_only_board", "RemoteOK lists remote jobs only"), applicantLocations=F.array_compact(F.array(place)),
    )


def jobicy(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "id bigint, url string, jobTitle string, companyName string, jobIndustry string, jobType string, jobGeo string, jobLevel string, jobExcerpt string, jobDescription string, pubDate string, salaryMin double, salaryMax double, salaryCurrency string, salaryPeriod string")
    rows = rows.where("id is not null and jobTitle <> '' and url <> ''")
    place = text_or_null(c("jobGeo"))
    return filled(
        rows, source=F.lit("jobicy"), sourceJobId=c("id").cast("string"), title=F.trim("jobTitle"), company=text_or_null(c("companyName")), location=place,
        descriptionHtml=c("jobDescription"), descriptionText=F.when(c("jobDescription").isNull(), c("jobExcerpt")), employmentType=F.nullif(F.array_join(_list("jobType"), ", "), F.lit("")),
        salary=pay(c("salaryMin"), c("salaryMax"), c("salaryCurrency"), period_code(c("salaryPeriod"))), postedAt=c("pubDate"), fetchedAt=c("fetchedAt"), jobUrl=c("url"),
        tags=F.concat(_list("jobIndustry"), F.array_compact(F.array("jobLevel"))), remoteHints=hint("remote_only_board", "Jobicy lists remote jobs only"), applicantLocations=F.array_compact(F.array(place)),
    )


def careerjet(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "title string, company string, locations string, date string, url string, description string, salary string, salary_min string, salary_max string, salary_type string, salary_currency_code string, site string")
    rows = rows.where("title <> '' and url <> ''")
    e = lambda x: F.coalesce(x, F.lit(""))
    number = lambda x: F.expr(f"try_cast({x} as double)")
    return filled(
        rows, source=F.lit("careerjet"), sourceJobId=sha1_id(F.concat_ws("|", "title", e(c("company")), e(c("locations")), e(c("date")))), title=F.trim("title"),
        company=text_or_null(c("company")), location=text_or_null(c("locations")), descriptionHtml=c("description"), descriptionIsSnippet=F.lit(True), salaryRaw=text_or_null(c("salary")),
        salary=pay(number("salary_min"), number("salary_max"), c("salary_currency_code"), period_code(c("salary_type"))), postedAt=c("date"), fetchedAt=c("fetchedAt"), jobUrl=c("url"),
        countryHint=F.lit("US"), originSite=text_or_null(c("site")),
    )


def jooble(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "id string, title string, location string, snippet string, salary string, source string, type string, link string, company string, updated string").where("title <> '' and link <> ''")
    return filled(
        rows, source=F.lit("jooble"), sourceJobId=c("id"), title=html_to_text(c("title")), company=text_or_null(c("company")), location=text_or_null(c("location")),
        descriptionHtml=c("snippet"), descriptionIsSnippet=F.lit(True), employmentType=c("type"), salaryRaw=text_or_null(c("salary")), postedAt=c("updated"), fetchedAt=c("fetchedAt"),
        jobUrl=c("link"), countryHint=F.lit("US"), originSite=text_or_null(c("source")),
    )


# Names of pay periods of one board.
_SPANS = {"hourly": "hour", "weekly": "week", "monthly": "month", "annual": "year", "yearly": "year"}


def himalayas(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "title string, excerpt string, companyName string, employmentType string, minSalary double, maxSalary double, salaryPeriod string, currency string, seniority array<string>, locationRestrictions array<string>, categories array<string>, parentCategories array<string>, description string, pubDate bigint, applicationLink string, guid string")
    rows = rows.where("guid <> '' and title <> ''")
    none = F.array().cast("array<string>")
    places = F.filter(F.transform(F.coalesce("locationRestrictions", none), lambda x: F.trim(x)), lambda x: x != "")
    span = F.create_map(*[F.lit(x) for kv in _SPANS.items() for x in kv])[F.coalesce("salaryPeriod", F.lit("annual"))]
    slugs = F.transform(F.coalesce("categories", none), lambda x: F.replace(x, F.lit("-"), F.lit(" ")))
    return filled(
        rows, source=F.lit("himalayas"), sourceJobId=c("guid"), title=collapse_ws(c("title")), company=text_or_null(c("companyName")), location=F.nullif(F.array_join(places, ", "), F.lit("")),
        descriptionHtml=c("description"), descriptionText=F.when(c("description").isNull(), c("excerpt")), descriptionIsSnippet=F.coalesce("description", F.lit("")) == "",
        employmentType=c("employmentType"), salary=pay(c("minSalary"), c("maxSalary"), c("currency"), span), postedAt=c("pubDate").cast("string"), fetchedAt=c("fetchedAt"), jobUrl=c("guid"),
        applyUrl=F.nullif("applicationLink", "guid"), tags=F.concat(F.coalesce("parentCategories", none), slugs, F.coalesce("seniority", none)),
        remoteHints=hint("remote_only_board", "Himalayas lists remote jobs only"), applicantLocations=F.when(F.size(places) > 0, places).otherwise(F.array(F.lit("Worldwide"))),
    )


def _stitched(items: DataFrame) -> Column:
    """A description out of a summary and the lists beside it, each under its heading."""
    parts = [F.nullif(collapse_ws(c("jobSummary")), F.lit(""))]
    for column, heading in (("coreResponsibilities", "Responsibilities"), ("requirements", "Requirements")):
        if column in items.columns:
            lines = F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), collapse_ws), lambda x: x != "")
            parts.append(F.when(F.size(lines) > 0, F.concat(F.lit(f"{heading}:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))))
    return F.nullif(F.concat_ws("\n\n", *parts), F.lit(""))


def jobright_rows(items: DataFrame) -> DataFrame:
    """Listings of flat result rows (jobId, jobTitle, ...): times without a zone are UTC."""
    model = F.trim(F.coalesce("workModel", F.lit("")))
    kind = F.when(model.rlike("(?i)hybrid"), "structured_hybrid").when(model.rlike("(?i)on-?site"), "structured_onsite").when(model.rlike("(?i)remote") | F.coalesce("isRemote", F.lit(False)), "structured_remote")
    told = F.struct(kind.alias("kind"), F.concat(F.lit("JobRight: "), F.coalesce(F.nullif(model, F.lit("")), F.lit("isRemote"))).alias("detail"))
    stamp = F.regexp_extract(F.trim("publishTime"), r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}(?::\d{2})?)$", 1)
    clock = F.regexp_extract(F.trim("publishTime"), r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}(?::\d{2})?)$", 2)
    return filled(
        items.where("jobId <> '' and jobTitle <> ''"), source=F.lit("jobright"), sourceJobId=c("jobId"), title=collapse_ws(c("jobTitle")), company=text_or_null(c("companyName")), location=text_or_null(c("jobLocation")),
        descriptionText=_stitched(items), descriptionIsSnippet=F.lit(True), employmentType=c("employmentType"), salaryRaw=text_or_null(c("salaryDesc")),
        postedAt=F.when(stamp != "", F.concat(stamp, F.lit("T"), clock, F.lit("Z"))), postedText=c("publishTimeDesc"), fetchedAt=c("fetchedAt"), jobUrl=F.concat(F.lit("https://jobright.ai/jobs/info/"), c("jobId")),
        tags=F.array_compact(F.array("jobSeniority")), remoteHints=F.when(kind.isNotNull(), F.array(told)).otherwise(F.array().cast("array<struct<kind:string,detail:string>>")), countryHint=F.lit("US"),
    )


def jobright(payloads: DataFrame) -> DataFrame:
    result = "jobId string, jobTitle string, jobNlpTitle string, jobSeniority string, jobLocation string, isRemote boolean, workModel string, publishTime string, publishTimeDesc string, salaryDesc string, employmentType string, jobSummary string, coreResponsibilities array<string>, requirements array<string>"
    read = F.from_json("body", f"struct<result: struct<jobList: array<struct<jobResult: struct<{result}>, companyResult: struct<companyName: string>>>>>")
    rows = payloads.select("fetchedAt", F.inline(read["result"]["jobList"])).select("fetchedAt", "jobResult.*", "companyResult.companyName")
    return jobright_rows(rows.withColumn("jobTitle", F.coalesce(text_or_null(c("jobTitle")), c("jobNlpTitle"))))


def simplyhired(payloads: DataFrame) -> DataFrame:
    """Search pages with their data in a script block."""
    data = F.regexp_extract("body", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    job = "jobKey string, title string, company string, location string, snippet string, salaryInfo string, indeedApply boolean, dateOnIndeed bigint, remoteAttributes array<string>, jobTypes array<string>"
    read = F.from_json(data, f"struct<props: struct<pageProps: struct<jobs: array<struct<{job}>>>>>")
    rows = payloads.select("fetchedAt", F.inline(read["props"]["pageProps"]["jobs"])).where("jobKey <> ''")
    told = lambda a: F.struct(F.when(a.rlike("(?i)hybrid"), "structured_hybrid").otherwise("structured_remote").alias("kind"), F.concat(F.lit("SimplyHired: "), a).alias("detail"))
    none = F.array().cast("array<string>")
    return filled(
        rows, source=F.lit("simplyhired"), sourceJobId=c("jobKey"), title=c("title"), company=text_or_null(c("company")), location=text_or_null(c("location")), descriptionText=c("snippet"), descriptionIsSnippet=F.lit(True),
        employmentType=F.get(F.filter(F.coalesce("jobTypes", none), lambda t: t.rlike("(?i)time|contract|temporary|per diem")), F.lit(0)), salaryRaw=text_or_null(c("salaryInfo")), postedAt=c("dateOnIndeed").cast("string"),
        fetchedAt=c("fetchedAt"), jobUrl=F.concat(F.lit("https://www.simplyhired.com/job/"), c("jobKey")), remoteHints=F.transform(F.filter(F.coalesce("remoteAttributes", none), lambda a: a.rlike("(?i)hybrid|remote")), told),
        countryHint=F.lit("US"), viaFlag=F.coalesce("indeedApply", F.lit(False)),
    )


def simplyhired_detail(payloads: DataFrame) -> DataFrame:
    """Detail pages as columns that override a listing's (see state.override), by jobKey; pay is given in hundredths."""
    data = F.regexp_extract("body", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    detail = (
        "jobKey string, jobTitle string, employerName string, formattedLocation string, jobDescriptionHtml string, datePublished string, dateOnIndeed string, compensation string, "
        "baseSalary struct<minMinor: double, maxMinor: double, unitOfWork: string, currencyCode: string>, workSettings array<string>, isIndeedApply boolean"
    )
    read = F.from_json(data, f"struct<props: struct<pageProps: struct<viewJobData: struct<{detail}>, jobKey: string>>>")["props"]["pageProps"]
    d = payloads.select(read["viewJobData"].alias("d"), read["jobKey"].alias("k"))
    hundredth = lambda x: F.when(c(f"d.baseSalary.{x}") != 0, c(f"d.baseSalary.{x}") / 100)
    return d.select(
        F.coalesce("d.jobKey", "k").alias("sourceJobId"), c("d.jobTitle").alias("title"), c("d.employerName").alias("company"), c("d.formattedLocation").alias("location"), c("d.jobDescriptionHtml").alias("descriptionHtml"),
        (F.coalesce("d.jobDescriptionHtml", F.lit("")) == "").alias("descriptionIsSnippet"), F.coalesce("d.datePublished", "d.dateOnIndeed").alias("postedAt"), c("d.compensation").alias("salaryRaw"),
        pay(hundredth("minMinor"), hundredth("maxMinor"), c("d.baseSalary.currencyCode"), period_code(c("d.baseSalary.unitOfWork"))).alias("salary"), F.coalesce("d.isIndeedApply", F.lit(False)).alias("viaFlag"),
    ).where("sourceJobId <> ''")
