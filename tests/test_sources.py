import json

from weftline.sources import json_boards as j
from weftline.sources import markup_boards as m

AT = "2026-09-28T15:00:00Z"


def payload(spark, body):
    return spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body), AT)], "body string, fetchedAt string")


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def test_remotive(spark):
    (r,) = rows(j.remotive(payload(spark, {"jobs": [{"id": 7, "url": "https://x.example/7", "title": " Coder ", "company_name": "Acme", "category": "Health", "tags": ["a"], "candidate_required_location": "USA"}, {"id": 8}]})))
    assert (r["sourceJobId"], r["title"], r["company"], r["tags"], r["applicantLocations"]) == ("7", "Coder", "Acme", ["a", "Health"], ["USA"])


def test_remoteok_skips_the_notice(spark):
    items = [{"legal": "notice"}, {"id": 5, "epoch": 1700000000, "company": "B", "position": "Biller", "url": "https://remoteOK.com/remote-jobs/5", "salary_min": 0, "salary_max": 70000}]
    (r,) = rows(j.remoteok(payload(spark, items)))
    assert r["jobUrl"] == "https://remoteok.com/remote-jobs/5" and r["salary"] == {"min": None, "max": 70000.0, "currency": "USD", "period": "year"} and r["postedAt"] == "1700000000"


def test_jobicy_takes_lists_and_texts(spark):
    jobs = [{"id": 1, "url": "u", "jobTitle": "T", "jobType": ["full-time", "contract"], "jobIndustry": "Health", "jobLevel": "Any", "salaryMin": 5, "salaryPeriod": "hourly"}]
    (r,) = rows(j.jobicy(payload(spark, {"jobs": jobs})))
    assert (r["employmentType"], r["tags"], r["salary"]["period"], r["salary"]["max"]) == ("full-time, contract", ["Health", "Any"], "hour", None)


def test_careerjet_has_an_id_of_its_content(spark):
    job = {"title": "T", "company": "C", "locations": "L", "date": "D", "url": "u1", "salary_min": "10", "salary_max": "", "salary_type": "H"}
    a, b = rows(j.careerjet(payload(spark, {"jobs": [job, job | {"url": "u2"}]})))
    assert a["sourceJobId"] == b["sourceJobId"] and len(a["sourceJobId"]) == 16 and a["salary"] == {"min": 10.0, "max": None, "currency": None, "period": "hour"}


def test_jooble_himalayas_jobright_simplyhired(spark):
    (r,) = rows(j.jooble(payload(spark, {"jobs": [{"id": 3, "title": "A <b>b</b> &amp; c", "link": "l", "source": "s"}]})))
    assert r["title"] == "A b & c" and r["originSite"] == "s"
    (r,) = rows(j.himalayas(payload(spark, {"jobs": [{"title": "T", "guid": "g", "locationRestrictions": [], "categories": ["Medical-Coder"], "minSalary": 1, "salaryPeriod": "annual", "pubDate": 1700000000}]})))
    assert (r["applicantLocations"], r["tags"], r["salary"]["period"], r["descriptionIsSnippet"]) == (["Worldwide"], ["Medical Coder"], "year", True)
    items = [{"jobResult": {"jobId": "k", "jobTitle": "T", "publishTime": "2026-09-28 19:19:36", "workModel": "Hybrid"}, "companyResult": {"companyName": "C"}}, {"jobResult": {"jobId": ""}}]
    (r,) = rows(j.jobright(payload(spark, {"result": {"jobList": items}})))
    assert (r["postedAt"], r["remoteHints"][0]["kind"], r["company"]) == ("2026-09-28T19:19:36Z", "structured_hybrid", "C")
    page = '<script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {"jobs": [{"jobKey": "z", "title": "T", "remoteAttributes": ["Remote"], "indeedApply": True}]}}}) + "</script>"
    (r,) = rows(j.simplyhired(payload(spark, page)))
    assert (r["sourceJobId"], r["viaFlag"], r["remoteHints"][0]["kind"]) == ("z", True, "structured_remote")


def test_broken_payloads_give_no_rows(spark):
    for parse in (j.remotive, j.remoteok, j.jobicy, j.careerjet, j.jooble, j.himalayas, j.jobright, j.simplyhired, m.linkedin, m.dice, m.weworkremotely, m.canada_job_bank):
        assert rows(parse(payload(spark, "{broken"))) == []


def test_feeds(spark):
    rss = "<rss><channel><item><title>Acme: Medical Coder</title><region>Anywhere</region><country>🇺🇸 United States</country><state>Texas</state><skills>icd, cpt</skills><category>Health</category><link>https://weworkremotely.com/remote-jobs/acme-coder</link><description>&lt;p&gt;x&lt;/p&gt;</description></item></channel></rss>"
    (r,) = rows(m.weworkremotely(payload(spark, rss)))
    assert (r["company"], r["title"], r["location"], r["sourceJobId"], r["tags"]) == ("Acme", "Medical Coder", "Texas, United States", "acme-coder", ["Health", "icd", "cpt"])
    atom = '<feed><entry><title>clerk</title><link href="https://j.example/jobposting/991;jsessionid=1"/><id>id=5</id><updated>2026-09-01</updated><summary>Employer: Acme&lt;br/&gt;Location: Ottawa&lt;br/&gt;Salary: $20 hourly</summary></entry></feed>'
    (r,) = rows(m.canada_job_bank(payload(spark, atom)))
    assert (r["sourceJobId"], r["company"], r["location"], r["salaryRaw"], r["jobUrl"]) == ("991", "Acme", "Ottawa", "$20 hourly", "https://j.example/jobposting/991")


def test_pages(spark):
    card = '<div class="base-search-card" data-entity-urn="urn:li:jobPosting:4001"><a class="base-card__full-link" href="https://x/view/4001?y"></a><h3 class="base-search-card__title"> Coder </h3><h4 class="base-search-card__subtitle"><a href="c?z">Acme</a></h4><span class="base-search-card__location">Austin, TX</span><time datetime="2026-09-28">3 hours ago</time></div>'
    (r,) = rows(m.linkedin(payload(spark, f"<ul><li>{card}</li><li>{card}</li></ul>")))
    assert (r["sourceJobId"], r["title"], r["company"], r["location"], r["postedAt"], r["postedText"]) == ("4001", "Coder", "Acme", "Austin, TX", "2026-09-28", "3 hours ago")
    page = '<div data-testid="job-card" data-job-guid="g-1"><a data-testid="job-detail-link" href="/job-detail/g-1">Biller</a><p data-testid="job-card-company-name">Acme</p><p>Remote • Today</p><p id="salary-label">$20</p></div>'
    (r,) = rows(m.dice(payload(spark, page)))
    assert (r["sourceJobId"], r["title"], r["company"], r["location"], r["postedText"], r["salaryRaw"]) == ("g-1", "Biller", "Acme", "Remote", "Today", "$20")


def test_postings_inside_pages(spark):
    ld = {"@graph": [{"@type": "Thing"}, {"@type": "JobPosting", "title": "A &amp; B", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX", "addressCountry": "US"}}, "jobLocationType": "TELECOMMUTE", "employmentType": ["FULL_TIME", "OTHER"], "baseSalary": {"currency": "USD", "value": {"minValue": 10, "maxValue": 12, "unitText": "HOUR"}}}]}
    page = '<script type="application/ld+json">{"@type": "Org"}</script><script type="application/ld+json">' + json.dumps(ld) + "</script>"
    df = spark.createDataFrame([(page, AT, "dice", "u"), ("<p>none</p>", AT, "dice", "v")], "body string, fetchedAt string, source string, jobUrl string")
    (r,) = rows(m.jsonld_posting(df))
    assert (r["title"], r["company"], r["location"], r["employmentType"], r["salary"]) == ("A & B", "Acme", "Austin, TX, US", "FULL_TIME, OTHER", {"min": 10.0, "max": 12.0, "currency": "USD", "period": "hour"})
    assert r["remoteHints"][0]["kind"] == "structured_remote"


def test_title_list(spark):
    lines = spark.createDataFrame([("# note",), (" Coder ",), ("",)], "value string")
    assert [r.title for r in m.title_list(lines).collect()] == ["Coder"]


def test_details_override_a_listing(spark):
    detail = {"jobKey": "z", "jobTitle": "T", "jobDescriptionHtml": "<p>x</p>", "baseSalary": {"minMinor": 2500, "maxMinor": 0, "unitOfWork": "HOUR", "currencyCode": "USD"}}
    page = '<script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {"viewJobData": detail}}}) + "</script>"
    (r,) = rows(j.simplyhired_detail(payload(spark, page)))
    assert (r["sourceJobId"], r["title"], r["descriptionIsSnippet"], r["salary"]) == ("z", "T", False, {"min": 25.0, "max": None, "currency": "USD", "period": "hour"})
    assert rows(j.simplyhired_detail(payload(spark, "{broken"))) == []


def test_summaries_are_stitched(spark):
    items = [{"jobResult": {"jobId": "k", "jobTitle": "T", "jobSummary": " A  b. ", "coreResponsibilities": ["do x", " "], "requirements": ["know y", "know z"]}, "companyResult": {}}]
    (r,) = rows(j.jobright(payload(spark, {"result": {"jobList": items}})))
    assert r["descriptionText"] == "A b.\n\nResponsibilities:\n- do x\n\nRequirements:\n- know y\n- know z"
