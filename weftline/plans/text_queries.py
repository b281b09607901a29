"""Registered queries of text, address, listing and rule expressions, with the SQL that tells the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import listing, rules, text, urls
from weftline.plans.stages import spread, table

NOW = "2026-09-28T15:00:00Z"
c = F.col
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Pieces of SQL that several queries share.
SQL_WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_WS}', ' ', 'g'))"


# Signs that the compatibility form writes out, which strip_accents leaves.
_WRITTEN_OUT = {"¼": "1⁄4", "½": "1⁄2", "¾": "3⁄4", "…": "...", "™": "TM", "ﬂ": "fl", "ﬁ": "fi", "´": " ", "¨": " ", "¸": " ", "¯": " ", "˙": " ", "˚": " ", "‾": " "}


def sql_match(x: str) -> str:
    for sign, out in _WRITTEN_OUT.items():
        x = f"replace({x}, '{sign}', '{out}')"
    x = f"translate({x}, '¹²³ªº', '123ao')"
    return sql_collapse(f"translate(lower(strip_accents({x})), '’‘`–—', '''''''--')")


def sql_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({sql_match(x)}, '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {sql_collapse('text')} AS clean FROM documents WHERE text IS NOT NULL")
def collapse_ws(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.collapse_ws(c("text")).alias("clean"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS short FROM documents")
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(c("text"), 80).alias("short"))


@query("SELECT raw_id, substr(sha1(source || '|' || coalesce(sourceJobId, jobUrl)), 1, 16) AS id FROM raw_jobs")
def sha1_id(spark, sf):
    return table(spark, sf, "raw_jobs").select("raw_id", text.sha1_id(F.concat_ws("|", "source", F.coalesce("sourceJobId", "jobUrl"))).alias("id"))


@query(f"SELECT id, {sql_match('company')} AS company_match FROM jobs WHERE company IS NOT NULL")
def norm_match(spark, sf):
    return table(spark, sf, "jobs").where("company is not null").select("id", text.norm_match(c("company")).alias("company_match"))


@query(f"SELECT id, list_distinct(list_filter({sql_words('title')}, lambda w: length(w) > 1)).list_sort().array_to_string(' ') AS words FROM jobs")
def token_set(spark, sf):
    return table(spark, sf, "jobs").select("id", F.array_join(F.array_sort(text.token_set(c("title"))), " ").alias("words"))


@query(f"""WITH t AS (SELECT id, list_distinct({sql_words('title')}) a, list_distinct({sql_words('norm_title')}) b FROM jobs)
SELECT id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN floor(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE * 10000 + 0.5) / 10000 ELSE 0.0 END AS share FROM t""")
def title_jaccard(spark, sf):
    words = lambda x: F.array_distinct(text.ascii_words(text.norm_match(c(x))))
    return table(spark, sf, "jobs").select("id", listing.round_half_up(text.jaccard(words("title"), words("norm_title")), 4).alias("share"))


@query(f"""WITH w AS (SELECT raw_id, list_slice({sql_words('descriptionText')}, 1, 600) w FROM raw_jobs WHERE descriptionText IS NOT NULL),
s AS (SELECT raw_id, list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN generate_series(1, len(w) - 2)]) s FROM w WHERE len(w) >= 3)
SELECT w.raw_id, coalesce(len(s.s), 0)::BIGINT AS runs FROM w LEFT JOIN s USING (raw_id)""")
def shingle_counts(spark, sf):
    rows = spread(table(spark, sf, "raw_jobs").select("raw_id", "descriptionText").where("descriptionText is not null"))
    return rows.select("raw_id", F.size(text.shingles(c("descriptionText"))).cast("bigint").alias("runs"))


@query(f"""WITH t AS (SELECT doc_id, substr({sql_match("concat_ws(' ', text, company)")}, 1, 20000) h FROM documents)
SELECT doc_id, regexp_matches(h, '(^|[^a-z0-9_])denial') AND regexp_matches(h, '(^|[^a-z0-9_])letter') AS hit FROM t""")
def loose_keyword(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.loose_keyword("the denial letter", c("text"), c("company")).alias("hit"))


@query(f"""WITH t AS (SELECT raw_id, {sql_match("coalesce(title, '')")} t, {sql_match("coalesce(descriptionText, '')")} d FROM raw_jobs)
SELECT raw_id, CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])coding\\s+specialist($|[^a-z0-9_])') THEN 0.9
 WHEN regexp_matches(t, '(^|[^a-z0-9_])coding($|[^a-z0-9_])') AND regexp_matches(t, '(^|[^a-z0-9_])specialist($|[^a-z0-9_])') THEN 0.75
 WHEN regexp_matches(d, '(^|[^a-z0-9_])coding\\s+specialist($|[^a-z0-9_])') AND (regexp_matches(t, '(^|[^a-z0-9_])coding($|[^a-z0-9_])') OR regexp_matches(t, '(^|[^a-z0-9_])specialist($|[^a-z0-9_])')) THEN 0.55
 ELSE 0.0 END::DOUBLE AS score FROM t""".replace("\\\\s", "\\s"))
def generic_match(spark, sf):
    return spread(table(spark, sf, "raw_jobs").select("raw_id", "title", "descriptionText")).select("raw_id", text.generic_match("coding specialist", c("title"), c("descriptionText")).alias("score"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[\\s\\x{A0}\\x{2000}-\\x{200B}\\x{202F}\\x{3000}\\x{FEFF}]+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> ''))::BIGINT AS pieces
FROM documents WHERE text IS NOT NULL""")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(text.split_sentences(c("text"))).cast("bigint").alias("pieces"))


@query("SELECT company_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM companies")
def slug(spark, sf):
    return table(spark, sf, "companies").select("company_id", text.slug(c("name")).alias("slug"))


@query("""WITH t AS (SELECT raw_id, unnest(foundBy) w, generate_subscripts(foundBy, 1) i FROM raw_jobs),
u AS (SELECT raw_id, trim(regexp_replace(w, '\\s+', ' ', 'g')) w, i FROM t), f AS (SELECT raw_id, lower(w) k, arg_min(w, i) w, min(i) i FROM u WHERE w <> '' GROUP BY ALL)
SELECT r.raw_id, coalesce((SELECT string_agg(w, ';' ORDER BY i) FROM f WHERE f.raw_id = r.raw_id), '') AS terms FROM raw_jobs r""")
def dedupe_terms(spark, sf):
    return table(spark, sf, "raw_jobs").select("raw_id", F.coalesce(F.array_join(text.dedupe_terms(c("foundBy")), ";"), F.lit("")).alias("terms"))


@query("""WITH t AS (SELECT doc_id, 'GET https://me:' || doc_id || '@x.example/a?Token=' || doc_id || '&q=1&affid=z' || doc_id || ' https://jooble.org/api/k' || doc_id || ' ' || coalesce(text, '') s FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(s, '(?i)(jooble[.]org/api/)[^/?\\s"'']+', '\\1***', 'g'), '(?i)([?&](api_key|apikey|key|token|access_token|affid|password|secret)=)[^&\\s"'']+', '\\1***', 'g'),
'(?i)(\\b[a-z][a-z0-9+.-]*://)[^/@\\s:]+:[^/@\\s]+@', '\\1***:***@', 'g') AS line FROM t""")
def redact(spark, sf):
    k = c("doc_id")
    head = F.concat(F.lit("GET https://me:"), k, F.lit("@x.example/a?Token="), k, F.lit("&q=1&affid=z"), k, F.lit(" https://jooble.org/api/k"), k, F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", text.redact(F.concat(head, F.coalesce("text", F.lit("")))).alias("line"))


@query("""WITH t AS (SELECT raw_id, CASE WHEN length(title) > 32000 THEN substr(title, 1, 31999) || '…' ELSE title END s FROM raw_jobs),
u AS (SELECT raw_id, CASE WHEN s[1] IN ('=', '+', '@', chr(9), chr(13)) THEN '''' || s ELSE s END s FROM t)
SELECT raw_id, coalesce(CASE WHEN contains(s, '"') OR contains(s, ',') OR contains(s, chr(10)) OR contains(s, chr(13)) THEN '"' || replace(s, '"', '""') || '"' ELSE s END, '') AS cell FROM u""")
def csv_cells(spark, sf):
    return table(spark, sf, "raw_jobs").select("raw_id", text.csv_cell(c("title")).alias("cell"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM documents")
def html_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.html_escape(c("text")).alias("safe"))


@query(f"""WITH t AS (SELECT doc_id, list_transform(string_split(replace(text, chr(13), ' '), chr(10)), lambda x: {sql_collapse('x')}) l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(regexp_replace(array_to_string(['• ' || doc_id::VARCHAR] || l, chr(10)), '\\n{{2,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS plain FROM t""")
def html_to_text(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    body = F.replace(F.replace(text.html_escape(c("text")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit("<br/>"))
    page = F.concat(F.lit("<script>var a = 1;</script><ul><li>"), c("doc_id"), F.lit("</li>"), body, F.lit("</ul>"))
    return docs.select("doc_id", text.html_to_text(page).alias("plain"))


# -- addresses

TRACK = "', '".join(urls.TRACKING)


@query("SELECT id, lower(regexp_extract(apply_url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(apply_url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path FROM jobs WHERE apply_url IS NOT NULL")
def url_parts(spark, sf):
    u = c("apply_url")
    return table(spark, sf, "jobs").where("apply_url is not null").select("id", urls.host(u).alias("host"), F.try_parse_url(u, F.lit("PATH")).alias("path"))


@query(f"""WITH t AS (SELECT raw_id, applyUrl u, regexp_replace(lower(regexp_extract(applyUrl, '^https?://([^/:?#]+)', 1)), '^www\\.', '') h, regexp_extract(applyUrl, '^https?://[^/?#]+([^?#]*)', 1) p,
 list_sort(list_filter(string_split(regexp_extract(applyUrl, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT (lower(string_split(x, '=')[1]) LIKE 'utm\\_%' ESCAPE '\\' OR lower(string_split(x, '=')[1]) IN ('{TRACK}')))) q
 FROM raw_jobs WHERE applyUrl IS NOT NULL)
SELECT raw_id, 'https://' || h || CASE WHEN p = '' THEN '/' WHEN length(p) > 1 AND len(q) = 0 THEN regexp_replace(p, '/$', '') ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM t""")
def canonical_url(spark, sf):
    return table(spark, sf, "raw_jobs").where("applyUrl is not null").select("raw_id", urls.canonical(c("applyUrl")).alias("url"))


@query(f"""WITH t AS (SELECT raw_id, applyUrl u, regexp_extract(applyUrl, '^([^?#]*)', 1) b, regexp_extract(applyUrl, '(#.*)$', 1) f,
 list_filter(string_split(regexp_extract(applyUrl, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT (lower(string_split(x, '=')[1]) LIKE 'utm\\_%' ESCAPE '\\' OR lower(string_split(x, '=')[1]) IN ('{TRACK}'))) q FROM raw_jobs WHERE applyUrl IS NOT NULL)
SELECT raw_id, b || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || f AS url FROM t""")
def strip_tracking(spark, sf):
    return table(spark, sf, "raw_jobs").where("applyUrl is not null").select("raw_id", urls.strip_tracking(c("applyUrl")).alias("url"))


@query("""WITH t AS (SELECT id, string_split(regexp_replace(lower(regexp_extract(canonical_url, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '.') l FROM jobs)
SELECT id, CASE WHEN len(l) <= 2 THEN array_to_string(l, '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM t""")
def registrable_domain(spark, sf):
    return table(spark, sf, "jobs").select("id", urls.registrable_domain(c("canonical_url")).alias("domain"))


# Addresses and whether they are safe to follow.
GUARDED = (
    ("https://example.org/a", True), ("http://10.0.0.1/", False), ("http://172.20.3.4/x", False), ("http://8.8.8.8/", True), ("https://localhost/", False), ("ftp://example.org/", False),
    ("https://u:p@example.org/", False), ("https://example.org:8443/", False), ("https://example.org:443/", True), ("https://printer.local/", False), ("https://intranet/", False), ("not a url", False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {str(ok).lower()})" for u, ok in GUARDED) + ") t(url, ok)")
def ssrf_guard(spark, sf):
    rows = spark.createDataFrame([(u,) for u, _ in GUARDED], "url string")
    return rows.select("url", urls.is_public_http(c("url")).alias("ok"))


# Forms of addresses ({c} a company, {j} a job), with the system, job and company that they tell.
FORMS = (
    ("https://boards.greenhouse.io/{c}/jobs/{j}?gh_src=x", "Greenhouse", True, True), ("https://boards.greenhouse.io/embed/job_app?for={c}&gh_jid={j}", "Greenhouse", True, True), ("https://jobs.lever.co/{c}/{j}/apply", "Lever", True, True),
    ("https://{c}.wd5.myworkdayjobs.com/en-US/ext/job/Coder_JR-100{j}", "Workday", "JR-100", True), ("https://jobs.ashbyhq.com/{c}/{j}", "Ashby", True, True), ("https://jobs.smartrecruiters.com/{c}/{j}-coder", "SmartRecruiters", True, True),
    ("https://careers-{c}.icims.com/jobs/{j}/coder/job", "iCIMS", True, True), ("https://jobs.jobvite.com/{c}/job/{j}", "Jobvite", True, True), ("https://jobs.jobvite.com/{c}?j={j}", "Jobvite", True, True),
    ("https://{c}.bamboohr.com/careers/{j}", "BambooHR", True, True), ("https://{c}.bamboohr.com/view.php?id={j}", "BambooHR", True, True), ("https://{c}.fa.us2.oraclecloud.com/x/job/{j}/", "Oracle Recruiting", True, True),
    ("https://{c}.taleo.net/careersection/jobdetail.ftl?job={j}", "Oracle Recruiting", True, True), ("https://workforcenow.adp.com/x.html?cid={c}&jobId={j}", "ADP Recruiting", True, True),
    ("https://recruiting.ultipro.com/X1/{c}/JobBoard/b?opportunityId={j}", "UKG", True, True), ("https://recruiting.paylocity.com/Recruiting/Jobs/Details/{j}/x", "Paylocity", True, False),
    ("https://www.paycomonline.net/v4/ats/web.php/jobs?clientkey={c}&job={j}", "Paycom", True, True), ("https://apply.workable.com/{c}/j/{j}/", "Workable", True, True), ("https://{c}.applytojob.com/apply/x/{j}", "JazzHR", True, True),
    ("https://{c}.breezy.hr/p/{j}", "Breezy HR", True, True), ("https://ats.rippling.com/{c}/jobs/{j}", "Rippling", True, True), ("https://career4.successfactors.com/career?company={c}", "SuccessFactors", False, False),
    ("https://jobs.dayforcehcm.com/en/{c}/jobs/{j}", "Dayforce", True, True), ("https://{c}.recruitee.com/o/{j}", "Recruitee", True, True), ("https://careers.{c}.example/jobs/{j}", None, False, False),
)
_SQL_FORMS = ", ".join("(" + ", ".join([str(i), f"'{u}'", f"'{p}'" if p else "NULL", f"'{j}'" if isinstance(j, str) else "''" if j else "NULL", "''" if k else "NULL"]) + ")" for i, (u, p, j, k) in enumerate(FORMS))


@query(f"""WITH f(i, u, provider, j, k) AS (VALUES {_SQL_FORMS}), t AS (SELECT id, ((times_seen + ascii(right(id, 1))) % {len(FORMS)})::INT i, 'c' || (times_seen % 7)::VARCHAR co, (1000 + times_seen * 13)::VARCHAR no FROM jobs)
SELECT id, f.provider, f.j || no AS job_id, f.k || co AS company FROM t JOIN f USING (i)""")
def ats_detect(spark, sf):
    k = (c("times_seen") + F.ascii(F.right("id", F.lit(1)))) % len(FORMS)
    form = F.element_at(F.array(*[F.lit(u) for u, *_ in FORMS]), (k + 1).cast("int"))
    url = F.replace(F.replace(form, F.lit("{c}"), F.concat(F.lit("c"), (c("times_seen") % 7).cast("string"))), F.lit("{j}"), (1000 + c("times_seen") * 13).cast("string"))
    a = urls.detect_ats(c("url"))
    return table(spark, sf, "jobs").select("id", url.alias("url")).select("id", a["provider"].alias("provider"), a["job_id"].alias("job_id"), a["company"].alias("company"))


@query("""WITH t AS (SELECT id, lower(regexp_extract(apply_url, '^https?://([^/:?#]+)', 1)) h, regexp_extract(apply_url, '^https?://[^/?#]+([^?#]*)', 1) p FROM jobs WHERE apply_url IS NOT NULL)
SELECT id, regexp_matches(h, '(^|[.])(linkedin|dice|remoteok|remotive|jobicy|simplyhired|ziprecruiter|monster|careerbuilder|builtin|wellfound|flexjobs|weworkremotely|talent|lensa|jobgether|jobviewtrack)[.]com$|(^|[.])(jooble[.]org|jobbank[.]gc[.]ca|jobright[.]ai|himalayas[.]app)$|(^|[.])(careerjet|glassdoor|adzuna)[.][a-z.]+$') AS board,
regexp_matches(h, '(^|[.])(jobviewtrack[.]com|jooble[.]org)$') OR regexp_matches(p, '(?i)/(away|redirect|out|clk|click|rc/clk)($|[^a-z0-9_])') AS tracker, NOT board AND NOT tracker AS employer FROM t""")
def address_kinds(spark, sf):
    u = c("apply_url")
    return table(spark, sf, "jobs").where("apply_url is not null").select("id", urls.is_board(u).alias("board"), urls.is_tracker(u).alias("tracker"), urls.is_employer(u).alias("employer"))


@query("""SELECT raw_id, regexp_matches(lower(jobUrl), '^https?://(www\\.)?wrenboard\\.example') OR coalesce(regexp_matches(lower(applyUrl), '^https?://(www\\.)?wrenboard\\.example'), false) AS from_host FROM raw_jobs""")
def via_host(spark, sf):
    at = lambda x: urls.leads_to(c(x), r"^(www\.)?wrenboard\.example$")
    return table(spark, sf, "raw_jobs").select("raw_id", (at("jobUrl") | at("applyUrl")).alias("from_host"))


# -- listings


def sql_company(x: str) -> str:
    """The company key, spelled in the words of its definition."""
    name = f"regexp_replace({sql_match(f'coalesce({x}, {chr(39) * 2})')}, '\\((formerly|fka|f/k/a|a\\s+subsidiary|part\\s+of)[^)]*\\)', ' ', 'g')"
    name = f"replace(regexp_replace({name}, '\\b(dba|db/a|d/ba|d/b/a|doing business as)\\b.*$', ' '), '&', ' and ')"
    name = f"regexp_replace(regexp_replace({name}, '\\bhealth\\s+care\\b', 'healthcare', 'g'), '[^a-z0-9 ]+', ' ', 'g')"
    ends = "incorporated|inc|l ?l ?c|ltd|limited|corp|corporation|co|company|plc|lp|llp|pllc|p ?c|p ?a|gmbh|sa|ag|bv|nv|holdings?"
    name = f"regexp_replace(regexp_replace({name}, ' +', ' ', 'g'), '\\b({ends})\\b', ' ', 'g')"
    return sql_collapse(f"regexp_replace({name}, '^the ', '')")


def sql_title(x: str) -> str:
    """The title key, spelled in the words of its definition."""
    states = (
        "district of columbia|north carolina|south carolina|massachusetts|new hampshire|west virginia|north dakota|pennsylvania|rhode island|south dakota|puerto rico|connecticut|mississippi|california|"
        "new jersey|new mexico|washington|louisiana|minnesota|tennessee|wisconsin|delaware|arkansas|colorado|illinois|kentucky|maryland|michigan|missouri|nebraska|new york|oklahoma|virginia|alabama|arizona|"
        "florida|georgia|indiana|montana|vermont|wyoming|alaska|hawaii|kansas|nevada|oregon|idaho|maine|texas|iowa|ohio|utah|"
        "al|ak|az|ar|ca|co|ct|dc|de|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|pr|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy"
    )
    steps = [
        ("\\b(req|requisition|job) *(id|#|no\\.?|number)? *[:#] *[a-z]*[-_]?[0-9][a-z0-9_-]*", " "), ("\\b(req|jr|r)[-_]?[0-9]{4,}\\b", " "), ("# *[a-z0-9_]+", " "), ("[(\\[{][^)\\]}]*[)\\]}]", " "),
        (f" *[-|,:] *(remote *[-,]? *)?({states}) *$", " "), (f" *[-|,:] *(remote *[-,]? *)?({states}) *$", " "), ("&", " and "), ("\\bsr\\b", "senior"), ("\\bjr\\b", "junior"), ("\\bspec\\b", "specialist"),
        ("\\breps?\\b", "representative"), ("\\bcoord\\b", "coordinator"), ("\\bmgr\\b", "manager"), ("\\basst\\b", "assistant"), ("\\bassoc\\b", "associate"), ("\\badmin\\b", "administrator"),
        ("\\ba */ *r\\b", "accounts receivable"), ("\\brcm\\b", "revenue cycle management"), ("\\biv\\b", "4"), ("\\biii\\b", "3"), ("\\bii\\b", "2"), ("[^a-z0-9]+", " "),
        ("\\b(fully|full ?time|part ?time|remote|remotely|work from home|wfh|telecommute|telework|virtual|hybrid|on ?site|nationwide|anywhere|united states|usa|us|contract|temp|temporary|per diem|prn|"
         "days|nights|evenings|weekends?|shift|urgent|urgently|hiring|immediate|immediately|now|new)\\b", " "),
    ]
    x = sql_match(x)
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"regexp_replace({sql_collapse(x)}, '\\bi$', '1')"


@query(f"SELECT id, {sql_company('company')} AS company_k FROM jobs")
def company_key(spark, sf):
    return table(spark, sf, "jobs").select("id", listing.company_key(c("company")).alias("company_k"))


@query(f"SELECT id, {sql_title('title')} AS title_k FROM jobs")
def title_key(spark, sf):
    return table(spark, sf, "jobs").select("id", listing.title_key(c("title")).alias("title_k"))


@query(f"SELECT raw_id, length(lower(trim(coalesce(company, '')))) < 2 OR regexp_full_match(lower(trim(company)), '{listing.PLACEHOLDERS}') AS placeholder FROM raw_jobs")
def placeholder_company(spark, sf):
    return table(spark, sf, "raw_jobs").select("raw_id", listing.is_placeholder_company(c("company")).alias("placeholder"))


@query("""WITH t AS (SELECT raw_id, employmentType e, lower(trim(replace(employmentType, '_', ' '))) v FROM raw_jobs)
SELECT raw_id, CASE WHEN coalesce(v, '') = '' THEN NULL WHEN regexp_matches(v, 'full[ -]?time') THEN 'Full-time' WHEN regexp_matches(v, 'part[ -]?time') THEN 'Part-time'
 WHEN regexp_matches(v, 'contract|freelance|1099') THEN 'Contract' WHEN regexp_matches(v, 'intern') THEN 'Internship'
 WHEN regexp_matches(v, 'per +diem|prn') THEN 'Per diem' ELSE array_to_string(list_transform(string_split(trim(e), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS kind FROM t""")
def employment_type(spark, sf):
    return table(spark, sf, "raw_jobs").select("raw_id", listing.employment_type(c("employmentType")).alias("kind"))


@query("SELECT raw_id, CASE " + " ".join(f"WHEN lower(trim(salary.period)) IN ('{chr(39).join(k.split()).replace(chr(39), chr(39) + ', ' + chr(39))}') THEN '{p}'" for p, k in listing.PERIODS.items()) + " END AS period FROM raw_jobs")
def period_code(spark, sf):
    return table(spark, sf, "raw_jobs").select("raw_id", listing.period_code(c("salary.period")).alias("period"))


@query("""WITH t AS (SELECT raw_id, salary.min a, salary.max b, CASE WHEN salary.currency = 'USD' OR salary.currency IS NULL THEN '$' ELSE salary.currency || ' ' END s, salary.period p FROM raw_jobs),
f AS (SELECT *, regexp_replace(regexp_replace(format('{:,.2f}', a), '0+$', ''), '\\.$', '') fa, regexp_replace(regexp_replace(format('{:,.2f}', b), '0+$', ''), '\\.$', '') fb FROM t)
SELECT raw_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN s || fa || ' - ' || s || fb ELSE s || coalesce(fa, fb) END || coalesce(' per ' || p, '') END AS pay FROM f""")
def salary_format(spark, sf):
    s = c("salary")
    return table(spark, sf, "raw_jobs").select("raw_id", listing.format_pay(s["min"], s["max"], s["currency"], s["period"]).alias("pay"))


@query(f"SELECT id, greatest(floor(date_diff('millisecond', posted_at::TIMESTAMPTZ, '{NOW}'::TIMESTAMPTZ) / 3600000.0 * 10 + 0.5) / 10, 0.0) AS age FROM jobs WHERE posted_at IS NOT NULL")
def age_hours(spark, sf):
    jobs = table(spark, sf, "jobs").where("posted_at is not null")
    return jobs.select("id", listing.age_hours(F.to_timestamp("posted_at"), F.to_timestamp(F.lit(NOW))).alias("age"))


@query("SELECT event_id, CASE WHEN ceil(user_id / 24.0) <= 1 THEN 1 WHEN ceil(user_id / 24.0) <= 3 THEN 3 WHEN ceil(user_id / 24.0) <= 7 THEN 7 ELSE 30 END::INTEGER AS days FROM events")
def day_bucket(spark, sf):
    return table(spark, sf, "events").select("event_id", listing.day_bucket(c("user_id"), (1, 3, 7, 30)).alias("days"))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS cut FROM lineitem")
def round_half_up(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", listing.round_half_up(c("l_extendedprice") * c("l_discount")).alias("cut"))


_STATE_LIST = (
    "district of columbia|north carolina|south carolina|massachusetts|new hampshire|west virginia|north dakota|pennsylvania|rhode island|south dakota|puerto rico|connecticut|mississippi|california|"
    "new jersey|new mexico|washington|louisiana|minnesota|tennessee|wisconsin|delaware|arkansas|colorado|illinois|kentucky|maryland|michigan|missouri|nebraska|new york|oklahoma|virginia|alabama|arizona|"
    "florida|georgia|indiana|montana|vermont|wyoming|alaska|hawaii|kansas|nevada|oregon|idaho|maine|texas|iowa|ohio|utah"
)


@query(f"""WITH t AS (SELECT raw_id, regexp_extract_all(lower(coalesce(title, '')), '\\b({_STATE_LIST})\\b', 1) l FROM raw_jobs)
SELECT raw_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') AS states FROM t""")
def states_named(spark, sf):
    return table(spark, sf, "raw_jobs").select("raw_id", F.array_join(listing.states_named(F.coalesce("title", F.lit(""))), ";").alias("states"))


@query("""SELECT raw_id, regexp_matches(location, '(?i)\\bunited\\s+states(\\s+of\\s+america)?\\b|\\bu\\.\\s?s\\.\\s?a\\b|\\busa\\b|\\bu\\.\\s?s\\.($|[^a-z0-9_])|(^|[\\s,(/-])us($|[\\s,)/-])') AS us,
regexp_matches(location, '(?i)\\b(north\\s+america|americas|world\\s*wide|global|globally|international|any\\s+location|all\\s+countries)\\b') OR (regexp_matches(location, '(?i)\\banywhere\\b') AND NOT regexp_matches(location, '(?i)\\banywhere\\s+in\\b')) AS wide
FROM raw_jobs WHERE location IS NOT NULL""")
def country_named(spark, sf):
    return table(spark, sf, "raw_jobs").where("location is not null").select("raw_id", listing.names_country(c("location")).alias("us"), listing.names_wide_region(c("location")).alias("wide"))


@query()
def states_found(spark, sf):
    return table(spark, sf, "raw_jobs").select("raw_id", F.array_join(listing.states_found(F.coalesce("location", F.lit(""))), ";").alias("states"))


# -- rules

SIGNS = ("claim", "denial", "ledger", "payer", "audit", "coding", "billing")


@query("SELECT doc_id, (" + " + ".join(f"coalesce(regexp_matches(text, '{s}'), false)::INT" for s in SIGNS) + ")::BIGINT AS hits FROM documents")
def context_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.count_hits(c("text"), SIGNS).alias("hits"))


@query("""SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 40 THEN 'short' WHEN coalesce(lower(lang), '') <> 'en' THEN 'language' WHEN contains(text, 'endoftext') THEN 'marker' END AS code,
CASE WHEN coalesce(length(text), 0) < 40 THEN coalesce(length(text), 0)::VARCHAR WHEN coalesce(lower(lang), '') <> 'en' THEN coalesce(lang, '') WHEN contains(text, 'endoftext') THEN 'yes' END AS detail FROM documents""")
def reject_first_fail(spark, sf):
    size = F.coalesce(F.length("text"), F.lit(0))
    checks = [("short", size < 40, size), ("language", F.coalesce(F.lower("lang"), F.lit("")) != "en", F.coalesce("lang", F.lit(""))), ("marker", F.contains("text", F.lit("endoftext")), F.lit("yes"))]
    r = rules.first_reason(checks)
    return table(spark, sf, "documents").select("doc_id", r["code"].alias("code"), r["detail"].alias("detail"))


@query("""SELECT raw_id, concat_ws(';', CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' END, CASE WHEN company IS NULL THEN 'no_company' END, CASE WHEN applyUrl IS NULL THEN 'no_apply' END,
CASE WHEN coalesce(length(descriptionText), 0) < 40 THEN 'short' END) AS reasons FROM raw_jobs""")
def final_filter_reasons(spark, sf):
    empty = F.coalesce(F.trim("title"), F.lit("")) == ""
    checks = [("no_title", empty), ("no_company", c("company").isNull()), ("no_apply", c("applyUrl").isNull()), ("short", F.coalesce(F.length("descriptionText"), F.lit(0)) < 40)]
    return table(spark, sf, "raw_jobs").select("raw_id", F.array_join(rules.all_reasons(checks), ";").alias("reasons"))


@query("SELECT doc_id, (CASE WHEN regexp_matches(text, 'remote') THEN 3.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, 'hybrid') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, 'office') THEN 1.5 ELSE 0.0 END)::DOUBLE AS weight FROM documents")
def weighted_evidence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.evidence(c("text"), {"remote": 3, "hybrid": 2, "office": 1.5}).alias("weight"))
