"""Text expressions: Column in, Column out. What Spark has no built-in for runs in Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blanks beyond ASCII, as members of a character class.
WS = r"\s\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Words without weight in a keyword.
STOP_WORDS = ("and", "or", "the", "of", "for", "in", "a", "an", "to", "with")
# Named entities that are decoded; others stay.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "hellip": "…", "bull": "•",
}
# Tags that end a line.
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote"
# Fixed values: (label, pattern, least status, second pattern) of pages that refuse a client; the first that fits counts.
REFUSALS = (
    ("DataDome CAPTCHA", r"(?i)captcha-delivery\.com|datadome", 400, None),
    ("Cloudflare managed challenge", r"(?i)<title>\s*Just a moment\.\.\.\s*</title>", 0, None),
    ("Cloudflare block page", r"(?i)<title>\s*Attention Required! \| Cloudflare\s*</title>", 0, None),
    ("Cloudflare Turnstile challenge", r"(?i)challenges\.cloudflare\.com/turnstile|turnstileLoad\s*=", 0, None),
    ("PerimeterX CAPTCHA", r"(?i)px-captcha|perimeterx", 400, None),
    ("Glassdoor security check", r"(?i)<title>\s*Security \| Glassdoor\s*</title>", 0, None),
    ("Indeed security check", r"(?i)<title[^>]*>\s*Security Check - Indeed\.com\s*</title>", 0, None),
    ("JobRight security check", r"(?i)<title[^>]*>\s*Security check \| Jobright\s*</title>", 0, None),
    ("Akamai edge block (Access Denied)", r"(?i)<title>\s*Access Denied\s*</title>", 0, r"(?i)edgesuite(\.|&#46;)net"),
)
# Parameters of an address that are secret, and an address that holds its key in the path.
SECRET_PARAMS = "api_key apikey key token access_token affid password secret".split()
KEY_IN_PATH = r"(?i)(jooble\.org/api/)[^/?\s\"']+"
#: Longest part of a text that the page and keyword checks look at, as the semantics ask for.
HEAD = 20_000


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def sha1_id(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, length)


@F.pandas_udf(T.StringType())
def _without_accents(s: pd.Series) -> pd.Series:
    strip = lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not "\u0300" <= c <= "\u036f")
    return s.map(strip)


def norm_match(c: Column) -> Column:
    """Lower case, no accents, straight quotes, hyphens for dashes, single blanks."""
    s = F.lower(_without_accents(c))
    s = F.translate(s, "’‘`–—", "'''--")
    return collapse_ws(s)


def ascii_words(c: Column) -> Column:
    """The [a-z0-9] words of a text already in match form, in order."""
    return F.filter(F.split(F.regexp_replace(c, "[^a-z0-9 ]+", " "), " "), lambda w: w != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(ascii_words(norm_match(c)), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def shingles(c: Column, size: int = 3, most: int = 600) -> Column:
    """Distinct runs of words; of the first `most` words, which is part of the measure's definition."""

    def runs(w: Column) -> Column:
        beside = F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.greatest(F.size(w) - size + 1, F.lit(0))).alias(f"w{i}") for i in range(size)])
        return F.array_distinct(F.transform(beside, lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(size)])))

    # bound by a lambda, the words are made once, not once for each place that they shift to
    return F.transform(F.array(F.slice(ascii_words(norm_match(c)), 1, most)), lambda w: runs(w))[0]


def keyword_tokens(keyword: str) -> list[str]:
    s = "".join(c for c in unicodedata.normalize("NFKD", keyword) if not "\u0300" <= c <= "\u036f").lower()
    return [w for w in re.split(r"[^a-z0-9]+", s) if len(w) > 1 and w not in STOP_WORDS]


def loose_keyword(keyword: str, *fields: Column) -> Column:
    """Whether every weighty token of the keyword begins a word of the fields."""
    hay = F.substring(norm_match(F.concat_ws(" ", *fields)), 1, HEAD)
    found = F.lit(True)
    for t in keyword_tokens(keyword):
        found = found & hay.rlike(rf"(?<![a-z0-9_]){re.escape(t)}")
    return found


def generic_match(term: str, title: Column, description: Column) -> Column:
    """0.9 the phrase in the title, 0.75 all tokens there, 0.55 the phrase in the description and a token in the title, else 0."""
    t, d = norm_match(F.coalesce(title, F.lit(""))), norm_match(F.coalesce(description, F.lit("")))
    tokens = keyword_tokens(term)
    phrase = rf"(?<![a-z0-9_]){r'\s+'.join(map(re.escape, term.lower().split()))}(?![a-z0-9_])"
    has = [t.rlike(rf"(?<![a-z0-9_]){re.escape(x)}(?![a-z0-9_])") for x in tokens]
    every, some = F.lit(bool(tokens)), F.lit(False)
    for h in has:
        every, some = every & h, some | h
    return F.when(t.rlike(phrase), 0.9).when(every, 0.75).when(d.rlike(phrase) & some, 0.55).otherwise(0.0)


def split_sentences(c: Column) -> Column:
    """Pieces after . ! ? with a blank behind, or at line breaks; without blank ones."""
    return F.filter(F.split(c, rf"(?<=[.!?])[{WS}]+|\n+", -1), lambda s: F.trim(s) != "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def dedupe_terms(terms: Column) -> Column:
    """Terms trimmed and collapsed, the first of those equal but for case; blank ones left out."""
    clean = F.filter(F.transform(terms, collapse_ws), lambda t: t != "")
    return F.filter(clean, lambda t, i: ~F.exists(F.slice(clean, F.lit(1), i), lambda o: F.lower(o) == F.lower(t)))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _entity(m: re.Match) -> str:
    code = m.group(1)
    if code[0] != "#":
        return ENTITIES.get(code.lower(), m.group())
    try:
        return chr(int(code[2:], 16) if code[1] in "xX" else int(code[1:]))
    except (ValueError, OverflowError):
        return m.group()


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """Named and numeric entities decoded in one pass, unknown ones kept."""
    return s.map(lambda x: None if x is None else re.sub(r"(?i)&(#x[0-9a-f]+|#\d+|[a-z]+);", _entity, x))


def html_to_text(c: Column) -> Column:
    """Readable text of a page: list items as bullets, a line for each block, no scripts, entities decoded."""
    tags, hidden = c.rlike("(?i)<[a-z]"), c.rlike("(?i)&lt;[a-z]")
    s = F.when(~tags & hidden, decode_entities(c)).otherwise(c)
    s = F.regexp_replace(s, r"(?is)<(script|style|noscript).*?</\1>", " ")
    s = F.regexp_replace(s, r"(?i)<li\b[^>]*>", "\n• ")
    s = F.regexp_replace(s, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    s = decode_entities(F.regexp_replace(s, "<[^>]+>", " "))
    lines = F.transform(F.split(s, "\n", -1), collapse_ws)
    squeezed = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.coalesce(F.regexp_replace(squeezed, rf"^[{WS}]+|[{WS}]+\z", ""), F.lit(""))


def refusal(body: Column, status: Column, mitigated: Column | None = None) -> Column:
    """Label of the first sign that a page refuses the client, else null. mitigated: the answer's header of that name."""
    head = F.coalesce(F.substring(body, 1, HEAD), F.lit(""))
    said = [F.when(mitigated == "challenge", F.lit("Cloudflare challenge (cf-mitigated)"))] if mitigated is not None else []
    for label, pattern, least, second in REFUSALS:
        fits = head.rlike(pattern) & (F.coalesce(status, F.lit(0)) >= least)
        said.append(F.when(fits & head.rlike(second) if second else fits, F.lit(label)))
    return F.coalesce(*said, F.when(status == 999, F.lit("Request denied by anti-bot system (HTTP 999)")))


def redact(c: Column) -> Column:
    """Secrets out of a log line: a key in a path, secret parameters, credentials before a host."""
    c = F.regexp_replace(c, KEY_IN_PATH, "$1***")
    c = F.regexp_replace(c, rf"(?i)([?&](?:{'|'.join(SECRET_PARAMS)})=)[^&\s\"']+", "$1***")
    return F.regexp_replace(c, r"(?i)(\b[a-z][a-z0-9+.-]*://)[^/@\s:]+:[^/@\s]+@", "$1***:***@")


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds to wait: seconds, or an HTTP date against now; never below 0, null if neither."""
    seconds = F.expr("NULL") if value is None else F.when(value.rlike(r"^\s*\d+(\.\d+)?\s*$"), value.cast("double") * 1000)
    date = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.greatest(F.coalesce(seconds, (F.unix_millis(date) - F.unix_millis(now)).cast("double")), F.lit(0.0))


def csv_cell(c: Column, kind: str = "string", most: int = 32_000) -> Column:
    """A field of a spreadsheet file: '' for null, lists joined, structs as JSON, formulas disarmed, quoted where needed."""
    s = F.array_join(c, "; ") if kind.startswith("array<string") else F.to_json(c) if kind.startswith(("struct", "array", "map")) else c.cast("string")
    s = F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)
    s = F.when(s.rlike(r"^[=+@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    s = F.when(s.rlike(r"[\",\n\r]"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
    return F.coalesce(s, F.lit(""))


def unescape(text: str) -> str:
    return html.unescape(text)
