"""Reading of one statement of pay: bounds, currency and period as stated, nothing guessed from size."""

from __future__ import annotations

import re

# Signs and codes of currencies; a bare dollar sign is the US dollar.
CURRENCY_SIGNS = {
    "CAD": ("CA$", "C$", "CAD", "CDN$"),
    "AUD": ("AU$", "A$", "AUD"),
    "USD": ("US$", "USD", "$"),
    "GBP": ("£", "GBP"),
    "EUR": ("€", "EUR", "euros", "euro"),
    "INR": ("₹", "INR", "Rs.", "Rs"),
}
_SIGNS = {s.lower(): code for code, signs in CURRENCY_SIGNS.items() for s in signs}
# Words for a period of pay.
PERIOD_WORDS = {
    "hour": r"(?:per|an|each|/|p\.?|pro|por|la|par)\s*(?:hours?|hrs?|h|stunde|std|hora|heure)\b\.?|de\s*l['’]\s*heure|à\s*l['’]\s*heure|hourly|\bp\.?h\b|stündlich",
    "day": r"(?:per|a|each|/|pro|am|por|al|par)\s*(?:day|tag|día|dia|jour)\b|daily|täglich|\bp\.d\.|diarios?",
    "week": r"(?:per|a|each|/|pro|in\s+der|die|por|a\s+la|la|par)\s*(?:week|wk|woche|semana|semaine)\b|weekly|wöchentlich|\bp\.?w\b|hebdomadaire|semanal(?:es)?",
    "month": r"(?:per|a|each|/|pro|im|por|al|par)\s*(?:months?|mo|monat|mes|mois)\b|monthly|monatlich|\bp\.?c?\.?m\b|mensual(?:es)?|mensuels?",
    "year": r"(?:per|a|an|each|/|pro|im|por|al|par)\s*(?:years?|yr|y|jahr|año|an|année|annum)\b|annually|annual(?:es)?|yearly|jährlich|\bp\.?\s?a\b\.?|annuels?|anual(?:es)?|\blpa\b",
}
_PERIODS = {k: re.compile(v, re.I) for k, v in PERIOD_WORDS.items()}
# Codes of a period in structured pay.
PERIOD_CODES = {
    "hour": "h hr hour hourly per_hour",
    "day": "d day daily per_day",
    "week": "w wk week weekly per_week",
    "month": "m mo month monthly per_month",
    "year": "a y yr year yearly annual annually annum per_annum per_year p.a.",
}
_CODES = {c: k for k, codes in PERIOD_CODES.items() for c in codes.split()}
# Words that leave the lower or the upper bound open.
UP_TO = r"(?:up\s+to|max(?:imum|\.)?|no\s+more\s+than|under|jusqu['’]\s?à|hasta|bis(?:\s+zu)?|maximal|máximo|höchstens)"
FROM = r"(?:from|at\s+least|start(?:s|ing)\s+(?:at|from)|min(?:imum|\.)?|à\s+partir\s+de|dès|au\s+moins|desde|a\s+partir\s+de|mínimo|ab|mindestens)"
# What is paid or counted beside the pay.
BESIDE = r"bonus(?:es)?|stipend|sign-?on|signing|allowance|equity|commission|differential|401\s?\(?k|match(?:ing)?|prime|prima|zulage|relocation|reimburse\w*|incentive|pto|leave|benefits?|experience"
COUNTED = r"(?:days?|hours?|hrs|years?|yrs|weeks?|months?|tage|stunden|wochen|jahre|jours|heures|semaines|ans|días|horas|semanas|años|meses|shifts?|openings?|positions?)\b"

_cur = "|".join(re.escape(s) for s in sorted(_SIGNS, key=len, reverse=True))
_num = r"\d{1,3}(?:[    ]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d[\d.,'’]*\d|\d"
_scale = r"(?:k\b|lakhs?\b|lacs?\b|lpa\b|crores?\b|cr\b|mn?\b|million\b)"
_AMOUNT = re.compile(rf"(?P<c1>{_cur})?\s*(?<![\d.,])(?P<n>{_num})\s*(?P<s>{_scale})?\s*(?P<pct>%)?(?P<paren>\s?\()?\s*(?:(?P<c2>{_cur})(?![A-Za-z]))?", re.I)
_BETWEEN = re.compile(r"\s*(?:[-–—‐‑−~]|\bto\b|\bà\b|\ba\b|\bbis\b|\band\b|\bund\b|\by\b|\bet\b)\s*", re.I)
_SPLIT = re.compile(r"[;()|\n]|\s\+|\+\s|\bplus\b|,\s+(?!\d{3}\b)", re.I)
_SCALES = {"k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "lpa": 1e5, "crore": 1e7, "crores": 1e7, "cr": 1e7, "m": 1e6, "mn": 1e6, "million": 1e6}


def number(text: str) -> float | None:
    """A number with either mark as point, thousands grouped by blanks, commas, points or apostrophes, also in Indian groups."""
    s = re.sub(r"[\s  '’]", "", text).strip(".,")
    comma, point = s.rfind(","), s.rfind(".")
    if comma >= 0 and point >= 0:
        s = s.replace(",", "") if point > comma else s.replace(".", "").replace(",", ".")
    elif comma >= 0:
        s = s.replace(",", "") if re.fullmatch(r"\d{1,3}(?:,\d{2,3})*,\d{3}", s) else s.replace(",", ".")
    elif re.fullmatch(r"\d{1,3}(?:\.\d{3})+", s):
        s = s.replace(".", "")
    try:
        return float(s)
    except ValueError:
        return None


def _amounts(part: str) -> tuple[list[float], str | None, int] | None:
    """The first amount of a part, or a range; the currency beside it; where the amounts begin."""
    at = 0
    while m := _AMOUNT.search(part, at):
        at = m.end()
        rest = part[m.end() :]
        beside = m["pct"] or m["paren"] and re.match(r"k", rest, re.I) or not (m["c1"] or m["c2"]) and re.match(rf"\s*\+?\s*(?:{COUNTED})", rest, re.I)
        if beside:
            continue
        got = [m]
        if (b := _BETWEEN.match(part, m.end() if not m["paren"] else m.end("s"))) and (second := _AMOUNT.match(part, b.end())) and not second["pct"]:
            got.append(second)
        values = [number(x["n"]) for x in got]
        scales = [_SCALES.get((x["s"] or "").lower(), 1.0) for x in got]
        if None in values:
            continue
        if len(got) == 2 and 1.0 in scales:
            # a scale behind one bound holds for both, unless the other is written out
            other = scales.index(1.0)
            if max(scales) > 1 and values[other] < 1000:
                scales[other] = max(scales)
        money = next((s for x in got for s in (x["c1"], x["c2"]) if s), None)
        return [round(v * s, 6) for v, s in zip(values, scales)], _SIGNS[money.lower()] if money else None, m.start()
    return None


def read_pay(text: str | None) -> tuple[float | None, float | None, str | None, str | None] | None:
    """(low, high, currency, period) of a statement; None if it states no amount of pay. An open bound is None."""
    if not text or not re.search(r"\d", text):
        return None
    for part in _SPLIT.split(re.sub(r"401\s?\(?k\)?", ";", text, flags=re.I)):
        if not re.search(r"\d", part) or re.search(BESIDE, part, re.I):
            continue
        found = _amounts(part)
        if not found:
            continue
        values, money, start = found
        period = next((k for k, p in _PERIODS.items() if p.search(part)), None)
        if money is None and (m := re.search(rf"(?<![A-Za-z])(?:{_cur})(?![A-Za-z])", part, re.I)):
            money = _SIGNS[m.group().lower()]
        low, high = values[0], values[-1]
        if len(values) == 1:
            if re.search(rf"(?<!\w){UP_TO}\W*$", part[:start], re.I):
                low = None
            elif re.search(rf"(?<!\w){FROM}\W*$", part[:start], re.I) or re.match(r"[\d.,]+\s*k?\s*\+", part[start:].lstrip("$£€₹ "), re.I):
                high = None
        return low, high, money, period
    return None


def currency_code(text: str | None) -> str | None:
    return _SIGNS.get(text.strip().lower()) if text else None


def period_code(text: str | None) -> str | None:
    return _CODES.get(re.sub(r"[\s-]+", "_", text.strip().lower())) if text else None


# Amounts that tell their period, where a listing states none.
SIZES = {"hour": (10, 250), "year": (15_000, 1_000_000)}


def listing_pay(text: str | None) -> tuple[float | None, float | None, str | None, str | None] | None:
    """As read_pay, for showing a listing: a period that isn't stated is told from the amount, where that is plain."""
    found = read_pay(text)
    if found is None:
        return None
    low, high, money, period = found
    top = high if high is not None else low
    return low, high, money, period or next((k for k, (a, b) in SIZES.items() if top is not None and a <= top <= b), None)
