"""Reading of one time notation: absolute (an instant) or relative (seconds before the fetch)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names and abbreviations, by number.
MONTH_NAMES = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fév febrero",
    3: "march mar märz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aoû agosto ago",
    9: "september sept sep septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc diciembre dic",
}
MONTHS = {name: n for n, names in MONTH_NAMES.items() for name in names.split()}
# Zone abbreviations with a fixed offset in minutes, and those that follow a region's clock.
OFFSETS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "bst": 60, "west": 60, "eet": 120, "eest": 180, "ist": 330,
}
REGIONS = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}
# Seconds of a unit, and its names.
UNIT_NAMES = {
    1: "s sec secs second seconds sekunde sekunden seconde secondes segundo segundos secondi 秒 秒钟",
    60: "m min mins minute minutes minuten minuto minutos minuti 分 分钟 分鐘",
    3600: "h hr hrs hour hours std stunde stunden heure heures hora horas ore ora 時間 小时 小時",
    86400: "d day days tag tage tagen jour jours j día días dia dias giorno giorni dag dagen 日 天",
    604800: "w wk wks week weeks woche wochen semaine semaines sem semana semanas settimana settimane weken 週間 周",
    2592000: "mo mos month months monat monate monaten mois mes meses mese mesi maand maanden か月 ヶ月 个月",
    31536000: "y yr yrs year years jahr jahre jahren an ans année années año años anno anni jaar 年",
}
UNITS = {name: n for n, names in UNIT_NAMES.items() for name in names.split()}
# Phrases for today (12 h), yesterday (36 h) and just now.
PHRASES = (
    {x: 43200 for x in ("today", "heute", "aujourd'hui", "hoy", "oggi", "hoje", "vandaag", "今日", "本日", "今天")}
    | {x: 129600 for x in ("yesterday", "gestern", "hier", "ayer", "ieri", "ontem", "gisteren", "昨日", "昨天")}
    | {x: 0 for x in ("just now", "just posted", "moment ago", "moments ago", "few seconds ago", "now", "new", "gerade eben", "soeben", "à l'instant", "ahora mismo", "recién publicado", "たった今", "刚刚")}
)
ONES = {"a", "an", "one", "ein", "eine", "einem", "einer", "un", "une", "una", "uno"}

_month = "|".join(sorted(MONTHS, key=len, reverse=True))
_zone = r"(?P<zone>Z|[+-]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z_+-]+)+|[A-Za-z]{2,5})"
_time = rf"(?P<h>\d{{1,2}})[:h.](?P<mi>\d{{2}})(?::(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[ap]\.?m\b\.?)?(?:\s*uhr|\s*h)?(?:\s*{_zone})?"
_ISO = re.compile(rf"(?P<y>\d{{4}})[-/](?P<mo>\d{{1,2}})[-/](?P<d>\d{{1,2}})(?:(?:t|,?\s+){_time})?", re.I)
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:t?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:\.(?P<f>\d+))?(?P<zone>Z|[+-]\d{2}:?\d{2})?)?", re.I)
_NUMBERS = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[/.-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}})(?:,?\s+{_time})?", re.I)
_day = r"(?:[^\W\d]{2,12}\.?,?\s+)?"
_link = r"(?:,?\s+(?:à|um|at|a\s+las|alle|om)?\s*"
_DAY_FIRST = re.compile(rf"{_day}(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er|º)?[\s-]+(?:de\s+)?(?P<mon>{_month})\.?,?[\s-]+(?:de[l]?\s+)?(?P<y>\d{{4}}){_link}{_time})?", re.I)
_MONTH_FIRST = re.compile(rf"{_day}(?P<mon>{_month})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_link}{_time})?", re.I)
_SAID = re.compile(r"^(?:(?:re)?posted|active|updated|listed|publié|publicado|veröffentlicht|aktualisiert)\b\s*:?\s*(?:on\b|am\b|le\b|el\b)?\s*", re.I)
_unit = r"(?P<u>[^\W\d]+)\.?"
_n = r"(?:(?:about|over|more than|etwa|über|mehr als|environ|plus de|más de|unos)\s+)?(?P<n>\d+|" + "|".join(sorted(ONES, key=len, reverse=True)) + r")\s*\+?\s*"
_RELATIVE = [
    re.compile(rf"(?:vor|il y a|hace|há)\s+{_n}{_unit}"),
    re.compile(rf"{_n}{_unit}\s*(?:ago|fa|geleden|atrás)"),
    re.compile(rf"(?P<n>\d+)\s*\+?\s*{_unit}"),
    re.compile(r"(?P<n>\d+)\s*\+?\s*(?P<u>[^\W\d]+?)\s*前"),
]


@lru_cache(None)
def _region(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # not the name of a zone
        return None


def _zone_of(name: str | None, default: str | None):
    """A tzinfo, or None where the zone isn't known. Without a name the source's own zone holds."""
    if not name:
        return _region(default) if default else timezone.utc
    low = name.lower()
    if low in OFFSETS:
        return timezone(timedelta(minutes=OFFSETS[low]))
    if low in REGIONS:
        return _region(REGIONS[low])
    if m := re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", low):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return timezone(timedelta(minutes=minutes if m[1] == "+" else -minutes)) if minutes < 1440 else None
    return _region(name) if "/" in name else None


def _instant(y: int, mo: int, d: int, m: dict, default: str | None) -> int | None:
    """Microseconds since 1970. A date alone is noon UTC; of two equal wall-clock times the first holds."""
    try:
        if m.get("h") is None:
            return int(datetime(y, mo, d, 12, tzinfo=timezone.utc).timestamp()) * 1_000_000
        h, half = int(m["h"]), (m.get("ap") or "").lower().replace(".", "")
        if half:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + 12 * (half == "pm")
        zone = _zone_of(m.get("zone"), default)
        if zone is None:
            return None
        at = datetime(y, mo, d, h, int(m["mi"]), int(m.get("s") or 0), tzinfo=zone, fold=0)
        return int(at.timestamp()) * 1_000_000 + int(((m.get("f") or "") + "000000")[:6])
    except (ValueError, OverflowError):
        return None


def _clean(text: str) -> str:
    s = re.sub(r"[\s  ​]+", " ", text.replace("’", "'")).strip()
    return re.sub(r"\s*\([A-Za-z ]+\)$", "", s)


def absolute(text: str, zone: str | None = None, order: str | None = None) -> int | None:
    """Microseconds since 1970 of an absolute notation, else None."""
    s = _clean(text)
    if re.fullmatch(r"\d{9,13}(?:\.\d+)?|\d{16}", s):
        n = float(s)
        return int(s) if len(s) == 16 and "." not in s else int(round(n * 1_000_000)) if n < 1e12 else int(round(n * 1000))
    s = _SAID.sub("", s)
    for shape in (_ISO, _COMPACT):
        if m := shape.fullmatch(s):
            g = m.groupdict()
            return _instant(int(g["y"]), int(g["mo"]), int(g["d"]), g, zone)
    if m := _NUMBERS.fullmatch(s):
        g = m.groupdict()
        a, b = int(g["a"]), int(g["b"])
        mo, d = (a, b) if order == "mdy" else (b, a)
        if mo > 12:
            mo, d = d, mo
        return _instant(int(g["y"]), mo, d, g, zone)
    for shape in (_DAY_FIRST, _MONTH_FIRST):
        if m := shape.fullmatch(s):
            g = m.groupdict()
            return _instant(int(g["y"]), MONTHS[g["mon"].lower()], int(g["d"]), g, zone)
    return None


def relative(text: str) -> int | None:
    """Seconds before the fetch of a relative notation, else None."""
    s = _SAID.sub("", _clean(text).lower()).strip()
    if s in PHRASES:
        return PHRASES[s]
    for shape in _RELATIVE:
        if (m := shape.fullmatch(s)) and m["u"] in UNITS:
            return (1 if m["n"] in ONES else int(m["n"])) * UNITS[m["u"]]
    return None


def read_time(text: str | None, zone: str | None = None, order: str | None = None) -> tuple[int | None, int | None]:
    """(microseconds since 1970, seconds before the fetch), of which one at most is set."""
    if not text or not text.strip():
        return None, None
    at = absolute(text, zone, order)
    return (at, None) if at is not None else (None, relative(text))


# How far behind the fetch a time may lie to count as clock skew, in microseconds.
SKEW = 48 * 3600 * 1_000_000
EARLIEST = 946_684_800 * 1_000_000


def sure_absolute(text: str, fetched: int) -> tuple[int, str] | None:
    """(instant, confidence) of an absolute notation seen from its fetch: days are estimated, times a little ahead are the fetch's, others null."""
    at = absolute(text)
    if at is None or not EARLIEST <= at <= fetched + SKEW:
        return None
    return min(at, fetched), "estimated" if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()) else "exact"


def sure_relative(text: str, fetched: int) -> tuple[int, str] | None:
    """(instant, confidence) of a relative notation: exact where it counts seconds, minutes or hours in figures."""
    back = relative(text)
    if back is None:
        return None
    counted = any((m := shape.fullmatch(_SAID.sub("", _clean(text).lower()).strip())) and m["n"].isdigit() and UNITS.get(m["u"], 86400) <= 3600 for shape in _RELATIVE)
    return fetched - back * 1_000_000, "exact" if counted else "estimated"


def resolve_posted(value: str | None, text: str | None, fetched: int | None) -> tuple[int | None, str]:
    """The surer of a listing's time and its text: exact time, exact text, time, text, a time that stands in the text."""
    if fetched is None:
        return None, "unknown"
    told = sure_absolute(value, fetched) if value and value.strip() else None
    said = sure_relative(text, fetched) if text and text.strip() else None
    late = sure_absolute(text, fetched) if text and text.strip() and said is None else None
    for found in (told if told and told[1] == "exact" else None, said if said and said[1] == "exact" else None, told, said, late):
        if found:
            return found
    return None, "unknown"
