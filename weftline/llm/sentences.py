r"""Sentence units of texts in many scripts, planned entirely as SQL expressions.

1. Mask: points that end nothing (in numbers, addresses, initials, abbreviations, ordinals, list
   markers) and end marks inside quotations become private-use placeholders, one character for one
   and one placeholder for each mark, so that offsets stay those of the text and marks can be put back.
2. Split: behind an end mark of the script, at blank lines, before list items and, in Thai, at blanks
   between Thai words. The places get a separator, then the text is split there.
3. Restore: the pieces' lengths give the offsets; a unit's text is its piece with the marks put back.

No pattern bounds the length of what it looks at: a quotation is whole however long it is, unless it
holds a blank line, which always ends a unit, and so are addresses and indents. Texts that hold a
placeholder already are cut by offsets instead of being put back. Null, empty and blank texts have no
units. The running offset is a window over the pieces of one row; a row is told from its repeats by a
row number, so repeated ids and texts are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Blanks, as the signs themselves and as members of a character class.
_BLANK_SIGNS = " \t\n\v\f\r\u00a0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\ufeff"
BLANKS = r"\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_IN_LINE = rf"[{BLANKS}&&[^\n]]"

# Abbreviations whose point never ends a sentence, whatever follows.
TITLES = (
    "Dr Dra Drs Sr Sra Srta Mr Mrs Ms Mme Mlle Prof St Ste Mt Ft Fr Hr Hrn Gen Gov Rep Sen Rev Hon Capt Lt Col Sgt "
    "vgl vs cf incl inkl zzgl bzw evtl ggf approx aprox env ca Avda Av Ave Ph z u d i.d e.g i.e p.ej"
).split()
# Abbreviations whose point ends nothing before a number or a roman numeral.
BEFORE_NUMBERS = (
    "No Nos Nr núm num Abs Art S p pp vol vols fig ch cap ext tel Tel Bd Kap Ziff art pág págs "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mär Mai Okt Dez janv févr avr juil ene abr ago dic"
).split()
# What follows a German ordinal.
ORDINAL_NOUNS = (
    "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember "
    "Quartal Stock Etage Jahrhundert Klasse Auflage Tag Woche Monat Jahr Mal"
).split()

_ENDS = r".!?…؟।॥۔"
_WIDE = r"。！？｡"
#: A placeholder for each end mark, the separator, and what stands for either in texts that hold one already.
_MASKS = "".join(chr(0xE000 + i) for i in range(len(_ENDS + _WIDE)))
POINT, CUT, OTHER = _MASKS[0], "\ue010", "\ue011"
_CLOSE = r"\"”“»’'›」』）)\]}"
_NOT_NEXT = r"\p{Ll},;:%/=&+)\]}»”」』、，"
_ITEM = rf"[ \t]*+(?:[•‣◦▪·*–—-]|\d{{1,3}}[.){POINT}])[ \t]"

#: What must stand behind and before a point for it to end nothing. All are tried in one pass over the text; what
#: stands before is looked up from behind the point, so that look-behinds are tried at points only.
_NO_END: list[str] = [
    # decimals, versions, times
    r"(?=\p{Nd})(?<=(?<![\p{L}\p{M}])\.)",
    # dotted abbreviations: the inner points, then initials
    r"(?=\p{L}\.)(?<=(?<![\p{L}\p{M}])\p{L}\.)",
    r"(?=\s*+\p{Lu})(?<=(?<![\p{L}\p{M}\p{N}.])\p{Lu}\.)",
    r"(?<=(?<![\p{L}\p{M}])د\.|डॉ\.|श्री\.|डा\.)",
    # abbreviations
    rf"(?<=(?<![\p{{L}}\p{{M}}])(?i:{'|'.join(x.replace('.', '[.]') for x in TITLES)})\.)",
    rf"(?=\s*+\p{{Nd}})(?<=(?<![\p{{L}}\p{{M}}])(?i:{'|'.join(BEFORE_NUMBERS)})\.)",
    rf"(?=\s++(?:{'|'.join(ORDINAL_NOUNS)}))(?<=(?<![\p{{L}}\p{{N}}])\p{{Nd}}{{1,2}}\.)",
]
_MASKED = rf"\.(?:{'|'.join(_NO_END)})"
#: Number of a list item, up to its point.
_NUMBERED = r"((?:\A|\n)[ \t]*+\d{1,3})\.(?=[ \t])"
#: Where an address begins; it reaches to the next blank.
_ADDRESS_AT = r"(?=https?://|(?<![A-Za-z0-9_])www\.)"
#: Signs of a mail address, and its borders.
_MAIL = r"[A-Za-z0-9_.+@\-]"
_MAIL_AT = rf"(?<!{_MAIL})(?={_MAIL})|(?<={_MAIL})(?!{_MAIL})"

#: (borders of quotations, whole quotation, signs of which the text must hold one). A text is taken apart at the
#: borders and its quotations alone are looked into.
_QUOTED: list[tuple[str, str, str]] = [
    (r"(?=[“«「『])|(?<=[”»」』])", r"(?s)\A(?:“[^“]++(?<=”)|«[^«]++(?<=»)|「[^「]++(?<=」)|『[^『]++(?<=』))\z", "“«「『"),
    (r"(?=„)|(?<=“)", r"(?s)\A„[^„]++(?<=“)\z", "„"),
    (r"(?=(?<=[\s(])\"(?=\S))|(?<=[.!?,]\")(?=\s)|(?<=\")(?=\z)", r"(?s)\A\"[^\"]+\"\z", '"'),
]
#: The last end marks of a quotation with its closing sign; the marks before them end nothing.
_LAST = rf"[{_ENDS}{_WIDE}]*+\s?[”“»」』\"]\z"

#: Behind these a unit ends. A run of marks is tried from its first mark only.
_CUT_BEHIND: list[str] = [
    # a mark, closing quotes, a blank, and what may begin a sentence
    rf"(?<![{_ENDS}])[{_ENDS}]++[{_CLOSE}]*+(?=[{BLANKS}]++(?:[^{BLANKS}{_NOT_NEXT}]|\p{{Ll}}+\p{{Lu}}))",
    # the blank is missing
    rf"(?<=[\p{{Ll}}\p{{N}}\p{{M}}\p{{Lo}})\]”\"»’\p{{So}}\p{{Cf}}])\.++[{_CLOSE}]*+(?=[\p{{Lu}}\p{{Lo}}¿¡“„«(∑\p{{So}}])",
    r"\.(?=\p{Lu}[\p{Ll} ’'])(?<=\p{Lu}\.)",
    r"(?<![!?؟।॥۔])[!?؟।॥۔][.!?؟।॥۔]*+(?![”“»\"」])[)\]]*+(?=[\p{Lu}\p{Lo}¿¡“„«(∑\p{So}])",
    # a closing quotation followed directly by a capital
    r"(?<![.!?])[.!?]++[”»\"](?=\p{Lu}\p{Ll})",
    # scripts with wide marks; behind a closing quotation the sentence goes on
    rf"(?<![{_WIDE}])[{_WIDE}]++[）)]*+(?![{_WIDE}{_CLOSE}])",
    rf"(?<![{_WIDE}])[{_WIDE}]++[」』”’]++(?=[{BLANKS}「『“])",
]
#: Before these a unit ends: a blank line, a list item, a blank between Thai words.
_CUT_BEFORE: list[str] = [
    rf"\n{_IN_LINE}*+\n[{BLANKS}]*+",
    rf"\n(?={_ITEM})",
    rf"(?<=[ก-๎])[{BLANKS}]++(?=[ก-๎])",
]


def _holds(x: Column, signs) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(s)) for s in signs])


def _taken_apart(borders: str, signs, inside):
    """A text that holds one of the signs, split at the borders, each piece changed, put together again."""
    return lambda x: F.when(_holds(x, signs), F.array_join(F.transform(F.split(x, borders, -1), inside), "")).otherwise(x)


def _masked_all(x: Column) -> Column:
    return F.translate(x, _ENDS + _WIDE, _MASKS)


def _address(piece: Column) -> Column:
    """The address that a piece begins with loses its marks, but for those at its end."""
    long = F.length(F.regexp_extract(piece, r"\A(?:https?://|www\.)\S*?(?=[.!?\"”»)]*+(?:\s|\z))", 0))
    return F.when(long > 0, F.concat(_masked_all(F.substr(piece, F.lit(1), long)), F.substr(piece, long + 1))).otherwise(piece)


def _mail(piece: Column) -> Column:
    long = F.length(F.regexp_extract(piece, r"\A[A-Za-z0-9_.+\-]+@[A-Za-z0-9_.\-]*[A-Za-z0-9_]", 0))
    return F.when(long > 0, F.concat(_masked_all(F.substr(piece, F.lit(1), long)), F.substr(piece, long + 1))).otherwise(piece)


def _quotation(whole: str):
    def inside(q: Column) -> Column:
        last = F.length(F.regexp_extract(q, _LAST, 0))
        held = F.length(q) - last
        return F.when(q.rlike(whole) & ~q.rlike(rf"\n{_IN_LINE}*+\n"), F.concat(_masked_all(F.substr(q, F.lit(1), held)), F.substr(q, held + 1))).otherwise(q)

    return inside


def masked(text: Column) -> Column:
    """The text with every mark that ends nothing replaced, character for character."""
    c = F.translate(text, _MASKS + CUT, OTHER * (len(_MASKS) + 1))
    steps = [
        _taken_apart(_ADDRESS_AT, ["://", "www."], _address),
        _taken_apart(_MAIL_AT, ["@"], _mail),
        lambda x: F.regexp_replace(F.regexp_replace(x, _MASKED, POINT), _NUMBERED, f"$1{POINT}"),
        *[_taken_apart(borders, signs, _quotation(whole)) for borders, whole, signs in _QUOTED],
    ]
    for step in steps:
        # a lambda binds the text once; a plain CASE would repeat the whole chain in each branch
        c = F.transform(F.array(c), step)[0]
    return c


def pieces(text: Column) -> Column:
    """The masked text split at the units' borders; put together again the pieces are the masked text."""
    c = F.regexp_replace(masked(text), f"(?=[{_ENDS}{_WIDE}])(?:{'|'.join(_CUT_BEHIND)})", f"$0{CUT}")
    return F.split(F.regexp_replace(c, "|".join(_CUT_BEFORE), f"{CUT}$0"), CUT, -1)


def _units(df: DataFrame, text: str, made: list[str], with_text: bool) -> DataFrame:
    keep = [c for c in df.columns if c not in (text, *made)]
    row, no, part, size, lead, tail, at, odd = "__row", "__no", "__part", "__size", "__lead", "__tail", "__at", "__odd"
    # the text itself comes along only where its marks can't be put back
    own = {odd: F.when(F.col(text).rlike(f"[{_MASKS}{CUT}{OTHER}]"), F.col(text))} if with_text else {}
    part_of = [part, odd] if with_text else []
    blanks = F.lit(_BLANK_SIGNS)
    cut = (
        df.where(F.length(F.col(text)) > 0)
        .withColumns({row: F.monotonically_increasing_id(), **own})
        .select(*keep, row, *own, F.posexplode(pieces(F.col(text))).alias(no, part))
        .select(
            *keep, row, no, *part_of, F.length(part).alias(size),
            (F.length(part) - F.length(F.ltrim(F.col(part), blanks))).alias(lead),
            (F.length(part) - F.length(F.rtrim(F.col(part), blanks))).alias(tail),
        )
    )
    before = Window.partitionBy(row).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    start, end = F.col(at) + F.col(lead), F.col(at) + F.col(size) - F.col(tail)
    spans = cut.withColumn(at, F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col(lead) < F.col(size))
    out = [*keep, start.cast("bigint").alias("start_char"), end.cast("bigint").alias("end_char")]
    if with_text:
        back = F.trim(F.translate(F.col(part), _MASKS, _ENDS + _WIDE), blanks)
        out.append(F.when(F.col(odd).isNull(), back).otherwise(F.substr(odd, (start + 1).cast("int"), (end - start).cast("int"))).alias("sentence"))
    return spans.select(*out)


def sentence_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df's rows once for each unit, without the text, with start_char and end_char (code points, end exclusive)."""
    return _units(df, text, ["start_char", "end_char"], False)


def sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """As sentence_spans, with the unit's own text in `sentence`."""
    return _units(df, text, ["start_char", "end_char", "sentence"], True)
