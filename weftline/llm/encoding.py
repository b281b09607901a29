"""Repair of text that was decoded with a wrong character encoding.

Every distinct clean word of the corpus that holds a character beyond ASCII is put through all
encoding chains; the garbled forms make a table form -> word that the documents' words are
hash-joined with. A form counts only if the corpus backs it: a multi-byte form always (its shape
is not a word's), a one-byte form where its shape is less a word's than the clean word's is, however
often either is repeated; of two equally good shapes the one in at least twice as many distinct texts is clean.
Words of which the corpus has no clean copy are tried by undoing the same chains on their garbled
runs, and the one-byte chains where the word's shape shows it garbled. U+FFFD and C1 controls name a value as garbled whether or not it can be restored.

Null and empty texts are never affected; repeated rows give repeated keys one result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.stages import materialize

# Charsets that UTF-8 bytes get read in, and the pairs a one-byte text gets read in.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-15", "cp1254")
ONE_BYTE = (
    ("cp1252", "mac_roman"),
    ("cp1252", "cp850"),
    ("cp1252", "cp437"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
    ("mac_roman", "cp1252"),
    ("cp850", "cp1252"),
    ("cp437", "cp1252"),
)
WORD = r"[A-Za-z0-9]*+[^\x00-\x7F](?:[A-Za-z0-9]|[^\x00-\x7F])*+"
LOST = "\ufffd"
#: A one-byte form whose shape is as good as its word's must stand in fewer distinct texts by this factor.
RARER = 2


@lru_cache(None)
def charset(name: str) -> tuple[str, ...]:
    """The characters of the bytes 0..255; bytes without one are C1 controls, as browsers read them."""
    return tuple(bytes([i]).decode(name, "replace") if bytes([i]).decode(name, "replace") != LOST else chr(i) for i in range(256))


@lru_cache(None)
def _bytes_of(name: str) -> dict[str, int]:
    return {c: i for i, c in reversed(list(enumerate(charset(name))))}


def misread(raw: bytes, name: str) -> str:
    return "".join(map(charset(name).__getitem__, raw))


def as_bytes(text: str, name: str) -> bytes | None:
    try:
        return bytes(_bytes_of(name)[c] for c in text)
    except KeyError:
        return None


def garbled_forms(word: str) -> list[tuple[str, str]]:
    """(form, chain) of a word under every chain, and with case changed before or after."""
    out: dict[str, str] = {}
    for case, shown in (("", word), ("lower ", word.lower()), ("upper ", word.upper())):
        raw = shown.encode("utf-8", "replace")
        for name in UTF8_READ_AS:
            once = misread(raw, name)
            twice = misread(once.encode(), "cp1252")
            out.setdefault(once, f"utf8>{name}")
            out.setdefault(twice, f"utf8>{name}>utf8>cp1252")
            if not case:
                out.setdefault(once.lower(), f"lower utf8>{name}")
                out.setdefault(once.upper(), f"upper utf8>{name}")
                out.setdefault(misread(twice.encode(), "cp1252"), f"utf8>{name}>utf8>cp1252>utf8>cp1252")
        for a, b in ONE_BYTE:
            if (one := as_bytes(shown, a)) is not None:
                out.setdefault(misread(one, b), f"{a}>{b}")
        lost = re.sub(r"[^\x00-\x7f]", LOST, shown)
        out.setdefault(lost, "lost")
        out.setdefault(re.sub(f"{LOST}+", LOST, lost), "lost")
        utf_lost = "".join(c if c < "\x80" else LOST * len(c.encode("utf-8", "replace")) for c in shown)
        out.setdefault(utf_lost, "lost")
    out.pop(word, None)
    out.pop(word.lower(), None)
    out.pop(word.upper(), None)
    return [(f, c) for f, c in out.items() if not f.isascii()]


@lru_cache(None)
def _runs(name: str) -> re.Pattern:
    """Runs that UTF-8 sequences of two to four bytes make when read in a charset."""
    cs = charset(name)
    cls = lambda a, b: "[" + re.escape("".join(cs[a : b + 1])) + "]"
    tail = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xF0, 0xF4)}{tail}{{3}}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xC2, 0xDF)}{tail}")


def _common(text: str) -> bool:
    """Whether a decoded run is Latin letters, marks or usual punctuation, the only ones a run alone may prove."""
    return all("\xa0" <= c <= "ſ" or "‐" <= c <= "™" for c in text)


def undo(word: str) -> tuple[str, str] | None:
    """(original, chain) from a word's garbled runs, or None where no chain explains them; of several chains the one that explains most."""
    best: tuple[int, int, str, str] | None = None
    for rank, name in enumerate(UTF8_READ_AS):

        def back(m: re.Match, name: str = name) -> str:
            raw = as_bytes(m.group(), name)
            try:
                found = raw.decode() if raw else LOST
            except UnicodeDecodeError:
                return m.group()
            return found if found != LOST and (_common(found) or any("\x80" <= c <= "\x9f" for c in found)) else m.group()

        for shown in dict.fromkeys((word, word.replace("ã", "Ã") if re.search("ã[©¨±³¼¤¶º¡\xad´ª]", word) else word)):
            now, rounds = shown, 0
            while rounds < 3 and (then := _runs(name).sub(back, now)) != now:
                now, rounds = then, rounds + 1
            if rounds and not re.search("[\x80-\x9f]", now):
                found = (len(now), rank, now, f"utf8>{name}" + ">utf8>cp1252" * (rounds - 1))
                best = min(best, found) if best else found
    return best[2:] if best else None


# a sign within a word that no spelling has there, a capital letter beyond ASCII between small ones, or two scripts
_ODD = re.compile(r"(?<=[a-z])(?:[\x80-\x9f¡-©«-¬®-¶¸¹»-¿×÷‚„†‡‰‹›∂-⋿⌀-◿ﬁﬂ˙-˝¨´¸ƒ€](?=[a-z]|[^\x00-\x7f])|[À-ÖØ-ÞŽŠŸŒ](?=[a-z]|[^\x00-\x7f]|$))|[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z]")


def odd(word: str) -> int:
    """Places of a word that its shape shows garbled."""
    return len(_ODD.findall(word))


def undo_one_byte(word: str) -> tuple[str | None, str] | None:
    """(original, chain) of a word whose shape shows a one-byte misreading; the original is null where chains disagree."""
    # signs at the end, as of trade marks, prove nothing
    if not odd(re.sub(r"[^\w]+$", "", word)):
        return None
    found = {}
    for a, b in ONE_BYTE:
        raw = as_bytes(word, b)
        back = misread(raw, a) if raw else None
        # only small Latin letters with marks are taken on shape alone
        if back and all(c < "\x80" or "ß" <= c <= "ÿ" and c != "÷" for c in back):
            found.setdefault(back, f"{a}>{b}")
    if not found:
        return None
    return (next(iter(found)) if len(found) == 1 else None), next(iter(found.values()))


@F.pandas_udf(T.ArrayType(T.StructType().add("form", T.StringType()).add("chain", T.StringType()).add("worse", T.IntegerType())))
def _forms(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield pd.Series([[{"form": f, "chain": c, "worse": odd(f) - odd(w)} for f, c in garbled_forms(w)] for w in batch], dtype=object)


@F.pandas_udf(T.StructType().add("original", T.StringType()).add("chain", T.StringType()))
def _undone(words: pd.Series) -> pd.DataFrame:
    found = [undo(w) or undo_one_byte(w) or (None, None) for w in words]
    return pd.DataFrame({"original": [a for a, _ in found], "chain": [b for _, b in found]}, dtype=object)


def words_of(text: Column) -> Column:
    """A text's distinct words that hold a character beyond ASCII."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def occurring(values: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, __h (hash of the text), word: the words beyond ASCII of every value, as a table; the texts are gone through once."""
    return materialize(values.select(*keys, F.xxhash64(text).alias("__h"), F.explode(words_of(F.col(text))).alias("word")), "encoding-occurring")


def garbled_words(held: DataFrame) -> DataFrame:
    """The corpus' garbled words: word, original (null where it is lost), chain. held: as of occurring."""
    seen = materialize(held.groupBy("word").agg(F.count_distinct("__h").alias("n")), "encoding-words")
    marked = F.col("word").rlike("[\x80-\x9f�]")
    cores = max(2, held.sparkSession.sparkContext.defaultParallelism)
    table = (
        seen.where(~marked)
        .repartition(cores, "word")
        .select(F.col("word").alias("clean"), F.col("n").alias("n_clean"), F.explode(_forms("word")).alias("f"))
        .select("clean", "n_clean", F.col("f.form").alias("word"), F.col("f.chain").alias("chain"), F.col("f.worse").alias("worse"))
    )
    multi = F.col("chain").contains("utf8")
    # a sign alone that is usual by itself says nothing of a charset
    usual = F.col("word").rlike(r"^[0-9¡-©«-¹»-¿×÷‐-™]+$")
    hit = (
        table.join(seen, "word")
        .where(multi | (F.col("chain") == "lost") | (((F.col("worse") > 0) | (F.col("worse") == 0) & (F.col("n_clean") >= RARER * F.col("n"))) & ~usual))
        .groupBy("word")
        .agg(
            F.min_by(F.struct("clean", "chain"), F.struct((~multi).cast("int"), F.length("clean"), -F.col("n_clean"), "clean")).alias("best"),
            F.count_distinct(F.lower("clean")).alias("choices"),
        )
        .select(
            "word",
            F.when((F.col("best.chain") != "lost") | (F.col("choices") == 1), F.col("best.clean")).alias("original"),
            F.col("best.chain").alias("chain"),
        )
    )
    hit = materialize(hit, "encoding-hits")
    rest = (
        seen.join(hit, "word", "left_anti")
        .select("word", _undone("word").alias("u"), marked.alias("marked"))
        .where(F.col("u.chain").isNotNull() | F.col("marked"))
        .select("word", F.col("u.original").alias("original"), F.coalesce("u.chain", F.lit("lost")).alias("chain"))
    )
    return materialize(hit.unionByName(rest), "encoding-garbled")


def affected(values: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The distinct keys of values that hold a garbled word."""
    held = occurring(values, keys, text)
    return held.join(garbled_words(held), "word", "left_semi").select(*keys).distinct()


def restored(values: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Affected values with `restored`, the text with every known original put back, and whether all were known.

    A value is rebuilt from its own words: they are joined one by one, pre-aggregated into one map a value and
    substituted in place. Rows with the same key and text share one result.
    """
    held = occurring(values, keys, text)
    maps = (
        held.distinct()
        .join(garbled_words(held), "word")
        .groupBy(*keys, "__h")
        .agg(F.collect_list(F.struct("word", "original", "chain")).alias("__w"))
    )
    whole = rf"(?s){WORD}|[^\x80-\x{{10FFFF}}]+?(?={WORD}|\z)"
    joined = values.withColumn("__h", F.xxhash64(text)).join(maps, [*keys, "__h"])
    back = F.map_from_entries(F.transform("__w", lambda w: F.struct(w["word"], w["original"])))
    parts = F.regexp_extract_all(F.col(text), F.lit(whole), F.lit(0))
    return (
        joined.withColumn("__m", back)
        .select(
            *keys,
            F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(F.col("__m"), p), p)), "").alias("restored"),
            (~F.exists("__w", lambda w: w["original"].isNull())).alias("complete"),
            F.array_join(F.array_sort(F.array_distinct(F.transform("__w", lambda w: w["chain"]))), " ").alias("chains"),
        )
        .distinct()
    )
