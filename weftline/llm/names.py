"""Variant spellings of organisations attributed through a noisy channel.

Every distinct spelling is a noisy copy of some canonical form. Candidate forms are the register's names
and, beside them, frequent spellings that no register entry explains (their form_id is null). A spelling goes to
the form of the greatest posterior: log prior (how often the form is written as it stands) minus the cost of the
edits that lead from the form to the spelling: typos, abbreviations, initials, nicknames, reordering,
glued or broken words, legal endings, trade names, wrong decoding.

A form is told by its rare words (common ones are learned from the forms). A spelling is a candidate for a form if
one of its words, or two neighbours written as one, tells a rare word of the form (`tells`), or if it is the whole
form but for two edits. Both are found by hash joins of keys that every such pair has in common: what is left of a
word without as many letters as edits are allowed, its beginnings and its consonants; of whole names the fifth that
two edits leave intact. So no pair that the channel accepts is missed, and no spelling meets all forms.

Frequencies count in relation to the median form only, so repeating all rows changes nothing. Null, blank and
placeholder spellings name nobody. Counting is by distinct spelling, so that a name that fills a third of all rows
is one row here.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.encoding import undo
from weftline.plans.stages import materialize, sent_if_small

# Endings and additions that are no part of a name.
LEGAL = "inc incorporated llc l.l.c ltd limited corp corporation pllc plc lp llp gmbh sa holdings holding usa us careers career jobs hiring remote pc".split()
TRADING_AS = r"(?:\bdoing\s+business\s+as\b|\bd\s*/\s*b\s*/\s*a\b|\bd\.b\.a\.|\bdba\b|\btrading\s+as\b|\bt/a\b|\baka\b|\ba/k/a\b)"
FORMERLY = r"\((?:formerly|previously|ex)\b[^)]*\)|\b(?:formerly|previously known as)\b.*$"
# Placeholders for no company.
PLACEHOLDERS = {"", "na", "none", "null", "unknown", "confidential", "undisclosed", "hiringcompany", "companyconfidential", "private", "anonymous", "notdisclosed", "tbd", "various", "employer"}
# Short forms of words of names; any other short form must keep the first letter and the order of letters.
SHORT_FORMS = {"st": "saint", "mt": "mount", "ft": "fort", "intl": "international", "centre": "center", "ctr": "center", "mgmt": "management", "co": "company", "grp": "group", "dept": "department"}
# Nicknames of first names.
NICKNAMES = {
    "elizabeth": "beth liz lizzie betty eliza liza lisa", "margaret": "maggie peggy meg marge", "robert": "bob rob bobby robbie", "william": "bill will billy liam",
    "richard": "rick dick rich ricky", "frederick": "fred freddie freddy", "alexander": "alex sandy al lex", "susannah": "sue susan susie suzy", "katherine": "kate kathy katie kit kath",
    "theodore": "ted theo teddy", "edward": "ed ned eddie ted", "josephine": "jo josie", "james": "jim jimmy", "john": "jack johnny", "michael": "mike mick", "thomas": "tom tommy",
    "charles": "charlie chuck", "joseph": "joe joey", "david": "dave", "daniel": "dan danny", "samuel": "sam", "benjamin": "ben", "christopher": "chris", "anthony": "tony",
    "patricia": "pat patty trish", "jennifer": "jen jenny", "deborah": "deb debbie", "barbara": "barb", "dorothy": "dot dottie", "rebecca": "becky", "victoria": "vicky tori",
}
_NICK = {n: full for full, all_ in NICKNAMES.items() for n in all_.split()}
_NICK_PAIRS = {(n, full) for full, all_ in NICKNAMES.items() for n in all_.split()}

# Costs, as negative logarithms of the channel's probabilities.
TYPO, SHORT, INITIAL, NICK, ACRONYM, MISSING, EXTRA, MOVED = 2.2, 1.0, 1.6, 1.0, 1.5, 7.0, 5.0, 0.6
#: A spelling goes to nobody beyond this cost, nor where the second form lies within MARGIN.
MOST, MARGIN = 6.9, 0.7
#: A spelling that needs a typo to fit a form is a form of its own if it is written more than OWN_SHARE times as often
#: as the form, or as FLOOR times the median form where the form is written less.
OWN_SHARE, FLOOR = 1 / 3, 4.0
#: A spelling that no register entry explains is a form if it is written more often than this times the median form.
FREQUENT = 1.0
#: A word in more than this many forms, or this share of them, is common.
COMMON_FORMS, COMMON_SHARE = 5, 0.01


def plain(text: str) -> str:
    """Lower case without accents, with wrong decoding undone."""
    fixed = undo(text)
    s = unicodedata.normalize("NFKD", fixed[0] if fixed else text)
    s = "".join(c for c in s if not unicodedata.combining(c)).lower()
    return s.replace("’", "'").replace("ß", "ss")


@lru_cache(100_000)
def words(text: str) -> tuple[str, ...]:
    """A name's words in order: the part that trades, without legal endings, additions and a leading article."""
    s = re.sub(FORMERLY, " ", plain(text))
    s = re.split(TRADING_AS, s)[-1]
    s = re.sub(r"\((?:remote|hybrid|onsite|us|usa|careers|hiring)\)", " ", s)
    s = s.replace("&", " ").replace("'", "").replace("l.l.c", "llc")
    s = re.sub(r"(?<=\w)-(?=\w)", "", s)
    out = [w for w in re.sub(r"[^\w]+|_", " ", s).split() if w != "and"]
    while len(out) > 1 and out[-1] in LEGAL:
        out.pop()
    if len(out) > 1 and out[0] == "the":
        out.pop(0)
    return tuple(out)


@lru_cache(200_000)
def distance(a: str, b: str, most: int) -> int:
    """Edits (one letter in, out, other, or two swapped) between two words; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


def _allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def _shortened(short: str, word: str) -> bool:
    if SHORT_FORMS.get(short) == word:
        return True
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in short) or short[-1] == "s" and word[-1] == "s" and _shortened(short[:-1], word)


@lru_cache(200_000)
def word_cost(said: str, meant: str) -> float:
    """Cost of one word for another; MISSING and more where they have nothing in common."""
    if said == meant:
        return 0.0
    if (said, meant) in _NICK_PAIRS:
        return NICK
    if len(said) == 1:
        return INITIAL if meant[0] == said else 99.0
    d = distance(said, meant, max(1, _allowed(meant)))
    if d <= _allowed(meant) or d == 1 and len(meant) >= 4 and len(said) >= 3:
        near = TYPO * d
    else:
        near = 99.0
    # spelling of the other side of the ocean, plurals
    if said.replace("ae", "e").replace("centre", "center") == meant.replace("ae", "e").replace("centre", "center"):
        near = min(near, 0.5)
    return min(near, SHORT if _shortened(said, meant) else 99.0)


def skeleton(word: str) -> str:
    """A word's first letter and consonants, double ones as one."""
    out = word[:1]
    for x in word[1:]:
        if x not in "aeiouy" and x != out[-1]:
            out += x
    return out


@lru_cache(200_000)
def tells(said: str, meant: str) -> bool:
    """Whether a word alone is reason to think of another: equal, nickname, few edits, a beginning, or the consonants."""
    if len(said) < 2:
        return False
    if said == meant or (said, meant) in _NICK_PAIRS or SHORT_FORMS.get(said) == meant:
        return True
    if len(said) >= 3 and (meant.startswith(said) or len(said) < len(meant) and skeleton(meant) in (said, skeleton(said), said.removesuffix("s"))):
        return True
    allowed = _allowed(meant)
    return allowed > 0 and len(said) >= 3 and distance(said, meant, allowed) <= allowed


def beginnings(word: str) -> list[str]:
    """Keys of a word's short forms; a said word has itself and its skeleton as such keys."""
    return [*(word[:k] for k in range(3, len(word))), *([skeleton(word)] if len(skeleton(word)) >= 3 else [])]


def _align(said: Sequence[str], meant: Sequence[str], rare: set[str]) -> float:
    """Cost of the assignment of the words found greedily from the surest pair on."""
    pairs = sorted((word_cost(s, m), abs(i - j), i, j) for i, s in enumerate(said) for j, m in enumerate(meant))
    used_s: dict[int, int] = {}
    used_m: set[int] = set()
    cost = 0.0
    for c, _, i, j in pairs:
        if c < 50 and i not in used_s and j not in used_m:
            used_s[i] = j
            used_m.add(j)
            cost += c
    left_s = [i for i in range(len(said)) if i not in used_s]
    left_m = [j for j in range(len(meant)) if j not in used_m]
    order = [used_s[i] for i in sorted(used_s)]
    if order != sorted(order):
        cost += MOVED
    for j in left_m:
        cost += 99.0 if meant[j] in rare else MISSING
    for i in left_s:
        cost += 0.3 if said[i] in ("of", "the", "a", "at") else EXTRA
    return cost


def channel_cost(spelling: str, form: str, rare: set[str]) -> float:
    """Cost of the edits from a form to a spelling; 0 for the form itself. rare: the form's telling words."""
    if spelling == form:
        return 0.0
    said, meant = words(spelling), words(form)
    if not said or not meant:
        return 99.0
    glued, whole = "".join(said), "".join(meant)
    if glued == whole:
        return 0.3
    # unless some word tells of a telling one, no alignment is worth trying
    if not any(tells(w, r) for w in said for r in rare):
        d = distance(glued, whole, 2)
        if d <= 2:
            return 0.5 + TYPO * d
        stuck = (a + b for a, b in zip(said, said[1:]))
        if not any(tells(w, r) for w in stuck for r in rare):
            return 99.0
    best = _align(said, meant, rare)
    for i, w in enumerate(said):
        # initials of successive words
        for j in range(len(meant) - len(w) + 1) if len(w) > 1 else ():
            run = meant[j : j + len(w)]
            if w == "".join(x[0] for x in run) and not rare <= set(run):
                best = min(best, ACRONYM + _align([*said[:i], *run, *said[i + 1 :]], meant, rare))
    if best > 1:
        d = distance(glued, whole, 2)
        if d <= 2:
            best = min(best, 0.5 + TYPO * d)
        stripped = next((glued[: -len(x)] for x in LEGAL if glued.endswith(x) and len(glued) > len(x) + 4), glued)
        if stripped != glued and (d := distance(stripped, whole, 1)) <= 1:
            best = min(best, 0.5 + TYPO * d)
        for i in range(len(said) - 1):
            # a blank too many
            best = min(best, 0.8 + _align([*said[:i], said[i] + said[i + 1], *said[i + 2 :]], meant, rare))
    return best


_PREPARED = T.StructType().add("glued", T.StringType()).add("parts", T.ArrayType(T.StringType())).add("tries", T.ArrayType(T.StringType()))


@F.pandas_udf(_PREPARED)
def _prepared(names: pd.Series) -> pd.DataFrame:
    """A name's words, all of them as one, and the words it may tell: its own and neighbours written as one."""
    out = [words(x) for x in names]
    tries = [list(dict.fromkeys([*w, *(a + b for a, b in zip(w, w[1:]))])) for w in out]
    return pd.DataFrame({"glued": ["".join(w) for w in out], "parts": [list(w) for w in out], "tries": tries})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _short_keys(meant: pd.Series) -> pd.Series:
    by_word: dict[str, list[str]] = {}
    for nick, full in _NICK_PAIRS:
        by_word.setdefault(full, []).append(nick)
    for short, full in SHORT_FORMS.items():
        by_word.setdefault(full, []).append(short)
    return meant.map(lambda w: [*beginnings(w), *by_word.get(w, [])])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _said_short(said: pd.Series) -> pd.Series:
    return said.map(lambda w: list({w, skeleton(w), w.removesuffix("s")}))


@F.pandas_udf(T.BooleanType())
def _tells(said: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([tells(a, b) for a, b in zip(said, meant)], dtype=bool)


def deletions(word: str, most: Column) -> Column:
    """A word and what is left of it without one or two letters, as far as `most` goes. Two words within k edits (swaps count one) share what is left without k letters."""
    cut = lambda w, i: f"concat(substring({w}, 1, {i} - 1), substring({w}, {i} + 1))"
    one = F.expr(f"transform(sequence(1, length({word})), i -> {cut(word, 'i')})")
    two = F.expr(f"flatten(transform(sequence(1, greatest(1, length({word}) - 1)), i -> transform(sequence(i, greatest(i, length({word}) - 1)), j -> {cut(cut(word, 'i'), 'j')})))")
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(word), F.when(most >= 1, one).otherwise(none), F.when(most >= 2, two).otherwise(none)))


def _fifths(whole: str) -> Column:
    """Keys of a form's whole name: its length and each fifth of it. Two edits, of which a swap may touch two fifths, leave one intact."""
    at = f"transform(array(0, 1, 2, 3, 4), k -> concat_ws(':', length({whole}), k, substring({whole}, int(length({whole}) * k / 5) + 1, int(length({whole}) * (k + 1) / 5) - int(length({whole}) * k / 5))))"
    return F.expr(at)


def _met_fifths(glued: str) -> Column:
    """Keys of a spelling: for each length of a form within two edits, what stands where a fifth of it may stand intact."""
    start = f"int(m * k / 5) + CASE k WHEN 0 THEN 0 WHEN 4 THEN length({glued}) - m ELSE e END"
    of = f"concat_ws(':', m, k, substring({glued}, {start} + 1, int(m * (k + 1) / 5) - int(m * k / 5)))"
    shifts = "CASE WHEN k IN (0, 4) THEN array(0) ELSE array(-2, -1, 0, 1, 2) END"
    lengths = f"sequence(length({glued}) - 2, length({glued}) + 2)"
    return F.array_distinct(F.expr(f"flatten(transform({lengths}, m -> flatten(transform(array(0, 1, 2, 3, 4), k -> transform({shifts}, e -> {of})))))"))


def spelling_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.trim(name) != "").groupBy(F.col(name).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Over an explicit number of parts, as the rows are few bytes but much work."""
    return df.repartition(2 * max(2, df.sparkSession.sparkContext.defaultParallelism), key)


def scored(spellings: DataFrame, forms: DataFrame, words_of: DataFrame) -> DataFrame:
    """spelling, n, form_id, form, as_is, cost of the pairs that the channel accepts.

    spellings: spelling, n, glued, tries. forms: form_id, form, glued, parts, as_is. words_of: forms (column parts) from
    which common words are learned.
    """
    total = words_of.count()
    common = words_of.select(F.explode(F.array_distinct("parts")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("k"))
    rare = common.where((F.col("k") <= COMMON_FORMS) | (F.col("k") <= F.lit(COMMON_SHARE * total))).select("word")
    told = forms.select("form", F.explode(F.array_distinct("parts")).alias("word")).join(rare, "word").groupBy("form").agg(F.array_sort(F.collect_list("word")).alias("rare"))
    # a form of common words alone is told by all of them
    known = materialize(forms.join(told, "form", "left").withColumn("rare", F.coalesce("rare", "parts")), "names-known")
    told_by = known.select("form", F.explode("rare").alias("word"))
    meant = told_by.select("word").distinct()
    size = F.length("word")
    allowed = F.when(size < 4, 0).when(size < 8, 1).otherwise(2)
    by_edit = meant.select("word", F.explode(F.transform(deletions("word", allowed), lambda k: F.xxhash64(F.lit("e"), k))).alias("key"))
    by_start = meant.select("word", F.explode(F.transform(_short_keys("word"), lambda k: F.xxhash64(F.lit("s"), k))).alias("key"))
    index = sent_if_small(materialize(by_edit.unionByName(by_start), "names-index"))
    said = _spread(spellings.select(F.explode("tries").alias("said")).where(F.length("said") > 1).distinct(), "said")
    tried = F.when(F.length("said") < 3, 0).when(F.length("said") < 6, 1).otherwise(2)
    keys = F.concat(F.transform(deletions("said", tried), lambda k: F.xxhash64(F.lit("e"), k)), F.transform(_said_short("said"), lambda k: F.xxhash64(F.lit("s"), k)))
    met = said.select("said", F.explode(keys).alias("key")).join(index, "key").select("said", "word").distinct()
    met = materialize(met.where(_tells("said", "word")), "names-words")
    near = spellings.select("spelling", F.explode("tries").alias("said")).join(met, "said").join(told_by, "word").select("spelling", "form")
    fifths = known.where(F.length("glued") >= 8).select("form", F.col("glued").alias("whole"), F.explode(_fifths("glued")).alias("key"))
    met_whole = _spread(spellings.where(F.length("glued") >= 6).select("spelling", "glued"), "spelling").select("spelling", "glued", F.explode(_met_fifths("glued")).alias("key")).join(fifths, "key")
    # a swap counts two here
    whole = met_whole.where(F.levenshtein("glued", "whole", 4) >= 0).select("spelling", "form")
    # few letters are compared as a word is
    brief = known.where(F.length("glued") < 8).select("form", F.col("glued").alias("whole"), F.explode(deletions("glued", F.lit(2))).alias("key"))
    met_brief = spellings.where(F.length("glued").between(1, 9)).select("spelling", F.explode(deletions("glued", F.lit(2))).alias("key")).join(brief, "key")
    short = met_brief.select("spelling", "form")
    pairs = near.unionByName(whole).unionByName(short).distinct().join(known.select("form_id", "form", "rare", "as_is"), "form").join(spellings.select("spelling", "n"), "spelling")

    @F.pandas_udf(T.DoubleType())
    def cost(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for spelling, form, told in batches:
            yield pd.Series([channel_cost(s, f, set(r)) for s, f, r in zip(spelling, form, told)], dtype="float64")

    found = _spread(pairs, "spelling").withColumn("cost", cost("spelling", "form", "rare")).where((F.col("cost") <= MOST) & (F.col("spelling") != F.col("form")))
    return materialize(found.select("spelling", "n", "form_id", "form", "as_is", "cost"), "names-scored")


def _best(pairs: DataFrame, typical: float) -> DataFrame:
    """The form of the greatest posterior of each spelling, unless the second comes within MARGIN or the spelling stands for itself."""
    # the first two of each spelling decide; the third and later ones never leave their task
    order = Window.partitionBy("spelling").orderBy(F.desc("post"), "form_id", "form")
    own = (F.col("cost") >= TYPO) & (F.col("n") > F.greatest(F.coalesce("as_is", F.lit(0)), F.lit(FLOOR * typical)) * OWN_SHARE)
    return (
        pairs.withColumn("post", F.ln(F.coalesce("as_is", F.lit(0)) / max(typical, 1e-9) + 0.3) * 0.25 - F.col("cost"))
        .withColumn("__no", F.row_number().over(order))
        .where(F.col("__no") <= 2)
        .groupBy("spelling")
        .agg(F.min_by(F.struct("n", "form_id", "form", "cost", "post", "as_is"), "__no").alias("m"), F.max(F.when(F.col("__no") == 2, F.col("post"))).alias("second"))
        .select("spelling", "m.*", "second")
        .where((F.col("second").isNull() | (F.col("post") - F.col("second") >= MARGIN)) & ~own)
        .select("spelling", "n", "form_id", "form", "cost")
    )


def attribute(rows: DataFrame, name: str, register: DataFrame, form_id: str, form: str) -> DataFrame:
    """spelling, n, form_id, form, cost of every distinct spelling that has a form; those that are one have cost 0. form_id is null beside the register."""
    counts = materialize(spelling_counts(rows, name).withColumn("p", _prepared("spelling")).select("spelling", "n", "p.*"), "names-spellings")
    listed = register.where(F.trim(form) != "").select(F.col(form_id).alias("form_id"), F.col(form).alias("form")).dropDuplicates(["form"])
    listed = listed.withColumn("p", _prepared("form")).select("form_id", "form", "p.glued", "p.parts")
    listed = materialize(listed.join(counts.select(F.col("spelling").alias("form"), F.col("n").alias("as_is")), "form", "left"), "names-forms")
    typical = float(listed.agg(F.median("as_is")).first()[0] or 0)
    exact = listed.where("as_is is not null").select(F.col("form").alias("spelling"), F.col("as_is").alias("n"), "form_id", "form", F.lit(0.0).alias("cost"))
    loose = counts.join(listed.select(F.col("form").alias("spelling")), "spelling", "left_anti").where(~F.col("glued").isin(*PLACEHOLDERS))
    by_register = scored(loose, listed, listed)
    plain_best = _best(by_register, typical)
    # frequent spellings that no entry explains are forms beside the register
    unexplained = loose.where(F.col("n") > F.lit(FREQUENT * typical)).join(plain_best.select("spelling"), "spelling", "left_anti")
    own = unexplained.select(F.lit(None).cast(dict(listed.dtypes)["form_id"]).alias("form_id"), F.col("spelling").alias("form"), "glued", "parts", F.col("n").alias("as_is"))
    own = materialize(own, "names-own-forms")
    rest = loose.join(own.select(F.col("form").alias("spelling")), "spelling", "left_anti")
    beside = scored(rest, own, listed.select("parts").unionByName(own.select("parts")))
    stands = own.select(F.col("form").alias("spelling"), F.col("as_is").alias("n"), "form_id", "form", F.lit(0.0).alias("cost"))
    best = _best(by_register.join(stands.select("spelling"), "spelling", "left_anti").unionByName(beside), typical)
    return exact.unionByName(stands).unionByName(best)


def variant_rows(rows: DataFrame, row_id: str, name: str, register: DataFrame, form_id: str, form: str) -> DataFrame:
    """row_id, form_id of rows whose name differs from its register entry in any character."""
    found = attribute(rows, name, register, form_id, form).where("cost > 0 and form_id is not null")
    linked = materialize(found.select("spelling", "form_id"), "names-linked")
    return rows.select(F.col(row_id), F.col(name).alias("spelling")).join(linked, "spelling").select(row_id, F.col("form_id").alias(form_id))
