"""The corpus operators against brute force, exact round trips and small hand-made cases."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import encoding, fusion, names, neardup, packing, queries, sentences, tokenize

P_QUERIES = [q for q in queries.QUERIES if q.startswith("p")]


# -- every query on hostile tables ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", P_QUERIES)
def test_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() == 0


@pytest.mark.parametrize("name", P_QUERIES)
def test_hostile_tables(spark, hostile_tables, name):
    queries.QUERIES[name](spark, hostile_tables).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, name):
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    df = queries.QUERIES[name](spark, sf)
    got = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in got.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in got.fetchall())


# -- tokens -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokenize.DEFAULT_RANKS, "rb") as f:
        raw = f.read()
    return tokenize.encoder(raw), tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=tokenize.read_ranks(raw), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=200) | st.text(alphabet="abest h’éñ漢กิ!.\n1", max_size=400))
def test_ids_equal_the_merge_loop(encoders, text):
    mine, theirs = encoders
    assert mine.encode(text) == theirs.encode_ordinary(text)


def test_long_runs_and_special_strings(encoders):
    mine, theirs = encoders
    for text in ("a" * 20_000, "ab" * 9_000, " " * 5_000 + ".", "<|endoftext|>", "\t\r\n" * 400):
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_ids_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "hello world")], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in df.select("doc_id", tokenize.token_ids(df).alias("ids")).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 2


# -- sentences --------------------------------------------------------------------------------------------------

CASES = [
    ("Dr. Marisol leads it, e.g. when work runs past 6 p.m. on weekdays. We left.", ["Dr. Marisol leads it, e.g. when work runs past 6 p.m. on weekdays.", "We left."]),
    ("Coverage is limited to the U.S.  Training lasts 5 weeks.", ["Coverage is limited to the U.S.", "Training lasts 5 weeks."]),
    ("J. Q. Okumbe wrote it (vol. 3, pp. 27–521).Pay is $22.50 per hr. and rises.", ["J. Q. Okumbe wrote it (vol. 3, pp. 27–521).", "Pay is $22.50 per hr. and rises."]),
    ("Our motto is “Ask first. Bill second.” and we mean it. “Is it clean?” is asked.", ["Our motto is “Ask first. Bill second.” and we mean it.", "“Is it clean?” is asked."]),
    ('She told us, "I love it." Item No. 2 is due by Oct. 19. See www.x.example/a.html?id=1 or ask.', ['She told us, "I love it."', "Item No. 2 is due by Oct. 19.", "See www.x.example/a.html?id=1 or ask."]),
    ("We said we would wait... but began. Done?! Yes.", ["We said we would wait... but began.", "Done?!", "Yes."]),
    ("About the role\n\nFirst line\ngoes on. Next.\n• One item\n• Two. Still two.\n", ["About the role", "First line\ngoes on.", "Next.", "• One item", "• Two.", "Still two."]),
    ("1. Travel to Ft. Wexley\n2. A stamp\r\n\r\nEnd", ["1. Travel to Ft. Wexley", "2. A stamp", "End"]),
    ("Der Start ist am 5. Oktober um 8.30 Uhr. Unser Satz „Erst prüfen. Dann buchen.“ hängt z. B. bei Tarif Nr. 4. Gut.", ["Der Start ist am 5. Oktober um 8.30 Uhr.", "Unser Satz „Erst prüfen. Dann buchen.“ hängt z. B. bei Tarif Nr. 4.", "Gut."]),
    ("「まず確認。次に請求。」が合言葉です。時給は24.50ドルです！本当ですか？はい。", ["「まず確認。次に請求。」が合言葉です。", "時給は24.50ドルです！", "本当ですか？", "はい。"]),
    ("“先核对。再收费。”是口号。您喜欢吗？", ["“先核对。再收费。”是口号。", "您喜欢吗？"]),
    ("डॉ. वेणुका प्रमुख हैं। क्या आपको पसंद है? हाँ।", ["डॉ. वेणुका प्रमुख हैं।", "क्या आपको पसंद है?", "हाँ।"]),
    ("د. رائف يقود الفريق. هل تحب ذلك؟ نعم.", ["د. رائف يقود الفريق.", "هل تحب ذلك؟", "نعم."]),
    ("สมัครวันนี้ที่ท่าหินงาม ค่าจ้างเริ่มต้น 30.40 ดอลลาร์ คุณชอบหรือไม่", ["สมัครวันนี้ที่ท่าหินงาม", "ค่าจ้างเริ่มต้น 30.40 ดอลลาร์", "คุณชอบหรือไม่"]),
    ("Placeholder  and  stay. Next 🙂 one.", ["Placeholder  and  stay.", "Next 🙂 one."]),
    ("", []),
    (None, []),
    (" \n\t ", []),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t, "own") for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string, start_char string")
    got = {}
    for r in sentences.sentences(df).orderBy("doc_id", "start_char").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    for i, (text, expected) in enumerate(CASES):
        assert got.get(i, []) == expected, text


@pytest.mark.parametrize("size", [10, 301, 3_000, 100_000])
def test_no_length_bounds_what_is_masked(spark, size):
    words = ("word. Next " * (size // 11 + 1))[:size]
    texts = [
        f"He said “{words}.” and left. Then more.", f"Er sagte „{words}.“ und ging. Dann mehr.", f'He said "{words}." and left. Then more.',
        f"See https://x.example/{'a.B' * (size // 3 + 1)} now. Then more.", f"Ask {'a.B' * (size // 3 + 1)}@x.example now. Then more.", f"First.\n{' ' * size}\n{' ' * size}Then more.", f"First\n{' ' * size}7. Then more",
        f"Wait{'.' * size}Then more.",
    ]
    got = {}
    for r in sentences.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert {i: (len(u), u[-1].lstrip("7. ")) for i, u in got.items()} == {i: (2, "Dann mehr." if i == 1 else "Then more" if i == 6 else "Then more.") for i in range(len(texts))}


def test_an_unclosed_quotation_ends_at_a_blank_line(spark):
    df = spark.createDataFrame([(1, "“One. Two.\n\nThree. Four.” Five.")], "doc_id int, text string")
    assert [r.sentence for r in sentences.sentences(df).orderBy("start_char").collect()] == ["“One.", "Two.", "Three.", "Four.”", "Five."]


def test_spans_cut_the_same_units(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    a = {(r.doc_id, r.start_char, r.end_char) for r in sentences.sentence_spans(docs).collect()}
    full = sentences.sentences(docs).join(docs, "doc_id").collect()
    assert a == {(r.doc_id, r.start_char, r.end_char) for r in full}
    assert all(r.text[r.start_char : r.end_char] == r.sentence for r in full)


# -- encodings --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("word", ["Gefäßchirurgie", "señalización", "–", "d’été", "naïve"])
def test_garbled_forms_hold_every_chain(word):
    forms = dict(encoding.garbled_forms(word))
    assert {word.encode().decode("latin-1"), encoding.misread(word.encode(), "cp437"), encoding.misread(encoding.misread(word.encode(), "cp1252").encode(), "cp1252")} <= set(forms)
    assert "lost" in forms.values() and word not in forms


@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437"])
def test_undo_inverts_a_misreading(charset):
    for word in ("señalización", "Büro", "d’été"):
        garbled = encoding.misread(word.encode(), charset)
        assert encoding.undo(garbled)[0] == word
    assert encoding.undo("Ångelholt") is None and encoding.undo("Œuvrel") is None and encoding.undo("Ã") is None


def test_affected_and_restored(spark):
    clean = "El equipo de señalización está en la oficina – mañana, según el período."
    rows = [("t", str(i), clean) for i in range(6)] + [
        ("t", "utf", clean.encode().decode("latin-1")), ("t", "mac", clean.encode("cp1252").decode("mac_roman")), ("t", "lost", clean.replace("ñ", "�")), ("t", "decoy", "Watch for stray Ã and â marks, ½ and ©, in Ångelholt."),
        ("t", "plain", "nothing here"), ("t", "null", None), ("t", "empty", ""),
    ]
    df = spark.createDataFrame(rows, "tab string, rec_key string, text string")
    assert {r.rec_key for r in encoding.affected(df, ["tab", "rec_key"]).collect()} == {"utf", "mac", "lost"}
    back = {r.rec_key: r for r in encoding.restored(df, ["tab", "rec_key"]).collect()}
    assert back["utf"].restored == clean and back["utf"].complete and back["mac"].restored == clean


def test_one_byte_forms_are_found_however_often_they_are_repeated(spark):
    bad = lambda w: w.encode("cp1252").decode("mac_roman")
    rows = [(f"hot{i}", bad("la señalización")) for i in range(30)] + [("clean", "la señalización"), ("alone", bad("según lo dicho")), ("ok", "30 m² à l’œuvre, “Ask” 20°C Acme™")]
    df = spark.createDataFrame(rows, "rec_key string, text string")
    assert {r.rec_key for r in encoding.affected(df, ["rec_key"]).collect()} == {f"hot{i}" for i in range(30)} | {"alone"}


# -- fusion -----------------------------------------------------------------------------------------------------


def fused(spark, rows):
    """Accuracies, dependences, surviving values of (item, value, source) claims."""
    df = spark.createDataFrame([(str(i), v, s, f"{i}-{s}") for i, v, s in rows], "item string, value string, source string, id string")
    values = fusion.materialize(fusion.claims(df, ["item"], "value", "source", "id", [F.lit(0).cast("bigint")]), "test-claims")
    accuracy, dependence = fusion.estimate(values, ["item"], "value")
    found = fusion.survivors(values, ["item"], "value", accuracy, dependence)
    return {r.s: r.a for r in accuracy.collect()}, {(r.a, r.b): r.p for r in dependence.collect()}, {r.item: (r.value, r.votes) for r in found.collect()}


def test_votes_decide_among_values_of_one_rank(spark):
    rows = [(i, "x", s) for i in range(30) for s in ("good1", "good2")] + [(i, "x" if i % 2 else f"bad{i}", "bad") for i in range(30)]
    accuracy, _, found = fused(spark, rows)
    assert accuracy["good1"] > accuracy["bad"] and {v for v, _ in found.values()} == {"x"}


def test_copies_are_found_and_outvoted(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        said = {f"own{k}": "true" if rng.random() < 0.75 else f"false {rng.randrange(20)}" for k in range(1, 6)}
        # a bad source that is copied twice outnumbers the others
        bad = "true" if rng.random() < 0.35 else f"false {rng.randrange(20)}"
        rows += [(i, v, s) for s, v in (said | {"bad": bad, "copy1": bad, "copy2": bad}).items()]
    accuracy, dependence, found = fused(spark, rows)
    assert min(dependence["bad", "copy1"], dependence["bad", "copy2"], dependence["copy1", "copy2"]) > 0.9 > 0.2 > dependence["own1", "own2"]
    right = sum(v == "true" for v, _ in found.values())
    counted = {}
    for i, v, _ in rows:
        counted.setdefault(str(i), []).append(v)
    by_number = sum(max(sorted(set(vs)), key=vs.count) == "true" for vs in counted.values())
    assert right > by_number + 15 and right > 135


def test_votes_equal_the_formula(spark):
    acc = {"a": 0.9, "b": 0.8, "c": 0.8, "d": 0.6}
    dep = {("a", "b"): 0.5, ("b", "c"): 1.0, ("a", "d"): 0.1}
    values = spark.createDataFrame([("i", "v", list("abcd")), ("i", "w", ["c"]), ("j", "v", ["new"])], "item string, value string, sources array<string>")
    accuracy = spark.createDataFrame(list(acc.items()), "s string, a double")
    dependence = spark.createDataFrame([(a, b, p) for (a, b), p in dep.items()], "a string, b string, p double")
    got = {(r.item, r.value): r.votes for r in fusion.votes(values, ["item", "value"], accuracy, dependence).collect()}

    def vote(sources):
        total, before = 0.0, []
        for s in sorted(sources, key=lambda x: (-acc.get(x, fusion.ACCURACY), x)):
            a = acc.get(s, fusion.ACCURACY)
            own = math.prod(1 - fusion.COPIED * dep.get((min(s, t), max(s, t)), 0.0) for t in before)
            total += own * math.log(fusion.FALSE_VALUES * a / (1 - a))
            before.append(s)
        return total

    assert got == {k: pytest.approx(vote(v)) for k, v in {("i", "v"): "abcd", ("i", "w"): "c", ("j", "v"): ["new"]}.items()}


def test_merged_records_follow_the_rows_that_survive(spark, sf):
    jobs = {r.id: r for r in spark.read.parquet(f"{sf}/jobs.parquet").collect()}
    found = {r.canonical_url: r for r in queries.p1_found(spark, sf).collect()}
    merged = queries.p1_merged(spark, sf).collect()
    assert {r.canonical_url for r in merged} == set(found)
    for r in merged:
        ids = found[r.canonical_url]
        assert ((r.data_id or ""), (r.posted_id or ""), (r.apply_id or "")) == (ids.data_id, ids.posted_id, ids.apply_id)
        assert r.data == (jobs[r.data_id].data if r.data_id else None) and r.posted_at == (jobs[r.posted_id].posted_at if r.posted_id else None)
        titles = {" ".join(j.title.split()) for j in jobs.values() if j.canonical_url == r.canonical_url and j.title and j.title.strip()}
        assert r.title in titles or not titles
    report = queries.p1_sources(spark, sf).collect()
    assert all(0 < x.dependence < 1 and x.source_a < x.source_b and 0 < x.accuracy_a < 1 for x in report)


# -- near duplicates --------------------------------------------------------------------------------------------


def texts_for_groups(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.randint(1, 4)):
            w = base[:]
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return out


def brute_groups(texts, width, similarity):
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= similarity * len(a | b):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    return {frozenset(i for i in range(len(texts)) if label[i] == k) for k in label}


@pytest.mark.parametrize("pivots", [1, 4, 31])
def test_groups_equal_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    monkeypatch.setattr(neardup, "BLOCK", 40)
    texts = texts_for_groups(7, 60)
    df = spark.createDataFrame(list(enumerate(texts)) + [(9001, None), (9002, ""), (9003, "one two")], "id bigint, text string")
    got = {}
    for r in neardup.groups(df, "id", "text", 3, 0.5).collect():
        got.setdefault(r.group, set()).add(r.id)
    assert {frozenset(x) for x in got.values()} == brute_groups(texts, 3, 0.5)


def test_a_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(400):
        w = base[:]
        w[rng.randrange(80)] = f"x{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{i}-{k}" for k in range(60)) for i in range(200)]
    got = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect()
    assert len({r.group for r in got if r.id < 400}) == 1 and len({r.group for r in got}) == 201


def test_pairs_at_the_threshold_are_all_linked(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 150)
    # two texts share 20 of 40 words, just one half
    texts = [" ".join(f"w{i}x{k}" for k in range(a, a + 30)) for i in range(200) for a in (0, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {(r.a, r.b) for r in neardup.linked_pairs(df, "id", "text", 1, 0.5).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(200)}


def test_runs_are_written_once_and_blocks_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    monkeypatch.setattr(neardup, "GROUP", 1, raising=False)
    written = []
    keep = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, label: written.append((label, df.columns)) or keep(df, label))
    texts = texts_for_groups(5, 60)
    got = {}
    for r in neardup.groups(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text", 3, 0.5).collect():
        got.setdefault(r.group, set()).add(r.id)
    assert {frozenset(x) for x in got.values()} == brute_groups(texts, 3, 0.5)
    assert [label for label, columns in written if "runs" in columns and label != "neardup-asked-sets"] == ["neardup-nodes"]
    assert sum(label == "neardup-apart" for label, _ in written) > 1


def test_first_runs_find_every_pair_that_is_similar_enough():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(150):
        base = rng.choice(3000, rng.integers(5, 90), replace=False)
        for share in (1, 0.95, 0.7):
            sets.append(np.unique(np.r_[rng.choice(base, max(1, int(len(base) * share)), replace=False), rng.choice(3000, 1)]).astype(np.uint32) * np.uint32(2654435761))
    sets = sorted((np.sort(v) for v in sets), key=len)
    n, v = np.array([len(x) for x in sets]), np.concatenate(sets)
    often = np.bincount(v & np.uint32(neardup.SLOTS - 1), minlength=neardup.SLOTS)
    maps = neardup._maps512(v, np.repeat(np.arange(len(n)), n), len(n)).view(np.uint64)
    for s in (500, 800):
        side = neardup._Side(n, maps, np.frombuffer(b"".join(neardup._codes(v, n, often, s)), np.uint16), s)
        found = set(zip(*(x.tolist() for x in neardup._near(side, side))))
        both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(len(n)) for j in range(len(n))}
        like = {(i, j) for (i, j), k in both.items() if k * (1000 + s) >= (n[i] + n[j]) * s}
        assert like <= found and len(like) > len(n)
        few = side.slice(100, 200)
        assert {(i + 100, j) for i, j in zip(*(x.tolist() for x in neardup._near(few, side)))} >= {p for p in like if 100 <= p[0] < 200}


# -- names ------------------------------------------------------------------------------------------------------

REGISTER = ["Marrowgate Health Partners", "Elizabeth Stovdell & Associates", "Jurbinley Memorial Hospital", "Stolkgarth Children's Hospital", "Relstead Home Care", "Relstead Revenue Management", "Saint Waelkley Medical Group"]
VARIANTS = {
    "Marrowgate HP": 0, "marrowgatehealthpartners": 0, "Health Partners, Marrowgate": 0, "Nine Elms Holdings doing business as Marrowgate Health Partners": 0, "Márrowgate Health Partners, Inc.": 0, "Marro wgate Hlth Ptnrs": 0,
    "Beth Stovdell & Assoc.": 1, "E. Stovdell & Associates": 1, "Stovdell, Elizabeth, & Associates": 1, "Jurbiniey Mem'l Hosp": 2, "Children's Hospital of Stolkgarth": 3, "Relstead HC": 4, "Relstead RM LLC": 5, "St. Waelkley Med Grp": 6,
}


def test_variants_find_their_names(spark):
    own = ["Gessolkhaven University Hospital", "N/A", "Confidential", "", None, "Relstead Pharmacy Services"]
    rows = [(f"v{i}", v) for i, v in enumerate(VARIANTS)] + [(f"o{i}", v) for i, v in enumerate(own)] + [(f"r{i}", v) for i, v in enumerate(REGISTER)]
    jobs = spark.createDataFrame(rows, "job_id string, company string")
    register = spark.createDataFrame([(i, n) for i, n in enumerate(REGISTER)] + [(99, None), (98, "")], "company_id bigint, name string")
    got = {r.job_id: r.company_id for r in names.variant_rows(jobs, "job_id", "company", register, "company_id", "name").collect()}
    assert got == {f"v{i}": k for i, k in enumerate(VARIANTS.values())}


def test_no_pair_that_the_channel_accepts_is_missed(spark):
    rng = random.Random(4)
    tails = ["Health", "Clinic", "Health Partners", "Care Group"]
    register = sorted({f"{''.join(rng.choice('abcdefgil') for _ in range(rng.randint(3, 9))).title()} {rng.choice(tails)}" for _ in range(60)})

    def bent(name):
        w = list(name)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) - 1)
            w[i : i + 2] = rng.choice([w[i], w[i] + w[i + 1] + rng.choice("aeil"), w[i + 1] + w[i], rng.choice("aeil") + w[i + 1]])
        return rng.choice(["{}", "{} Inc", "The {}"]).format("".join(w)) if rng.random() < 0.8 else "".join(w).replace(" ", "")

    spellings = sorted({bent(rng.choice(register)) for _ in range(300)} - set(register))
    df = spark.createDataFrame([(x, 1) for x in spellings], "spelling string, n bigint").withColumn("p", names._prepared("spelling")).select("spelling", "n", "p.*")
    forms = spark.createDataFrame([(i, x, 1) for i, x in enumerate(register)], "form_id bigint, form string, as_is bigint").withColumn("p", names._prepared("form")).select("form_id", "form", "as_is", "p.glued", "p.parts")
    got = {(r.spelling, r.form) for r in names.scored(df, forms, forms).collect()}
    often = {w: sum(w in names.words(x) for x in register) for x in register for w in names.words(x)}
    rare = {x: {w for w in names.words(x) if often[w] <= names.COMMON_FORMS} or set(names.words(x)) for x in register}
    every = {(a, b) for a in spellings for b in register if names.channel_cost(a, b, rare[b]) <= names.MOST}
    assert got == every and len(every) > 200


def test_frequent_spellings_beside_the_register_are_forms_and_repeating_rows_changes_nothing(spark):
    said = ["Quonfield Dental Group"] * 6 + ["Quonfeild Dental Group", "Quonfield Dental Grp", "Quonfyeld Dental Inc"] + ["Marrowgate Health Partners"] * 5 + ["Marrowgate Hlth Partners", "Marowgate Health Partners"] + ["Marrowgade Health Partners"] * 9
    register = spark.createDataFrame([(1, "Marrowgate Health Partners"), (2, "Relstead Home Care")], "id bigint, name string")

    def links(times):
        rows = spark.createDataFrame([(x,) for x in said * times], "company string")
        return {(r.spelling, r.form_id, r.form) for r in names.attribute(rows, "company", register, "id", "name").where("cost > 0").collect()}

    once = links(1)
    assert once == links(10)
    assert {(a, f) for a, i, f in once if i is None} == {(a, "Quonfield Dental Group") for a in ("Quonfeild Dental Group", "Quonfield Dental Grp")}
    assert {a for a, i, _ in once if i == 1} == {"Marrowgate Hlth Partners", "Marowgate Health Partners"}


@given(st.text("abcd", max_size=6), st.text("abcd", max_size=6))
def test_distance_is_symmetric_and_bounded(a, b):
    d = names.distance(a, b, 10)
    assert d == names.distance(b, a, 10) and d <= max(len(a), len(b)) and (d == 0) == (a == b)


# -- packing ----------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_no_bin_overflows(sizes):
    got, counted = packing.pack(sizes, 64)
    assert all(packing.CLASSES > 64 // s for s, c in zip(sizes, counted) if c)
    used = {}
    for s, b in zip(sizes, got):
        used[b] = used.get(b, 0) + s
    assert len(got) == len(sizes) and all(v <= 64 for v in used.values())
    assert len(used) <= 1.7 * -(-sum(sizes) // 64) + 1 and set(used) == set(range(len(used)))


def test_bins_are_the_same_whatever_the_cores(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_WORKER", 100)
    rng = random.Random(8)
    rows = [(i, rng.randint(1, 700)) for i in range(600)]
    packs = spark.createDataFrame([(1, 512), (2, 2048)], "pack_id bigint, capacity_tokens bigint")
    made = lambda parts: sorted(map(tuple, packing.packed(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").repartition(parts), packs).collect()))
    assert made(1) == made(7)
    (a, b) = packing.fill(packing.packed(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), packs), packs).orderBy("pack_id").collect()
    assert a.used_tokens == b.used_tokens == sum(n for _, n in rows) and 0.9 < b.filled <= 1 and 0 < a.counted_items <= a.items


def test_long_texts_are_cut_and_others_are_whole(spark):
    sized = spark.createDataFrame([(1, 1300), (2, 100), (3, 0), (4, 412), (5, 512)], "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([(1, 512), (2, 2048), (3, None)], "pack_id bigint, capacity_tokens bigint")
    rows = packing.packed(sized, packs).collect()
    assert sorted((r.piece, r.n_tokens) for r in rows if r.doc_id == 1 and r.pack_id == 1) == [(0, 512), (1, 512), (2, 276)]
    assert sorted((r.doc_id, r.n_tokens) for r in rows if r.pack_id == 2) == [(1, 1300), (2, 100), (4, 412), (5, 512)]
    filled = packing.containers(packing.packed(sized, packs), packs).collect()
    assert all(r.used <= r.capacity_tokens for r in filled) and sum(r.used for r in filled if r.pack_id == 1) == 2324
