"""Skeletons, languages, answers and truncation: brute force on small fixtures, held-out accuracy on the labelled tables."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import answers, languages, skeleton, sqltext, truncation
from starloom.llm.automata import SuffixAutomaton, Walkers, covered
from starloom.llm.sqltext import read, split_answer


@given(st.text("ab ", max_size=30), st.text("abc ", max_size=20))
@settings(max_examples=150, deadline=None)
def test_suffix_automaton_against_brute_force(text, query):
    a = SuffixAutomaton(text)
    longest = lambda end: max((n for n in range(end + 1) if query[end - n : end] in text), default=0)
    assert a.matches(query) == [longest(i + 1) for i in range(len(query))]
    count, i = 0, 0
    while i < len(query):
        j = i
        while j < len(query) and query[i : j + 1] in text:
            j += 1
        count, i = count + 1, max(j, i + 1)
    assert a.phrases(query) == count
    m = a.matches(query)
    assert covered(m, 2) == len({p for e, n in enumerate(m, 1) if n >= 2 for p in range(e - n, e)})


@given(st.lists(st.text("abc", max_size=25), min_size=1, max_size=3), st.lists(st.text("abcd", min_size=1, max_size=12), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_walkers_against_single_automata(texts, queries):
    walkers = Walkers({str(i): t for i, t in enumerate(texts)})
    number = walkers.numbers(np.array([ord(ch) for ch in "".join(queries)]))
    ends = np.cumsum([len(q) for q in queries])
    spans = np.repeat(np.c_[np.r_[0, ends[:-1]], ends], len(texts), axis=0)
    which = np.tile(np.arange(len(texts)), len(queries))
    got = np.full((len(texts), len(number)), -1)

    def put(lane, places, lengths):
        got[lane, places] = lengths

    walkers.matches(number, spans, which, 3, put)
    single = [SuffixAutomaton(t) for t in texts]
    assert got.tolist() == [[min(m, 3) for q in queries for m in a.matches(q)] for a in single]
    assert walkers.phrases(number, spans, which).tolist() == [a.phrases(q) for q in queries for a in single]


ALIKE = [
    ("Which ﬁve", "Which five"), ("ａｂｃ １２，", "abc 12,"), ("wo​rd﻿", "word"), ("a b　c d", "a b c d"), ("Cаfе́", "Café"), ("Café", "Café"), ("आहेत", "अाहेत"), ("কো", "কো"), ("ড়", "ড়"),
    ("ΚΜ", "KM"), ("іѕ", "is"),
]
DIFFERENT = [("Ab", "ab"), ("café", "cafe"), ("१२", "12"), ("a.b", "a,b"), ("l", "1"), ("I", "l"), ("rn", "m"), ("a  b", "a b"), ("a\nb", "a b"), ("x²", "x2")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert skeleton.skeleton(a) == skeleton.skeleton(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert skeleton.skeleton(a) != skeleton.skeleton(b)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_skeleton_is_stable(text):
    once = skeleton.skeleton(text)
    assert skeleton.skeleton(once) == once
    assert skeleton.skeleton(skeleton.clean(text)) == once
    assert skeleton.clean(skeleton.clean(text)) == skeleton.clean(text)


def test_clean_form_keeps_alphabets_that_are_meant():
    for text in ("Москва и Рим", "ΑΘΗΝΑ 12", "Соты", "where is Москва"):
        assert skeleton.clean(text) == text
    assert [skeleton.clean(t) for t in ("hоw mаny", "Which сор", "ＡＢ　ｃ", "अाहेत", "wo\u200brd", "")] == ["how many", "Which cop", "AB c", "आहेत", "word", ""]
    assert skeleton.clean(None) is None


def test_public_table(spark):
    letters = skeleton.public_letters(spark)
    table = skeleton.Prototypes(letters)
    form = lambda t: skeleton.skeleton(t, table)
    assert len(letters) > 2000
    for one, two in [*ALIKE, ("ᗅ", "A"), ("Ƅ", "b"), ("ℓ", "l"), ("Ⅳ", "IV"), ("ⅰ", "i"), ("І", "I"), ("ӏ", "l"), ("ओ", "अो"), ("ഔ", "ഒൗ"), ("औ", "अौ"), ("औ", "अाै"), *skeleton.COMPOSED_VOWELS.items()]:
        assert form(one) == form(two), (one, two)
    for one, two in [*DIFFERENT, ("Москва", "Moscow"), ("ः", ":"), ("।", "l")]:
        assert form(one) != form(two), (one, two)
    for ch in letters:
        assert form(form(ch)) == form(ch), ch
    for whole, letters_ in skeleton.LOOK_ALIKES.items():
        assert {form(ch) for ch in letters_} == {whole}


def test_pairs_against_brute_force(spark):
    rng, base = random.Random(5), ["where is the cafe?", "how many five", "लाभ अाहेत", "", None, "x" * 5000]
    variants = [lambda t: t, lambda t: t.replace("a", "а"), lambda t: t.replace(" ", " "), lambda t: t.replace("fi", "ﬁ"), str.upper, lambda t: t + "​"]
    rows = []
    for i in range(150):
        t = rng.choice(base)
        rows.append((rng.randint(1, 120), rng.choice(variants)(t) if t else t, 1, "z"))
    rows.append((None, "where is the cafe?", 1, "z"))
    got = sorted(tuple(r) for r in skeleton.look_alike_pairs(spark.createDataFrame(rows, "id long, q string, key int, own string"), "id", "q").collect())
    texts = {(i, t) for i, t, *_ in rows if i is not None and t}
    assert got == sorted({(i, j) for i, s in texts for j, t in texts if i < j and s != t and skeleton.skeleton(s) == skeleton.skeleton(t)}) and got
    assert skeleton.look_alike_pairs(spark.createDataFrame([], "id long, q string"), "id", "q").count() == 0
    forms = {(r.id, r.q): r.consistent for r in skeleton.one_form(spark.createDataFrame(rows, "id long, q string, key int, own string"), "id", "q").collect()}
    for (_, s), a in forms.items():
        for (_, t), b in forms.items():
            assert (a == b) == (skeleton.skeleton(s) == skeleton.skeleton(t)), (s, t)


@pytest.fixture(scope="module")
def samples(spark, data):
    return languages.collect_samples(spark.read.parquet(f"{data}/language_samples.parquet"), "language", "sample_text")


def test_held_out_languages(samples):
    """Trained on half of the labelled samples, right on at least 98 % of the others, alone and two at a time."""
    train = {k: v[::2] for k, v in samples.items()}
    test = [(k, t) for k, v in samples.items() for t in v[1::2]]
    model = languages.Languages(train)
    right = sum([s[0] for s in model.segments(t)] == [k] for k, t in test)
    assert right / len(test) >= 0.98
    rng, pairs = random.Random(1), 0
    for _ in range(120):
        (a, s), (b, t) = rng.sample(test, 2)
        if a != b:
            pairs += [x[0] for x in model.segments(s + rng.choice([" ", "\n", " / ", " — "]) + t)] == [a, b]
    assert pairs >= 95


def test_languages_of_odd_texts(spark, samples):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "12 ?!"), (5, "How many wells are there near 'Kotapalli' in the year 2001?"), (6, "नापल्ली में कितने कुएँ हैं " * 300)]
    got = languages.identify(spark.createDataFrame([(i, t, "x") for i, t in rows], "id int, t string, language string"), "id", "t", samples).collect()
    assert sorted((r.id, r.segment_no, r.language) for r in got) == [(5, 1, "English"), (6, 1, "Hindi")]
    assert all(0.5 < r.confidence <= 1 for r in got)
    assert languages.identify(spark.createDataFrame([], "id int, t string"), "id", "t", samples).count() == 0


def test_short_clauses_and_unknown_scripts(samples):
    model = languages.Languages(samples)
    names = lambda t: [(name, round(c, 3)) for name, c, _ in model.segments(t)]
    only = lambda t: [name for name, _ in names(t)]
    assert only("How many wells are there in the block of Goa? कितने कुएँ हैं?") == ["English", "Hindi"]
    assert only("Join the yearly table with the place table. எத்தனை கிணறுகள் உள்ளன?") == ["English", "Tamil"]
    assert only("নলকূপ এর উপরে কত অকৃষি প্রতিষ্ঠান (latest revision)?") == ["Bengali"]
    assert only("নলকূপ এর উপরে কত অকৃষি প্রতিষ্ঠান (How many wells?)") == ["Bengali", "English"]
    assert only("நாபள்ளி இல் 'Form B' மற்றும் total wells எத்தனை உள்ளன?") == ["Tamil"]
    for text in ("كم عدد الآبار في المنطقة؟", "这个地区有多少口井？", "આ જિલ્લામાં કેટલા કૂવા છે?", "ਇਸ ਜ਼ਿਲ੍ਹੇ ਵਿੱਚ ਕਿੰਨੇ ਖੂਹ ਹਨ?"):
        assert names(text) == [("und", 0.0)]
    assert only("Join the yearly table with the place table before grouping. આ જિલ્લામાં કેટલા કૂવા છે?") == ["English", "und"]
    ((_, sure),) = names("গণনাকারীরা জানিয়েছেন যে 1995 সালে শিক্ষক পদ দুবার লেখা হয়েছিল")
    assert 0.5 < sure < 1  # measured, though no other language has the script


def test_long_texts_are_parsed_in_blocks(samples, monkeypatch):
    model = languages.Languages(samples)
    text = " ".join(t for pair in zip(samples["Tamil"][:30], samples["English"][:30]) for t in pair)
    whole = model.segments(text)
    assert len(text) > 4 * languages.BLOCK and len(whole) > 30
    monkeypatch.setattr(languages, "BLOCK", 1 << 20)
    assert model.segments(text) == whole


COLUMNS, TABLES = frozenset(["district_id", "district_name", "wells", "calendar_year"]), frozenset(["fact_wells", "dim_district"])
WHOLE = [
    "SELECT COUNT(*) FROM fact_wells WHERE wells < 5;", "SELECT d.district_name, SUM(f.wells) AS total_wells FROM fact_wells f JOIN dim_district d ON f.district_id = d.district_id GROUP BY d.district_name HAVING SUM(f.wells) > 3",
    "WITH y AS (SELECT wells FROM fact_wells) SELECT wells FROM y WHERE wells > 2 ORDER BY wells DESC LIMIT 5", "SELECT d.district_name FROM dim_district d WHERE d.district_name = 'It''s'",
]


@pytest.mark.parametrize("sql", WHOLE)
def test_statements_and_their_cuts(sql):
    assert not read(sql, COLUMNS, TABLES).broken
    tokens = sql.rstrip(";").split(" ")
    for n in range(1, len(tokens)):
        part = " ".join(tokens[:n])
        if part.split()[-1].upper() in ("SELECT", "FROM", "WHERE", "BY", "AND", "ON", "JOIN", "=", "<", ">", "HAVING", "ORDER", "AS"):
            assert read(part, COLUMNS, TABLES).broken, part
    assert read(sql.rstrip(";") + " '", COLUMNS, TABLES).broken


def test_split_answer():
    assert split_answer("Here it is.\n\n```sql\nSELECT 1 FROM t\nWHERE x\n```\nDone well.") == ("SELECT 1 FROM t\nWHERE x", "Here it is.\n\n\n\nDone well.") or split_answer("Here it is.\n\n```sql\nSELECT 1 FROM t\nWHERE x\n```\nDone well.")[0] == "SELECT 1 FROM t\nWHERE x"
    assert split_answer("-- why?\nSELECT 1 FROM t;")[1] == ""
    assert split_answer("With regard to this, no.")[0] is None
    for end in ("HAVIN", "ORDE;", "WHER\n```"):
        cut_off = split_answer(f"```sql\nSELECT d.district_name FROM dim_district d\n{end}")
        assert cut_off[1] == "" and read(cut_off[0], COLUMNS, TABLES).broken
    assert split_answer("SELECT a FROM t\nOK")[1] == "OK"


def test_statements_of_many_lines():
    listed = "SELECT wells FROM fact_wells WHERE wells IN (\n" + ",\n".join(map(str, range(1000))) + "\n)"
    assert split_answer(f"Here it is.\n{listed};\nDone well.") == (listed, "Here it is.\n\n\nDone well.")
    assert not read(split_answer(listed)[0], COLUMNS, TABLES).broken


@given(st.lists(st.text("(');\"-a .", max_size=6), max_size=8))
@settings(max_examples=300, deadline=None)
def test_lines_read_on_as_if_read_whole(lines):
    seen, so_far = sqltext._Lines("\n".join(lines)), []
    for line in lines:
        so_far.append(line)
        tokens, end = sqltext.TOKEN.findall("\n".join(so_far)), seen.add(line)
        assert end == (sum(map(len, tokens[: tokens.index(";")])) if ";" in tokens else None)
        if end is not None:
            break
        assert seen.depth == tokens.count("(") - tokens.count(")")


def test_defects(spark, data, samples):
    q, ok = "How many wells are in the district of Goa?", "SELECT COUNT(*) FROM fact_wells WHERE wells < 5"
    cases = [
        (1, q, None, None, "empty"), (2, q, "```sql\n;\n```", "", "empty"), (3, q, ok, None, "empty"), (4, q, ok, ok + ";", None), (5, q, "SQL: " + ok[:-5], ok[:-5], "truncated"), (6, q, "I'm sorry, but I can't help with writing this statement.", "", "refusal"),
        (7, q, "माफ़ कीजिए, उत्तर देना मेरे लिए संभव नहीं है।", None, "refusal"), (8, q, f"Question: {q.upper()}", None, "copied_question"), (9, q, f"-- {q}\n{ok};", ok, None), (10, q, f"Sorry for the mistake before, this statement works now and it is right.\n{ok}", ok, None),
        (11, q, f"यह कथन आपके प्रश्न में दिए गए स्थान और वर्ष के आँकड़े लौटाएगा।\n\n```sql\n{ok}\n```", ok, "other_language"), (12, q, "This counts every matching office and", None, "truncated"), (13, None, ok, ok, None), (14, "", "", "", "empty"),
        (15, q, "```sql\n" + ok, ok, None), (16, q, ok + " " * 20_000, ok, None), (4, q, None, None, None), (None, q, None, None, None),
    ]
    rows = [(i, a, b, c, "2025" if n < 16 else "2026", "x", 0) for n, (i, a, b, c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "eval_id long, question string, raw_output string, predicted_sql string, run_at string, q string, id int")
    schema = spark.createDataFrame([("fact_wells", "wells"), ("dim_district", "district_id")], "table_name string, column_name string")
    judged = lambda d: {r.id: r.defect for r in answers.judge(d, "eval_id", "question", "raw_output", "predicted_sql", "run_at", samples, schema).collect()}
    assert judged(df) == {i: d for i, _, _, _, d in cases if d}
    assert judged(df.limit(0)) == {}


def test_statement_that_usually_goes_on(spark, samples):
    whole, early = "SELECT COUNT(*) FROM fact_wells WHERE wells < 5", "SELECT COUNT(*) FROM fact_wells"
    rows = [(i, "?", whole, whole, None) for i in range(60)] + [(99, "?", early, early, None)]
    schema = spark.createDataFrame([("fact_wells", "wells")], "table_name string, column_name string")
    got = answers.judge(spark.createDataFrame(rows, "eval_id long, question string, raw_output string, predicted_sql string, run_at string"), "eval_id", "question", "raw_output", "predicted_sql", "run_at", samples, schema).collect()
    assert [tuple(r) for r in got] == [(99, "truncated")]


SENTENCES = ["The office counted {} wells during the last round of the year.", "Use the latest sheet when the totals for {} farms disagree.", "Some offices (e.g. Kotapur in the hill dist. of the north) still file {} by hand.", "How many clinics were counted in the year {} by the office?"]


def corpus(n=400, seed=2):
    rng, docs, cut = random.Random(seed), [], set()
    for i in range(n):
        text = " ".join(rng.choice(SENTENCES).format(rng.randint(10, 99_999)) for _ in range(rng.randint(2, 5)))
        if i % 10 == 0:
            at = len(text) - rng.choice([12, 17, 23, 28])
            text, _ = text[:at].rstrip() + rng.choice(["", "…", "...", "�"]), cut.add(i)
        docs.append((i, text, "English", "s", 1))
    return docs, cut


def test_truncation_on_planted_cuts(spark):
    docs, cut = corpus()
    docs += [(1000, None, "English", "s", 1), (1001, "", None, "s", 1), (1002, " \n", None, None, 1), (1003, "…", "English", "s", 1), (1004, docs[1][1].rstrip("."), "English", "s", 1)]
    got = {r.id for r in truncation.truncated(spark.createDataFrame(docs, "doc_id long, text string, lang string, id string, stop int"), "doc_id", "text", "lang").collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 2 and not got & {1000, 1001, 1002, 1003}
    assert truncation.truncated(spark.createDataFrame([], "doc_id long, text string, lang string"), "doc_id", "text", "lang").count() == 0


def test_thresholds_are_the_languages_own(spark, monkeypatch):
    """Ends of language A have lower odds, so its threshold is -4.5; a few low ends in B don't move its own."""
    rows = [(i, lang, mark, False, True, 9, odds) for lang, usual, low, first in (("A", -3.3, -3.3, 0), ("B", -2.0, -6.0, 1000)) for i, mark, odds in [*((first + i, "?", low if i < 10 else usual) for i in range(100)), (first + 500, "", -4.2), (first + 501, "", -4.6), (first + 502, ".", -4.2), (first + 503, ".", -4.6)]]
    scored = spark.createDataFrame(rows, "id long, language string, stop string, fragment boolean, full boolean, ends long, log_odds double")
    monkeypatch.setattr(truncation, "score", lambda *_: scored)
    assert sorted(r.id for r in truncation.truncated(scored, "id", "stop", "language").collect()) == [501, 503, 1500, 1501, 1502, 1503]


def test_context_counts_against_brute_force():
    docs, _ = corpus(30)
    known = frozenset(w for w, n in Counter(w for _, t, *_ in docs for w in truncation.words_of(t)).items() if n >= 3)
    model, tally = truncation.Model(known, frozenset(), frozenset()), truncation.Tally()
    ends, goes_on, last = Counter(), Counter(), {}
    whole = lambda s: int(model.rolling.ending_at(s, np.array([len(s)]), np.array([len(s)]))[0, 0])
    views = [model.view(t) for _, t, *_ in docs]
    finals = np.concatenate([model.count(views[a : a + 7], tally) for a in range(0, len(views), 7)])
    for (i, *_), v, final in zip(docs, views, finals):
        last[i] = list(final)
        text, at = "".join(v["pieces"]), 0
        for p in v["pieces"]:
            for j in model.inside.get(p, ()):
                for n in truncation.LENGTHS:
                    goes_on[whole(text[max(0, at + j - n) : at + j])] += 1
            at += len(p)
            if not p.isspace() and p != truncation.START_OF_TEXT:
                for n in truncation.LENGTHS:
                    if at < len(text):
                        goes_on[whole(text[max(0, at - n) : at])] += 1
                    elif v["counts"]:
                        ends[whole(text[max(0, at - n) : at])] += 1
        assert last[i] == [whole(text[max(0, len(text) - n) :]) for n in truncation.LENGTHS]
    got = tally.counts()
    assert {r.context: (r.ends, r.goes_on) for r in got.itertuples()} == {k: (ends[k], goes_on[k]) for k in ends | goes_on}
