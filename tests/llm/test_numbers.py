"""Percentiles, cutoffs, encoding and mixing."""

import math
import random
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom import lineage
from starloom.llm import cutoffs, mixing, quantiles, tokens


@pytest.mark.parametrize("order", ["random", "sorted", "equal"])
def test_sketch_keeps_its_bound_over_merges(order):
    rng = np.random.default_rng(1)
    values = {"random": rng.normal(size=200_000), "sorted": np.arange(200_000.0), "equal": np.ones(200_000)}[order]
    parts = [quantiles.Sketch(256, 3).add(p) for p in np.array_split(values, 37)]
    whole = quantiles.Sketch.unpack(parts[0].pack())
    for p in parts[1:]:
        whole.merge(quantiles.Sketch.unpack(p.pack()))
    assert whole.n == len(values) and sum(map(len, whole.levels)) < 4000
    ranks = np.sort(values)
    for q in (0.01, 0.25, 0.5, 0.9, 0.999):
        x = whole.quantiles([q])[0]
        low, high = np.searchsorted(ranks, x, "left") / len(values), np.searchsorted(ranks, x, "right") / len(values)
        assert low - quantiles.rank_error(256) <= q <= high + quantiles.rank_error(256)
    assert whole.quantiles([0, 1]) == [values.min(), values.max()]


def test_percentiles_by_group(spark):
    rows = [("a", float(x), "d1") for x in range(101)] + [("b", 5.0, "d1")] * 7 + [(None, 1.0, "d2"), ("c", None, "d1"), ("c", float("nan"), "d1"), ("a", float("inf"), "d2")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, v double, day string, sketch int")
    parts = quantiles.sketches(df, {"g": F.col("g"), "day": F.col("day")}, F.col("v"))
    got = {r.g: r for r in quantiles.percentiles(quantiles.merged(parts, ["g"]), [0.0, 0.5, 0.995]).collect()}
    assert set(got) == {"a", "b", None} and got["a"].n == 102 and got["a"].p50 == 50.0 and got["a"].p0 == 0.0 and got["a"].high == math.inf
    assert (got["b"].p50, got["b"].n, got[None].p50, got["a"].rank_error) == (5.0, 7, 1.0, 0.0)
    days = quantiles.percentiles(quantiles.merged(parts, ["g", "day"]), [0.5])
    assert days.count() == 4
    assert quantiles.percentiles(quantiles.merged(quantiles.sketches(df.limit(0), {"g": F.col("g")}, F.col("v")), ["g"]), [0.5]).count() == 0
    # small buffers flush in the middle: the same answers within the bound
    small = quantiles.sketches(df, {"g": F.col("g")}, F.col("v"), buffer_rows=5, held_values=3)
    assert {r.g: r.n for r in quantiles.merged(small, ["g"]).collect()} == {"a": 102, "b": 7, None: 1}


@given(st.lists(st.tuples(st.sampled_from(["a", "b", None, "z"]), st.one_of(st.none(), st.just(float("nan")), st.integers(-3, 3).map(float))), max_size=40), st.sampled_from([0.0, 0.1, 0.5, 0.8, 1.0]))
@settings(max_examples=6, deadline=None)
def test_cutoffs_against_brute_force(spark, rows, share):
    df = spark.createDataFrame([(s, v, 1, "x") for s, v in rows], "s string, v double, part int, source string")
    goals = spark.createDataFrame([("a", share), ("b", 0.5), ("none", 0.5), (None, 0.5)], "s string, f double")
    got = {r.source: r for r in cutoffs.cutoffs(df, "s", "v", goals, "s", "f").collect()}
    assert set(got) == {"a", "b", "none"}
    for s, f in (("a", share), ("b", 0.5), ("none", 0.5)):
        vs = sorted((v for x, v in rows if x == s and v is not None and not math.isnan(v)), reverse=True)
        k = min(len(vs), math.ceil(f * len(vs) - 1e-9))
        cut = vs[k - 1] if k else None
        kept = sum(v >= cut for v in vs) if k else 0
        assert (got[s].scored, got[s].cutoff, got[s].kept) == (len(vs), cut, kept)
        assert got[s].actual_fraction == (kept / len(vs) if vs else None)
    keep = cutoffs.kept_rows(df, "s", "v", spark.createDataFrame([tuple(r) for r in got.values()], "source string, target_fraction double, scored long, cutoff double, kept long, actual_fraction double"))
    assert keep.count() == sum(r.kept for r in got.values())


TEXTS = [
    None, "", " ", "Hello  world!  it's", "don't won't they'll I'VE we'd.", "\t\tcol_a\r\n1\t2\r\n.", "áé ​﻿ zero.", "𝟙𝟚𝟛 🛰️🚰🏫 — 👍🏽.", "\x00nul and \x07bell.", "    indented\n\n\n\n        deeper.", "  trailing   ", "<|endoftext|>", "a b　c d\x85e\x1cf",
    "தமிழ் मराठी বাংলা తెలుగు", "word " * 5000, "x=1;;;y<>2 || z!=3 -- ok.", "Hello  world!  it's",
]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("hot", [1e-4, 0.02, 0.9])
def test_encoding_round_trip(spark, hot):
    rows = [(i, t, "w", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, pos int")
    got = tokens.encode(df, "doc_id", "text", hot_share=hot)
    expected = sorted(zip([r[0] for r in rows], reference_ids([r[1] for r in rows])))
    assert sorted((r.doc_id, list(r.ids)) for r in got.collect()) == expected
    back = tokens.decode(got.dropDuplicates(["doc_id"]), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    sizes = tokens.token_counts(df, ["doc_id"], "text", hot_share=hot)
    assert sorted((str(r.doc_id), r.tokens) for r in sizes.collect()) == sorted((str(i), len(x)) for i, x in expected)
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_blocks_of_many_texts_are_read_one_at_a_time(spark):
    """Sixty texts of 60,000 words in one task: neither a row nor a row group nor a batch for Python may grow with them."""
    texts = spark.range(60, numPartitions=1).selectExpr("id as _key", "array_join(transform(sequence(1, 60000), x -> string(pmod(xxhash64(x, id), 50000))), ' ') as t")
    coded = tokens._coded(texts, ["_key"])
    assert coded.select(F.sum(F.size("_key"))).first()[0] == 60 and coded.select(F.max(F.size("_key"))).first()[0] <= 3  # rows end after the text that fills them
    groups = [file.metadata.row_group(i) for file in map(pq.ParquetFile, (unquote(urlparse(f).path) for f in coded.inputFiles())) for i in range(file.metadata.num_row_groups)]
    assert max(g.total_byte_size for g in groups) <= 2 * lineage.WIDE_BYTES
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    assert lineage.written(coded.mapInArrow(sizes, "n long")).agg(F.max("n")).first()[0] <= 2 * lineage.WIDE_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"


def test_token_counts_of_many_texts_are_worked_out_block_by_block(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(tokens, "written", lambda *a, **k: kept.append(lineage.written(*a, **k)) or kept[-1])
    texts = spark.range(40, numPartitions=1).coalesce(1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 60000), x -> string(pmod(xxhash64(x, id), 50000))), ' ') as text")
    monkeypatch.setattr(tokens, "in_parts", lambda df: df)
    got = {r.doc_id: r.tokens for r in tokens.token_counts(texts, ["doc_id"], "text").collect()}
    some = texts.filter("doc_id in (0, 39)").collect()
    assert len(got) == 40 and [got[r.doc_id] for r in some] == list(map(len, reference_ids([r.text for r in some])))
    files = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in kept[0].inputFiles()]
    assert max(file.row_group(i).total_byte_size for file in files for i in range(file.num_row_groups)) <= lineage.WIDE_BYTES * 2 and max(file.num_rows for file in files) >= 10


def test_token_counts_keep_rows_small_whatever_a_text_has_of_rare_words(spark, monkeypatch):
    """Twelve texts of 20,000 words that no other one has: only the blocks, which have bounded row groups, may have wide rows."""
    kept = []
    monkeypatch.setattr(tokens, "written", lambda df, wide=False: kept.append((lineage.written(df, wide), wide)) or kept[-1][0])
    long = spark.range(12).selectExpr("id as doc_id", "array_join(transform(sequence(1, 20000), x -> string(100000 * (id + 1) + x)), ' ') as text")
    texts = long.union(spark.createDataFrame([(12, None), (13, ""), (14, "some some word")], "doc_id long, text string"))
    got = {r.doc_id: r.tokens for r in tokens.token_counts(texts, ["doc_id"], "text").collect()}
    some = texts.collect()
    assert len(got) == 15 and [got[r.doc_id] for r in some] == list(map(len, reference_ids([r.text or "" for r in some])))
    for df in (df for df, wide in kept if not wide):
        groups = [file.metadata.row_group(i) for file in map(pq.ParquetFile, (unquote(urlparse(f).path) for f in df.inputFiles())) for i in range(file.metadata.num_row_groups)]
        assert max(g.total_byte_size / g.num_rows for g in groups) < 10_000


def spread(node, budget):
    """Gives `budget` to a node {weight, room, children} and down its tree, round by round: what a child cannot use goes to its siblings."""
    node["budget"] = left = min(budget, node["room"])
    children, shares = node["children"], [0.0] * len(node["children"])
    open_ = list(range(len(children)))
    while open_ and left > 1e-9:
        total = sum(children[i]["weight"] for i in open_)
        full = [i for i in open_ if shares[i] + left * children[i]["weight"] / total >= children[i]["room"]]
        if not full:
            for i in open_:
                shares[i] += left * children[i]["weight"] / total
            break
        for i in full:
            left -= children[i]["room"] - shares[i]
            shares[i] = children[i]["room"]
        open_ = [i for i in open_ if i not in full]
    for child, share in zip(children, shares):
        spread(child, share)


def brute_budgets(leaves, weights, repeats, budget):
    of_name = Counter()
    for path, tokens in leaves:
        of_name[path[-1]] += tokens

    def node(prefix):
        below = [(p, n) for p, n in leaves if p[: len(prefix)] == prefix]
        names = list(dict.fromkeys(p[len(prefix)] for p, _ in below)) if len(prefix) < len(leaves[0][0]) else []
        return {"path": prefix, "weight": sum(weights[p[-1]] * n / of_name[p[-1]] for p, n in below), "room": sum(n * repeats[p[-1]] for p, n in below), "children": [node((*prefix, x)) for x in names]}

    root = node(())
    spread(root, budget)
    out = {}

    def walk(n):
        if not n["children"]:
            out[n["path"]] = n["budget"]
        for child in n["children"]:
            walk(child)

    walk(root)
    return out


def test_budgets_give_shortages_to_siblings_first(spark):
    goals = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.4, 1)]
    weights, repeats = {s: w for s, w, _ in goals}, {s: r for s, _, r in goals}
    targets = spark.createDataFrame(goals, "source string, target_share double, max_repeats int")
    rng = random.Random(3)
    paths = [(d, x, s) for d in ("x", "y", None, "") for x in ("en", "hi", None) for s in "abc" if rng.random() < 0.7]
    leaves = [(p, rng.choice([3, 10, 200, 5000])) for p in paths]
    df = spark.createDataFrame([(i, *p, n) for i, (p, n) in enumerate(leaves)], "id int, domain string, lang string, source string, size int")
    levels = ["domain", "lang", "source"]
    rows = mixing.sized_rows(df, "id", "size", levels, targets, "source")
    room = sum(n * repeats[p[-1]] for p, n in leaves)
    for budget in (50.0, 0.4 * room, 0.8 * room, 2.0 * room):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(rows, levels, "source", budget).collect()}
        want = brute_budgets(leaves, weights, repeats, budget)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 * room for k in want)
    # the default meets every target that has rows
    of = {s: sum(n for p, n in leaves if p[-1] == s) for s in "abc"}
    total = sum(r.budget for r in mixing.budgets(rows, levels, "source").collect())
    assert abs(total - min(of[s] * repeats[s] / weights[s] for s in of)) < 1e-6 * total
    # a null name and an empty one stay apart
    assert {r.domain for r in mixing.mix(df, "id", "size", levels, targets, "source", 2.0 * room).collect()} == {p[0] for p in paths}


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["big", "big", "big", "small", "other", None]), rng.choice(["en", "hi", None]), rng.randint(1, 40), 0) for i in range(3000)] + [(9000, "small", "en", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long, uses int")
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    run = lambda **k: mixing.mix(df.drop("uses"), "doc_id", "tokens", ["source", "lang"], goals, "source", **k)
    got = {r.doc_id: r for r in run().collect()}
    own = {r[0]: r for r in rows}
    assert all(own[i][1] == r.source and own[i][3] == r.tokens and 1 <= r.uses <= {"big": 1, "small": 3}[r.source] for i, r in got.items())
    total = {s: sum(r.tokens * r.uses for r in got.values() if r.source == s) for s in ("big", "small")}
    assert abs(total["big"] / sum(total.values()) - 0.5) < 0.01
    full = {s: sum(r[3] for r in rows if r[1] == s) for s in ("big", "small")}
    assert abs(sum(total.values()) - min(full["big"] / 0.5, 3 * full["small"] / 0.5)) < 200
    # the same seed gives the same records whatever the buckets; a larger budget extends a smaller one
    assert {i: r.uses for i, r in got.items()} == {r.doc_id: r.uses for r in run().collect()}
    less = {r.doc_id for r in run(budget=3000, rows_per_bucket=50).collect()}
    more = {r.doc_id for r in run(budget=6000, rows_per_bucket=50).collect()}
    assert less and less <= more
    report = {r.source: r for r in mixing.report(run(), goals, "source").collect()}
    assert report["absent"].tokens == 0 and report["big"].most_uses == 1 and report["small"].records == len([r for r in got.values() if r.source == "small"])
    assert mixing.mix(df.limit(0).drop("uses"), "doc_id", "tokens", ["source", "lang"], goals, "source").count() == 0
