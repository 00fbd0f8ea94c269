"""Similarity, retrieval of examples, and greedy near-duplicate removal for question/statement pairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.sizes import broadcast_if_small, by_key
from starloom.functions.transforms import ascii_tokens, bigrams, unicode_tokens, word_list
from starloom.lineage import cut, written
from starloom.operators.profile import sequence_ratio

#: Words that carry no topic, and words of the survey domain.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "shall",
    "can", "of", "to", "in", "for", "on", "with", "at", "by",
    "from", "as", "into", "through", "during", "before", "after",
    "above", "below", "between", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "and", "but", "if", "or",
    "because", "until", "while", "what", "which", "who",
    "this", "that", "these", "those", "it", "its",
)
DOMAIN_WORDS = (
    "village", "district", "state", "population", "distance",
    "accessibility", "service", "road", "transport", "health",
    "education", "financial", "market", "civic", "rural",
)


class Encoder(Protocol):
    def encode(self, text: str) -> list[float]: ...


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def lexical(a: str, b: str, strict_reference: bool = False) -> Column:
    """0.6 Jaccard of tokens + 0.4 matching-blocks ratio. Strict tokens know only a-z and 0-9."""
    tokens = ascii_tokens if strict_reference else unicode_tokens
    return 0.6 * jaccard(tokens(F.col(a)), tokens(F.col(b))) + 0.4 * sequence_ratio(F.lower(F.col(a)), F.lower(F.col(b)))


def weighted_lexical(a: Column, b: Column, strict_reference: bool = False) -> Column:
    """0.4 Jaccard of content words + 0.35 overlap of domain words + 0.25 overlap of bigrams; 0 if either text has no content word.

    Strictly, two equal texts without a domain word score 0.65; otherwise the domain part is shared out where neither text has such words.
    """
    return _weighted(_words(word_list(a)), _words(word_list(b)), strict_reference)


def _words(w: Column) -> tuple[Column, Column, Column]:
    """Content words, domain words and bigrams of a list of words."""
    content = F.array_except(w, F.array(*map(F.lit, STOP_WORDS)))
    return content, F.array_intersect(content, F.array(*map(F.lit, DOMAIN_WORDS))), bigrams(w)


def _weighted(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], strict_reference: bool) -> Column:
    (ca, da, ga), (cb, db, gb) = a, b
    has = F.size(F.array_union(da, db)) > 0
    words, grams = jaccard(ca, cb), jaccard(ga, gb)
    full = 0.4 * words + 0.35 * jaccard(da, db) + 0.25 * grams
    score = full if strict_reference else F.when(has, full).otherwise((0.4 * words + 0.25 * grams) / 0.65)
    return F.when((F.size(ca) > 0) & (F.size(cb) > 0), score).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def similarity(df: DataFrame, a: str, b: str, out: str, make_encoder: Callable[[], Encoder] | None = None, strict_reference: bool = False) -> DataFrame:
    """Cosine of the two texts' vectors; where no encoder can be made or it fails on a row, their lexical similarity."""
    scored = df.withColumn(out, lexical(a, b, strict_reference))
    if make_encoder is None:
        return scored

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            encoder = make_encoder()
        except Exception:  # noqa: BLE001 - any failure means the lexical score
            encoder = None

        def one(text: str | None):
            try:
                return None if text is None or encoder is None else [float(x) for x in encoder.encode(text)]
            except Exception:  # noqa: BLE001
                return None

        for part in texts:
            yield part.map(one)

    both = scored.withColumns({"_va": vectors(F.col(a)), "_vb": vectors(F.col(b))})
    return both.withColumn(out, F.when(F.col("_va").isNotNull() & F.col("_vb").isNotNull(), cosine(F.col("_va"), F.col("_vb"))).otherwise(F.col(out))).drop("_va", "_vb")


def top_k(pairs: DataFrame, by: list[str], score: str, k: int, ties: list[str], least: float | None = None) -> DataFrame:
    """The k best rows of each group, at or above `least`: a window whose limit Spark applies before the shuffle too, so that each task sends k rows of a group."""
    rows = pairs if least is None else pairs.filter(F.col(score) >= least)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def cosine_top_k(queries: DataFrame, items: DataFrame, id_col: str, vector: str, k: int, least: float | None = None) -> DataFrame:
    """(`query_id`, `id`, `score`, `rank`): every item against a stated query set, which is broadcast if small; an item is never its own match."""
    q = broadcast_if_small(queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("_q")), 20_000)
    pairs = items.select(F.col(id_col).alias("id"), F.col(vector).alias("_v")).join(q, F.col("id") != F.col("query_id")).withColumn("score", F.round(cosine(F.col("_v"), F.col("_q")), 9)).drop("_q", "_v")
    return top_k(pairs, ["query_id"], "score", k, ["id"], least)


def _sets(df: DataFrame, db: str, id_col: str, words: DataFrame, tokens: Callable[[Column], Column], text: str) -> DataFrame:
    """(`id`, `db`, `n`, `ws`, `bits`): of each text its number of distinct words, those of them that `words` numbers, the rarest first, and the parity of these at 64 places."""
    each = df.select(F.col(id_col).alias("id"), F.col(db).alias("db"), F.array_distinct(tokens(F.col(text))).alias("t"))
    rows = each.select("id", "db", F.size("t").alias("n"), F.posexplode("t").alias("at", "word"))
    rows = rows.select("id", "word", *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("db", "n")]).join(words, "word", "left")
    sets = by_key(rows.select("id", "db", "n", "w"), "id").groupBy("id").agg(F.max("db").alias("db"), F.max("n").alias("n"), F.sort_array(F.collect_list("w")).alias("ws"))
    return cut(sets.withColumn("bits", F.expr("aggregate(ws, 0L, (s, w) -> s ^ shiftleft(1L, int(pmod(xxhash64(w), 64))))")))


def examples(
    target: DataFrame, pool: DataFrame, db: str, text: str, id_col: str, k: int, strict_reference: bool = False, levels: Sequence[float] = (0.8, 0.65, 0.5, 0.3, 0.0)
) -> DataFrame:
    """For each target the k most similar pool rows of other databases; ties by id. Ids are unique. Only rows with a shared token are given, never all with all.

    Level by level, the pairs at or above a score are found whole, until a target has k of them; the last level is 0, which takes every shared token. Of two sets at
    or above a score, the rarest shared token is among the first few of both, enough of either is left behind it, and few places of their bits differ, as each
    place that differs is a word of one set alone (these filters lose no pair). A pair is formed at its rarest shared token and scored there, so that nothing but the k best of a target in each task is shuffled.
    """
    tokens = ascii_tokens if strict_reference else unicode_tokens
    counts = pool.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = written(counts.orderBy("n", "word").select("word", F.monotonically_increasing_id().alias("w")))  # numbers in order of frequency
    right = _sets(pool, db, id_col, words, tokens, text)
    left = _sets(target, db, id_col, words, tokens, text).withColumnsRenamed({"id": "target_id", "db": "_da", "n": "_na", "ws": "_wa", "bits": "_ba"})
    right = right.withColumnsRenamed({"db": "_db", "n": "_nb", "ws": "_wb", "bits": "_bb"})

    def placed(sets: DataFrame, ws: str, n: str, at: str, level: float) -> DataFrame:
        """A row for each word that may be the rarest shared one; words without number come before all others."""
        unknown = F.col(n) - F.size(ws)
        first = F.least(F.size(ws), F.greatest(F.lit(0), F.col(n) - F.ceil(F.col(n) * level - 1e-6).cast("int") + 1 - unknown))
        return sets.select("*", F.posexplode(F.slice(F.col(ws), F.lit(1), first)).alias(at, "_w")).withColumn(at, F.col(at) + unknown)

    out = []
    for level in levels:
        a, b = placed(left, "_wa", "_na", "_pa", level), placed(right, "_wb", "_nb", "_pb", level).withColumnRenamed("_w", "_v")
        least = level / (1 + level) * (F.col("_na") + F.col("_nb")) - 1e-6
        enough = F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb")) >= least
        alike = F.size("_wa") + F.col("_nb") - F.bit_count(F.col("_ba").bitwiseXOR(F.col("_bb"))) >= 2 * least
        pairs = b.join(broadcast_if_small(a), (F.col("_w") == F.col("_v")) & (F.col("_da") != F.col("_db")) & enough & alike)
        pairs = pairs.withColumn("_both", F.array_intersect("_wa", "_wb")).filter(F.get("_both", F.lit(0)) == F.col("_w")).withColumn("_n", F.size("_both"))
        scored = pairs.select("target_id", "id", F.round(F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n")), 9).alias("score"))
        best = top_k(scored, ["target_id"], "score", k, ["id"], level)
        if level == 0:
            out.append(best)
            break
        best = cut(best)
        done = best.filter((F.col("rank") == k) & (F.col("score") >= level + 1e-8)).select("target_id")  # what is below the level can't tie with it
        out.append(best.join(done, "target_id", "left_semi"))
        left = cut(left.join(done, "target_id", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def diversified(scored: DataFrame, query: str, db: str, score: str, id_col: str, databases: int, per_database: int) -> DataFrame:
    """The best item of each database, the best `databases` of those, and then each one's next best items up to `per_database`."""
    ranked = scored.withColumn("_in_db", F.row_number().over(Window.partitionBy(query, db).orderBy(F.desc(score), id_col)))
    best = ranked.filter("_in_db = 1").withColumn("db_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), id_col))).filter(F.col("db_rank") <= databases)
    keep = best.select(F.col(query).alias("_q"), F.col(db).alias("_d"), "db_rank")
    out = ranked.filter(F.col("_in_db") <= per_database).join(keep, (F.col(query) == F.col("_q")) & (F.col(db) == F.col("_d")))
    return out.drop("_q", "_d").withColumnRenamed("_in_db", "rank_in_db")


def usable_evidence(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "") & (F.lower(F.trim(c)) != "false;")


def one_shot(pool: DataFrame, db_col: str, target_db: str, id_col: str, seed: int = 7) -> DataFrame:
    """One row of another database, by a seeded hash."""
    return pool.filter(F.col(db_col) != target_db).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))), id_col).limit(1)


def schema_values(question: str, columns: list[tuple[str, str]], most: int = 12, values: int = 2) -> list[tuple[str, str, str]]:
    """Table, column and quoted value candidates of a question: columns by shared words with the question, at most `most` x `values`."""
    words = set(re.findall(r"\w+", question.lower()))
    quoted = [a or b for a, b in re.findall(r"'([^']+)'|\"([^\"]+)\"", question)][:values]
    ranked = sorted(columns, key=lambda tc: (-len(words & set(re.split(r"[_\W]+", f"{tc[0]}_{tc[1]}".lower()))), tc))[:most]
    return [(t, c, v) for t, c in ranked for v in quoted]


def greedy_duplicates(pairs: list[tuple], similar, threshold: float = 0.95) -> list[tuple]:
    """Keeps a pair unless it is similar to a kept one: order-dependent, so it runs over one block (a database's candidates) at a time."""
    kept: list[tuple] = []
    for p in pairs:
        if not any(similar(p, k) > threshold for k in kept):
            kept.append(p)
    return kept


def greedily_dropped(edges: DataFrame) -> DataFrame:
    """(`id`) of the nodes that a greedy pass in id order drops; `edges` (`rep`, `rep2`) lead from lower to higher ids.

    In each round the nodes without an undecided lower neighbour are kept and their neighbours dropped. Every round decides the lowest
    undecided id at least; the number of rounds is that of the longest chain of decisions.
    """
    edges, out = cut(edges), []
    while not edges.isEmpty():
        kept = edges.select("rep").distinct().join(edges.select(F.col("rep2").alias("rep")), "rep", "left_anti")
        dropped = cut(edges.join(kept, "rep").select(F.col("rep2").alias("id")).distinct())
        out.append(dropped)
        edges = cut(edges.join(dropped, F.col("rep") == F.col("id"), "left_anti").join(dropped, F.col("rep2") == F.col("id"), "left_anti"))
    return reduce(DataFrame.unionByName, out) if out else edges.select(F.col("rep2").alias("id"))


def near_duplicates(df: DataFrame, block: str, id_col: str, text: str, other: str, threshold: float = 0.95, strict_reference: bool = False) -> DataFrame:
    """Ids of the pairs whose text and other text are both near those of an earlier kept pair of the block, in id order.

    Words are worked out once a pair of texts, as 64-bit hashes. A score above the threshold needs four fifths of the bigrams of both in common, so candidates
    share one of each text's rarest few (a prefix filter, which loses none) and are of near sizes; each is then scored with the weighted lexical similarity.
    """
    base = df.select(F.col(block).alias("b"), F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(other).alias("o"))
    # one representative a distinct pair of texts; its copies are near it by definition (unless strict, see weighted_lexical)
    reps = base.groupBy("b", "t", "o").agg(F.min("id").alias("rep"))
    hashed = lambda words: F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))
    shape = lambda c: F.struct(*[hashed(x).alias(n) for n, x in zip("cdg", _words(c))])
    parts = reps.withColumns({"_tw": word_list(F.col("t")), "_ow": word_list(F.col("o"))}).select("b", "rep", "t", "o", shape(F.col("_tw")).alias("ft"), shape(F.col("_ow")).alias("fo"))
    of = lambda c: tuple(F.col(f"{c}.{n}") for n in "cdg")
    parts = cut(parts)
    own = (_weighted(of("ft"), of("ft"), strict_reference) > threshold) & (_weighted(of("fo"), of("fo"), strict_reference) > threshold)
    copies = base.join(parts.filter(own).select("b", "t", "o", "rep"), ["b", "t", "o"]).filter("id <> rep").select("id")
    grams = parts.select("b", "rep", F.size("ft.g").alias("m"), F.explode("ft.g").alias("g"))
    counts = grams.groupBy("b", "g").agg(F.count("*").alias("df"))
    prefix = grams.join(counts.filter("df > 1"), ["b", "g"], "left").withColumn("r", F.row_number().over(Window.partitionBy("b", "rep").orderBy("df", "g")))
    prefix = cut(prefix.filter((F.col("r") <= F.col("m") - F.ceil(F.col("m") * 0.8) + 1) & F.col("df").isNotNull()).select("b", "g", "rep", "m"))
    right = prefix.select("b", "g", F.col("rep").alias("rep2"), F.col("m").alias("m2"))
    near = (F.col("rep") < F.col("rep2")) & (F.least("m", "m2") >= 0.8 * F.greatest("m", "m2"))
    pairs = prefix.join(right, ["b", "g"]).filter(near).select("rep", "rep2").distinct()
    close = pairs.join(parts.select("rep", "ft", "fo"), "rep").join(parts.select(F.col("rep").alias("rep2"), F.col("ft").alias("ft2"), F.col("fo").alias("fo2")), "rep2")
    close = close.filter(_weighted(of("ft"), of("ft2"), strict_reference) > threshold).filter(_weighted(of("fo"), of("fo2"), strict_reference) > threshold)
    return copies.unionByName(greedily_dropped(close.select("rep", "rep2"))).distinct()
