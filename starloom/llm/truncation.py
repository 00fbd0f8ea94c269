"""Texts cut off before their end: a backward character n-gram model of where texts end.

Texts are masked: numbers become 0, words that make up less than `word_share` of all words become X, statements at the end become their
masked tokens. For every word end in the corpus, and for every
place inside a word where a shorter word would end, the characters before it, at seven lengths, are counted as followed by the end of the
text or by more text. A value's final context is looked up from the longest length down to one with enough support; its log-odds of
ending against going on, thresholded per language and column, tell whole texts from cut ones. An exact check follows: a last word that
is only the beginning of a known word, or a statement that is open by its own delimiters, is cut; a text that ends in a full stop is cut
only after what never ends a text (abbreviations), and one that ends in another sentence mark never.

Defined results: null, empty and blank texts, and texts without a word, are whole; marks of omission, replacement characters, semicolons and
closing fences after the last word are looked through; every copy of a cut text is reported; texts of any length are read whole; a null
language or source is a group of its own; ids must be unique.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.sizes import in_parts
from starloom.lineage import cut
from starloom.llm.sqltext import START, _begins, read, split_answer

#: Letters with their marks; the dandas between the Indic blocks are punctuation, their digits are digits.
LETTERS = "A-Za-zÀ-ɏʰ-ͯͰ-Ͽ҃-ԯऀ-ॣ॰-৥ৰ-੥ੰ-૥૰-୥୰-௥௰-౥౰-೥೰-൥൰-෿"
PIECE = re.compile(rf"[{LETTERS}]+|\d[\d,]*|\s+|.", re.S)
WORD = re.compile(rf"[{LETTERS}]")
WORDS, LAST_WORD = re.compile(rf"[{LETTERS}]+"), re.compile(rf"[{LETTERS}]+\Z")
LOOKED_THROUGH = re.compile(r"(?:\s|…|\.\.\.|�|```|;)+\Z")
CLOSING = re.compile(r"[\s.?!।॥\"'”’)\]]+\Z")
STOP = re.compile(r"[?!।॥.][\"'”’)\]\s]*\Z")
#: Stands before every text, so that a context which reaches back to the start is no other text's middle.
START_OF_TEXT = "\x02"
NOT_ENDS = frozenset((START_OF_TEXT, " ", "\n"))
LENGTHS = (48, 36, 24, 16, 10, 6, 4)
#: Place in LENGTHS of the context by which texts ending in a full stop are judged: short, so that abbreviations have full support.
AFTER_STOP = 4
WORD_SHARE = 2e-5
SUPPORT = 60


def pieces(text: str) -> list[str]:
    return PIECE.findall(text)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text)


class _Masks(dict):
    """Masked form of a piece, worked out on first use; forgotten when there are many."""

    def __init__(self, known: frozenset[str], most: int = 1 << 17) -> None:
        super().__init__()
        self.known, self.most = known, most

    def __missing__(self, p: str) -> str:
        if len(self) >= self.most:
            self.clear()
        out = "0" if p[0].isdigit() else ("\n" if "\n" in p else " ") if p.isspace() else "X" if WORD.match(p) and p not in self.known else p
        self[p] = out
        return out


class Rolling:
    """64-bit hashes of all substrings that end at given places, from prefix sums of character * base ** place (modulo 2 ** 64; an odd base has an inverse)."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                factors = np.full(2 * n + 1, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def ending_at(self, text: str, at: np.ndarray, lengths: np.ndarray, floor: np.ndarray | int = 0) -> np.ndarray:
        """Hash of text[max(floor, i - n) : i] for every i of `at`, each with its floor, and n of `lengths`."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.grow(len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.up[: len(codes)], dtype=np.uint64)])
        start = np.maximum(np.broadcast_to(floor, len(at))[:, None], at[:, None] - lengths[None, :])
        h = (sums[at][:, None] - sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


class Tally:
    """Counts of contexts, gathered as arrays and added up when there are many."""

    def __init__(self, most: int = 1 << 23) -> None:
        self.most, self.waiting, self.size = most, {"ends": [], "goes_on": []}, 0

    def add(self, kind: str, contexts: np.ndarray) -> None:
        self.waiting[kind].append(contexts.ravel())
        self.size += contexts.size

    def counts(self) -> pd.DataFrame:
        parts = []
        for kind, arrays in self.waiting.items():
            keys, n = np.unique(np.concatenate(arrays) if arrays else np.empty(0, np.int64), return_counts=True)
            parts.append(pd.DataFrame({"context": keys, kind: n}))
        self.waiting, self.size = {"ends": [], "goes_on": []}, 0
        return parts[0].merge(parts[1], on="context", how="outer").fillna(0).astype("int64")


class Model:
    """Masking and final contexts, given the known words and the names of a schema."""

    def __init__(self, known: frozenset[str], columns: frozenset[str], tables: frozenset[str]) -> None:
        self.known, self.columns, self.tables = known, columns, tables
        self.beginnings = {w[:i] for w in known for i in range(1, len(w))}
        # places inside known words where another known word ends: a text cut there goes on inside the word
        self.inside = {w: at for w in known if (at := [i for i in range(1, len(w)) if w[:i] in known])}
        self.rolling, self.lengths, self.masks = Rolling(), np.array(LENGTHS), _Masks(known)

    def mask(self, text: str) -> list[str]:
        return list(map(self.masks.__getitem__, pieces(text)))

    def statement_at_end(self, text: str) -> tuple[str, str] | None:
        """(text before, statement) if the text ends in a statement."""
        starts = [m for m in START.finditer(text) if _begins(text[m.end() :])]
        if not starts:
            return None
        # a statement of several lines starts where its first line does
        at = starts[0].start()
        for before, after in zip(starts, starts[1:]):
            if re.search(r"\n\s*\n|```|[.?!।]\s*\n", text[before.end() : after.start()]):
                at = after.start()
        statement, prose = split_answer(text[at:])
        return (text[:at], statement) if statement and not prose else None

    def view(self, text: str | None) -> dict | None:
        """Masked pieces up to the last word, and what the end looks like; None for texts without a word."""
        if text is None:
            return None
        body = LOOKED_THROUGH.sub("", text)
        found = self.statement_at_end(text)
        if found:
            s = read(LOOKED_THROUGH.sub("", found[1]) if not found[1].rstrip().endswith(")") else found[1], frozenset(), frozenset())
            s = read(" ".join(s.tokens), self.columns, self.tables) if self.columns else s
            tokens = [x for t in s.skeleton for x in (" ", t)]
            return {"pieces": [START_OF_TEXT, *self.mask(found[0]), "\n", *tokens], "stop": "", "fragment": s.broken, "counts": not s.broken}
        stop = STOP.search(body)
        inner = CLOSING.sub("", body)
        if not WORD.search(inner) and not any(map(str.isdigit, inner)):
            return None
        cells = pieces(inner)
        last = cells[-1]
        unknown = bool(WORD.match(last)) and last not in self.known
        mark = stop[0][0] if stop else ""
        return {"pieces": [START_OF_TEXT, *map(self.masks.__getitem__, cells)], "stop": mark, "fragment": unknown and not mark and (last[0].islower() or last in self.beginnings), "counts": bool(mark) or not unknown}

    def count(self, seen: list[dict], tally: Tally) -> np.ndarray:
        """Adds the contexts of texts to the tally, all texts laid end to end; returns those of each text's end."""
        cells = list(chain.from_iterable(x["pieces"] for x in seen))
        after = np.cumsum(list(map(len, cells)))
        last_cell = np.cumsum([len(x["pieces"]) for x in seen]) - 1
        ends = after[last_cell]
        begins, text = np.r_[0, ends[:-1]], np.repeat(np.arange(len(seen)), np.diff(np.r_[-1, last_cell]))
        masked = "".join(cells)
        word = ~np.fromiter(map(NOT_ENDS.__contains__, cells), bool, len(cells))
        at, of = after[word], text[word]
        contexts = self.rolling.ending_at(masked, at, self.lengths, begins[of])
        last = at == ends[of]
        tally.add("goes_on", contexts[~last])
        inner = np.array([(end - len(p) + i, begin) for p, end, begin in zip(cells, after.tolist(), begins[text].tolist()) if p in self.inside for i in self.inside[p]])
        if len(inner):
            tally.add("goes_on", self.rolling.ending_at(masked, inner[:, 0], self.lengths, inner[:, 1]))
        tally.add("ends", contexts[last & np.array([bool(x["counts"]) for x in seen])[of]])
        return self.rolling.ending_at(masked, ends, self.lengths, begins)


def _words(df: DataFrame, text: str) -> DataFrame:
    """(`word`, `n`, `bare`): occurrences, and those of them with which a text breaks off or ends without any mark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, bare = Counter(), Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame([(w, n, bare[w]) for w, n in counts.items()], columns=["word", "n", "bare"])

        for frame in frames:
            for t in frame["t"]:
                body = LOOKED_THROUGH.sub("", t)
                counts.update(words_of(body))
                if last := LAST_WORD.search(body):
                    bare[last[0]] += 1
                if len(counts) > 200_000:
                    yield out()
                    counts, bare = Counter(), Counter()
        yield out()

    rows = in_parts(df.select(F.col(text).alias("t"))).filter("t is not null").mapInPandas(run, "word string, n bigint, bare bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"))


def known_words(df: DataFrame, text: str, share: float = WORD_SHARE, least: int = 5) -> list[str]:
    """Words that make up at least `share` of all words and occur `least` times: 1 / share words at most.

    A word that mostly stands bare at the end of texts and is the beginning of a more frequent word is a fragment that many cuts left.
    """
    counts = cut(_words(df, text))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= max(least, share * total)).collect()
    most: dict[str, int] = {}
    for r in rows:
        for i in range(1, len(r.word)):
            most[r.word[:i]] = max(most.get(r.word[:i], 0), r.n)
    return [r.word for r in rows if not (2 * r.bare > r.n and most.get(r.word, 0) > r.n)]


def score(df: DataFrame, id_col: str, text: str, language: str, schema: DataFrame | None = None, most_chars: int = 1 << 19) -> DataFrame:
    """(`id`, `language`, `stop`, `fragment`, `length`, `ends`, `goes_on`, `log_odds`) of every text with a word; contexts are counted for about `most_chars` characters at a time."""
    spark = df.sparkSession
    names = schema.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct().limit(200_001).collect() if schema is not None else []
    if len(names) > 200_000:
        raise ValueError("more than 200,000 schema columns")
    shared = spark.sparkContext.broadcast((frozenset(known_words(df, text)), frozenset(r.c for r in names if r.c), frozenset(r.t for r in names if r.t)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Two kinds of rows from one masking of each text: counts of contexts (no `contexts`), and each text's end."""
        model, tally = Model(*shared.value), Tally()
        names = ["id", "language", "stop", "fragment", "own", "contexts", "context", "ends", "goes_on"]

        def tallies() -> pd.DataFrame:
            counts = tally.counts()
            nothing = pd.Series([None] * len(counts), dtype=object)
            return pd.DataFrame({n: counts[n] if n in counts else nothing for n in names})

        waiting, chars, rows = [], 0, []

        def counted() -> None:
            finals = model.count([seen for *_, seen in waiting], tally)
            rows.extend((key, lang, seen["stop"], bool(seen["fragment"]), int(seen["counts"]), end, None, None, None) for (key, lang, seen), end in zip(waiting, finals))
            waiting.clear()

        for frame in frames:
            for key, lang, t in zip(frame["id"], frame["language"], frame["t"]):
                if seen := model.view(t):
                    waiting.append((key, lang, seen))
                    chars += len(t)
                if chars > most_chars:
                    counted()
                    chars = 0
                    if tally.size > tally.most:  # as many contexts as 64 MB hold
                        yield tallies()
            if len(rows) >= 5000:
                yield pd.DataFrame(rows, columns=names)
                rows.clear()
        if waiting:
            counted()
        yield pd.DataFrame(rows, columns=names)
        yield tallies()

    texts = in_parts(df).select(F.col(id_col).alias("id"), F.col(language).cast("string").alias("language"), F.col(text).alias("t")).filter("t is not null")
    kind = texts.schema["id"].dataType.simpleString()
    both = cut(texts.mapInPandas(run, f"id {kind}, language string, stop string, fragment boolean, own int, contexts array<bigint>, context bigint, ends bigint, goes_on bigint"))
    counts = both.filter("context is not null").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    finals = both.filter("contexts is not null")
    keyed = finals.select("id", "language", "stop", "fragment", "own", F.posexplode("contexts").alias("place", "context"))
    # a text's own end says nothing about it
    found = keyed.join(counts, "context", "left").select("id", "language", "stop", "fragment", "place", (F.greatest(F.coalesce("ends", F.lit(0)) - F.col("own"), F.lit(0))).alias("e"), F.coalesce("goes_on", F.lit(0)).alias("c"))
    n = F.col("e") + F.col("c")
    # the longest context with full support, else the shortest that was seen three times
    rank = F.when((F.col("stop") == ".") & (F.col("place") == AFTER_STOP) & (n >= SUPPORT), F.lit(200)).when(n >= SUPPORT, 100 - F.col("place")).when(n >= 3, F.col("place"))
    best = found.withColumn("rank", F.coalesce(rank, F.lit(-1))).groupBy("id").agg(F.first("language").alias("language"), F.first("stop").alias("stop"), F.first("fragment").alias("fragment"), F.max(F.struct("rank", "place", "e", "c")).alias("b"))
    lengths = F.array(*[F.lit(x) for x in LENGTHS])
    return best.select("id", "language", "stop", "fragment", F.when(F.col("b.rank") >= 0, F.get(lengths, F.col("b.place"))).otherwise(0).alias("length"), (F.col("b.rank") > 50).alias("full"), F.col("b.e").alias("ends"), F.col("b.c").alias("goes_on"), F.when(F.col("b.rank") >= 0, F.log((F.col("b.e") + 0.5) / (F.col("b.c") + 1))).alias("log_odds"))


def truncated(df: DataFrame, id_col: str, text: str, language: str, schema: DataFrame | None = None, below_median: float = 1.2, least: float = -3.6, sparse: float = -2.3, after_abbreviation: float = -4.0) -> DataFrame:
    """(`id`, `log_odds`) of the cut texts.

    A language's threshold is the median of the log-odds of its texts that end in a sentence mark, less `below_median`, but between -5 and
    `least`; contexts without full support need `sparse`. Texts without a mark are left out of it, as cut ones are among them; a low
    percentile would be set by abbreviations before the full stop and by rare ends.
    A text that ends in a full stop is cut below its language's threshold and `after_abbreviation`.
    """
    scored = cut(score(df, id_col, text, language, schema))
    whole = scored.filter((F.col("stop") != "") & F.col("full"))
    limits = whole.groupBy("language").agg(F.greatest(F.lit(-5.0), F.least(F.lit(least), F.percentile_approx("log_odds", 0.5, 1000) - below_median)).alias("limit"))
    rows = scored.join(limits.withColumnRenamed("language", "_l"), F.col("language").eqNullSafe(F.col("_l")), "left").withColumn("limit", F.coalesce("limit", F.lit(least)))
    odds = F.col("log_odds")
    bare = F.col("fragment") | odds.isNull() | F.when(F.col("full"), odds < F.col("limit")).otherwise((odds < sparse) | (F.col("ends") == 0))
    after_stop = F.col("full") & (odds < F.least(F.col("limit"), F.lit(after_abbreviation)))
    is_cut = F.when(F.col("stop") == "", bare).when(F.col("stop") == ".", after_stop).otherwise(False)
    return rows.filter(is_cut).select("id", "log_odds")
