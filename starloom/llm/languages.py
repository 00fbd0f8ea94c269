"""Languages of texts and of mixed-language segments, by cross-parsing entropy.

A suffix automaton of labelled text per language yields, for every position of a text, the longest match that ends there. A text that
is parsed into longest matches needs about the sum of the reciprocal match lengths in phrases; the language that needs the fewest wins. As that
sum is additive over words, mixed texts are cut by the cheapest path over words and languages, with a price for each change of
language. Segments shorter than `LEAST_WORDS` words (names, quoted values, column names, short terms) join a neighbour, unless marks set them apart as a clause
of their own. The language of each segment is then the one whose automaton parses it into the fewest phrases, normalised: phrases times the
logarithm of the language's labelled text, by the segment's length, is what a character costs in bits.

All texts of a batch are walked together (automata.Walkers), equal ones once; the automata are built once, on the driver.

Defined results: null, empty and blank texts, and texts without a letter, give no segment; whole texts are parsed, however long (phrases start anew every
`PIECE` characters of a segment); texts are brought to their clean form first; equal costs go to the first language by name. Confidence is the second best
language's bits as a share of the best two's, where no language at all costs `UNKNOWN` bits: it is below a half where the best one explains no more than that.
A segment whose letters mostly belong to scripts of no labelled language is `und`, with confidence 0.
Labelled text is cut at `most_chars` characters a language, the bound of what is fitted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.automata import Walkers
from starloom.llm.skeleton import clean

MOST_CHARS = 200_000
SWITCH = 3.0
LEAST_WORDS = 4
#: A position that matches nothing costs so many phrases.
UNSEEN = 1.5
LONGEST = 24
#: Bits a character that is not compressed at all.
UNKNOWN = 8.0
NO_LANGUAGE = "und"
#: Texts are walked in blocks of so many characters, after the LONGEST before them; phrases of a segment are counted in pieces.
BLOCK, PIECE = 512, 2048
#: Words and marks that set clauses apart.
APART = re.compile(r"[/|–—;:-]+\Z")
CLOSES = re.compile(r"[.?!।॥][\"'”’)\]]*\Z")
CLOSES_INSIDE = re.compile(r"[.?!।॥][\"'”’]*[)\]]")


def plain(text: str) -> str:
    """Clean form, lower case, every digit 0, single spaces."""
    text = clean(text).lower()
    return re.sub(r"\s+", " ", re.sub(r"\d", "0", text)).strip()


class Languages:
    def __init__(self, samples: dict[str, list[str]], most_chars: int = MOST_CHARS) -> None:
        self.names = sorted(samples)
        texts = {name: "\n".join(map(plain, samples[name]))[:most_chars] for name in self.names}
        self.walkers = Walkers(texts)
        self.letters: dict[str, set[int]] = {}
        for name, text in texts.items():
            seen: dict[int, int] = {}
            for ch in text:
                if ch.isalpha():
                    seen[self.script(ch)] = seen.get(self.script(ch), 0) + 1
            # scripts that make up a quarter of the language's letters
            self.letters[name] = {s for s, n in seen.items() if 4 * n >= sum(seen.values())}

    @staticmethod
    def script(ch: str) -> int:
        """Latin, or the Unicode block of 128 that holds the letter."""
        return 0 if ch < "Ͱ" or "Ḁ" <= ch < "ἀ" else ord(ch) >> 7

    def segments(self, text: str | None) -> list[tuple[str, float, str]]:
        """(language, confidence, segment's text in plain form) from left to right."""
        return self.segments_of([text])[0]

    def segments_of(self, texts: list[str | None], most_chars: int = 1 << 19) -> list[list[tuple[str, float, str]]]:
        """The segments of each text; equal texts are worked on once, and about `most_chars` characters at a time."""
        given = {t: plain(t) for t in texts if t is not None}
        distinct = list(dict.fromkeys(p for p in given.values() if any(map(str.isalpha, p))))
        found: dict[str, list] = {}
        first = size = 0
        for i, p in enumerate(distinct, 1):
            size += len(p)
            if size >= most_chars or i == len(distinct):
                found.update(zip(distinct[first:i], _Batch(self, distinct[first:i]).segments()))
                first, size = i, 0
        return [[] if t is None else found.get(given[t], []) for t in texts]


class _Batch:
    """Plain texts, none of them empty, laid end to end."""

    def __init__(self, languages: Languages, texts: list[str]) -> None:
        self.of, self.texts, self.names = languages, texts, languages.names
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sizes = np.array([len(t) for t in texts])
        self.starts, self.ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        self.number = languages.walkers.numbers(codes)
        # letters and their scripts, looked up once for each character that occurs
        present = np.flatnonzero(np.bincount(codes))
        alpha, script = np.zeros(present[-1] + 1, bool), np.full(present[-1] + 1, -1)
        for c in present.tolist():
            if (ch := chr(c)).isalpha():
                alpha[c], script[c] = True, languages.script(ch)
        self.alpha, script = alpha[codes], script[codes]
        known = [np.isin(script, list(languages.letters[n])) for n in self.names]
        self.near = np.array([np.add.reduceat(k, self.starts, dtype=np.int64) > 0 for k in known]).reshape(len(known), len(texts))  # language by text
        self.strange = self.alpha & ~np.logical_or.reduce([np.zeros(len(codes), bool), *known])
        space = codes == 32
        edge = np.zeros(len(codes) + 1, bool)
        edge[self.starts] = edge[-1] = True
        before = np.r_[True, space[:-1]] | edge[:-1]
        after = np.r_[space[1:], True] | edge[1:]
        self.word_starts, self.word_ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        self.word_of = np.searchsorted(self.ends, self.word_starts, side="right")
        self.first_word = np.searchsorted(self.word_of, np.arange(len(texts) + 1))
        self.solid = np.add.reduceat(self.alpha, self.word_starts, dtype=np.int64) > 0

    def costs(self) -> np.ndarray:
        """Phrases by language and word; infinite for languages whose script doesn't occur in the text. The last row stands for no language."""
        blocks = [np.arange(a, b, BLOCK) for a, b in zip(self.starts, self.ends)]
        text = np.repeat(np.arange(len(blocks)), list(map(len, blocks)))
        at = np.concatenate(blocks)
        which, lane = np.nonzero(self.near[:, text])
        spans = np.c_[np.maximum(self.starts[text], at - LONGEST), np.minimum(self.ends[text], at + BLOCK)][lane]
        used = np.flatnonzero(self.near.any(axis=1))  # one row for each language whose script occurs at all
        row = np.searchsorted(used, np.arange(len(self.names)))
        each = np.full((len(used) + 1, len(self.number)), UNSEEN, dtype=np.float32)
        price = np.r_[UNSEEN, 1 / np.arange(1, LONGEST + 1)].astype(np.float32)

        # a block's first places are walked again by the block before, whose longer matches come later and stay
        def put(which: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> None:
            each[row[which], places] = np.minimum(each[row[which], places], price[lengths])

        self.of.walkers.matches(self.number, spans, which, LONGEST, put)
        each[-1] = np.where(self.strange, 0.1, np.where(self.alpha, 1.0, 0.25))
        each = np.concatenate([each, np.zeros((len(each), 1), np.float32)], axis=1)
        out = np.full((len(self.names) + 1, len(self.word_starts)), np.inf)
        out[[*used, -1]] = np.add.reduceat(each, np.c_[self.word_starts, self.word_ends].ravel(), axis=1)[:, ::2]
        strange = np.add.reduceat(self.strange, self.starts, dtype=np.int64) > 0
        out[~np.concatenate([self.near, strange[None]])[:, self.word_of]] = np.inf
        return out

    def path(self, costs: np.ndarray) -> np.ndarray:
        """The language of each word on each text's cheapest path; of equals the first by name."""
        words = np.diff(self.first_word)
        order = np.argsort(-words, kind="stable")
        first, words = self.first_word[:-1][order], words[order]
        going = np.searchsorted(-words, -np.arange(words[0]), side="left")  # texts with more than k words
        total, back = costs[:, first].T.copy(), []
        for k, n in enumerate(going[1:], 1):
            cheapest = np.argmin(total[:n], axis=1)
            change = total[np.arange(n), cheapest] + SWITCH
            stays = total[:n] <= change[:, None]
            total[:n] = np.where(stays, total[:n], change[:, None]) + costs[:, first[:n] + k].T
            back.append((stays, cheapest))
        label = np.argmin(total, axis=1)
        out = np.empty(len(self.word_starts), np.int64)
        out[first + words - 1] = label
        for k in range(len(going) - 1, 0, -1):
            stays, cheapest = back[k - 1]
            n = len(cheapest)
            label[:n] = np.where(stays[np.arange(n), label[:n]], label[:n], cheapest)
            out[first[:n] + k - 1] = label[:n]
        return out

    def segments(self) -> list[list[tuple[str, float, str]]]:
        costs = self.costs()
        label = self.path(costs)
        change = np.r_[True, (label[1:] != label[:-1]) | (self.word_of[1:] != self.word_of[:-1])]
        at = np.flatnonzero(change)
        runs = np.c_[at, np.r_[at[1:], len(label)], label[at]]
        per_text = np.split(runs, np.searchsorted(self.word_of[at], np.arange(1, len(self.texts))))
        runs = [[tuple(r) for r in part.tolist()] if len(part) == 1 else self.merged([tuple(r) for r in part.tolist()], costs) for part in per_text]
        judged = self.best([r for part in runs for r in part])
        runs = [self.joined([(a, b, judged[a, b][0]) for a, b, _ in part]) for part in runs]
        judged |= self.best([r for part in runs for r in part if (r[0], r[1]) not in judged])
        out = []
        for i, part in enumerate(runs):
            text, base = self.texts[i], self.starts[i]
            names = [(*judged[a, b], text[self.word_starts[a] - base : self.word_ends[b - 1] - base]) for a, b, _ in part]
            out.append([(self.names[k] if k < len(self.names) else NO_LANGUAGE, c, t) for k, c, t in names])
        return out

    def merged(self, runs: list[tuple[int, int, int]], costs: np.ndarray) -> list[tuple[int, int, int]]:
        """The shortest segment joins the neighbour whose language parses it best, until all are long enough or clauses of their own."""
        while len(runs) > 1:
            counts = [int(self.solid[a:b].sum()) for a, b, _ in runs]
            short = [i for i, (a, b, _) in enumerate(runs) if counts[i] < LEAST_WORDS and not (counts[i] > 1 and self.clause(a, b))]
            if not short:
                break
            i = min(short, key=lambda i: counts[i])
            a, b, _ = runs[i]
            j = min((j for j in (i - 1, i + 1) if 0 <= j < len(runs)), key=lambda j: costs[runs[j][2], a:b].sum())
            lo, hi = sorted((i, j))
            runs[lo : hi + 1] = [(runs[lo][0], runs[hi][1], runs[j][2])]
            runs = self.joined(runs)
        return runs

    def clause(self, a: int, b: int) -> bool:
        """Whether the words from a to b stand between the ends of clauses."""
        text, base = self.texts[self.word_of[a]], self.starts[self.word_of[a]]
        word = lambda i: text[self.word_starts[i] - base : self.word_ends[i] - base]
        while a < b and not self.solid[a]:
            a += 1
        while a < b and not self.solid[b - 1]:
            b -= 1
        lo, hi = self.first_word[self.word_of[a]], self.first_word[self.word_of[a] + 1]
        if word(a)[0] in "([":  # a term in brackets is none; a clause has its own mark in them
            return bool(CLOSES_INSIDE.search(word(b - 1)))
        begins = a == lo or bool(APART.match(word(a - 1)) or CLOSES.search(word(a - 1)))
        ends = b == hi or bool(CLOSES.search(word(b - 1)) or APART.match(word(b))) or word(b)[0] in "(["
        return begins and ends

    @staticmethod
    def joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for a, b, name in runs:
            if out and out[-1][2] == name:
                out[-1] = (out[-1][0], b, name)
            else:
                out.append((a, b, name))
        return out

    def best(self, runs: list[tuple[int, int, int]]) -> dict[tuple[int, int], tuple[int, float]]:
        """The language that needs the fewest bits a character for each run of words, and the confidence; of equals the given one."""
        if not runs:
            return {}
        a, b, given = np.array(runs).T
        begin, end = self.word_starts[a], self.word_ends[b - 1]
        which, lane = np.nonzero(self.near[:, self.word_of[a]])
        pieces = [np.arange(x, y, PIECE) for x, y in zip(begin[lane], end[lane])]
        owner = np.repeat(np.arange(len(lane)), list(map(len, pieces)))
        at = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        counts = self.of.walkers.phrases(self.number, np.c_[at, np.minimum(end[lane][owner], at + PIECE)].astype(np.int64), which[owner])
        bits = np.full((len(self.names), len(runs)), np.inf)
        bits[which, lane] = np.bincount(owner, counts, minlength=len(lane)) * np.log2(self.of.walkers.sizes[which]) / (end - begin)[lane]
        letters, strange = (np.add.reduceat(np.r_[x, False], np.c_[begin, end].ravel(), dtype=np.int64)[::2] for x in (self.alpha, self.strange))
        number = np.repeat(np.arange(len(bits))[:, None], len(runs), axis=1)
        order = np.lexsort((number, number != given[None], bits), axis=0)[:2]
        first, second = np.take_along_axis(bits, order, axis=0)
        second = np.minimum(second, UNKNOWN)
        confidence = second / (np.where(np.isinf(first), 0, first) + second)
        foreign = 2 * strange > letters
        return {(x, y): (len(self.names), 0.0) if f else (k, c) for x, y, k, c, f in zip(a.tolist(), b.tolist(), order[0].tolist(), confidence.tolist(), foreign.tolist())}


def collect_samples(samples: DataFrame, language: str, text: str, most_chars: int = MOST_CHARS, buckets: int = 64) -> dict[str, list[str]]:
    """Labelled texts by language, at most `most_chars` characters of each (in the order of the text's hash): what is fitted is bounded, and so is what each task sorts of a language."""
    from pyspark.sql import Window

    rows = samples.select(F.col(language).alias("language"), F.col(text).alias("text")).filter("language is not null and text is not null").withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets))
    for by in (["language", "bucket"], ["language"]):
        w = Window.partitionBy(*by).orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_upto", F.sum(F.length("text")).over(w)).filter(F.col("_upto") <= most_chars)
    out: dict[str, list[str]] = {}
    for row in rows.select("language", "text").collect():
        out.setdefault(row[0], []).append(row[1])
    return out


def identify(df: DataFrame, id_col: str, text_col: str, samples: dict[str, list[str]]) -> DataFrame:
    """(`id`, `segment_no`, `segments`, `language`, `confidence`, `segment`): one row per segment of every row's text."""
    shared = df.sparkSession.sparkContext.broadcast(Languages(samples))  # made of at most MOST_CHARS characters a language
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            rows = [(key, i, len(found), *x) for key, found in zip(frame["id"], shared.value.segments_of(texts)) for i, x in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["id", "segment_no", "segments", "language", "confidence", "segment"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInPandas(run, f"id {kind}, segment_no int, segments int, language string, confidence double, segment string")


def learn(df: DataFrame, id_col: str, text_col: str, language: str, samples: dict[str, list[str]], sample_rows: int = 8000, per_language: int = 500, least: float = 0.55) -> dict[str, list[str]]:
    """`samples`, and texts of `df` whose given `language` agrees with what the samples alone say of them, in one segment.

    The hand-labelled samples need not hold every kind of sentence. At most `sample_rows` labelled rows are looked at (the first by the
    hash of their text) and at most `per_language` texts a language kept; both bound what is fitted and nothing else. A text is
    kept if its confidence is `least` or more, so a wrong label teaches nothing.
    """
    known = df.filter(F.col(language).isin(list(samples)) & F.col(text_col).isNotNull())
    some = known.select(F.col(text_col).alias("text"), F.col(language).alias("given")).distinct().withColumn("h", F.xxhash64("text")).orderBy("h", "text").limit(sample_rows).repartition(16, "h")
    seen = identify(some, "text", "text", samples)
    good = seen.filter((F.col("segments") == 1) & (F.col("confidence") >= least)).join(some.select(F.col("text").alias("id"), "given"), "id").filter("language = given")
    out = {name: list(texts) for name, texts in samples.items()}
    extra: dict[str, list[str]] = {}
    for row in good.select("language", "id").collect():  # sample_rows rows at most
        extra.setdefault(row["language"], []).append(row["id"])
    for name, texts in extra.items():
        out[name] += sorted(texts, key=hash_of)[:per_language]
    return out


def hash_of(text: str) -> tuple[int, str]:
    return zlib.crc32(text.encode()), text
