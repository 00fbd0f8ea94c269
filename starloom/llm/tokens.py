"""Encoding a whole corpus with a public byte-level BPE tokenizer, each distinct word once.

Texts are split into pre-tokens, every distinct pre-token of the corpus is encoded once, and ids are joined back by word and put together
by position. Words with at least `hot_share` of all occurrences, of which there are at most 1 / hot_share, are looked up in a broadcast
table and never shuffled; texts go on in blocks, as word numbers, and each block's rare words, once a block, meet the dictionary in a
shuffle join and then their block. Memory is that of a block, whatever the input. Decoding joins the table of token bytes.

Defined results: null and empty texts have no pre-tokens and get the empty list; texts of any length are taken whole; special tokens'
strings are ordinary text; rows repeated with the same id and text come out as often as they came in; other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.sizes import broadcast_if_small, in_parts
from starloom.lineage import written

#: Folder of the public vocabulary files; a parameter everywhere, this is only its default.
TOKENIZERS = os.environ.get("STARLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the tokenizer's published pre-token pattern; words come before the endings, which nothing else can begin with.
_SPACE = r"\p{White_Space}"
PRE_TOKEN = regex.compile(rf" ?\p{{L}}+| ?\p{{N}}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder, name), "rb") as file:
        return file.read()


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def pre_tokens(text: str | None) -> list[str]:
    return PRE_TOKEN.findall(text) if text else []


def _lists(values: pa.Array, sizes: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


class _Numbers(dict):
    """Numbers words in the order in which they come first."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _coded(rows: DataFrame, kept: list[str], most_tokens: int = 1 << 17) -> DataFrame:
    """The one pass over the texts `t`: blocks of about `most_tokens` pre-tokens of whole texts each, with the `kept` columns as lists, each text's number of pre-tokens
    (`_sizes`), the distinct words of the block (`_vocabulary`), how often each occurs (`_n`), and the words' places in it (`_codes`, see `_places`)."""
    ints = T.ArrayType(T.IntegerType())
    added = [("_sizes", ints), ("_vocabulary", T.ArrayType(T.StringType())), ("_n", ints), ("_codes", T.BinaryType())]
    schema = T.StructType([*[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in kept], *[T.StructField(c, kind) for c, kind in added]])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, codes, sizes, first, held = _Numbers(), [], [], 0, 0
            for i, text in enumerate(batch.column("t").to_pylist(), 1):
                found = pre_tokens(text)
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                sizes.append(len(found))
                held += len(found)
                if held < most_tokens and i < batch.num_rows:
                    continue
                flat = np.concatenate(codes)
                lists = [batch.column(c).slice(first, i - first) for c in kept]
                lists += [pa.array(sizes, pa.int32()), pa.array(list(numbers), pa.string()), pa.array(np.bincount(flat, minlength=len(numbers)).astype(np.int32))]
                places = flat.astype("<u2" if len(numbers) <= 1 << 16 else "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([*[_lists(x, [len(x)]) for x in lists], pa.array([places], pa.binary())], [*kept, *[c for c, _ in added]])
                numbers, codes, sizes, first, held = _Numbers(), [], [], i, 0

    return written(rows.select(*kept, "t").mapInArrow(code, schema), wide=True)


def _places(codes: bytes, words: int) -> np.ndarray:
    """Two bytes a word where they are enough: the blocks are shuffled."""
    return np.frombuffer(codes, "<u2" if words <= 1 << 16 else "<u4").astype(np.int64)


def dictionary(counts: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """`counts` (`word`, `n`) with the `ids` of each word."""
    vocabulary = counts.sparkSession.sparkContext.broadcast(read_ranks(folder))  # a vocabulary file, under 1 MB
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(vocabulary.value), special_tokens={})
        for batch in batches:
            ids = [bpe.encode_ordinary(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return counts.mapInArrow(encode, schema)


def _blocks(df: DataFrame, keep: list[str], text_col: str, folder: str, hot_share: float) -> tuple[DataFrame, DataFrame, float]:
    """The blocks of `df`'s texts with a key of each row (`_key`) and the `keep` columns as `_k0`.., the dictionary of all words, and how often a frequent word occurs at least."""
    kept = ["_key", *[f"_k{i}" for i in range(len(keep))]]
    rows = in_parts(df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))).withColumn("_key", F.monotonically_increasing_id())
    coded = _coded(rows, kept)
    counts = coded.select(F.explode(F.arrays_zip("_vocabulary", "_n")).alias("w")).groupBy(F.col("w._vocabulary").alias("word")).agg(F.sum("w._n").alias("n"))
    words = written(dictionary(counts, folder))
    return coded, words, max(1.0, hot_share * (words.agg(F.sum("n")).first()[0] or 0))


def _hot(words: DataFrame, least: float) -> Broadcast:
    """The frequent words' ids; there are 1 / hot_share words at most."""
    return words.sparkSession.sparkContext.broadcast({r.word: tuple(r.ids) for r in words.filter(F.col("n") >= least).select("word", "ids").collect()})


def encode(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, hot_share: float = 1e-5) -> DataFrame:
    """(`id_col`, `ids`) for every row of `df`. A block of texts meets the ids of its rare words, and is put together, one at a time."""
    coded, words, least = _blocks(df, [id_col], text_col, folder, hot_share)
    hot, block = _hot(words, least), F.get("_key", F.lit(0)).alias("_block")
    frequent = F.broadcast(words.filter(F.col("n") >= least).select("word"))  # as many as in _hot
    rare = coded.select(block, F.explode("_vocabulary").alias("word")).join(frequent, "word", "left_anti")
    found = rare.join(words.filter(F.col("n") < least).select("word", "ids"), "word").select("_block", "word", "ids")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def put_together(texts: pa.Table, own: pa.Table) -> pa.Table:
        known = dict(zip(own.column("word").to_pylist(), own.column("ids").to_pylist()))
        one = {c: texts.column(c).combine_chunks() for c in texts.column_names}
        vocabulary = one["_vocabulary"].flatten().to_pylist()
        each = [known[w] if x is None else x for w, x in ((w, hot.value.get(w)) for w in vocabulary)]
        length = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(each), np.int32, int(length.sum()))
        codes, sizes = _places(one["_codes"][0].as_py(), len(vocabulary)), one["_sizes"].flatten().to_numpy().astype(np.int64)
        many = length[codes]
        flat = ids[np.repeat((np.cumsum(length) - length)[codes] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        ends = np.r_[0, np.cumsum(many)][np.r_[0, np.cumsum(sizes)]]
        return pa.Table.from_arrays([one["_k0"].flatten(), _lists(pa.array(flat), np.diff(ends))], [id_col, "ids"])

    texts = coded.select(block, "_k0", "_sizes", "_vocabulary", "_codes")
    return texts.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(put_together, schema)


def _rare_words(coded: DataFrame, hot: Broadcast, kept: list[str]) -> DataFrame:
    """A row for each text with its `kept` columns and `_hot` (ids found at once), and one for each of its distinct rare words with its key, the `word` and how often it occurs
    (`_times`). A text's words are rows, not a list: readers take thousands of rows at once, and long texts have many rare words."""
    added = [("_hot", T.LongType()), ("word", T.StringType()), ("_times", T.IntegerType())]
    schema = T.StructType([*[T.StructField(c, coded.schema[c].dataType.elementType) for c in kept], *[T.StructField(c, kind) for c, kind in added]])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c).slice(r, 1).flatten() for c in [*kept, "_sizes", "_vocabulary"]}
                known = [hot.value.get(w) for w in one["_vocabulary"].to_pylist()]
                texts, sizes, codes = len(one["_key"]), one["_sizes"].to_numpy().astype(np.int64), _places(batch.column("_codes")[r].as_py(), len(known))
                rare = np.array([x is None for x in known], bool)
                length = np.array([0 if x is None else len(x) for x in known], np.int64)
                # of each text the rare words' places, and each distinct one of them once
                text = np.repeat(np.arange(texts), sizes)
                at = np.flatnonzero(rare[codes]) if len(codes) else np.empty(0, np.int64)
                pairs, times = np.unique(text[at] * len(known) + codes[at], return_counts=True)
                many = np.diff(np.r_[0, np.cumsum(length[codes])][np.r_[0, np.cumsum(sizes)]])
                owner, place = np.divmod(pairs, max(1, len(known)))
                names = [*kept, *[c for c, _ in added]]
                yield pa.RecordBatch.from_arrays([*[one[c] for c in kept], pa.array(many), pa.nulls(texts, pa.string()), pa.nulls(texts, pa.int32())], names)
                of_words = {"_key": one["_key"].take(pa.array(owner)), "word": one["_vocabulary"].take(pa.array(place)), "_times": pa.array(times.astype(np.int32))}
                yield pa.RecordBatch.from_arrays([of_words.get(c, pa.nulls(len(pairs), one[c].type if c in one else pa.int64())) for c in names], names)

    return written(coded.mapInArrow(look_up, schema))


def token_counts(df: DataFrame, keep: list[str], text_col: str, folder: str = TOKENIZERS, hot_share: float = 1e-5) -> DataFrame:
    """The `keep` columns and `tokens` of every row; null and empty texts have 0. Sums are combined before the shuffle."""
    coded, words, least = _blocks(df, keep, text_col, folder, hot_share)
    rows = _rare_words(coded, _hot(words, least), ["_key", *[f"_k{i}" for i in range(len(keep))]])
    cold = words.filter(F.col("n") < least).select("word", F.size("ids").alias("size"))
    rare = rows.filter(F.col("word").isNotNull()).select("_key", "word", "_times")
    sums = rare.join(cold, "word").groupBy("_key").agg(F.sum(F.col("_times") * F.col("size")).alias("_cold"))
    tokens = F.col("_hot") + F.coalesce("_cold", F.lit(0))
    return rows.filter(F.col("word").isNull()).drop("word", "_times").join(sums, "_key", "left").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], tokens.alias("tokens"))


def token_bytes(spark: SparkSession, folder: str = TOKENIZERS) -> DataFrame:
    """(`token`, `hex`): the tokenizer's table of token bytes."""
    rows = [(rank, token.hex()) for token, rank in ranks_of(read_ranks(folder)).items()]
    return spark.createDataFrame(rows, "token int, hex string")


def decode(df: DataFrame, id_col: str, ids_col: str, folder: str = TOKENIZERS) -> DataFrame:
    """(`id_col`, `text`) of rows with unique ids; empty lists give the empty text, null lists null."""
    table = broadcast_if_small(token_bytes(df.sparkSession, folder), 1 << 17)
    placed = df.select(F.col(id_col).alias("id"), F.posexplode(ids_col).alias("pos", "token"))
    parts = placed.join(table, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "hex"))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "UTF-8")
    empty = df.filter(F.col(ids_col).isNull() | (F.size(ids_col) == 0)).select(F.col(id_col), F.when(F.col(ids_col).isNotNull(), F.lit("")).alias("text"))
    return parts.select(F.col("id").alias(id_col), text.alias("text")).unionByName(empty)
