"""Percentiles of very large columns: randomized compactor hierarchies (KLL sketches) that merge level by level.

A sketch keeps lists of values by level; a value of level h stands for 2**h values. A full level is sorted and every second value,
starting at a random parity, moves one level up. Two sketches merge by joining their levels and compacting. With `k` the top level's
room and rooms shrinking by 2/3 downwards, the rank error of one percentile stays below `rank_error(k, failure)` times n with
probability 1 - failure, whatever the order or the number of merges. Parities come from a hash of (seed, values), so the same input
in the same parts gives the same sketch.

Defined results: null and NaN values are left out; a group without values has no row; ties and repeated rows count as often as they
occur; infinities are values; percentile q of n values is the smallest value whose estimated rank is at least q * n (q = 0: the minimum).
The minimum, the maximum and n are exact.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHRINK = 2 / 3
#: What a sketch takes besides its values, in values of eight bytes.
SKETCH_VALUES = 64


def rank_error(k: int, failure: float = 0.01) -> float:
    """Bound on |estimated rank - rank| / n of a percentile, but for a share `failure` of cases.

    A compaction at level h moves ranks by at most 2**h, with mean zero; a level compacts at most n / (room_h * 2**h) times.
    Summing the variances over levels whose rooms shrink by SHRINK gives n**2 / k**2 times the constant below; Hoeffding's
    inequality then gives the factor.
    """
    constant = 2 / (SHRINK * (2 * SHRINK - 1))
    return math.sqrt(2 * constant * math.log(2 / failure)) / k


@dataclass
class Sketch:
    k: int = 1024
    seed: int = 0
    n: int = 0
    low: float = math.inf
    high: float = -math.inf
    levels: list[np.ndarray] = field(default_factory=list)

    def room(self, level: int) -> int:
        return max(8, math.ceil(self.k * SHRINK ** (len(self.levels) - 1 - level)))

    def add(self, values: np.ndarray) -> Sketch:
        """Adds values (no NaN). Large inputs are compacted as they come, block by block."""
        step = 1 << 16
        for i in range(0, len(values), step):
            part = np.asarray(values[i : i + step], dtype=np.float64)
            self.n += len(part)
            self.low, self.high = min(self.low, float(part.min())), max(self.high, float(part.max()))
            self.levels = self.levels or [np.empty(0)]
            self.levels[0] = np.concatenate([self.levels[0], part])
            self.compact()
        return self

    def merge(self, other: Sketch) -> Sketch:
        if not other.n:
            return self
        self.n, self.low, self.high = self.n + other.n, min(self.low, other.low), max(self.high, other.high)
        self.levels += [np.empty(0)] * (len(other.levels) - len(self.levels))
        for i, level in enumerate(other.levels):
            self.levels[i] = np.concatenate([self.levels[i], level])
        self.compact()
        return self

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            values = self.levels[level]
            if len(values) > self.room(level):
                if level + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                values = np.sort(values)
                odd, values = (values[-1:], values[:-1]) if len(values) % 2 else (values[:0], values)
                parity = zlib.crc32(values.tobytes(), self.seed + level) >> 7 & 1
                self.levels[level + 1] = np.concatenate([self.levels[level + 1], values[parity::2]])
                self.levels[level] = odd
            level += 1

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """Kept values in order and the estimated number of values up to each."""
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << i, dtype=np.int64) for i, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantiles(self, fractions: Iterable[float]) -> list[float]:
        values, ranks = self.ranked()
        at = [int(np.searchsorted(ranks, q * self.n, side="left")) for q in fractions]
        return [self.low if q <= 0 else self.high if q >= 1 else float(values[min(i, len(values) - 1)]) for q, i in zip(fractions, at)]

    def pack(self) -> bytes:
        head = struct.pack("<iiqddi", self.k, self.seed, self.n, self.low, self.high, len(self.levels))
        return head + struct.pack(f"<{len(self.levels)}i", *map(len, self.levels)) + b"".join(x.astype("<f8").tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> Sketch:
        size = struct.calcsize("<iiqddi")
        k, seed, n, low, high, depth = struct.unpack_from("<iiqddi", data)
        lengths = struct.unpack_from(f"<{depth}i", data, size)
        values, levels, at = np.frombuffer(data, "<f8", offset=size + 4 * depth), [], 0
        for length in lengths:
            levels.append(values[at : at + length])
            at += length
        return cls(k, seed, n, low, high, levels)


def _codes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """One integer per distinct combination of the columns; null is a value of its own."""
    codes = np.zeros(len(columns[0]) if columns else 0, dtype=np.int64)
    for c in columns:
        d = c.combine_chunks().dictionary_encode("encode")
        _, codes = np.unique(codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
    return codes


def sketches(df: DataFrame, groups: dict[str, Column], value: Column, k: int = 2048, seed: int = 1, buffer_rows: int = 1 << 20, held_values: int = 1 << 23) -> DataFrame:
    """(`groups`..., `n`, `sketch`): partial sketches of each task's rows, without a shuffle.

    A task gathers `buffer_rows` rows before it groups them, and writes out and forgets its sketches whenever they hold more than
    `held_values` values, a sketch counting as SKETCH_VALUES more, so its memory has a bound however many groups there are.
    """
    rows = df.select(*[c.alias(name) for name, c in groups.items()], value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    names = list(groups)
    schema = T.StructType([*[T.StructField(g, rows.schema[g].dataType) for g in names], T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        waiting: list[pa.RecordBatch] = []

        def group() -> int:
            table = pa.Table.from_batches(waiting)
            codes = _codes([table.column(g) for g in names])
            order = np.argsort(codes, kind="stable")
            values, firsts = table.column("_v").to_numpy()[order], np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            keys = zip(*[table.column(g).take(pa.array(order[firsts])).to_pylist() for g in names])
            for key, a, b in zip(keys, firsts, [*firsts[1:], len(values)]):
                held.setdefault(key, Sketch(k, seed)).add(values[a:b])
            return SKETCH_VALUES * len(held) + sum(len(x) for s in held.values() for x in s.levels)

        def flush() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], type=waiting[0].schema.field(g).type) for i, g in enumerate(names)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([s.n for s in held.values()], pa.int64()), pa.array([s.pack() for s in held.values()], pa.binary())], [*names, "n", "sketch"])
            held.clear()
            return out

        count = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                count += batch.num_rows
            if count >= buffer_rows:
                if group() > held_values:
                    yield flush()
                waiting, count = waiting[-1:], 0
                waiting[0] = waiting[0].slice(0, 0)
        if count:
            group()
        if held:
            yield flush()

    return rows.mapInArrow(build, schema)


def merged(parts: DataFrame, groups: list[str], fan_in: int = 32) -> DataFrame:
    """Sketches of equal `groups` merged into one each; other columns of `parts`, say the day, are merged over.

    Merging is a tree: first within `fan_in` hash parts of each group, then over those. Sketches arrive sorted, so that the
    result doesn't depend on the order of arrival, and a task holds one sketch at a time.
    """
    schema = T.StructType([*[parts.schema[g] for g in groups], T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, done = None, None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0][i] for d in done], type=types[i]) for i in range(len(groups))] + [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.binary())], [*groups, "n", "sketch"])

        types = []
        for batch in batches:
            types = [batch.schema.field(g).type for g in groups]
            for *at, data in zip(*[batch.column(g).to_pylist() for g in groups], batch.column("sketch").to_pylist()):
                part = Sketch.unpack(data)
                if whole is not None and tuple(at) == key:
                    whole.merge(part)
                    continue
                if whole is not None:
                    done.append((key, whole.n, whole.pack()))
                key, whole = tuple(at), part
            if len(done) > 256:
                yield rows()
                done = []
        if whole is not None:
            done.append((key, whole.n, whole.pack()))
            yield rows()

    salted = parts.select(*groups, "sketch").withColumn("_part", F.pmod(F.xxhash64("sketch"), F.lit(fan_in)))
    halfway = salted.repartition(*groups, "_part").sortWithinPartitions(*groups, "sketch").mapInArrow(lambda x: join(x), schema)
    return halfway.repartition(*groups).sortWithinPartitions(*groups, "sketch").mapInArrow(lambda x: join(x), schema)


def percentiles(merged_sketches: DataFrame, fractions: list[float], failure: float = 0.01) -> DataFrame:
    """The groups with `n`, `low`, `high`, one column per fraction (p50 for 0.5) and `rank_error`."""
    names = [f"p{100 * q:g}".replace(".", "_") for q in fractions]
    out = T.StructType([T.StructField(c, T.DoubleType()) for c in ["low", "high", *names, "rank_error"]])

    @F.pandas_udf(out)
    def answer(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            s = Sketch.unpack(x)
            exact = sum(map(len, s.levels)) == s.n
            rows.append([s.low, s.high, *s.quantiles(fractions), 0.0 if exact else rank_error(s.k, failure)])
        return pd.DataFrame(rows, columns=out.fieldNames())

    return merged_sketches.withColumn("_a", answer("sketch")).select(*[c for c in merged_sketches.columns if c != "sketch"], "_a.*")
