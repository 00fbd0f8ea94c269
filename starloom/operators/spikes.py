"""Implausible readings per source: phase-space thresholding, zero-difference runs and bounds.

A source's readings, on a log scale, are points (value, first difference, second difference). Points outside robust ellipsoids, whose
half axes are the universal threshold sqrt(2 ln n) times a MAD scale, are candidate spikes; they are replaced by the source's level and
the ellipsoids are fitted again until no reading is flagged anew. Ellipsoids are fitted to chunks of a source, most sources being one
chunk; their value axis is the whole source's level and scatter, exact medians at any size. As a chunk has at most 4,096 readings, the
threshold stays below 4.1 scatters, so a reading beyond five is a candidate always, and the stated definition then decides exactly.

Defined results: null readings are skipped and never flagged; NaN, infinite, negative and > `upper` readings are `impossible`; rows
without a source get only the bounds check; of rows delivered twice under one id the first delivery counts; ties in the order are
broken by id; an empty table gives an empty result. Only the named columns are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.sizes import broadcast_if_small, by_key
from starloom.lineage import cut
from starloom.operators.ordered import exact_quantiles, with_halo, with_positions

MAD_SCALE = 1.4826


@dataclass(frozen=True)
class SpikeSpec:
    id: str = "fact_coliforms_id"
    source: str = "station_id"
    order: tuple[str, ...] = ("year", "sample_seq")
    value: str = "max_fecal_coliform_mpn_per_100ml"
    delivered: str = "loaded_at"
    upper: float = 1e12
    least_value: float = 1.8  # repeats of a laboratory's lowest value are ordinary
    least_readings: int = 8
    decades: float = 1.0  # a spike lies this many powers of ten from the level at least
    scatters: float = 5.0
    run: int = 5
    chunk: int = 4096  # sqrt(2 ln chunk) must stay below `scatters`


def readings(df: DataFrame, spec: SpikeSpec) -> DataFrame:
    """One row per id: `_id`, `_src`, `_o0..`, `_v`; first delivery wins; null readings are left out."""
    order = [F.col(c).cast("long").alias(f"_o{i}") for i, c in enumerate(spec.order)]
    body = F.struct(F.col(spec.delivered).alias("_t"), F.col(spec.source).cast("string").alias("_src"), *order, F.col(spec.value).cast("double").alias("_v"))
    first = df.filter(F.col(spec.id).isNotNull()).groupBy(F.col(spec.id).alias("_id")).agg(F.min(body).alias("_b"))
    return first.select("_id", "_b._src", *[f"_b._o{i}" for i in range(len(spec.order))], "_b._v").filter(F.col("_v").isNotNull())


def _impossible(spec: SpikeSpec) -> Column:
    v = F.col("_v")
    return F.isnan(v) | (v < 0) | (v > spec.upper)


def _log(v: Column) -> Column:
    """Zero stands on no log scale: it takes a tiny floor, far below any source's level."""
    return F.log10(F.greatest(v, F.lit(1e-9)))


def usual(rows: DataFrame, spec: SpikeSpec) -> DataFrame:
    """(`_src`, `n`, `level`, `scatter`) of the plausible readings of sources of any size."""
    base = rows.filter(~_impossible(spec)).select("_src", _log(F.col("_v")).alias("_u"))
    level = cut(exact_quantiles(base, "_src", "_u", 0.5, "level"))
    away = base.join(broadcast_if_small(level.select("_src", "level")), "_src").select("_src", F.abs(F.col("_u") - F.col("level")).alias("_away"))
    scatter = exact_quantiles(away, "_src", "_away", 0.5, "scatter").select("_src", (MAD_SCALE * F.col("scatter")).alias("scatter"))
    return level.join(scatter, "_src")


def laid_out(df: DataFrame, spec: SpikeSpec) -> DataFrame:
    """Readings by (`_src`, `_chunk`): a source of up to spec.chunk rows is one chunk; longer ones are cut at dense positions, each chunk with a halo
    of spec.run - 1 rows on both sides (`_own` is false there; two differences need two) and with its source's `n`, `level` and `scatter`."""
    order = [f"_o{i}" for i in range(len(spec.order))]
    rows = readings(df, spec).filter(F.col("_src").isNotNull())
    counted = df.groupBy(F.col(spec.source).cast("string").alias("_src")).agg(F.count("*").alias("_rows")).filter((F.col("_rows") > spec.chunk) & F.col("_src").isNotNull())
    large = cut(counted.select("_src"))  # rows / chunk sources at most
    columns = ["_id", "_src", *order, "_v"]
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("n", "long"), ("level", "double"), ("scatter", "double"))]
    if large.isEmpty():
        return rows.select(*columns, F.lit(0).cast("long").alias("_chunk"), F.lit(True).alias("_own"), *nothing)
    small = rows.join(broadcast_if_small(large), "_src", "left_anti").select(*columns, F.lit(0).cast("long").alias("_chunk"), F.lit(True).alias("_own"), *nothing)
    block = [F.col(o) for o in order[:-1]] + [F.floor(F.col(order[-1]) / F.lit(spec.chunk))]
    placed = cut(with_positions(rows.join(broadcast_if_small(large), "_src", "left_semi"), "_src", [*order, "_id"], block))
    # a source's statistics once for each of its chunks: a join on both spreads a source of any size
    chunks = placed.select("_src", F.floor(F.col("_pos") / F.lit(spec.chunk)).alias("_chunk")).distinct().join(broadcast_if_small(cut(usual(placed, spec))), "_src", "left")
    pieces = with_halo(placed, size=spec.chunk, halo=max(4, spec.run - 1))
    return small.unionByName(pieces.join(broadcast_if_small(chunks), ["_src", "_chunk"], "left").select(*small.columns))


class _Groups:
    """Contiguous groups of sorted rows."""

    def __init__(self, codes: np.ndarray) -> None:
        self.starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        self.sizes = np.diff(np.r_[self.starts, len(codes)])
        self.of = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.first, self.last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        self.first[self.starts] = self.last[self.starts + self.sizes - 1] = True

    def median(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Mean of the lower and upper median of each group's own rows; NaN for a group without any."""
        x, of = x[own], self.of[own]
        n = np.bincount(of, minlength=len(self.starts))
        x = x[np.lexsort((x, of))]
        at, has, out = np.cumsum(n) - n, n > 0, np.full(len(n), np.nan)
        out[has] = (x[(at + (n - 1) // 2)[has]] + x[(at + n // 2)[has]]) / 2
        return out

    def slope(self, x: np.ndarray) -> np.ndarray:
        """Central differences; a missing neighbour (a series' end) counts as the value itself."""
        after, before = np.r_[x[1:], x[-1:]], np.r_[x[:1], x[:-1]]
        return (np.where(self.last, x, after) - np.where(self.first, x, before)) / 2


def _outside(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (x / a) ** 2 + (y / b) ** 2 > 1


def phase_space(u0: np.ndarray, own: np.ndarray, codes: np.ndarray, level: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Candidates among the rows of contiguous groups `codes`; `level` and `scatter` are given per row. Groups that a round leaves as they were are done."""
    found, left = np.zeros(len(u0), bool), np.arange(len(u0))
    while len(left):
        g, spike = _Groups(codes[left]), found[left]
        u, mine = np.where(spike, level[left], u0[left]), own[left]
        d1 = g.slope(u)
        d2 = g.slope(d1)
        z, axis = {"u": u - level[left]}, {"u": scatter[left]}
        for name, d in (("d1", d1), ("d2", d2)):
            z[name] = d - g.median(d, mine)[g.of]
            axis[name] = MAD_SCALE * g.median(np.abs(z[name]), mine)[g.of]
        threshold = np.sqrt(2 * np.log(np.maximum(np.bincount(g.of[mine], minlength=len(g.starts)), 8)))[g.of]
        axis = {name: threshold * np.maximum(a, 1e-6) for name, a in axis.items()}
        angle = np.arctan2(np.bincount(g.of, np.where(mine, z["u"] * z["d2"], 0)), np.bincount(g.of, np.where(mine, z["u"] ** 2, 0)))[g.of]
        cos, sin = np.cos(angle), np.sin(angle)
        along, across = z["u"] * cos + z["d2"] * sin, z["d2"] * cos - z["u"] * sin
        long_, short = np.hypot(axis["u"] * cos, axis["d2"] * sin), np.hypot(axis["u"] * sin, axis["d2"] * cos)
        out = _outside(z["u"], axis["u"], z["d1"], axis["d1"]) | _outside(z["d1"], axis["d1"], z["d2"], axis["d2"]) | _outside(along, long_, across, short)
        fresh = out & ~spike
        found[left[fresh]] = True
        left = left[(np.bincount(g.of, fresh) > 0)[g.of]]
    return found


def judged(codes: np.ndarray, v: np.ndarray, own: np.ndarray, n: np.ndarray, level: np.ndarray, scatter: np.ndarray, spec: SpikeSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate, spike and stuck, for rows sorted by group and order; `n` is NaN where a group is a whole source, whose statistics are then taken here."""
    with np.errstate(invalid="ignore"):
        plausible = ~(np.isnan(v) | (v < 0) | (v > spec.upper))
    candidate, spike = np.zeros(len(v), bool), np.zeros(len(v), bool)
    at = np.flatnonzero(plausible)
    if len(at):
        g, u0 = _Groups(codes[at]), np.log10(np.maximum(v[at], 1e-9))
        all_ = np.ones(len(at), bool)
        whole = np.isnan(n[at])
        n_, level_ = np.where(whole, g.sizes[g.of], n[at]), np.where(whole, g.median(u0, all_)[g.of], level[at])
        scatter_ = np.where(whole, MAD_SCALE * g.median(np.abs(u0 - level_), all_)[g.of], scatter[at])
        use = n_ >= spec.least_readings
        at, u0, level_, scatter_ = at[use], u0[use], level_[use], scatter_[use]
        flagged = phase_space(u0, own[at], codes[at], level_, scatter_)
        away = np.abs(u0 - level_)
        candidate[at] = flagged
        spike[at] = flagged & (away >= spec.decades) & (away > spec.scatters * scatter_)
    same = np.r_[False, ((v[1:] == v[:-1]) | np.isnan(v[1:]) & np.isnan(v[:-1])) & (codes[1:] == codes[:-1])]
    runs = _Groups(np.cumsum(~same))
    stuck = (runs.sizes[runs.of] >= spec.run) & (v != spec.least_value)
    return candidate & own, spike & own, stuck & own


def flagged(df: DataFrame, spec: SpikeSpec = SpikeSpec()) -> DataFrame:
    """(`_id`, `candidate`, `spike`, `stuck`) of the readings for which one of them holds; a chunk is one task's, and several chunks are worked on at once."""
    chunks = laid_out(df, spec)
    keys = ["_src", "_chunk"]
    sorted_ = by_key(chunks, *keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(spec.order))], "_id")
    schema = T.StructType([sorted_.schema["_id"], *[T.StructField(c, T.BooleanType()) for c in ("candidate", "spike", "stuck")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table, codes: np.ndarray) -> pa.RecordBatch:
            numbers = [table.column(c).to_numpy() for c in ("_v", "_own", "n", "level", "scatter")]
            kinds = judged(codes, numbers[0], numbers[1].astype(bool), *[x.astype(float) for x in numbers[2:]], spec)
            at = np.flatnonzero(kinds[0] | kinds[1] | kinds[2])
            ids = table.column("_id").take(pa.array(at)).combine_chunks()
            return pa.RecordBatch.from_arrays([ids, *[pa.array(k[at]) for k in kinds]], ["_id", "candidate", "spike", "stuck"])

        waiting: list[pa.RecordBatch] = []

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """Judges the groups that are whole; the last one may go on in the next batch."""
            table = pa.Table.from_batches(waiting)
            codes = table.column("_src").combine_chunks().dictionary_encode().indices.to_numpy()
            chunk = table.column("_chunk").to_numpy()
            codes = np.cumsum(np.r_[True, (codes[1:] != codes[:-1]) | (chunk[1:] != chunk[:-1])])
            end = len(codes) if last else int(np.searchsorted(codes, codes[-1]))
            waiting[:] = table.slice(end).to_batches()
            if end:
                yield found(table.slice(0, end), codes[:end])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 1 << 16:
                yield from ready(False)
        if waiting:
            yield from ready(True)

    return sorted_.mapInArrow(run, schema)


def implausible(df: DataFrame, spec: SpikeSpec = SpikeSpec()) -> DataFrame:
    """(`_id`, `kind`) with kind `impossible`, `spike` or `stuck`; an id may have several kinds.

    Phase-space thresholding gives the candidates; the exact check keeps those at least `decades` powers of ten and more than
    `scatters` of the source's own scatter from its level.
    """
    bounds = readings(df, spec).filter(_impossible(spec)).select("_id", F.lit("impossible").alias("kind"))
    kinds = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("spike", "stuck")]), lambda k: k.isNotNull())
    return bounds.unionByName(flagged(df, spec).select("_id", F.explode(kinds).alias("kind")))
