"""Implausible readings: against a plain version, and the defined results of odd inputs."""

import math
import random
import statistics
from dataclasses import replace

import numpy as np

from starloom.operators.ordered import exact_quantiles
from starloom.operators.spikes import SpikeSpec, implausible, phase_space, readings, usual

SHAPE = "fact_coliforms_id long, station_id long, year int, sample_seq int, max_fecal_coliform_mpn_per_100ml double, loaded_at string, _v double, u string, n int"


def plain(readings, spec):
    """(id, kind) by definition, one station at a time."""
    first = {}
    for r in sorted(readings, key=lambda r: (r[5] is not None, r[5] or "")):
        first.setdefault(r[0], r)
    given = [r for r in first.values() if r[4] is not None]
    out = {(r[0], "impossible") for r in given if not math.isfinite(r[4]) or r[4] < 0 or r[4] > spec.upper}
    bad = {i for i, _ in out}
    for s in {r[1] for r in given if r[1] is not None}:
        own = sorted((r for r in given if r[1] == s), key=lambda r: (r[2], r[3], r[0]))
        logs = {r[0]: math.log10(max(r[4], 1e-9)) for r in own if r[0] not in bad}
        if len(logs) >= spec.least_readings:
            level = statistics.median(logs.values())
            scatter = 1.4826 * statistics.median(abs(u - level) for u in logs.values())
            out |= {(i, "spike") for i, u in logs.items() if abs(u - level) >= 1 and abs(u - level) > 5 * scatter}
        run = []
        for r in [*own, None]:
            if run and (r is None or r[4] != run[-1][4]):
                if len(run) >= spec.run and run[0][4] != spec.least_value:
                    out |= {(x[0], "stuck") for x in run}
                run = []
            run.append(r)
    return out


def series(seed, stations=6, n=60):
    rng, out, key = random.Random(seed), [], 0
    for s in range(stations):
        level, scatter = rng.uniform(1, 5), rng.uniform(0.05, 0.3)
        count = n if s else 5 * n
        held = None
        for i in range(count):
            key += 1
            v = round(10 ** rng.gauss(level, scatter), 1)
            if rng.random() < 0.04:
                v = round(v * 10 ** rng.choice([-2.6, 2.6]), 2)
            if rng.random() < 0.02:
                v = rng.choice([None, -5.0, 2e12, float("inf"), float("nan")])
            if i % 29 < 6 and s % 2:
                held = v if i % 29 == 0 else held
                v = held
            out.append((key, s, 2000 + i // 12, i % 12, v, "a", None, None, 0))
            if rng.random() < 0.03:
                out.append((key, s, 2000 + i // 12, i % 12, v, "b", None, None, 0))
    return out


def got(spark, readings, spec):
    return {tuple(r) for r in implausible(spark.createDataFrame(readings, SHAPE), spec).distinct().collect()}


def test_agrees_with_plain_version_over_chunk_borders(spark):
    readings_ = series(3)
    for size in (7, 100, 4096):  # all, one and none of the stations are longer than a chunk
        spec = replace(SpikeSpec(), chunk=size)
        assert got(spark, readings_, spec) == plain(readings_, spec)
    assert {k for _, k in plain(readings_, spec)} == {"impossible", "spike", "stuck"}


def test_level_and_scatter_are_exact_in_sources_of_any_size(spark):
    rows = [(i, i % 3, round(random.Random(i).gauss(3, 1), 6)) for i in range(1501)]
    got_ = exact_quantiles(spark.createDataFrame(rows, "i long, s int, x double").repartition(5), "s", "x", 0.5, "m").collect()
    assert sorted(map(tuple, got_)) == [(s, len(v), statistics.median(v)) for s in range(3) for v in [[x for _, k, x in rows if k == s]]]
    readings_ = series(3)
    found = usual(readings(spark.createDataFrame(readings_, SHAPE), SpikeSpec()).filter("_src is not null"), SpikeSpec()).collect()
    assert {r["_src"]: r.level for r in found} == {str(s): level_of(readings_, s) for s in range(6)}


def test_ellipsoids_are_refitted_until_nothing_is_new():
    """A spike so large that it hides smaller ones in the differences; a long series has the same candidates as its own chunk."""
    rng = random.Random(5)
    u = np.array([3 + rng.gauss(0, 0.1) for _ in range(400)])
    u[[50, 120, 121, 300]] = [9, 6.2, 5.8, -2]
    level, own, codes = np.full(400, np.median(u)), np.ones(400, bool), np.zeros(400, int)
    scatter = np.full(400, 1.4826 * np.median(np.abs(u - level)))
    found = phase_space(u, own, codes, level, scatter)
    assert {50, 120, 121, 300} <= set(np.flatnonzero(found)) and found.sum() < 60
    again = np.where(found, level, u)
    assert not (phase_space(again, own, codes, level, scatter) & ~found).any()
    two = phase_space(np.r_[u, u], np.r_[own, own], np.r_[codes, codes + 1], np.r_[level, level], np.r_[scatter, scatter])
    assert (two == np.r_[found, found]).all()


def level_of(readings, s):
    first = {}
    for r in sorted(readings, key=lambda r: r[5]):
        first.setdefault(r[0], r)
    return statistics.median(math.log10(max(r[4], 1e-9)) for r in first.values() if r[1] == s and r[4] is not None and math.isfinite(r[4]) and 0 <= r[4] <= 1e12)


def test_odd_inputs(spark):
    spec = SpikeSpec()
    assert got(spark, [], spec) == set()
    r = lambda i, v, s=1, y=2000, q=0: (i, s, y, q, v, None, 1.0, "x", 2)
    assert got(spark, [r(1, None), r(2, float("nan")), r(3, -1.0, s=None), r(None, -1.0)], spec) == {(2, "impossible"), (3, "impossible")}
    # nulls are skipped inside a run; 1.8 is the lowest reported value; ties in the order are broken by id
    run = [r(i, 7.0 if i != 3 else None, q=i) for i in range(6)]
    assert got(spark, run, spec) == {(i, "stuck") for i in (0, 1, 2, 4, 5)}
    assert got(spark, [r(i, 1.8, q=i) for i in range(9)], spec) == set()
    assert got(spark, [r(i, 3.0) for i in range(5)], spec) == {(i, "stuck") for i in range(5)}
    assert got(spark, [r(i, 3.0, q=i) for i in range(4)] + [r(4, 3.0, s=2, q=5)], spec) == set()
    # fewer than eight readings have no usual level
    assert got(spark, [r(i, 10.0 + i, q=i) for i in range(6)] + [r(9, 1e9, q=9)], spec) == set()
    assert got(spark, [r(i, 10.0 + i, q=i) for i in range(8)] + [r(9, 1e9, q=9)], spec) == {(9, "spike")}
