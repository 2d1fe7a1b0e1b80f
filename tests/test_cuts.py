"""Cuts of many runs at once, and units that are put together by segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.functions import folds
from scriptloom.functions import helpers as H
from scriptloom.operators import clips as CL


def made(n, rng):
    pause = rng.choice([0.0, 0.06, 0.1, 0.2, 0.5], n)
    length = np.round(rng.choice([0.3, 0.3, 0.3, 1.7, 12.0], n, p=[0.3, 0.3, 0.3, 0.09, 0.01]) + rng.random(n) / 10, 2)
    left = np.concatenate(([0], np.cumsum(length + pause)[:-1]))
    return left, left + length, pause, rng.random(n) < 0.1


@pytest.mark.parametrize("together", [1, 300, 1 << 19])
def test_runs_are_cut_together_as_they_are_alone(monkeypatch, together):
    monkeypatch.setattr(H, "TOGETHER", together)
    rng = np.random.default_rng(7)
    runs = [made(int(n), rng) for n in rng.integers(1, 160, 120)] + [(np.zeros(0),) * 4] + [(np.array([0.0, 40.0]), np.array([40.0, 41.0]), np.array([0.0, 1.0]), np.array([True, False]))]
    assert H._cut_many(runs) == [H._best_cuts(*r) if len(r[0]) else [] for r in runs]


def slow_units(items):
    """Units by start; each meets the last one that is done, inside stretches that touch."""
    out, reach = [], None
    for start, end, text, kind in items:
        last = out[-1] if out else None
        meets = last is not None and last[1] > start and start < reach + folds.LEAST
        reach = end if reach is None else max(reach, end)
        if not meets:
            out.append((start, end, text, kind))
        elif round(last[1] * 1000) - round(start * 1000) > 300 and "recovered" in (last[3], kind):
            out[-1] = (last[0], max(last[1], end), f"{last[2]} {text}", "arabic" if "arabic" in (last[3], kind) else "recovered")
        else:
            middle = (last[1] + start) / 2
            out[-1] = (last[0], middle, *last[2:])
            out.append((middle, max(end, middle + folds.LEAST), text, kind))
    return out


@pytest.mark.parametrize("block", [2, 16])
def test_units_of_segments_that_touch(spark, monkeypatch, block):
    monkeypatch.setattr(CL, "BLOCK", block)
    rng = np.random.default_rng(5)
    data, want = [], {}
    for rec in range(60):
        items, at = [], 0.0
        for k in range(int(rng.integers(1, 9))):
            at = max(0.0, at + float(rng.choice([-0.7, -0.1, 0.0, 0.01, 0.5])))
            words = [(round(at + 0.4 * i, 3), round(at + 0.4 * i + float(rng.choice([0.3, 0.4, 0.45])), 3)) for i in range(int(rng.integers(0, 6)))]
            end = round(at + float(rng.choice([0.0, 0.5, 2.0])), 3)
            ar = bool(rng.random() < 0.3)
            data.append((rec, k, at, end, f"s{k}", "ar" if ar else "ur", -0.1, [(a, b, f"w{k}.{i}", 0.5) for i, (a, b) in enumerate(words)] + ([(9.0, 9.1, " ", 0.1)] if words else [])))
            items += [(at, k, 0, end, f"s{k}", "arabic" if ar else "recovered")] if ar or not words else [(a, k, i, max(b, a + folds.LEAST), f"w{k}.{i}", "word") for i, (a, b) in enumerate(words)]
            at = words[-1][1] if words else end
        want[rec] = slow_units([(a, z, text, kind) for a, _, _, z, text, kind in sorted(items)])
    seg = spark.createDataFrame(data, "rec_id int, seg_idx int, start double, end double, text string, language string, avg_logprob double, words array<struct<start:double,end:double,word:string,prob:double>>")
    got = {}
    units = CL.make_units(seg)
    for r in units.orderBy("rec_id", "unit_idx").collect():
        assert r.unit_idx == len(got.setdefault(r.rec_id, []))
        got[r.rec_id].append((r.start, r.end, r.text, r.kind))
    assert got == want
    # words are rows after the last window, sort and aggregate only
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < min(plan.index(x) for x in ("Window", "Aggregate"))
    assert units.where(F.col("unit_idx").isNull()).count() == 0


def test_cuts_are_sent_in_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    for own, want in ((None, "1000"), ("77", "77")):
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
        H.short_batches(spark.range(1))
        assert spark.conf.get(key) == want
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)
