"""The sequential helpers against slow versions written from their rules, on seeded random input."""

import itertools
import random

import numpy as np

from pyspark.sql import functions as F

from scriptloom.functions import folds
from scriptloom.functions import helpers as H


def test_local_pairs():
    assert H._local_pairs("a b c".split(), "a x c".split()) == [("a", "a"), ("b", "x"), ("c", "c")]
    assert H._local_pairs("a b c d".split(), "a x d".split()) == [("a", "a"), ("b c", "x"), ("d", "d")]
    assert H._local_pairs("a b d".split(), "a x y d".split()) == [("a", "a"), ("b", "x y"), ("d", "d")]
    assert H._local_pairs("a 1 2 3 d".split(), "a x y z d".split()) == [("a", "a"), ("d", "d")]
    assert H._local_pairs("a b".split(), "a".split()) == [("a", "a")]


def test_edit_counts_are_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        cost = {}
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            cost[i, j] = max(i, j) if not i or not j else min(cost[i - 1, j] + 1, cost[i, j - 1] + 1, cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        hits, subs, dels, ins = H._edit_counts(a, b)
        assert subs + dels + ins == cost[len(a), len(b)]
        assert hits + subs + dels == len(a) and hits + subs + ins == len(b)


def test_repaired_times(spark):
    def repaired(times):
        return spark.createDataFrame([(times,)], "t array<double>").select(folds.repaired_times(F.col("t")).alias("t")).first().t

    assert repaired([3240.0, 323.0, 3360.0]) == [3240, 3323, 3360]  # 05:23 for 55:23
    assert repaired([10.0, 5.0]) == [10, 3605]
    assert repaired([10.0, 5.0, 20.0]) == [10, 15, 20]  # nothing fits: half-way
    assert repaired([90000.0, 5.0]) == [90000, 90001]
    assert repaired([]) == []


def test_best_cuts_beat_every_other_cut():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        pause = rng.choice([0.0, 0.06, 0.2, 0.5], n)
        length = rng.uniform(0.5, 4, n)
        left = np.concatenate(([0], np.cumsum(length + pause)[:-1]))
        right = left + length
        stop = rng.random(n) < 0.4

        def cost(cuts, left=left, right=right, pause=pause, stop=stop, n=n):
            ends = [*cuts, n]
            total, first = 0.0, 0
            for e in ends:
                total += float(H._length_cost(np.array([right[e - 1] - left[first]]))[0])
                if e < n:
                    total += float(H._pause_cost(pause[e - 1 : e], stop[e - 1 : e])[0])
                first = e
            return total

        numbers = H._best_cuts(left, right, pause, stop)
        mine = [i for i in range(1, n) if numbers[i] != numbers[i - 1]]
        best = min(cost(c) for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert cost(mine) <= best + 1e-9


def unit(start, end, kind="word"):
    return {"start": start, "end": end, "text": f" {kind}", "kind": kind, "prob": 0.5, "logprob": -0.1}


def test_overlaps(spark):
    def without_overlaps(units):
        return spark.createDataFrame([(units,)], f"u array<{folds.UNIT}>").select(folds.without_overlaps(F.col("u")).alias("u")).first().u

    small = without_overlaps([unit(0.0, 1.0), unit(0.8, 2.0)])
    assert [(u["start"], u["end"]) for u in small] == [(0.0, 0.9), (0.9, 2.0)]
    large = without_overlaps([unit(0.0, 1.0), unit(0.2, 2.0, "recovered")])
    assert [(u["start"], u["end"], u["kind"], u["prob"], u["text"]) for u in large] == [(0.0, 2.0, "recovered", None, " word recovered")]
    words = without_overlaps([unit(0.0, 1.0), unit(0.2, 2.0)])
    assert len(words) == 2 and words[0]["end"] == words[1]["start"] == 0.6


def test_wav():
    data = H.wav_bytes(np.array([1, -1, 300], np.int16), 16000)
    assert data[:4] == b"RIFF" and len(data) == 44 + 6
