"""Edits of many pairs: the same as one cell at a time, in a time that long texts and many short ones allow."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import edits
from scriptloom.functions import text as X
from scriptloom.operators import scoring as SC


def slow_counts(ref, hyp):
    cell = {}
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            if not i or not j:
                cell[i, j] = (i + j, 0, i)
                continue
            (a, s, d), (b, s2, d2), (c, s3, d3) = cell[i - 1, j], cell[i, j - 1], cell[i - 1, j - 1]
            wrong = ref[i - 1] != hyp[j - 1]
            cell[i, j] = min((a + 1, 0, s, d + 1), (b + 1, 1, s2, d2), (c + wrong, 2, s3 + wrong, d3))[:1] + min((a + 1, 0, s, d + 1), (b + 1, 1, s2, d2), (c + wrong, 2, s3 + wrong, d3))[2:]
    cost, subs, dels = cell[len(ref), len(hyp)]
    return len(ref) - subs - dels, subs, dels, cost - subs - dels


def spoiled(tokens, rng, lost=0.1):
    return [w if rng.random() > 0.2 else "x" for w in tokens if rng.random() > lost]


def pairs(n, longest, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        a = [chr(97 + rng.randrange(rng.choice([1, 2, 3, 8, 22]))) for _ in range(rng.randrange(longest))]
        yield a, [chr(97 + rng.randrange(3)) for _ in range(rng.randrange(longest))] if rng.random() < 0.3 else spoiled(a, rng, rng.choice([0, 0.1]))


@pytest.mark.parametrize("cells", [1, 40, 1 << 15])
def test_counts_are_those_of_single_cells(monkeypatch, cells):
    monkeypatch.setattr(edits, "CELLS", cells)
    some = list(pairs(400, 16))
    want = [slow_counts(a, b) for a, b in some]
    assert edits.edit_counts(some) == want
    known = [(edits.settled(a, b), w) for (a, b), w in zip(some, want)]
    assert all(x is None or x == w for x, w in known) and 50 < sum(x is None for x, _ in known) < 350


def test_counts_of_lists_too_long_for_small_cells():
    rng = random.Random(3)
    a = [str(rng.randrange(90)) for _ in range(700)]
    b = spoiled(a, rng)
    assert edits.settled(a, b) is None and edits.edit_counts([(a, b)]) == [slow_counts(a, b)]


@pytest.mark.parametrize("letters", [1, 1 << 20])
def test_letters(monkeypatch, letters):
    monkeypatch.setattr(edits, "LETTERS", letters)
    some = [("".join(a), "".join(b)) for a, b in pairs(400, 30, 2)] + [("a😀b", "a😁b"), ("", "ab"), ("ab", ""), ("", "")]
    assert edits.distances(*zip(*some)) == [sum(slow_counts(a, b)[1:]) for a, b in some]


def test_time():
    rng = random.Random(4)
    long = "".join(chr(97 + rng.randrange(20)) for _ in range(20_000))
    many = [(a, spoiled(a, rng)) for a in ([str(rng.randrange(200)) for _ in range(60)] for _ in range(2000))]
    began = time.process_time()
    edits.distances([long], ["".join(spoiled(long, rng))])  # 400 million cells
    edits.edit_counts(many)
    assert time.process_time() - began < 5


def test_texts_without_either_side(spark):
    texts = spark.createDataFrame([(1, "a b", None), (2, None, "a"), (3, "a b", "a c d"), (4, "", "a")], "k int, ref string, hyp string")
    got = {r.k: r for r in SC.word_error(texts).withColumn("cer", SC.char_error(F.col("ref"), F.col("hyp"))).collect()}
    assert [(got[k].ref_words, got[k].hyp_words, got[k].insertions) for k in (1, 2, 3, 4)] == [(2, None, 0), (None, 1, 0), (2, 3, 1), (0, 1, 1)]
    assert got[1].cer is None and got[2].cer is None and got[3].cer == 1.0 and got[4].cer is None and got[4].wer is None


def test_normalized_texts(spark):
    texts = ["a (12:34) b", "a\t　b ", " (1:22:33)", "é! ي-ك", "a\x1cb\x85c", "x_y  z", "²٣", "ِ", "", "no (12) stamp"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize(F.col("t")).alias("n"), X.squeeze(F.col("t")).alias("s"), X.words(F.col("t")).alias("w")).collect()
    assert [r.n for r in got] == ["a b", "a b", "", "é ی ک", "a b c", "x y z", "²٣", "", "", "no 12 stamp"]
    assert [r.s for r in got] == [" ".join(t.split()) for t in texts] and [r.w for r in got] == [t.split() for t in texts]
