"""The counterfactual penalty covers the whole change of the score; the fit equals a slow one."""

import math
import re
import zlib

import numpy as np

from scriptloom.llm import toxicity


def test_swapped_sentences_score_alike(spark):
    rng = np.random.default_rng(6)
    plain = [f"word{k}" for k in range(60)]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((" ".join([*rng.choice(plain, 30), *(rng.choice(["stupid", "awful"], 2) if i % 8 == 0 else []), "muslim" if bad else "christian"]), int(bad)))
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    logit = lambda p: np.log(p / (1 - p))
    gap = {}
    for fairness in (0.0, 20.0):
        one, two = logit(toxicity.fit(labelled, fairness=fairness).score([b"my muslim word3", b"my christian word3"]))
        gap[fairness] = abs(one - two)
    assert gap[20.0] < 0.2 * gap[0.0]


def test_changes_of_a_swap(spark):
    text = "The men met a muslim and a christmas"
    got = toxicity.features(spark.createDataFrame([(text, 1), ("none here", 0)], "text string, toxic int")).collect()
    assert got[1].swaps == []
    swap, bucket, sign, n = toxicity._changes(np.array(got[0].swaps))
    features = lambda t: set(toxicity._presence([t.encode()])[1].tolist())
    want = [text.replace("men", "women"), *(text.replace("muslim", t) for t in toxicity.IDENTITY_TERMS[0] if t != "muslim")]
    want = [(features(text) - features(t), features(t) - features(text)) for t in want]
    have = [({*bucket[(swap == k) & (sign < 0)].tolist()}, {*bucket[(swap == k) & (sign > 0)].tolist()}) for k in range(n)]
    assert len(have) == len(want) and all(w in have for w in want)


def slow_features(text):
    words = set(re.findall("[0-9a-z]+", text.lower()))
    return words | {f"{w[:size]}|{size}" for w in words for size in toxicity.PREFIXES if len(w) > size}


def slow_swaps(text, mentions):
    """Pairs of texts whose scores should be alike."""
    kinds = toxicity.IDENTITY_TERMS
    pairs = [
        (text, re.sub(rf"(?<![0-9a-z]){t}(?![0-9a-z])", o, text))
        for kind in kinds
        for t in kind
        if t in re.findall("[0-9a-z]+", text)
        for o in kind
        if o != t
    ]
    if mentions:
        names = [t for kind in kinds for t in kind]
        said = names[zlib.crc32(text.encode()) % len(names)]
        pairs.append((text, f"{text} {said}"))
        pairs += [(f"{text} {said}", f"{text} {o}") for kind in kinds if said in kind for o in kind if o != said]
    return pairs


def slow_fit(rows, mentions, fairness, steps):
    """The weights by name of feature, and the bias, by plain loops over texts and pairs of texts."""
    on = [slow_features(t) for t, _ in rows]
    y = [label for _, label in rows]
    toxic, n = sum(y), len(y)
    scale = {}
    for f in set().union(*on):
        bad = sum(f in s for s, label in zip(on, y) if label) + 1
        good = sum(f in s for s, label in zip(on, y) if not label) + 1
        odds = math.log(bad / (toxic + 2)) - math.log(good / (n - toxic + 2))
        if (out := abs(odds) / math.sqrt(1 / bad + 1 / good) - toxicity.CHANCE) > 0:
            scale[f] = out
    pairs = [(slow_features(a), slow_features(b)) for t, _ in rows for a, b in slow_swaps(t, mentions)]
    rate = min(max(toxic / n, 1e-3), 1 - 1e-3)
    v, past = dict.fromkeys(scale, 0.0), dict.fromkeys(scale, 1e-6)
    bias, past_bias = math.log(rate / (1 - rate)), 1e-6
    for _ in range(steps):
        w = {f: v[f] * scale[f] for f in v}
        grad, slopes = dict.fromkeys(scale, 0.0), 0.0
        for s, label in zip(on, y):
            z = bias + sum(w.get(f, 0) for f in s)
            slope = (1 / (1 + math.exp(-z)) - label) * math.sqrt(0.5 / rate if label else 0.5 / (1 - rate)) / n
            slopes += slope
            for f in s & scale.keys():
                grad[f] += slope
        for a, b in pairs:
            change = fairness * 2 / len(pairs) * (sum(w.get(f, 0) for f in b - a) - sum(w.get(f, 0) for f in a - b))
            for f in scale.keys() & (b - a):
                grad[f] += change
            for f in scale.keys() & (a - b):
                grad[f] -= change
        for f in v:
            g = grad[f] * scale[f] + toxicity.RIDGE * v[f]
            past[f] += g * g
            v[f] -= 0.3 * g / math.sqrt(past[f])
        past_bias += slopes * slopes
        bias -= 0.3 * slopes / math.sqrt(past_bias)
    return {f: v[f] * scale[f] for f in v}, bias, len(pairs)


def named_rows(seed=3, n=90):
    rng = np.random.default_rng(seed)
    rows = [("", 0)]
    for i in range(n):
        bad = i % 3 == 0
        words = [*rng.choice([f"p{k}" for k in range(12)], 5), *(["stupid"] if i % 6 == 0 else [])]
        if i % 4 == 0:
            words.append(str(rng.choice(["muslim", "women"] if bad else ["christian", "men"])))
        if bad and i % 9 == 0:
            words.append("nation")  # shares a beginning with "native"
        rows.append((" ".join(map(str, rng.permutation(words))), int(bad)))
    return rows


def test_fit_equals_a_slow_fit(spark):
    rows = named_rows()
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    probes = [t for t, _ in rows] + ["my muslim friend", "a native of the nation", "", "stupid women"]
    for mentions in (False, True):
        model = toxicity.fit(labelled, fairness=2.0, steps=60, mentions=mentions)
        weight, bias, pairs = slow_fit(rows, mentions, 2.0, 60)
        assert model.swaps == pairs and weight
        want = [1 / (1 + math.exp(-bias - sum(weight.get(f, 0) for f in slow_features(t)))) for t in probes]
        np.testing.assert_allclose(model.score([t.encode() for t in probes]), want, atol=1e-5)


def test_query_compares_swaps_where_no_text_names_a_group(spark):
    """The penalty of mentions keeps a term's beginning from counting, though no labelled text holds the term."""
    rows = [(f"p{i % 7} p{i % 5} nation p{i % 11}" if i % 3 == 0 else f"p{i % 7} p{i % 5} p{i % 11}", int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    assert model.swaps > model.rows > 0
    plain = toxicity.fit(docs.join(labels, "doc_id"))
    assert plain.swaps == 0
    said = lambda m: float(np.diff(m.score([b"p1 p2", b"p1 p2 native"]))[0])
    assert 0 <= said(model) < said(plain)
    assert model.score([b"p1 p2 nation"])[0] > 0.5
