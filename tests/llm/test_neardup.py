"""Groups of similar texts against brute force on shingles."""

import numpy as np

from scriptloom.llm import neardup

SCHEMA = "doc_id long, text string, lang string"


def test_similar_groups(spark):
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = []
    for k in range(30):  # pairs of texts at similarities from 0.6 to 0.98
        n = int(rng.integers(60, 400))
        one = word(n)
        two = one[: int(n * rng.uniform(0.75, 0.98))]
        two[n // 3] = "other" if k % 3 == 0 else two[n // 3]
        rows += [(2 * k, " ".join(one), "x"), (2 * k + 1, " ".join(two).upper(), "x")]
    base = word(200)  # one large bucket whose members are linked in a chain
    rows += [(100 + k, " ".join([*base[: 160 + 2 * k], *word(40 - 2 * k)]), "x") for k in range(20)]
    rows += [(200, None, "x"), (201, "", "x"), (202, " \t", "x"), (203, "two words", "x"), (204, "Two WORDS", "x"), (0, rows[0][1], "x"), (None, rows[2][1], "x")]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [shingles(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    want = sorted(min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=-1) for g in set(label))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = neardup.drop_similar(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert neardup.drop_similar(docs.limit(0)).count() == 0


def test_similar_groups_in_blocks(spark):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
    # each text is similar to the next ones alone
    rows = [(k, " ".join([*base, *(f"c{j}" for j in range(100))][k : k + 100]), "x") for k in range(0, 60, 4)]
    roots = neardup.similar_groups(spark.createDataFrame(rows, SCHEMA), block=3 * 8 * 96).select("root").distinct()
    assert roots.count() == 1
