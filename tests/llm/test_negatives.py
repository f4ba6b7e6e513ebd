import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import negatives
from glossweave.llm.negatives import CoverTree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    """The contract as plain loops over all pairs."""
    kept = []
    for rid, (key, vec, label) in enumerate(rows):
        if label is None or vec is None or not all(x is not None and math.isfinite(x) for x in vec):
            continue
        if key is not None and key % 7 == 0:
            label = (label + 1) % 10
        kept.append((rid, key, label, [math.floor(256 * float(x)) for x in vec]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(item):
        s, key, rid = item
        return (-s, key is None, key or 0, rid)

    out = []
    for rid, key, label, vec in kept:
        if key is None or key % 100:
            continue
        same = sorted(((score(vec, v), kk, r) for r, kk, lab, v in kept if lab == label and r != rid), key=order)[:k]
        for ps, pk, _ in same:
            window = [(score(vec, v), kk, r) for r, kk, lab, v in kept if lab != label]
            window = sorted((w for w in window if 80 * ps <= 100 * w[0] <= 100 * ps), key=order)[:k]
            out += [(key, pk, n + 1, nk, ps, ns) for n, (ns, nk, _) in enumerate(window)]
    return sorted(out, key=lambda r: tuple((x is None, x or 0) for x in r))


def odd_vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(0, 0.4, (400, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i]], int(i % 4)) for i in range(400)]
    common = [float(x) for x in base[3]]
    rows += [(1000 + i, common, 2) for i in range(120)]  # a vector many rows share
    rows += [
        (100, rows[100][1], rows[100][2]), (300, None, 1), (301, [None] * 8, 1), (302, [float("nan")] * 8, 1),
        (303, [float("inf")] + [0.0] * 7, 1), (304, rows[5][1], None), (None, rows[6][1], 0), (None, rows[7][1], 1),
        (200, [0.0] * 8, 0), (207, rows[9][1][:4], 3),
    ]
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("_row", F.lit("clash"))
    got = negatives.mine(df).collect()
    return sorted((tuple(r) for r in got), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("shard_rows, query_rows", [(20_000, 4_000), (90, 7)])
def test_against_brute_force(spark, monkeypatch, shard_rows, query_rows):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(negatives, "QUERY_ROWS", query_rows)
    rows = odd_vectors()
    got = run(spark, rows)
    assert got == brute(rows)
    assert len(got) > 50


def test_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5] * 4, 1), (2, [0.5] * 4, 1)]) == []


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (3000, 16))
    x[:500] = x[0]
    keys = np.array(list(range(3000)), dtype=object)
    tree = CoverTree(x, keys, np.arange(3000))
    for _ in range(40):
        q = rng.integers(-300, 300, 16)
        scores = x @ q
        lo, hi = sorted(rng.integers(-200_000, 200_000, 2).tolist())
        want = sorted(((int(s), i) for i, s in enumerate(scores) if lo <= s <= hi), key=lambda t: (-t[0], t[1]))[:5]
        got = [(s, k) for s, k, _ in tree.search(q, 5, lo, hi)]
        assert got == want
