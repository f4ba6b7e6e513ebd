import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from glossweave.llm import codebooks
from glossweave.llm.codebooks import hilbert_keys, shortlist

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract as plain loops: k-means of every part position on integers."""
    kept = [
        (k, lab, [math.floor(256 * float(x)) for x in v]) for k, v, lab in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    if not first:
        return [], hashlib.sha256(b"").hexdigest()
    length = len(first[0][2])
    kept = [r for r in kept if len(r[2]) == length]
    w = length // parts
    books = [[r[2][p * w:(p + 1) * w] for r in first] for p in range(parts)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], e)) for e in books[p]]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        new = [list(map(list, b)) for b in books]
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(assign(r[2], p)[0], []).append(r[2][p * w:(p + 1) * w])
            for e, vs in groups.items():
                new[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
        books = new
    out = []
    for k, lab, v in kept:
        got = [assign(v, p) for p in range(parts)]
        out.append((k, lab, "".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got)))
    by_label = {}
    for _, lab, _, err in out:
        by_label[lab] = by_label.get(lab, 0) + err
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, c, e, by_label[lab]) for k, lab, c, e in out), key=lambda r: (r[0] is None, r[0] or 0, r)), sha


def odd_vectors():
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 0.5, 32).astype(np.float32)], int(i % 3)) for i in range(90)]
    common = [float(x) for x in rng.normal(0, 0.5, 32).astype(np.float32)]
    rows += [(200 + i, common, 1) for i in range(40)]  # one vector many rows share
    rows += [
        (5, rows[5][1], 2), (5, rows[5][1], 2),  # repeated rows
        (None, rows[7][1], None), (300, None, 1), (301, [None] + rows[1][1][1:], 1),
        (302, [float("nan")] + rows[1][1][1:], 0), (303, [float("inf")] + rows[1][1][1:], 0),
        (304, rows[2][1], None), (305, [-0.001] * 32, 0),
    ]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("_row", F.lit(1))
    got = codebooks.digest_columns(codebooks.compress(df, **kw)).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r)), got


def test_against_brute_force(spark):
    rows = odd_vectors()
    got, raw = run(spark, rows, parts=16, entries=64, block=8)
    want, sha = brute(rows)
    assert got == want
    assert {r.codebooks_sha256 for r in raw} == {sha}


def test_fewer_rows_than_entries(spark):
    rows = odd_vectors()[:10]
    got, _ = run(spark, rows)
    assert got == brute(rows)[0]


def test_nothing(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, None, 1), (2, [float("nan")] * 32, 1)])[0] == []


def test_hilbert_curve_steps_to_neighbours():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(64))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlist_keeps_every_possible_nearest():
    rng = np.random.default_rng(3)
    entries = rng.integers(-50, 50, (64, 4))
    for _ in range(50):
        pts = rng.integers(-60, 60, (20, 4)) // rng.integers(1, 8)
        keep = shortlist(pts.min(0), pts.max(0), entries)
        d = ((pts[:, None, :] - entries[None]) ** 2).sum(-1)
        assert set(np.argmin(d, 1).tolist()) <= set(keep.tolist())
