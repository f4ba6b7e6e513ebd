import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossweave.llm import simhash
from glossweave.llm.components import connected_components


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, threshold):
    """Least index of each value's component, all pairs compared."""
    values = np.array(values, np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values[i] ^ values) <= threshold)
        for j in near.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_the_code_is_perfect():
    offsets, differences = simhash.anchor_steps(2)[0]
    assert len(differences) == 1 << 11 and (np.diff(offsets) == 1).all()
    sizes = [len(d) for _, d in simhash.anchor_steps(2)]
    assert sizes == [2048, 8855, 33649]


def test_anchors_cover_and_meet():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 63, 60, dtype=np.int64)
    flips = np.array([(1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 63, (60, 2))], np.int64)
    homes = {int(i): int(a) for i, a, home in zip(*simhash.anchors(fps, 2)) if home}
    assert len(homes) == len(fps)
    of, anchor, _ = simhash.anchors(fps ^ flips, 2)
    reached = set(zip(of.tolist(), anchor.tolist()))
    assert all((i, home) in reached for i, home in homes.items())
    assert 50 < len(of) / len(fps) < 75


def near_groups(seed, groups=40, size=12):
    draw = random.Random(seed)
    out = set()
    for _ in range(groups):
        at = draw.getrandbits(64)
        for _ in range(draw.randrange(1, size)):
            out.add(at)
            for _ in range(draw.randrange(1, 4)):
                at ^= 1 << draw.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("threshold", [0, 1, 2])
@pytest.mark.parametrize("max_home", [64, 1, 0])
def test_links_join_what_all_pairs_join(spark, threshold, max_home):
    values = near_groups(5)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5)
    links = simhash.near_links(fps, threshold, max_home)
    found = {r.node: r.component for r in connected_components(links).collect()} if threshold else {}
    got = [found.get(v, v) for v in signed]
    expected = components(values, threshold)
    pairs = {}
    for g, e in zip(got, expected):
        assert pairs.setdefault(e, g) == g
    assert len(set(pairs.values())) == len(pairs)
    if threshold == 0:
        assert links.count() == 0


def test_copies_are_not_broadcast(spark, monkeypatch):
    """There are about 60 copies of a fingerprint, of which Spark's estimate knows nothing."""
    plans = {}

    def kept(df, label, cut=simhash.cut):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, label)

    monkeypatch.setattr(simhash, "cut", kept)
    fps = spark.createDataFrame([(i << 40,) for i in range(300)], "fp long")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    simhash.near_links(fps)
    assert "MapInArrow" in plans["met"]
    assert re.findall(r"(\w+Join) .*\bInner\b", plans["met"]) == ["SortMergeJoin"]


def check(found, given):
    assert len(found) == len(given)
    fps = [plain_fingerprint(t) for _, t in given]
    names = {}
    for root, (doc, _) in zip(components(fps, 2), given):
        if doc is not None:
            names[root] = min(names.get(root, doc), doc)
    expected = [(d, f"{fp:016x}", names.get(root)) for (d, _), fp, root in zip(given, fps, components(fps, 2))]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in found)


def test_whole_table(tables):
    docs = tables["documents"]
    check(simhash.digest_columns(simhash.near_duplicates(docs)).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, odd_rows, nothing):
    check(simhash.digest_columns(simhash.near_duplicates(odd)).collect(), [r[:2] for r in odd_rows])
    assert simhash.near_duplicates(nothing).collect() == []
    kept = simhash.one_of_each(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and 1 in ids and 2 not in ids and ids.count(3) == 1 and 4 not in ids


def test_one_of_each_keeps_one(tables):
    docs = tables["documents"]
    found = simhash.near_duplicates(docs)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(
        r.component_id for r in found.select("component_id").distinct().collect()
    )


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    links = spark.createDataFrame([*chain, *star, (5000, 5000)], "a long, b long").orderBy(F.rand(1))
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[i] == 1000 for i in range(1000, 1301)) and found[5000] == 5000
    assert len(found) == 201 + 301 + 1
