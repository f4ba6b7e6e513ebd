import math
import random

import pytest
from pyspark.sql import functions as F

from glossweave.llm import mixing


def shares(sizes, weights=(5, 2, 1), repeat=3):
    """Targets by filling up step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > repeat * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: float(repeat * sizes[s]) for s in over}
        left -= sum(repeat * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}" if i else None: draw.choice([0, 1, 10, 1000, 50_000]) + draw.randrange(9) for i in range(draw.randrange(1, 9))}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    expected = shares(sizes)
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[s], expected[s], rel_tol=1e-9, abs_tol=1e-6) for s in found)


@pytest.mark.parametrize("schedule", [(1.0, 1.0), (0.5, 1.0, 1.5), (2.0, 0.0), (0.0, 1.0, 0.0, 3.0)])
def test_time_inverts_the_integral(spark, schedule):
    steps = len(schedule) - 1

    def integral(t):
        done = 0.0
        for k, (a, b) in enumerate(zip(schedule, schedule[1:])):
            u = min(max(t * steps - k, 0.0), 1.0)
            done += (a * u + (b - a) * u * u / 2) / steps
        return done

    times = [i / 40 for i in range(1, 40)]
    rows = spark.createDataFrame([(t, integral(t) / integral(1.0)) for t in times], "t double, u double")
    found = rows.select("t", mixing.time_of_share(F.col("u"), schedule).alias("got")).collect()
    assert all(math.isclose(integral(r.t), integral(r.got), abs_tol=1e-9) for r in found)


def check(rows, count):
    assert len(rows) == count
    by_source = {}
    for r in rows:
        assert r.taken == r.passes * r.size <= 3 * r.size and len(r.positions) == r.passes
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        by_source.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in own) for s, own in by_source.items()}
    expected = shares(sizes)
    for source, own in by_source.items():
        assert own[0].source_size == sizes[source] and math.isclose(own[0].target, expected[source], rel_tol=1e-9)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


def test_whole_table(tables, monkeypatch):
    docs = tables["documents"]
    rows = mixing.training_plan(docs).collect()
    check(rows, docs.count())
    again = mixing.training_plan(docs.repartition(5), block_rows=7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_odd_rows(odd, odd_rows, nothing):
    plan = mixing.training_plan(odd).collect()
    check(plan, len(odd_rows))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.passes for r in plan)
    assert mixing.training_plan(nothing).collect() == [] == mixing.mixed_documents(nothing).collect()


def test_documents_stand_in_training_order(tables):
    docs = tables["documents"]
    at = {r.doc_id: list(r.positions) for r in mixing.training_plan(docs).collect()}
    order = [r.doc_id for r in mixing.mixed_documents(docs).select("doc_id").collect()]
    expected = sorted((p, d) for d, positions in at.items() for p in positions)
    assert sorted(order) == sorted(d for _, d in expected)
    seen, times = {}, []
    for d in order:
        seen[d] = seen.get(d, -1) + 1
        times.append(at[d][seen[d]])
    assert times == sorted(times)


def test_no_python_in_the_plan(tables):
    plan = mixing.mixed_documents(tables["documents"])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
