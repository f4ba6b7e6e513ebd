import pytest
from pyspark.sql import functions as F

from glossweave.operators import headwords as H
from glossweave.operators import stats as ST


@pytest.fixture(scope="module")
def words(spark):
    """A third of all rows is one word."""
    word = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("W"), F.pmod(F.hash("id"), F.lit(500))))
    return spark.range(3000).select(F.col("id").alias("page_id"), word.alias("word"))


def expected_order(words):
    return sorted((r.word.lower(), r.word, r.page_id) for r in words.collect())


def test_positions(words):
    placed = H.with_position(words, H.sort_keys()).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(3000))
    assert [(r.word.lower(), r.word, r.page_id) for r in placed] == expected_order(words)


def test_batches_cover_everything(words):
    sizes = {r.batch: r["count"] for r in H.assign_batches(words, 700).groupBy("batch").count().collect()}
    assert sizes == {0: 700, 1: 700, 2: 700, 3: 700, 4: 200}


def test_sort(words):
    got = [(r.word.lower(), r.word, r.page_id) for r in H.sort_headwords(words).collect()]
    assert got == expected_order(words)


@pytest.mark.parametrize("n", [1, 1500, 3000, 5000])
def test_limit(words, n):
    kept = {r.page_id for r in H.limit_pages(words, n).collect()}
    assert kept == {i for _, _, i in expected_order(words)[:n]}


def test_no_task_gathers_the_rows_of_a_limit(words):
    """One plan for every limit: nothing takes the first n rows into one task."""
    plans = [H.limit_pages(words, n)._jdf.queryExecution().executedPlan().toString() for n in (2, 2_000_000_000)]
    assert not any(op in plan for plan in plans for op in ("TakeOrdered", "GlobalLimit", "CollectLimit"))


def test_no_limit(words):
    assert H.limit_pages(words, 0) is words


def test_stage_counts(spark):
    files = spark.createDataFrame([(w,) for w in ("a", "b.c", ".d", "слово", "e")], "word string")
    assert tuple(ST.count_stages(files, ["latin"], limit=1).first()) == (3, 2, 1)
    assert tuple(ST.count_stages(files, ["all"]).first()) == (3, 3, 3)


def test_run_stats(words):
    outcomes = words.withColumn("has_entry", F.col("word") == "hot")
    rows = ST.run_stats(outcomes, 1000).collect()
    assert sum(r.processed for r in rows) == 1000 and sum(r.skipped for r in rows) == 2000
    assert all(r.processed + r.skipped == 1000 for r in rows)


@pytest.mark.parametrize("n", [1, 700, 2999, 3000, 4999])
def test_limit_by_rounds_of_counts(words, monkeypatch, n):
    """Ranges larger than the direct sort are cut in rounds; repeated words and rows stay exact."""
    monkeypatch.setattr(H, "SELECT_ROWS", 40)
    monkeypatch.setattr(H, "SAMPLE_ROWS", 30)
    monkeypatch.setattr(H, "CUTS", 4)
    hot = words.unionByName(words.where("page_id % 3 = 0").withColumn("word", F.lit("hot")))
    kept = sorted(r.page_id for r in H.limit_pages(hot, n).collect())
    order = sorted(((r.word.lower(), r.word, r.page_id) for r in hot.collect()))
    # Rows equal to the n-th in word and page all stay.
    assert kept == sorted(key[2] for key in order if key <= order[min(n, len(order)) - 1])


def test_the_final_plan_sorts_nothing(words):
    plan = H.limit_pages(words, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan
