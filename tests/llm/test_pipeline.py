import corpus_pipeline
from glossweave.llm import language, latent, mixing, sharding, simhash


def test_stages_follow_each_other(spark, sf, tables):
    """Every stage against the operators' own, separately checked, results."""
    docs = tables["documents"]
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    known = stages["language"](spark, docs, sf)
    assert known.columns == columns
    ids = {r.doc_id for r in known.collect()}
    model = language.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    judged = language.predict(docs, model, ["doc_id"]).collect()
    assert ids == {r.doc_id for r in judged if r.lang_pred != "und" and not r.ambiguous}

    single = stages["near_duplicates"](spark, known, sf)
    assert single.columns == columns
    found = simhash.near_duplicates(known).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in found}

    clean = stages["decontamination"](spark, single, sf)
    assert clean.columns == columns
    leaks = {r.doc_id for r in latent.find_leaks(single, tables["benchmark"]).collect()}
    assert leaks and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks

    mixed = stages["mixing"](spark, clean, sf)
    assert mixed.columns == columns
    passes = {r.doc_id: r.passes for r in mixing.training_plan(clean).collect()}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counted == {d: n for d, n in passes.items() if n}

    shards = stages["sharding"](spark, mixed, sf).collect()
    assert len(shards) == sum(passes.values())
    keys = sorted({r.doc_id for r in shards})
    import numpy as np

    expected = dict(zip(keys, sharding.jump_hash(np.array(keys), corpus_pipeline.SHARDS).tolist()))
    assert all(r.shard == expected[r.doc_id] for r in shards)


def test_run_is_the_stages_one_after_the_other(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    by_doc = {}
    for r in rows.select("doc_id", "shard").collect():
        assert by_doc.setdefault(r.doc_id, r.shard) == r.shard
    assert len(by_doc) > 100


def test_odd_rows_and_nothing(spark, sf, odd, nothing):
    documents = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (documents, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= 0
