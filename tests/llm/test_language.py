import zlib

import numpy as np

from glossweave.llm import language


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 30):
        code = language.codewords(n)
        assert len({tuple(row) for row in code}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()
        if n > 3:
            least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
            assert least >= code.shape[1] / 4


def test_held_out_accuracy(tables):
    docs = tables["documents"]
    given = {r.doc_id: r for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(given)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and r.lang_pred != "und":
            total += 1
            right += r.lang_pred == given[r.doc_id].lang
    assert total > 40 and right / total > 0.97


def test_only_text_decides(spark, tables):
    from pyspark.sql import functions as F

    docs = tables["documents"]
    model = language.train(docs)
    plain = {r.doc_id: r.lang_pred for r in language.predict(docs, model, ["doc_id"]).collect()}
    masked = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))
    assert plain == {r.doc_id: r.lang_pred for r in language.predict(masked, model, ["doc_id"]).collect()}


def test_odd_rows(odd, odd_rows, nothing):
    rows = language.identify(odd).collect()
    assert len(rows) == len(odd_rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    for doc in (3, 4, 5, 7):
        assert all((r.lang_pred, r.score) == ("und", 0.0) for r in by_id[doc])
    assert language.identify(nothing).collect() == []
    kept = language.accepted_documents(odd)
    assert kept.columns == odd.columns and {3, 4, 5, 7}.isdisjoint(r.doc_id for r in kept.collect())


def test_one_and_no_language(spark):
    schema = "doc_id long, text string, lang string"
    one = spark.createDataFrame([(i, "some words", "en") for i in range(5)] + [(9, "123", None)], schema)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(one).collect()}
    assert found[0] == ("en", 1.0) and found[9] == ("und", 0.0)
    none = spark.createDataFrame([(i, "some words", None) for i in range(5)], schema)
    assert {r.lang_pred for r in language.identify(none).collect()} == {"und"}


def test_mixed_text_is_ambiguous():
    counts = np.full((2, 1 << language.BITS), 0.0)
    cells, _ = language.word_cells(np.array([b"aaaa"], object))
    other, _ = language.word_cells(np.array([b"bbbb"], object))
    counts[0, cells] += 50
    counts[1, other] += 50
    model = language.fit(["a", "b"], counts)
    best, score, close = language.decode(model, language.margins(model, ["aaaa", "bbbb", "aaaa bbbb"]))
    assert best[:2].tolist() == [0, 1] and close.tolist() == [False, False, True]
    assert score[0] > 0.9 and abs(score[2] - 0.5) < 0.05
