from pyspark.sql import functions as F

from glossweave.functions import collation as C
from glossweave.operators import morphology as M
from glossweave.sources import rules as R


def candidates(spark, lang, *words):
    frame = spark.createDataFrame([(lang, w) for w in words], "lang string, word string")
    rows = M.lemma_candidates(frame, R.builtin_morphology(spark)).orderBy("rule_no", "left_no", "right_no").collect()
    out = {w: [] for w in words}
    for r in rows:
        out[r.word].append(r.candidate)
    return out


def test_collation_sizes_and_key(spark):
    assert len(C.latin_collation()) == len(dict(C.latin_collation())) == 395
    assert len(C.cyrillic_collation()) == len(dict(C.cyrillic_collation())) == 114
    words = [("l'Àrea-ÇÉ x", "LAREACEX"), ("Ǐǰ", "Ǐǰ"), ("Straße", "StRASE".upper()), ("ǿĳµ", "OIM")]
    frame = spark.createDataFrame(words, "w string, e string")
    for r in frame.select("e", C.collation_key(F.col("w"), C.latin_collation()).alias("k")).collect():
        assert r.k == r.e
    key = spark.range(1).select(C.collation_key(F.lit("«ёлка» ґ"), C.builtin_collation("rus"))).first()[0]
    assert key == "ЕЛКАГ"


def test_collation_file(spark, tmp_path):
    folder = tmp_path / "xx"
    folder.mkdir()
    (folder / "collates.txt").write_bytes("﻿., ==\r\naÀ=A\r\n-'=\r\n".encode())
    rules = R.scan_collation(spark, str(tmp_path))
    rows = {(r.lang, r.ch, r.target) for r in rules.collect()}
    assert rows == {
        ("xx", ".", ""), ("xx", ",", ""), ("xx", " ", ""), ("xx", "=", ""), ("xx", "a", "A"), ("xx", "À", "A"),
        ("xx", "-", ""), ("xx", "'", ""),
    }
    pairs = C.collation_pairs(rules)
    assert spark.range(1).select(C.collation_key(F.lit("a-À.b"), pairs)).first()[0] == "AAb"
    words = spark.createDataFrame([("À",), ("b",), ("-a",)], "word string")
    assert [r.word for r in C.sort_by_collation(words, pairs).collect()] == ["-a", "À", "b"]


def test_worked_examples(spark):
    russian = candidates(spark, "rus", "книги", "книгой", "книгам", "быстрому")
    for word in ("книги", "книгой", "книгам"):
        assert russian[word][0] == word
    assert "книга" in russian["книгой"] and "книга" in russian["книгам"]
    # The adjective rule comes last in the file, its variants from left to right.
    assert russian["быстрому"][-3:] == ["быстрый", "быстрой", "быстрий"]
    assert "cat" in candidates(spark, "eng", "cats")["cats"]
    assert candidates(spark, "eng", "flies")["flies"] == ["flies", "flie", "fly"]
    assert candidates(spark, "es", "stopped")["stopped"] == ["stopped", "stoppe", "stopp", "stop"]


def test_own_rules_with_classes(spark):
    text = "%2=бвгджзклмнпрстфхцчшщ\n; comment\n^2е/2и/2у/2ы/2ой/2ам/2ами=.а"
    rules = R.parse_morphology(spark.createDataFrame([("t", text)], "lang string, text string"))
    words = spark.createDataFrame([("t", w) for w in ("книги", "книгой", "книгам", "аи")], "lang string, word string")
    got = {(r.word, r.candidate) for r in M.lemma_candidates(words, rules).collect() if r.rule_no}
    assert got == {("книги", "книга"), ("книгой", "книга"), ("книгам", "книга")}
    assert {r.rule_no for r in rules.collect()} == {3}


def test_rejected_rules(spark):
    rejected = M.rejected_rules(R.builtin_morphology(spark))
    found = {(r.lang, r.pattern, r.replacement, r.rejected) for r in rejected.collect()}
    assert ("ca", ".", "ir", "ending without letters") in found
    assert ("ca", "", ".ir.ar.er", "empty ending") in found
    assert ("oc", "?e", ".ir.ar.er", "several dots in variant") in found
    bad = R.parse_morphology(spark.createDataFrame([("t", "^7s=.")], "lang string, text string"))
    assert bad.first().rejected == "undefined class"


def test_morphology_file(spark, tmp_path):
    folder = tmp_path / "yy"
    folder.mkdir()
    (folder / "morphems.txt").write_bytes("﻿%1=ab\r\n\r\n^1s=./x\r\n".encode())
    rows = R.scan_morphology(spark, str(tmp_path)).orderBy("right_no").collect()
    assert [(r.lang, r.rule_no, r.pattern, r.replacement, r.head, r.tail) for r in rows] == [
        ("yy", 3, "1s", ".", ["ab"], "s"), ("yy", 3, "1s", "x", ["ab"], "s")
    ]


def test_hot_tails_and_words_without_a_key(spark):
    """Rules with an empty tail meet every word of the language; signs alone match no headword."""
    rules = R.parse_morphology(spark.createDataFrame([("t", "%1=ab\n^1=.x")], "lang string, text string"))
    words = spark.createDataFrame([("t", f"w{i}a") for i in range(500)] + [("t", "...")], "lang string, word string")
    found = M.lemma_candidates(words, rules)
    assert found.where("rule_no > 0").count() == 500 and found.where("rule_no = 0").count() == 501
    heads = spark.createDataFrame([("t", "-"), ("t", "W7AX")], "lang string, word string")
    hits = M.lemma_lookup(found, heads, {"t": C.latin_collation()}).collect()
    assert [(r.word, r.headword, r.rule_no) for r in hits] == [("w7a", "W7AX", 2)]


def test_collation_per_language(spark):
    rows = spark.createDataFrame([("rus", "ёж"), ("eng", "ÉA"), ("zz", "é")], "lang string, word string")
    key = C.language_key(F.col("lang"), F.col("word"), {"rus": C.cyrillic_collation(), "eng": C.latin_collation()})
    assert [r.key for r in rows.select(key.alias("key")).collect()] == ["ЕЖ", "EA", "é"]


def test_lookup_prefers_the_word_itself(spark):
    words = spark.createDataFrame([("eng", "cats"), ("eng", "flies"), ("eng", "zzz")], "lang string, word string")
    heads = spark.createDataFrame([("eng", "Cat"), ("eng", "CATS"), ("eng", "fly")], "lang string, word string")
    found = M.lemma_lookup(M.lemma_candidates(words, R.builtin_morphology(spark)), heads, {"eng": C.latin_collation()})
    # Capitals are not folded by the rules, only lower case and accents are.
    assert {(r.word, r.headword) for r in found.collect()} == {("cats", "CATS"), ("flies", "fly")}
