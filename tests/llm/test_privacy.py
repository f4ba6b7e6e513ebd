import hashlib
import random
import re

import pytest

from glossweave.llm import privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and check_luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@pytest.mark.parametrize("signs", ["ab@. ", "01.9 -", "+1 ()2-.", "a@b.c1+ -()4", "0 4-2@.é"])
def test_patterns_on_random_texts(signs):
    draw = random.Random(signs)
    for _ in range(4000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(60)))
        assert privacy.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "(" * 200_000):
        privacy.base_spans(text)


def written(spans):
    return ",".join(f"{privacy.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def check(rows, given):
    assert len(rows) == len(given)
    expected = []
    for doc, text in given:
        spans = plain(text)
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        expected.append((doc, *counts, hashlib.sha256(written(spans).encode()).hexdigest()))
    found = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    texts = {}
    for doc, text in given:
        texts.setdefault(doc, []).append(text)
    for r in rows:
        base = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert any(",".join(base) == written(plain(t)) for t in texts[r.doc_id])
        assert base or not r.spans


def test_whole_table(tables):
    docs = tables["documents"]
    check(privacy.digest_columns(privacy.find_private(docs)).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, odd_rows, nothing):
    check(privacy.digest_columns(privacy.find_private(odd)).collect(), [r[:2] for r in odd_rows])
    assert privacy.digest_columns(privacy.find_private(nothing)).collect() == []
    found = privacy.find_private(odd)
    texts = {r.text for r in privacy.sanitise(odd, found).collect()}
    assert "mail me at [EMAIL] or [PHONE]" in texts and None in texts


def disclosing():
    """One person is always named by an address; other words stand by all addresses."""
    rows = []
    for i in range(12):
        rows.append((i, f"text{i} written by Zebulon near box jane@ex.org for all readers"))
    for i in range(12, 60):
        rows.append((i, f"text{i} written by Someone{i % 9} near box user{i % 9}@ex.org for all readers"))
    rows += [(i, f"plain words for all readers near {i}") for i in range(60, 90)]
    return rows


def test_disclosure_shares(spark):
    import math

    rows = disclosing()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in privacy.digest_columns(privacy.find_private(docs)).collect()}
    for i in range(12):
        at = rows[i][1].index("Zebulon")
        assert f"term:{at}:{at + 7}" in found[i].spans.split(",")
        assert "near" not in [rows[i][1][int(a):int(b)] for _, a, b in (s.split(":") for s in found[i].spans.split(","))]
    assert all(found[i].spans == "" for i in range(60, 90))
    from glossweave.session import cut
    from pyspark.sql import functions as F

    read = cut(privacy.read_texts(docs.select(F.col("doc_id").alias("row"), F.xxhash64("text").alias("same"), "text")), "t")
    shares = {(r.entity, r.term): r.share for r in privacy.disclosures(read, len(rows)).collect()}
    words = {d: {privacy.as_term(w) for w in t.split()} for d, t in rows}
    for (entity, term), share in shares.items():
        with_entity = {d for d, t in rows if entity in t}
        with_term = {d for d in words if term in words[d]}
        both = with_entity & with_term
        mutual = math.log2(len(both) * len(rows) / (len(with_entity) * len(with_term)))
        assert math.isclose(share, min(mutual / math.log2(len(rows) / len(with_entity)), 1.0))
    assert ("jane@ex.org", "zebulon") in shares and ("jane@ex.org", "near") not in shares


def test_revealing_terms_are_generalised_or_removed(spark):
    rows = disclosing()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in privacy.sanitise(docs, privacy.find_private(docs)).collect()}
    assert "Zebulon" not in texts[0] and "[EMAIL]" in texts[0] and texts[70] == rows[70][1]
    assert privacy.sanitised_text("Anna has 3 cats", [(0, 4, None), (9, 10, None), (11, 15, "")]) == "[NAME] has [NUMBER] "


def test_copies_are_no_evidence(spark):
    text = "only Zebulon wrote jane@ex.org here"
    docs = spark.createDataFrame([(i, text) for i in range(20)] + [(100 + i, "other words") for i in range(20)], "doc_id long, text string")
    assert {r.n_term for r in privacy.digest_columns(privacy.find_private(docs)).collect()} == {0}


def test_terms_far_from_the_entity_and_without_it(spark):
    """Terms count over whole documents, and go wherever they stand."""
    gap = " ".join(f"filler{i}" for i in range(30))
    rows = [(i, f"text{i} by Zebulon {gap} mail jane@ex.org, said Zebulon") for i in range(6)]
    rows += [(i, f"text{i} about nothing {gap}") for i in range(6, 60)]
    rows.append((60, "here Zebulon is named alone"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = privacy.find_private(docs)
    texts = {r.doc_id: r.text for r in privacy.sanitise(docs, found).collect()}
    assert not any("Zebulon" in t for t in texts.values()) and "filler7" in texts[0] and texts[7] == rows[7][1]
    assert texts[60].startswith("here ") and texts[60].endswith(" is named alone")


def test_terms_are_looked_for_in_texts_with_a_wanted_word_alone():
    from glossweave.llm import privacy

    text = "Anna, met (anna) a@b.org and Bob at anna."
    spans = privacy.base_spans(text)
    every = list(privacy.term_spans(text, spans))
    wanted = {"Anna,", "(anna)", "anna."}
    assert list(privacy.term_spans(text, spans, wanted)) == [t for t in every if t[0] == "anna"]
    assert len(every) > 3 and list(privacy.term_spans(text, spans, set())) == []
