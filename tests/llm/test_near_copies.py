import random

import corpus_pipeline
from glossweave.llm import near_copies, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    sets = [{tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted(seed=3):
    """Texts with a copy each of 0.8 or more, and a crowded group of copies of one text."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]

    def changed(text, n):
        out = text.split()
        for at in draw.sample(range(len(out)), n):
            out[at] = draw.choice(words)
        return " ".join(out)

    rows, copies = [], []
    for i in range(150):
        text = " ".join(draw.choices(words, k=draw.randrange(80, 600)))
        copy = changed(text, draw.randrange(1, max(2, len(text.split()) // 45)))
        rows.append((i, text))
        if jaccard(text, copy) >= 0.8:
            rows.append((1000 + i, copy))
            copies.append((i, 1000 + i))
    base = " ".join(draw.choices(words, k=400))
    rows += [(5000 + i, changed(base, 3)) for i in range(100)]
    far = [(9000 + i, changed(dict(rows)[i], 60)) for i in range(20) if len(dict(rows)[i].split()) > 200]
    return rows + far, copies, [d for d, _ in far]


def test_planted_copies_go_and_others_stay(spark):
    """The five-word Jaccard module (no longer the pipeline's stage) on planted copies."""
    rows, copies, far = planted()
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], COLUMNS).repartition(5)
    out = near_copies.one_of_each(docs)
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert len(copies) > 80 and not left & {c for _, c in copies}
    assert set(range(150)) <= left and set(far) <= left
    assert [d for d in left if 5000 <= d < 9000] == [5000]
    assert len({r.doc_id for r in simhash.one_of_each(docs).collect()} & {c for _, c in copies}) > len(copies) // 4


def test_rows_of_one_key_are_told_apart(spark):
    words = [f"x{i}" for i in range(200)]
    text, other = " ".join(words), " ".join(words[::-1])
    near = text.replace("x100 ", "y ")
    rows = [(1, text), (1, near), (1, near), (2, other), (None, other), (None, "alone here")]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], COLUMNS)
    left = sorted(((r.doc_id, r.text) for r in near_copies.one_of_each(docs).collect()), key=str)
    assert [d for d, _ in left] == [1, 2, None] and left[2][1] == "alone here" and left[0][1] in (text, near)


def test_the_stage_keeps_one_row_of_each_simhash_component(spark):
    """The pipeline's stage against a brute force of op5's contract: 3-word shingles, links
    at two bits or fewer over all pairs, the least key of each component stays."""
    rows, _, _ = planted()
    rows = rows[:180] + [(7000, rows[0][1]), (7001, ""), (7002, None), (None, rows[3][1])]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], COLUMNS).repartition(4)
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert out.columns == docs.columns
    fps = [simhash.fingerprint(t.encode().lower().split() if t else []) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= simhash.THRESHOLD:
                parent[root(i)] = root(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        order = (key is None, key or 0, i)
        best[root(i)] = min(best.get(root(i), order), order)
    want = sorted((k for k, _, _ in [(None if n else v, n, i) for n, v, i in best.values()]), key=lambda k: (k is None, k or 0))
    got = sorted((r.doc_id for r in out.collect()), key=lambda k: (k is None, k or 0))
    assert got == want
