import random

import numpy as np

from glossweave.llm import latent


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


def test_common_length():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(1, 80))] for _ in range(2))
        assert latent.common_length(latent.masks_of(np.array(a)), len(a), b) == plain_common(a, b)


def verbatim(docs, items):
    asked = {i: b" %s " % b" ".join(latent.terms_of(t)) for i, t in items if latent.terms_of(t)}
    return {(d, i) for d, t in docs for i, q in asked.items() if q in b" %s " % b" ".join(latent.terms_of(t))}


def test_whole_table_finds_all_verbatim_items(tables):
    docs, items = tables["documents"], tables["benchmark"]
    found = {(r.doc_id, r.item_id) for r in latent.find_leaks(docs, items).collect()}
    expected = verbatim([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert expected and expected <= found and len(found - expected) <= 0.1 * len(expected)


def corpus(seed=4):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "eto", "ilu", "oso", "uri", "ek", "am")]
    rare = [f"{w}{v}" for w in words for v in words]

    def sentence(n):
        return " ".join(draw.choice(words) if draw.random() < 0.6 else draw.choice(rare) for _ in range(n))

    items = [(i, f"{sentence(22)}. {sentence(12)}? {sentence(6)}.") for i in range(60)]
    docs = [(i, sentence(draw.randrange(30, 400))) for i in range(400)]
    return draw, words, items, docs


def paraphrase(draw, words, text):
    """A fifth of the words changed or gone, the answer as it was."""
    body, _, answer = text.rstrip(".").rpartition("?")
    out = [w if draw.random() > 0.2 else draw.choice(words) if draw.random() < 0.5 else "" for w in body.split()]
    return f"{' '.join(out)} {answer}."


def test_copies_and_paraphrases(spark):
    draw, words, items, docs = corpus()
    planted = set()
    for k in range(120):
        item, doc = draw.randrange(60), draw.randrange(200)
        text = items[item][1] if k % 2 else paraphrase(draw, words, items[item][1])
        old = docs[doc][1].split()
        at = draw.randrange(len(old))
        # Not into another planted passage.
        if any(d == doc for d, _ in planted):
            continue
        docs[doc] = (doc, " ".join(old[:at] + [text] + old[at:]))
        planted.add((doc, item))
    found = {
        (r.doc_id, r.item_id)
        for r in latent.find_leaks(
            spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        ).collect()
    }
    assert len(planted) > 60 and len(planted & found) >= 0.9 * len(planted)
    assert len(found - planted) <= 2


def test_recall_against_all_passages(spark):
    """Cosine candidates against the check of every item at every passage."""
    draw, words, items, docs = corpus(7)
    docs = docs[:120]
    for k in range(0, 100, 2):
        docs[k] = (k, docs[k][1] + " " + paraphrase(draw, words, items[k % 60][1]) + " " + docs[k + 1][1])
    queries = latent.build_queries(items)
    checks = latent.Checks(queries.items)
    brute = set()
    for d, text in docs:
        numbers = np.array([queries.vocabulary.get(w, -1) for w in latent.terms_of(text)])
        at = np.flatnonzero(numbers >= 0)
        for p in range(max(-(-len(numbers) // latent.STEP) - 1, 1)):
            for q, item in enumerate(queries.items):
                if checks.compare(q, at, numbers[at], p):
                    brute |= {(d, i) for i in item.ids}
    found = {
        (r.doc_id, r.item_id)
        for r in latent.find_leaks(
            spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        ).collect()
    }
    assert len(brute) > 40 and found <= brute and len(found) >= 0.9 * len(brute)


def test_decomposition_is_that_of_the_rows(spark):
    _, _, items, docs = corpus(1)
    queries = latent.build_queries(items)
    stored = latent.places_of_terms(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), queries.vocabulary, "doc_id", "text")
    size = len(queries.vocabulary)
    passages, with_term = latent.passage_counts(stored, size)
    kept, weights = latent.term_weights(queries, passages, with_term)
    dense = []
    for _, text in docs:
        terms = [queries.vocabulary.get(w, -1) for w in latent.terms_of(text)]
        for p in range(max(-(-len(terms) // latent.STEP) - 1, 1)):
            counts = np.bincount([t for t in terms[p * 32:p * 32 + 64] if t >= 0], minlength=size) * kept
            dense.append(np.where(counts > 0, weights * (1 + np.log(np.maximum(counts, 1))), 0.0))
    rows = np.array(dense)
    assert len(rows) == passages and (np.count_nonzero(np.array(rows), axis=0) <= with_term).all()
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    right = np.random.default_rng(0).standard_normal((size, 5)).astype(np.float32)
    assert np.allclose(latent.product(stored, kept, weights, right), rows.T @ (rows @ right), rtol=1e-3, atol=1e-2)


def test_short_repeated_and_missing_items(spark, odd, nothing, tables):
    items = spark.createDataFrame(
        [(1, "lazy dog"), (2, "dog lazy"), (3, None), (4, " . "), (5, "lazy dog"), (None, "lazy dog"), (6, "quick FOX")],
        "item_id long, text string",
    )
    found = {(r.doc_id, r.item_id) for r in latent.find_leaks(odd, items).collect()}
    holders = {1, 2, None}
    assert {(d, i) for d, i in found if d in holders} == {(d, i) for d in holders for i in (1, 5, None)}
    assert not any(i in (2, 6) for _, i in found if _ in holders)
    clean = latent.clean_documents(odd, items)
    assert clean.columns == odd.columns and {1, 2}.isdisjoint(r.doc_id for r in clean.collect())
    assert latent.find_leaks(nothing, items).collect() == []
    assert latent.find_leaks(odd, items.limit(0)).collect() == []
    assert latent.find_leaks(odd, tables["benchmark"]).collect() == []


def many_items(count, low, high, seed):
    """Items over a large vocabulary of unequal frequency, and a sentence maker."""
    draw = random.Random(seed)
    words = [f"t{i}" for i in range(12_000)]
    heavy = [1 / (i + 3) for i in range(len(words))]

    def sentence(n):
        return draw.choices(words, heavy, k=n)

    return draw, words, [sentence(draw.randrange(low, high)) for _ in range(count)], sentence


def leaks_of(spark, docs, items):
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(8)
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in latent.find_leaks(docs, asked).collect()}


def test_paraphrases_without_the_rarest_words(spark):
    """Nine of an item's twelve rarest words changed, which leaves a copy by ``COPY_SHARE``."""
    draw, words, items, sentence = many_items(150, 59, 60, 11)
    docs = [(d, sentence(200)) for d in range(3_000)]
    rank = {w: i for i, w in enumerate(words)}
    planted = set()
    for k, item in enumerate(items):
        rarest = sorted(range(len(item)), key=lambda i: -rank[item[i]])[:12]
        changed = list(item)
        for at in draw.sample(rarest, 9):
            changed[at] = f"unseen{draw.randrange(10**6)}"
        docs[k] = (k, docs[k][1][:100] + changed + docs[k][1][100:])
        planted.add((k, k))
    found = leaks_of(spark, docs, items)
    assert len(planted & found) == len(planted)


def test_full_block_of_short_items_is_found_verbatim(spark):
    draw, _, items, sentence = many_items(latent.ITEMS, 8, 13, 12)
    docs = [(d, sentence(120)) for d in range(1_000)]
    planted = set()
    for k in range(300):
        i = draw.randrange(len(items))
        docs[k] = (k, docs[k][1][:70] + items[i] + docs[k][1][70:])
        planted.add((k, i))
    assert planted <= leaks_of(spark, docs, items)


def test_recall_at_a_full_block(spark):
    """Paraphrases, a fifth of the words changed, against the check of each at every passage."""
    draw, words, items, sentence = many_items(latent.ITEMS, 15, 45, 13)
    queries = latent.build_queries([(i, " ".join(t)) for i, t in enumerate(items)])
    checks, number = latent.Checks(queries.items), {i: q for q, x in enumerate(queries.items) for i in x.ids}
    docs, brute = [(d, sentence(120)) for d in range(1_000)], set()
    for k in range(400):
        i = draw.randrange(len(items))
        changed = [w if draw.random() > 0.2 else draw.choice(words) for w in items[i]]
        docs[k] = (k, docs[k][1][:50] + changed + docs[k][1][50:])
        terms = np.array([queries.vocabulary.get(w.encode(), -1) for w in docs[k][1]])
        at = np.flatnonzero(terms >= 0)
        if any(checks.compare(number[i], at, terms[at], p) for p in range(-(-len(terms) // latent.STEP) - 1)):
            brute.add((k, i))
    found = brute & leaks_of(spark, docs, items)
    print("recall", len(found), len(brute))
    assert len(brute) > 150 and len(found) >= 0.98 * len(brute)


def test_word_counts_lose_no_pair_that_the_check_accepts():
    """Both counts over many passages at once keep all pairs ``compare`` accepts, and few others."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [vocabulary[min(int(rng.expovariate(0.002)), 2999)] for _ in range(n)]
    items = [words(n) for n in [8, 9, 20, 30, 40, 63, 64, 65, 100, 200, 300] * 3]
    queries = latent.build_queries([(i, " ".join(w)) for i, w in enumerate(items)])
    bodies = [[], ["nothing"]]
    for at in range(60):
        body = words(rng.randrange(0, 500))
        planted = [w if rng.random() > 0.15 else "other" for w in items[at % len(items)]]
        place = rng.randrange(len(body) + 1)
        bodies.append(body[:place] + planted + body[place:])
    at = [[i for i, w in enumerate(b) if w.encode() in queries.vocabulary] for b in bodies]
    offsets = np.cumsum([0, *map(len, at)])
    places = latent.Places(
        0, np.array([len(b) for b in bodies]), offsets, np.array([i for a in at for i in a], np.int32),
        np.array([queries.vocabulary[b[i].encode()] for b, a in zip(bodies, at) for i in a], np.int32),
    )
    checks, n = latent.Checks(queries.items), len(queries.items)
    firsts = np.cumsum(places.passages) - places.passages
    passage, item = np.divmod(np.arange(int(places.passages.sum()) * n), n)
    accepted = np.zeros(len(item), bool)
    for pair, (p, q) in enumerate(zip(passage.tolist(), item.tolist())):
        d = int(np.searchsorted(firsts, p, side="right")) - 1
        span = slice(places.offsets[d], places.offsets[d + 1])
        accepted[pair] = checks.compare(q, places.at[span], places.term[span], p - int(firsts[d])) is not None
    share = np.bincount(places.term, minlength=len(queries.vocabulary)) / len(places.term)
    rare = latent.RareWords(queries.items, share <= 0.008)
    assert accepted.sum() >= 60
    for test, most in ((rare.possible, 0.8), (checks.possible, 0.2)):
        left = test(places, firsts, passage, item)
        assert (left | ~accepted).all()
        assert left.sum() < most * len(left), left.mean()
        assert test(places, firsts, passage[:0], item[:0]).shape == (0,)
