import math
from collections import Counter

import numpy as np
import pytest

from glossweave.llm import url_filter
from glossweave.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for rule in URL_RULES:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path):
            if best is None or len(rule.text) > len(best.text):
                best = rule
    return best


def plain_difference(text, grams, contexts, order=url_filter.ORDER):
    """The models' definition with dictionaries, without hashing."""
    signs = text.encode() + b"\x01"
    padded = b"\x00" * order + signs
    total = 0.0
    for i, sign in enumerate(signs):
        for kind, side in ((1, 1), (0, -1)):
            chance = 1 / 257
            for k in range(order + 1):
                context = padded[i + order - k:i + order]
                seen = contexts[kind][context, k]
                if seen >= url_filter.MIN_CONTEXT:
                    chance = (grams[kind][context, k, sign] + url_filter.PRIOR * chance) / (seen + url_filter.PRIOR)
            total += side * math.log(chance)
    return total / len(signs)


def test_models_are_smoothed_counts(spark):
    rows = [(f"good.host/{i}/index", 1) for i in range(40)] + [(f"spam.site/buy{i}?", 0) for i in range(30)] + [("", 1)]
    counts = url_filter.count_cells(spark.createDataFrame(rows, "text string, kind int").repartition(3), url_filter.ORDER, url_filter.BITS).collect()
    tables = np.zeros((2, 2, url_filter.ORDER + 1, 1 << url_filter.BITS), np.float32)
    for r in counts:
        tables[:, r.kind, r.order, r.cell] = r.gram, r.context
    grams, contexts = ([Counter(), Counter()] for _ in range(2))
    for text, kind in rows:
        signs = text.encode() + b"\x01"
        padded = b"\x00" * url_filter.ORDER + signs
        for i, sign in enumerate(signs):
            for k in range(url_filter.ORDER + 1):
                context = padded[i + url_filter.ORDER - k:i + url_filter.ORDER]
                grams[kind][context, k, sign] += 1
                contexts[kind][context, k] += 1
    texts = ["good.host/7/index", "spam.site/buy", "other", "", "ü/é"]
    found = url_filter.differences(texts, tables[0], tables[1])
    assert np.allclose(found, [plain_difference(t, grams, contexts) for t in texts], atol=1e-3)
    assert found[0] > 0.3 and found[1] < -0.3


def test_whole_table(tables):
    pages = tables["pages"]
    given = {r.page_id: r.url for r in pages.collect()}
    rows = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(rows) == len(given)
    for r in rows:
        host, path = split(given[r.page_id])
        rule = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)


def test_the_models_tell_kinds_apart(spark):
    rows = [(i, f"http://h{i}.example.org/{lang}/{i * 37 % 901}") for i in range(600) for lang in [("en/2", "es")[i % 2]]]
    rows += [(1000 + i, f"http://q{i}.example.net/{('en/2', 'es')[i % 2]}/{i}") for i in range(60)]
    found = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    wrong = sum(found[1000 + i] != ("allow", "block")[i % 2] for i in range(60))
    assert wrong <= 3


@pytest.mark.parametrize("kind", ["odd", "empty", "unruled"])
def test_odd_urls(spark, kind):
    odd = [
        (1, None), (2, ""), (3, "no scheme/fr/"), (4, "http://A.EXAMPLE.ORG/es/x?y#z"), (5, "http://example.org"),
        (6, "ftp://x://y.org/"), (7, "http://ÄB.org/é"), (None, "http://example.org/en/1"), (8, "://"), (9, "http://xorg/"),
        (10, "http://a.com/fr/" + "x" * 200_000), (10, "http://a.com/fr/"), (11, "http://line\nbreak.com/de/\n?"),
    ]
    given = {"odd": odd, "empty": [], "unruled": [(1, "http://a.net/"), (2, None), (2, None)]}[kind]
    frame = spark.createDataFrame([(*r, "c", "c") for r in given], "page_id long, url string, host string, score string")
    rows = url_filter.judge_urls(frame, URL_RULES).collect()
    expected = []
    for page_id, url in given:
        host, path = split(url)
        rule = ruled(host, path)
        expected.append((page_id, host, path, rule.text if rule else None))
    assert sorted(map(str, expected)) == sorted(str((r.page_id, r.host, r.path, r.rule)) for r in rows)
    for r in rows:
        assert r.rule or r.host or r.path or r.verdict == "allow"
    if kind == "unruled":
        assert {r.score for r in rows} == {0.0}


def test_cut_is_the_middle_of_the_best():
    bins, kinds, counts = np.array([-10, -8, 4, 6]), np.array([0, 0, 1, 1]), np.array([5, 5, 3, 3])
    cut = url_filter.calibrated_cut(bins, kinds, counts)
    assert -8 / 50 < cut <= 4 / 50
    assert url_filter.calibrated_cut(bins[:2], kinds[:2], counts[:2]) == 0.0
