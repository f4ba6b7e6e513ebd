import hashlib
import random

import numpy as np
import pytest

from glossweave.llm import suffix_dedup as S


def brute(rows, length=S.LENGTH):
    """Rows in the order in which documents count as earlier."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + length, bool)
        for i in range(len(raw) - length + 1):
            window = hash(raw[i:i + length])
            if window in seen:
                gone[i:i + length] = True
            seen.add(window)
        gone = gone[: len(raw)]
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame, **options):
    return sorted((tuple(r) for r in S.deduplicate(frame, **options).collect()), key=str)


def test_cover_has_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


@pytest.mark.parametrize("sizes", [(2 << 20, 16 << 20), (20_000, 30_000), (1, 5_000)])
def test_whole_table(tables, monkeypatch, sizes):
    monkeypatch.setattr(S, "CHUNK_BYTES", sizes[0])
    monkeypatch.setattr(S, "BUCKET_BYTES", sizes[1])
    docs = tables["documents"].where("doc_id < 80") if sizes[0] == 1 else tables["documents"]
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def random_documents(seed):
    draw = random.Random(seed)
    base = "".join(draw.choice("ab") for _ in range(1500))
    rows = []
    for i in range(40):
        parts = []
        for _ in range(draw.randrange(6)):
            start = draw.randrange(len(base))
            parts.append(base[start:start + draw.choice([20, 99, 100, 101, 150, 400])] + draw.choice(["", "x", "é"]))
        rows.append((draw.randrange(10_000) * 100 + i, "".join(parts)))
    return [*rows, (7, "a" * 350), (9, "ab" * 120), (11, "z" * 99), (13, "z" * 100), (12, "q" * 101)]


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "CHUNK_BYTES", 900)
    monkeypatch.setattr(S, "BUCKET_BYTES", 700)
    rows = random_documents(seed)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_odd_rows(spark, odd, odd_rows, nothing):
    plain = spark.createDataFrame([r[:2] for r in odd_rows], "doc_id long, text string").coalesce(1)
    assert found(plain) == brute([r[:2] for r in odd_rows])
    assert len(found(odd)) == len(odd_rows)
    assert found(nothing) == []


def test_kept_bytes(spark):
    rows = [(1, "x" * 30 + "shared passage " * 9), (2, "shared passage " * 9 + "tail")]
    kept = {r.doc_id: bytes(r.kept) for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert kept[2] == b"tail" and len(kept[1]) < 165
