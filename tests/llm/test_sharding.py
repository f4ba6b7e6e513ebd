import zlib

import numpy as np

from glossweave.llm.sharding import assign_shards, jump_hash, with_shards


def jump(key, shards):
    key %= 1 << 64
    bucket, ahead = -1, 0
    while ahead < shards:
        bucket = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((bucket + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return bucket


def test_jump_hash_is_the_published_loop():
    keys = [0, 1, 2, 10, 2**40, -1, -5, 2**63 - 1, *range(1000, 1300)]
    for shards in (1, 2, 8, 9, 1000):
        assert jump_hash(np.array(keys, np.int64), shards).tolist() == [jump(k, shards) for k in keys]


def test_appended_shard_takes_only_its_share():
    keys = np.arange(20_000)
    before, after = jump_hash(keys, 8), jump_hash(keys, 9)
    moved = before != after
    assert (after[moved] == 8).all() and 0.09 < moved.mean() < 0.13


def check(rows, given):
    assert len(rows) == len(given)
    for shard in range(8):
        mine = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in mine]
        assert keys == sorted(keys)
    expected = sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(-1 if d is None else d, 8)) for d, t in given
    )
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in rows) == expected


def test_whole_table(tables):
    docs = tables["documents"]
    check(assign_shards(docs, 8).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, odd_rows, nothing):
    check(assign_shards(odd, 8).collect(), [r[:2] for r in odd_rows])
    assert assign_shards(nothing, 8).collect() == []
    assert with_shards(odd, 8).count() == len(odd_rows)
