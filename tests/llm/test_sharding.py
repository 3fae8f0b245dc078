import zlib

import pytest

from colloquy.llm.sharding import balanced_shards
from tests.llm.helpers import none, with_clashes


def brute(rows, shards):
    """Shards by the definition: rows in order, cut by their middle bytes."""
    sized = sorted((i is not None, i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    total, before, slots, out = sum(r[3] for r in sized), 0, {}, []
    for _, i, crc, size in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, size, crc, "bytes", shard, slots[shard], None))
        before += size
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_against_brute_force(spark, shards):
    rows = [(i * 7 % 101, "é" * (i * i % 50)) for i in range(300)] + [(None, "x"), (None, None), (5, None), (5, "")]
    got = [tuple(r) for r in balanced_shards(with_clashes(spark, rows), shards).collect()]
    assert order(got) == order(brute(rows, shards))


def test_repeated_rows_and_one_long_text(spark):
    rows = [(1, "same")] * 400 + [(2, "y" * 5000)]
    got = balanced_shards(with_clashes(spark, rows), 8).collect()
    assert len(got) == 401
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_balance(spark):
    rows = [(i, "z" * (i * 37 % 97)) for i in range(2000)]
    got = balanced_shards(with_clashes(spark, rows), 8).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)


def test_empty_table(spark):
    assert balanced_shards(none(spark)).count() == 0
