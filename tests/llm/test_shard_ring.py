"""Operator 11: balance, movement, the sequential form of the waves, odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from dqlens.llm import shard_ring as RING


def spot(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def one_by_one(rows, shards, replicas, slack):
    """Every key walks clockwise by itself, wave after wave: {row: (shard, order)}.
    rows: (id, text)."""
    places = sorted((spot(f"shard {s}, replica {r}"), s) for s in range(shards) for r in range(replicas))
    keys = sorted((spot("" if i is None else str(i)), i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()), k)
                  for k, (i, t) in enumerate(rows))
    n = len(places)
    start = [next((a for a, (p, _) in enumerate(places) if p >= key[0]), n) for key in keys]
    room, found = RING.capacities(len(rows), shards, slack), {}
    for wave in range(n):
        for k in range(len(keys)):
            s = places[(start[k] + wave) % n][1]
            if k not in found and room[s] > 0:
                found[k] = s
                room[s] -= 1
    used, out = Counter(), []
    for k, key in enumerate(keys):
        i, t = rows[key[-1]]
        out.append((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), found[k], used[found[k]]))
        used[found[k]] += 1
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("id", "size", "text_crc32", "shard", "slot").collect()]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_waves_equal_single_walks(spark, small_docs, slack):
    docs = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    got = rows_of(RING.place(small_docs, 7, 5, slack))
    assert order(got) == order(one_by_one(docs, 7, 5, slack))


def test_awkward_rows(spark, awkward, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = rows_of(RING.place(awkward))
    assert order(got) == order(one_by_one(docs, 24, 64, 0.0))
    assert rows_of(RING.place(no_docs)) == []


def test_hot_id_fills_shards_evenly(spark):
    rows = spark.range(900).selectExpr("if(id < 300, 5, if(id < 320, null, id)) AS doc_id",
                                       "if(id < 200, 'same', concat('t', id)) AS text")
    got = rows_of(RING.place(rows))
    counts, slots = Counter(r[3] for r in got), defaultdict(list)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24
    for r in got:
        slots[r[3]].append(r[4])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r[:3] for r in got) == Counter(
        (i, len(t) + 8, zlib.crc32(t.encode())) for i, t in [(r[0], r[1]) for r in rows.collect()])


def test_few_keys_move_to_one_more_shard(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    before, after = ({r[0]: r[3] for r in rows_of(RING.place(rows, n, 64, 0.25))} for n in (24, 25))
    assert sum(before[i] != after[i] for i in before) < 0.2 * len(before)
    assert max(Counter(after.values()).values()) <= 200
