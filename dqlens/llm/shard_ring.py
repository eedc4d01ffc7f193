"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at several places of a ring; a document's key (its id) hashes
to a place and belongs to the next shard clockwise.  Shards have a capacity; keys
that find theirs full go on clockwise.  So the balance is guaranteed, and another
shard or another document moves only the keys near the places that change.

Keys between two neighbouring places (an arc) try the same shards in the same
order, so how many of them go where is decided from counts:

1. Narrow rows (id, size, checksum, place) are range-partitioned and sorted by
   place and written once with their position in their partition.
2. Counts per partition and arc (their number is bounded by places and
   partitions) reach the driver.  In wave w, the keys left of every arc try the
   shard w places clockwise; a full shard turns them away.  Within a shard, earlier
   arcs come first, within an arc the smaller places.
3. The outcome is a list of ranges of global positions, at most a few more than
   arcs; a look-up gives each row its shard and its slot there.

With ``slack`` 0 the capacities are the rows divided evenly, the remainder going
to the shards of least number: counts differ by one at most (law ``rows``).  With
a slack e, a shard takes at most ceil((1 + e) * rows / shards), and fewer keys move.

Defined cases: a null text has size 8 and checksum 0; an empty text too.  A null
id hashes as the empty string.  Rows that repeat an id hash to one place; what
exceeds a shard goes on, so a hot id does not unbalance the shards; such rows are
told apart by checksum and size, and rows equal in all of it are interchangeable.
Fewer documents than shards: shards may be empty.  An empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqlens.llm.common import ship_code, shuffle_partitions, stored

HEX_DIGITS = 15                    # a place on the ring: so many digits of an MD5
LAW = "rows"


def place_of(key: Column) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def ring(shards: int, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ascending order, and the shard that stands at each."""
    spots = sorted((int(hashlib.md5(f"shard {s}, replica {r}".encode()).hexdigest()[:HEX_DIGITS], 16), s)
                   for s in range(shards) for r in range(replicas))
    return np.array([p for p, _ in spots], np.int64), np.array([s for _, s in spots], np.int64)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def ranges(counts: list[int], owners: np.ndarray, room: list[int]) -> list[tuple[int, int, int]]:
    """(first position, shard, first slot) of every range of positions.

    ``counts``: rows per arc, the last arc (beyond the last place) belonging to
    the first place again."""
    n, room = len(owners), np.array(room, np.int64)
    left = np.array(counts, np.int64)
    at = np.concatenate([[0], np.cumsum(left)[:-1]])
    pieces = []
    arcs = np.arange(len(counts))
    for wave in range(n):
        aim = owners[(arcs + wave) % n]
        for a in np.flatnonzero((left > 0) & (room[aim] > 0)):
            take = min(left[a], room[aim[a]])
            if take:
                pieces.append((int(at[a]), int(aim[a]), int(take)))
                at[a] += take
                left[a] -= take
                room[aim[a]] -= take
        if not left.any():
            break
    used, out = dict.fromkeys(range(len(room)), 0), []
    for first, shard, take in sorted(pieces):
        out.append((first, shard, used[shard]))
        used[shard] += take
    return out


def place(docs: DataFrame, shards: int = 24, replicas: int = 64, slack: float = 0.0, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every document."""
    spark = docs.sparkSession
    ship_code(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), place_of(F.col(id_col)).alias("spot"),
                       F.monotonically_increasing_id().alias("salt"))
    order = ["spot", "id", "text_crc32", "size", "salt"]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    dealt = dealt.select("id", "size", "text_crc32", "spot", part.alias("part"), F.monotonically_increasing_id().bitwiseAND(
        (1 << 33) - 1).alias("at"))
    dealt = stored(dealt, "ring-rows")
    spots, owners = ring(shards, replicas)

    def arcs(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.searchsorted(spots, batch.column(1).to_numpy()))], ["part", "arc"])

    found = dealt.select("part", "spot").mapInArrow(arcs, "part int, arc long").groupBy("part", "arc").count().collect()
    per_arc, per_part = [0] * (len(spots) + 1), {}
    for r in found:
        per_arc[r["arc"]] += r["count"]
        per_part[r["part"]] = per_part.get(r["part"], 0) + r["count"]
    cuts = ranges(per_arc, owners, capacities(sum(per_arc), shards, slack))
    first = np.array([c[0] for c in cuts], np.int64)
    shard_of = np.array([c[1] for c in cuts], np.int32)
    slot_of = np.array([c[2] for c in cuts], np.int64)
    before = np.zeros(max(per_part, default=0) + 2, np.int64)
    for p, n in per_part.items():
        before[p + 1] = n
    before = np.cumsum(before)

    def settle(batches):
        for batch in batches:
            ids, size, crc, parts, at = batch.columns
            spot = before[parts.to_numpy()] + at.to_numpy()
            k = np.searchsorted(first, spot, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [ids, size, crc, pa.array(shard_of[k]), pa.array(slot_of[k] + spot - first[k])],
                ["id", "size", "text_crc32", "shard", "slot"])

    return dealt.select("id", "size", "text_crc32", "part", "at").mapInArrow(
        settle, f"id {dict(rows.dtypes)['id']}, size long, text_crc32 long, shard int, slot long")
