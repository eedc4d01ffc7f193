"""Hard negatives by rotated one-bit codes with certain bounds.

An anchor's positives are its best rows of the same label; the hard negatives of
a pair are the best rows of other labels whose score lies between a share of the
positive's score and that score.  Scores are integer inner products of vectors
floor(scale * x).

1. Codes.  Vectors are rotated by random signs and a Walsh-Hadamard transform,
   which keeps integers integers and multiplies every inner product by the
   length.  A code is the signs of a rotated vector, the next code the signs of
   what the one before leaves; stored with each is its alignment, the inner
   product of code and vector, and the norm of what is left at last.
2. Estimates.  A query is rounded to a few bit planes; the inner product of a
   code and a plane is a popcount.  Alignments times these products estimate the
   score.  What is left of the row is orthogonal to its last code, so
   Cauchy-Schwarz bounds its share by the norms of what is left of both; the
   rounding of the query is bounded in the same way.  The interval is certain.
3. Filter.  The best estimates are scored first; they set the bar.  Rows whose
   interval stays below it, or outside the wanted scores, are settled; all
   others are scored in integers.
4. Blocks.  Rows and queries are dealt to blocks of bounded size by a number
   written down with them, and every query block meets every row block once, in
   a task of its own; each pair of blocks hands on its best few for the final
   ranking.  Queries are the stated set, so this is a search, not a self-join.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part.  Components beyond +-2^20 after scaling count as +-2^20.
Shorter vectors are filled up with zeros.  Rows that repeat an id are rows of
their own: each is an anchor, a positive or a negative by itself.  A null id is
no anchor, keeps its label and comes after all others in ties.  Anchors without
positives or negatives return nothing; a negative score of a positive admits no
negative, zero admits zero.  An empty table gives an empty result.  Only the three
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqlens.llm.common import ship_code, shuffle_partitions, stored
from dqlens.llm.vector_codes import filled, integers, matrix, sound

LEVELS = 4                      # codes of a row, each of what the one before leaves
PLANES = 8                      # bits of a rounded query component
ROWS, QUERIES = 32_768, 8_192   # most of a block
LAST_ID = (1 << 63) - 1


def signs(length: int) -> np.ndarray:
    return np.random.default_rng(20_240_607).integers(0, 2, length) * 2 - 1


def rotated(v: np.ndarray) -> np.ndarray:
    """Random signs, then the Walsh-Hadamard transform, filled up to a power of
    two of at least 64: integers whose inner products are ``length`` times the
    original ones."""
    length = 1 << max(6, (v.shape[1] - 1).bit_length() if v.shape[1] else 0)
    out = np.zeros((len(v), length), np.int64)
    out[:, :v.shape[1]] = v * signs(length)[:v.shape[1]]
    half = 1
    while half < length:
        pairs = out.reshape(len(v), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(v), length)
        half *= 2
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 / 1 as 64-bit words."""
    return np.packbits(bits.astype(bool), axis=-1).view(np.uint64)


class RowCodes:
    """Codes and alignments of rotated rows, and the norm of what is left."""

    def __init__(self, turned: np.ndarray):
        n = turned.shape[1]
        left = turned.astype(np.float64)
        self.length, self.codes, self.align = n, [], []
        for _ in range(LEVELS):
            positive = left >= 0
            align = np.abs(left).sum(axis=1)
            left = left - np.where(positive, 1.0, -1.0) * (align / n)[:, None]
            self.codes.append(packed(positive))
            self.align.append(align)
        self.norm = np.sqrt(np.einsum("ij,ij->i", turned.astype(np.float64), turned.astype(np.float64)))
        self.left = np.sqrt(np.einsum("ij,ij->i", left, left))


class Query:
    """A rotated query rounded to bit planes."""

    def __init__(self, turned: np.ndarray):
        top = int(np.abs(turned).max(initial=0))
        self.shift = max(0, top.bit_length() - (PLANES - 1))
        half = (1 << self.shift) >> 1
        self.rounded = (turned + half) >> self.shift                    # within PLANES signed bits and one more
        planes = np.arange(PLANES + 1)
        self.planes = packed((self.rounded[None, :] >> planes[:, None]) & 1)
        self.weights = np.where(planes < PLANES, 1 << planes, -(1 << PLANES))
        self.sum = int(self.rounded.sum())
        coarse = self.rounded.astype(np.float64) * (1 << self.shift)
        self.norm2 = float(coarse @ coarse)
        self.rest = float(np.sqrt(((turned - coarse) ** 2).sum()))

    def interval(self, rows: RowCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate and certain bounds of the scores of all rows."""
        n = rows.length
        middle, along = 0.0, 0.0
        for code, align in zip(rows.codes, rows.align, strict=True):
            hits = np.bitwise_count(code[:, None, :] & self.planes[None, :, :]).sum(axis=2, dtype=np.int64) @ self.weights
            along = (2 * hits - self.sum) * float(1 << self.shift)        # code times rounded query
            middle = middle + align * along / n
        beside = np.sqrt(np.maximum(0.0, self.norm2 - along * along / n))
        width = rows.left * beside + self.rest * rows.norm
        width += 1e-9 * rows.norm * (np.sqrt(self.norm2) + self.rest) + 1e-6 * n    # of float64
        return middle / n, (middle - width) / n, (middle + width) / n


class Block:
    """The rows of one block, ready to be searched."""

    def __init__(self, table: pa.Table, length: int):
        self.row, self.tie, self.label = (table.column(c).to_numpy() for c in ("row", "tie", "label"))
        self.v = matrix(table.column("v"), length)
        self.codes = RowCodes(rotated(self.v))

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.v[at] @ query

    def best(self, at: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.row[at], self.tie[at], -scores))[:most]
        return at[order], scores[order]

    def bar(self, among: np.ndarray, middle: np.ndarray, query: np.ndarray, most: int, low: float, high: float) -> float:
        """A score that ``most`` of these rows reach without exceeding ``high``,
        found by scoring the best estimates; else ``low``."""
        tries = 3 * most
        if len(among) > tries:
            among = among[np.argpartition(-middle[among], tries)[:tries]]
        got = self.scores(among, query)
        got = np.sort(got[(got <= high) & (got >= low)])
        return max(low, float(got[-most])) if len(got) >= most else low


def same_label(block: Block, query: dict, turned: Query, most: int):
    """The block's best rows of the query's label: (places, scores)."""
    among = np.flatnonzero((block.label == query["label"]) & (block.row != query["row"]))
    if not len(among):
        return among, among
    middle, _, high = turned.interval(block.codes)
    bar = block.bar(among, middle, query["v"], most, -np.inf, np.inf)
    among = among[high[among] >= bar]
    return block.best(among, block.scores(among, query["v"]), most)


def other_labels(block: Block, query: dict, turned: Query, wanted: list[int], share: tuple[int, int], most: int):
    """For each wanted score the block's best rows of other labels between its
    share and it: {wanted: (places, scores)}."""
    other = np.flatnonzero(block.label != query["label"])
    wanted = [w for w in wanted if w >= 0]
    if not len(other) or not wanted:
        return {}
    middle, low, high = turned.interval(block.codes)
    out = {}
    for w in wanted:
        least = share[0] * w / share[1] - 0.5
        among = other[(high[other] >= least) & (low[other] <= w)]
        bar = block.bar(among[middle[among] <= w], middle, query["v"], most, least, w)
        among = among[high[among] >= bar]
        scores = block.scores(among, query["v"])
        inside = (share[1] * scores >= share[0] * w) & (scores <= w)
        out[w] = block.best(among[inside], scores[inside], most)
    return out


def blocks(rows: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """How many blocks of rows and of queries: bounded sizes, and at least one
    block of rows a shuffle partition where there are enough rows."""
    n, m = rows.count(), queries.count()
    return max(1, -(-n // ROWS), min(shuffle_partitions(rows.sparkSession), n // 512)), max(1, -(-m // QUERIES))


def met(rows: DataFrame, queries: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on every pair of a block of rows and a block of queries."""
    n, m = blocks(rows, queries)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("a", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn("b", every(m))
    right = queries.toDF(*queries.columns).withColumn("b", F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")).withColumn("a", every(n))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, schema)


def ranked(found: DataFrame, keys: list[str], score: str, tie: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, is_anchor=None, positives: int = 5, negatives: int = 5,
                   share: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id",
                   label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    ``is_anchor``: a function of the id column; default: divisible by 100."""
    ship_code(vectors.sparkSession)
    chosen = (is_anchor or (lambda c: c % 100 == 0))(F.col("id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).alias("v"))
    rows = rows.where(F.col("label").isNotNull() & sound(F.col("v")))
    rows = stored(rows.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(LAST_ID)).alias("tie"), "label",
        integers(F.col("v"), scale, 1 << 20).alias("v"), F.coalesce(chosen, F.lit(False)).alias("anchor")), "mining-rows")
    rows, length = filled(rows, "v", 1)
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")
    columns = ["anchor", "anchor_tie", "positive", "positive_tie", "positive_score"]

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in columns]
        if left.num_rows and right.num_rows:
            block, query = Block(left, length), Block(right, length)
            turned = rotated(query.v)
            for i in range(len(query.row)):
                one = {"row": query.row[i], "label": query.label[i], "v": query.v[i]}
                at, scores = same_label(block, one, Query(turned[i]), positives)
                for column, values in zip(out, (np.full(len(at), query.row[i]), np.full(len(at), query.tie[i]),
                                                block.row[at], block.tie[at], scores), strict=True):
                    column.extend(values.tolist())
        return pa.table([pa.array(c, pa.int64()) for c in out], columns)

    pairs = met(rows, anchors, find_positives, ", ".join(f"{c} long" for c in columns))
    pairs = stored(ranked(pairs, ["anchor"], "positive_score", ["positive_tie", "positive"], positives).drop("rank"),
                   "mining-positives")
    known = pairs.groupBy(F.col("anchor").alias("row"), F.col("anchor_tie").alias("tie")).agg(
        F.collect_list(F.struct("positive", "positive_tie", "positive_score")).alias("positives"))
    asking = stored(anchors.drop("tie").join(known, "row"), "mining-queries")
    more = [*columns, "negative", "negative_tie", "negative_score"]

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in more]
        if left.num_rows and right.num_rows:
            block, query = Block(left, length), Block(right, length)
            turned = rotated(query.v)
            for i, own in enumerate(right.column("positives").to_pylist()):
                one = {"label": query.label[i], "v": query.v[i]}
                found = other_labels(block, one, Query(turned[i]), sorted({p["positive_score"] for p in own}), share, negatives)
                for p in own:
                    at, scores = found.get(p["positive_score"], ((), ()))
                    for j, score in zip(at, scores, strict=True):
                        for column, value in zip(out, (query.row[i], query.tie[i], p["positive"], p["positive_tie"],
                                                       p["positive_score"], block.row[j], block.tie[j], score), strict=True):
                            column.append(int(value))
        return pa.table([pa.array(c, pa.int64()) for c in out], more)

    found = met(rows, asking, find_negatives, ", ".join(f"{c} long" for c in more))
    found = ranked(found, ["anchor", "positive"], "negative_score", ["negative_tie", "negative"], negatives)
    shown = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return found.select(F.col("anchor_tie").alias("anchor_id"), shown("positive_tie").alias("positive_id"), "rank",
                        shown("negative_tie").alias("negative_id"), "positive_score", "negative_score")
