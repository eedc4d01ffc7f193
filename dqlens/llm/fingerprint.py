"""Homomorphic multiset-hash fingerprints of documents.

A text is a multiset of units: its paragraphs (lines), cut after every sentence,
so that a one-line text has several units and one more sentence changes no other.
Each unit is hashed with SHA-512 to a wide vector and the vectors are summed
lane by lane modulo powers of two, so the fingerprint

* does not depend on the order of the units,
* is equal for equal texts (and, but for a clash of 240 hash bits, only for
  equal multisets of units),
* follows insertions and deletions by adding or subtracting the fingerprint
  of what was inserted or deleted (``combine``, ``remove``).

Lanes (``LANES`` = 49 numbers): 8 sums modulo 2^30 of 30 hash bits each, the
number of units modulo 2^30, and 40 sums modulo 2^60 that each count, at bits
0, 20 and 40, the units whose hash has a given bit: 120 counts in all.  With
the number of units, the counts are sums of random signs, whose squared
distance estimates by how many units two texts differ; ``likeness`` is
1 - |a - b|^2 / (|a|^2 + |b|^2), cut to [0, 1]: 1 for equal multisets, about
2 * shared / (units of both) otherwise.  Beyond 2^20 units a count runs over
into its neighbour, which blurs the likeness; sums, equality and updates stay
exact.

DataFrame functions only.  Defined cases: a null text is empty; an empty text
has the all-zero fingerprint; two empty texts have likeness 1.  Texts of any
length are taken whole.  Rows that repeat an id are ordered by text; repeated
rows are each other's next.  An empty table gives an empty result, and in a table
of one row that row is its own next.  Only the two named columns are read, so
others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.llm.common import shuffle_partitions

#: a sentence of one line with what ends it, or what is left of the line
UNIT = r"[^.!?。！？｡\n]*+[.!?。！？｡]++ *+|[^.!?。！？｡\n]++"

_HEX = 15                    # hex digits per hash word: 60 bits
_SUM_WORDS = 4               # words whose two 30-bit halves are summed
_SIGN_WORDS = 2              # words whose 60 bits are counted
_HALF, _SLOT = 30, 20
_LOW = (1 << _HALF) - 1
_TRIPLE = (1 << 2 * _SLOT) + (1 << _SLOT) + 1     # three counts in one sum
_FULL = (1 << 60) - 1
_N_HEAD = 2 * _SUM_WORDS + 1                      # half-word sums and the number of units
_N_TAIL = _SLOT * _SIGN_WORDS                     # sums of three counts
_N_SIGNS = 3 * _N_TAIL
LANES = _N_HEAD + _N_TAIL

SAMPLED = 64                 # ids sampled for each bucket


def units(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))


def _hash_words(unit: Column) -> Column:
    digest = F.sha2(unit, 512)
    return F.array(*[F.conv(F.substring(digest, 1 + _HEX * i, _HEX), 16, 10).cast("long")
                     for i in range(_SUM_WORDS + _SIGN_WORDS)])


def fingerprint(text: Column) -> Column:
    """Fingerprint lanes (array of 49 longs) of a text column."""
    hashed = F.transform(units(text), _hash_words)
    zero = F.lit(0).cast("long")

    def total(value, modulus: int):
        return lambda hs: F.aggregate(hs, zero, lambda acc, h: (acc + value(h)).bitwiseAND(F.lit(modulus)))

    sums = [total(lambda h, i=i: h[i].bitwiseAND(F.lit(_LOW)), _LOW) for i in range(_SUM_WORDS)]
    sums += [total(lambda h, i=i: F.shiftright(h[i], _HALF), _LOW) for i in range(_SUM_WORDS)]
    counts = [total(lambda h, i=i, k=k: F.shiftright(h[i], k).bitwiseAND(F.lit(_TRIPLE)), _FULL)
              for i in range(_SUM_WORDS, _SUM_WORDS + _SIGN_WORDS) for k in range(_SLOT)]
    lanes = [*sums, lambda hs: F.size(hs).cast("long"), *counts]
    # the one-element transform binds the hashed units once for all lanes
    return F.transform(F.array(hashed), lambda hs: F.array(*[f(hs) for f in lanes]))[0]


def _reduced(lanes: Column) -> Column:
    return F.transform(lanes, lambda x, i: x.bitwiseAND(
        F.when(i < _N_HEAD, F.lit(_LOW)).otherwise(F.lit(_FULL))))


def combine(a: Column, b: Column) -> Column:
    """Fingerprint after inserting the units of ``b`` into ``a``."""
    return _reduced(F.zip_with(a, b, lambda x, y: x + y))


def remove(a: Column, b: Column) -> Column:
    """Fingerprint after deleting the units of ``b`` from ``a``."""
    return _reduced(F.zip_with(a, b, lambda x, y: x - y))


def to_text(lanes: Column) -> Column:
    """Fixed-width hexadecimal form of a fingerprint."""
    head = F.transform(F.slice(lanes, 1, _N_HEAD), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    tail = F.transform(F.slice(lanes, _N_HEAD + 1, _N_TAIL), lambda x: F.lpad(F.lower(F.hex(x)), 15, "0"))
    return F.concat(F.array_join(head, ""), F.array_join(tail, ""))


def _signs(lanes: Column) -> Column:
    """The 120 sums of random signs that a fingerprint holds."""
    n = lanes[_N_HEAD - 1].cast("double")
    tail = F.slice(lanes, _N_HEAD + 1, _N_TAIL)
    low = F.lit((1 << _SLOT) - 1)

    def slot(k: int):
        return F.transform(tail, lambda x: F.shiftright(x, k * _SLOT).bitwiseAND(low))

    counts = F.concat(slot(0), slot(1), slot(2))
    return F.transform(counts, lambda c: c * F.lit(2.0) - n)


def _norm(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)


def likeness(a: Column, b: Column) -> Column:
    apart = _norm(F.zip_with(_signs(a), _signs(b), lambda x, y: x - y))
    both = _norm(_signs(a)) + _norm(_signs(b))
    near = F.when(both == 0, F.when(apart == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - apart / both))
    # equal fingerprints are certain; anything else stays below 1
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(near, F.lit(0.999999)))


# --------------------------------------------------------------------------
# neighbours in id order
# --------------------------------------------------------------------------

def _bucket(ids: DataFrame, id_col: str, n: int) -> Column:
    """Bucket of an id: how many of at most ``n`` - 1 cuts it reaches, -1 for
    null.  The cuts are quantiles of a sample of ids, so buckets hold about
    equally many rows however the ids are spread; equal ids stay together."""
    known = ids.where(F.col(id_col).isNotNull())
    share = min(1.0, SAMPLED * n / max(known.count(), 1))
    ranked = F.sort_array(F.collect_list(id_col))
    step = F.greatest(F.lit(1), F.ceil(F.size("ids") / F.lit(n)).cast("int"))
    cuts = known.sample(share, seed=9).agg(ranked.alias("ids")).select(F.to_json(F.array_distinct(
        F.filter("ids", lambda x, i: (i > 0) & (i % step == 0)))).alias("cuts")).first()["cuts"]
    # parsed once, when the plan is made
    cuts = F.from_json(F.lit(cuts), T.ArrayType(ids.schema[id_col].dataType))
    halving = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    reached = F.aggregate(halving, F.lit(0), lambda at, up: F.when(
        (at + up <= F.size(cuts)) & (F.get(cuts, at + up - 1) <= F.col(id_col)), at + up).otherwise(at))
    return F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(reached)


def with_next(docs: DataFrame, id_col: str, derive, carried: list[str],
              buckets: int | None = None) -> DataFrame:
    """``derive(docs)`` with ``next_<c>`` for each carried column: its value in
    the next row by ascending id (null first; equal ids by the carried values),
    after the last row the first.

    Rows are dealt to buckets of consecutive ids and each bucket also gets a
    copy of the first row of the following one, so no row meets more than its
    own bucket and there is one shuffle, whatever the size of the table.  Only
    rows of one id (or without one) cannot be parted.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * shuffle_partitions(spark)
    bucket = _bucket(docs.select(id_col), id_col, buckets)
    # at most buckets + 1 rows: the windows below run over that table only
    firsts = docs.select(bucket.alias("bucket"), id_col).groupBy("bucket").agg(F.min(id_col).alias("first_id"))
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("first_id", F.coalesce(F.lag("bucket").over(order), last).alias("bucket"))

    placed = docs.withColumn("bucket", bucket)
    placed = derive(placed)
    # the halo: one row per bucket, the least by (id, carried columns)
    halo = derive(docs.join(F.broadcast(firsts), docs[id_col].eqNullSafe(firsts["first_id"])))
    halo = halo.groupBy("bucket").agg(F.min(F.struct(*carried)).alias("_h")).select(
        "bucket", F.col("_h.*"), F.lit(True).alias("_halo"))
    both = placed.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy("bucket").orderBy("_halo", F.col(id_col).asc_nulls_first(), *carried)
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where(~F.col("_halo")).drop("bucket", "_halo")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form.

    The edited text replaces the last floor(n / 4) of its n code points by
    the first as many of the next document's text.  Returns id, text, edited,
    the lanes of both and of the next document."""
    base = docs.select(F.col(id_col).alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = with_next(base, "_id", lambda d: d.withColumn("_lanes", fingerprint(F.col("_text"))),
                     ["_text", "_lanes"])
    n = F.char_length("_text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - k),
                      F.substring(F.col("next__text"), F.lit(1), k))
    rows = rows.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), edited.alias("edited"),
                       n.cast("long").alias("n_chars"), F.col("_lanes").alias("lanes"),
                       F.col("next__lanes").alias("next_lanes"))
    return rows.withColumn("edited_lanes", fingerprint(F.col("edited")))
