"""Vector codes from exact integer products by limbs.

Vectors become integers, floor(scale * x), and are cut into equal consecutive
parts.  Every part position has a codebook; a vector's code names the nearest
entry of each part.  All arithmetic is exact, so results do not depend on how
rows are dealt to tasks:

1. ``exact_dots`` breaks integers into limbs so short that float64 BLAS
   products stay below 2^53, and recombines the products in int64.
2. A part's squared distances are |x|^2 - 2 x.c + |c|^2; the first smallest one
   names the entry.
3. A round of training is one job: tasks sum the components of the parts that
   each entry won, Spark adds up these sums (a row per part, entry, component and
   task), and the driver divides parts x entries sums: its share is bounded by
   the codebook, not by the data.

Defined cases: vectors that are null or hold null or non-finite components are
dropped.  Components beyond +-2^23 after scaling count as +-2^23, so that no
distance leaves 64 bits.  A vector shorter than the longest one, or than a
multiple of the number of parts, is filled up with zeros.  A null id comes
after all others; rows that repeat an id are rows of their own, ordered by
vector.  With fewer rows than entries, codebooks have as many entries as rows.
A null label is a label.  Sums of errors beyond 64 bits stop at the largest
64-bit integer.  An empty table gives an empty result.  Only the three named
columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqlens.llm.common import ship_code, sized, stored

LARGEST = (1 << 63) - 1


def exact_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of two int64 matrices, exact wherever they fit
    int64: float64 BLAS on limbs, recombined in int64."""
    width = a.shape[1]
    out = np.zeros((len(a), len(b)), np.int64)
    if not width or not out.size:
        return out
    bits = (53 - width.bit_length()) // 2
    for i, x in enumerate(_limbs(a, bits)):
        for j, y in enumerate(_limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def _limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Low limbs in [0, 2^bits), the last one signed, within +-2^bits."""
    found = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << bits:
        found.append((x & np.int64((1 << bits) - 1)).astype(np.float64))
        x = x >> np.int64(bits)
    return [*found, x.astype(np.float64)]


def sound(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & inside, F.lit(False))


def integers(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of every component, within +-limit."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(
        x.cast("double") * scale, F.lit(float(limit))), F.lit(float(-limit)))).cast("int"))


def filled(rows: DataFrame, name: str, multiple: int) -> tuple[DataFrame, int]:
    """Vectors of one length: the longest, rounded up to a multiple."""
    found = rows.agg(F.max(F.size(name)).alias("most"), F.min(F.size(name)).alias("least")).first()
    length = -(-(found["most"] or 0) // multiple) * multiple
    if found["least"] is not None and found["least"] < length:
        rows = rows.withColumn(name, F.concat(name, F.array_repeat(F.lit(0), length - F.size(name))))
    return rows, length


def matrix(column, length: int) -> np.ndarray:
    """An Arrow list column of equal lengths as an int64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of each row, and its squared distance."""
    gap = np.einsum("ij,ij->i", book, book)[None, :] - 2 * exact_dots(part, book)
    at = gap.argmin(axis=1)
    return at, gap[np.arange(len(part)), at] + np.einsum("ij,ij->i", part, part)


def first_books(vectors: DataFrame, parts: int, entries: int, length: int) -> np.ndarray:
    """(part, entry, component): the parts of the first rows by id."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    rows = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, length // parts)
    return rows.transpose(1, 0, 2)


def trained(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: the floor of the mean of what each entry won."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), parts * width).reshape(batch.num_rows, parts, width)
            for p in range(parts):
                at, _ = nearest(rows[:, p], books[p])
                np.add.at(total[p], at, rows[:, p])
                count[p] += np.bincount(at, minlength=entries)
        part, entry, place = np.indices(books.shape).reshape(3, -1)
        won = count[part, entry] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[won]) for x in (part, entry, place, total.reshape(-1), count[part, entry])],
            ["part", "entry", "place", "total", "n"])

    found = vectors.select("v").mapInArrow(sums, "part long, entry long, place long, total long, n long").groupBy(
        "part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                                      F.sum("n").alias("n")).collect()
    books = books.copy()
    for r in found:
        books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): two hex digits a part, and the squared distance."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")

    def run(batches):
        for batch in batches:
            rows = matrix(batch.column(2), parts * width).reshape(batch.num_rows, parts, width)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                at, gap = nearest(rows[:, p], books[p])
                codes[:, p] = at
                error += gap
            text = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()),
                                              pa.array(error)], ["id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("id", "label", "v").mapInArrow(
        run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             id_col: str = "vec_id", label_col: str = "label",
             vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error) of every sound vector, codebooks)."""
    ship_code(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.where(sound(F.col("v"))).withColumn("v", integers(F.col("v"), scale, 1 << 23))
    rows, length = filled(stored(rows, "code-integers"), "v", parts)
    books = first_books(rows, parts, entries, length)
    if books.size:
        for _ in range(rounds):
            books = trained(rows, books)
    done = stored(coded(rows, books), "code-rows")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)"))
    labels = stored(done.groupBy(F.col("label").alias("of")).agg(total.cast("long").alias("label_error")), "code-labels")
    done = done.join(sized(labels), done["label"].eqNullSafe(labels["of"])).drop("of")
    return done, books
