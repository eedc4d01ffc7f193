"""Asking and answering between chunks of documents and parts of a key space.

Operators that need, for every window or n-gram of a text, a number that
depends on the whole corpus use three steps on ordinary Spark shuffles:

* ``chunked``: documents are dealt to chunks by a hash of their id; the rows
  of a chunk travel as a few compressed Arrow batches.
* ``ask``: each chunk sorts and merges its own keys first, then sends every
  part of the key space one message (pre-aggregation before the shuffle).  A
  key that a third of the corpus holds reaches its part once per chunk.
* ``answer``: each part merges what it got and sends every chunk that asked
  one message back, in the order of the chunk's keys.

Chunks and parts have a size that follows ``spark.sql.shuffle.partitions``;
no key, document or group is ever held beyond one chunk or part, and nothing
passes through the driver.  Documents are dealt by (id, text), so copies with
different ids spread out; rows equal in both are one chunk's business.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqlens.llm.common import shuffle_partitions, ship_code

_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")
BUFFER_ROWS_BYTES = 24 << 20


def n_parts(df: DataFrame) -> int:
    """Parts of the key space: what the session's shuffle partitions are sized for."""
    return shuffle_partitions(df.sparkSession)


def n_chunks(df: DataFrame) -> int:
    """Chunks of documents: half of a shuffle partition each, as a task unpacks
    them.  Messages number at most chunks times parts."""
    return 2 * n_parts(df)


def pack_rows(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as writer:
        writer.write(batch)
    return sink.getvalue()


def unpack_rows(payloads: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads])


def chunked(rows: DataFrame, chunks: int, key: list[str]) -> DataFrame:
    """(chunk, payload): ``rows`` dealt to chunks by a hash of ``key``."""
    ship_code(rows.sparkSession)
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int"))

    def flush(held):
        table = pa.Table.from_batches(held)
        chunk = table.column("_chunk").to_numpy()
        table = table.drop_columns(["_chunk"])
        order = np.argsort(chunk, kind="stable")
        sizes = np.bincount(chunk)
        ends = np.cumsum(sizes)
        found, payloads = np.flatnonzero(sizes), []
        for c in found:
            payloads.append(pack_rows(table.take(order[ends[c] - sizes[c]:ends[c]])))
        return pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(payloads, pa.binary())], ["chunk", "payload"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= BUFFER_ROWS_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "chunk int, payload binary")


_C = zstandard.ZstdCompressor(level=1)
_D = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays (or None) as one compressed message; multi-byte numbers are
    stored byte plane by byte plane, which suits sorted and small numbers."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        body = _C.compress(planes)
        out.append(len(body).to_bytes(4, "little") + len(a).to_bytes(4, "little") + body)
    return b"".join(out)


def unpack(payload: bytes, *types) -> list[np.ndarray]:
    at, out = 0, []
    for t in types:
        t = np.dtype(t)
        size = int.from_bytes(payload[at:at + 4], "little")
        n = int.from_bytes(payload[at + 4:at + 8], "little")
        at += 8
        raw = np.frombuffer(_D.decompress(payload[at:at + size], max_output_size=n * t.itemsize), np.uint8) \
            if n else np.zeros(0, np.uint8)
        at += size
        out.append(np.ascontiguousarray(raw.reshape(t.itemsize, n).T).view(t).reshape(n))
    return out


def _messages(pairs: Iterable[tuple[int, bytes]], own: int, names: tuple[str, str]) -> pa.Table:
    to, payloads = [], []
    for k, body in pairs:
        to.append(k)
        payloads.append(body)
    cols = {names[0]: pa.array([own] * len(to), pa.int32()), names[1]: pa.array(to, pa.int32()),
            "payload": pa.array(payloads, pa.binary())}
    return pa.table(cols)


def _by_sender(table: pa.Table, sender: str) -> dict[int, bytes]:
    return dict(zip(table.column(sender).to_pylist(), table.column("payload").to_pylist(), strict=True))


def ask(chunks: DataFrame, work: Callable[[pa.Table], Iterable[tuple[int, bytes]]],
        replies: DataFrame | None = None) -> DataFrame:
    """(chunk, part, payload): ``work`` gets the rows of a chunk (and, with
    ``replies``, a dict part -> message) and yields (part, message)."""
    schema = "chunk int, part int, payload binary"
    if replies is None:
        def alone(key, table):
            rows = unpack_rows(table.column("payload").to_pylist())
            return _messages(work(rows), key[0].as_py(), ("chunk", "part"))
        return chunks.groupBy("chunk").applyInArrow(alone, schema)

    def both(key, left, right):
        if not left.num_rows:
            return _messages([], 0, ("chunk", "part"))
        rows = unpack_rows(left.column("payload").to_pylist())
        return _messages(work(rows, _by_sender(right, "part")), key[0].as_py(), ("chunk", "part"))
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)


def answer(asked: DataFrame, work: Callable[[int, dict[int, bytes]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """(part, chunk, payload): ``work`` gets a part and its messages by chunk
    and yields (chunk, message)."""
    def run(key, table):
        part = key[0].as_py()
        return _messages(work(part, _by_sender(table, "chunk")), part, ("part", "chunk"))
    return asked.groupBy("part").applyInArrow(run, "part int, chunk int, payload binary")


def finish(chunks: DataFrame, replies: DataFrame, work: Callable[[pa.Table, dict], pa.Table], schema) -> DataFrame:
    """Rows of the result: ``work`` gets a chunk's rows and its messages by part."""
    def both(key, left, right):
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _arrow(schema)})
        return work(unpack_rows(left.column("payload").to_pylist()), _by_sender(right, "part"))

    def _arrow(s):
        from pyspark.sql.pandas.types import to_arrow_schema
        return to_arrow_schema(s)
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)


# --------------------------------------------------------------------------
# words and rolling hashes
# --------------------------------------------------------------------------

class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; starts anew when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        import xxhash
        super().__init__()
        self.limit, self.hash = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = self.hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


class Rolling:
    """Hashes of all windows of a sequence of 64-bit numbers: a polynomial
    modulo 2^64 with an odd base, by prefix sums, then mixed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.concatenate(
                [[np.uint64(1)], np.full(n, self.base, np.uint64)]).astype(np.uint64))
            self.down = np.multiply.accumulate(np.concatenate(
                [[np.uint64(1)], np.full(n, self.inverse, np.uint64)]).astype(np.uint64))

    def sums(self, h: np.ndarray) -> np.ndarray:
        if len(h) >= len(self.up):
            self._grow(2 * len(h))
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[:len(h)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return (sums[width:] - sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


ROLL_A = Rolling(0x9E3779B97F4A7C15)
ROLL_B = Rolling(0xD1342543DE82EF95)
