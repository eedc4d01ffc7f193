"""Substring deduplication with fixed-block anchors.

A window of ``width`` words that occurs anywhere else is removed from every
place where it occurs.  With blocks of ``(width + 1) // 2`` words, each window
holds at least one whole block that starts at a multiple of the block length
of its document.  So:

1. index: the non-overlapping blocks of every document are the reference
   blocks; probe: every rolling window of block length, of all documents, is
   looked up.  A probe is a hit if its words are a reference block somewhere
   and occur at least twice.
2. extend: around each hit, the windows of full width that hold it are hashed
   to 128 bits and counted over the corpus.  Those that occur twice, the same
   document included, make up the maximal exact repeats.
3. every word under such a window is removed.

Both look-ups are asked and answered between chunks of documents and parts of
the key space (``exchange``), so a passage that a third of all documents share
is one key per chunk, and no pair of documents is ever formed.  Probes are
compared by about 60 bits (a false hit is only extended in vain); windows by
127 bits of two independent polynomial hashes over 64-bit word hashes.

Defined cases: a null or empty text has no words and nothing removed; a text
with fewer words than the window is kept; repeated rows (same id and text)
repeat each other, so their windows go; ids are only carried, null or not; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.llm import exchange as X
from dqlens.llm.common import mix64, stored

WIDTH = 35
_LOW48 = np.uint64((1 << 48) - 4)       # 46 bits of a key; the lowest two bits carry marks
_BLOCK, _MULTI = np.uint64(1), np.uint64(2)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _probes(rows: pa.Table, width: int, block: int):
    """Per document of at least ``width`` words: its word hashes and the
    rolling hashes of block length.  Words live for one document only."""
    hashes = X.WordHashes()
    for text in rows.column("text"):
        words = X.encoded(text.as_py()).split()
        if len(words) >= width:
            h = hashes.of(words)
            yield h, mix64(X.ROLL_A.windows(X.ROLL_A.sums(h), block))


def _windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window; the lowest bit of the
    second is free for a mark."""
    first = mix64(X.ROLL_A.windows(X.ROLL_A.sums(h), width))
    second = mix64(X.ROLL_B.windows(X.ROLL_B.sums(mix64(h ^ np.uint64(0x5851F42D4C957F2D))), width))
    return first, second & ~np.uint64(1)


def _split(part: np.ndarray, parts: int):
    """(part, slice) of a column sorted by part."""
    ends = np.searchsorted(part, np.arange(parts + 1, dtype=part.dtype))
    for p in range(parts):
        if ends[p + 1] > ends[p]:
            yield p, slice(int(ends[p]), int(ends[p + 1]))


def _ask_probes(width: int, block: int, parts: int):
    def work(rows: pa.Table):
        keys = []
        for _, h in _probes(rows, width, block):
            marked = h & ~np.uint64(3)
            marked[::block] |= _BLOCK
            keys.append(marked)
        if not keys:
            return
        keys = np.sort(np.concatenate(keys))
        plain = keys >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
        # equal keys are neighbours, the marked one last
        last = np.concatenate([first[1:], [len(keys)]]) - 1
        multi = np.where(last > first, _MULTI, np.uint64(0))
        merged = (plain[first] << np.uint64(2)) | (keys[last] & _BLOCK) | multi
        for p, s in _split(_part_of(merged, parts), parts):
            yield p, _pack48(merged[s])
    return work


def _pack48(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key: the part stands for the bits above."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(payload: bytes) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def _answer_probes(part: int, messages: dict[int, bytes]):
    """Hits: keys that are a block somewhere and occur at least twice."""
    senders = list(messages)
    parts_ = [_unpack48(messages[c]) for c in senders]
    keys = np.concatenate(parts_)
    sender = np.repeat(np.arange(len(senders)), [len(k) for k in parts_])
    plain = keys >> np.uint64(2)
    order = np.argsort(plain, kind="stable")
    plain, keys, sender = plain[order], keys[order], sender[order]
    first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    marks = np.bitwise_or.reduceat(keys, first)
    hit = ((marks & _BLOCK) > 0) & ((size > 1) | ((marks & _MULTI) > 0))
    chosen = np.repeat(hit, size)
    plain, sender = plain[chosen], sender[chosen]
    order = np.argsort(sender, kind="stable")
    plain, sender = plain[order], sender[order]
    for k, s in _split(sender, len(senders)):
        yield senders[k], _pack48(plain[s] << np.uint64(2))


def _ask_windows(width: int, block: int, parts: int):
    def work(rows: pa.Table, replies: dict[int, bytes]):
        hits = {p: _unpack48(body) for p, body in replies.items()}
        if not hits:
            return
        # hits as (part, 48 bits) in one sorted column
        known = np.sort(np.concatenate([np.uint64(p) << np.uint64(48) | k for p, k in hits.items()]))
        one, two = [], []
        for h, probe in _probes(rows, width, block):
            at = _part_of(probe, parts) << np.uint64(48) | (probe & _LOW48)
            place = np.minimum(np.searchsorted(known, at), len(known) - 1)
            found = np.flatnonzero(known[place] == at)
            if not len(found):
                continue
            # windows that hold a hit: they start up to width - block words before it
            mark = np.zeros(len(h) + 1, np.int32)
            np.add.at(mark, np.maximum(found - (width - block), 0), 1)
            np.add.at(mark, found + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[:len(h) - width + 1] > 0)
            a, b = _windows(h, width)
            one.append(a[starts])
            two.append(b[starts])
        if not one:
            return
        yield from _messages_of_windows(np.concatenate(one), np.concatenate(two), parts)
    return work


def _messages_of_windows(one: np.ndarray, two: np.ndarray, parts: int):
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    again = np.diff(np.concatenate([first, [len(one)]])) > 1
    one, two = one[first], two[first] | again.astype(np.uint64)
    for p, s in _split(_part_of(one, parts), parts):
        yield p, X.pack(one[s], two[s])


def _answer_windows(part: int, messages: dict[int, bytes]):
    """Windows that occur at least twice."""
    senders = list(messages)
    got = [X.unpack(messages[c], np.uint64, np.uint64) for c in senders]
    one, two = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    sender = np.repeat(np.arange(len(senders)), [len(g[0]) for g in got])
    again, two = (two & np.uint64(1)) > 0, two & ~np.uint64(1)
    order = np.lexsort((two, one))
    one, two, again, sender = one[order], two[order], again[order], sender[order]
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    size = np.diff(np.concatenate([first, [len(one)]]))
    twice = np.repeat((size > 1) | np.logical_or.reduceat(again, first), size)
    one, two, sender = one[twice], two[twice], sender[twice]
    order = np.argsort(sender, kind="stable")       # stays sorted by window within a sender
    one, two, sender = one[order], two[order], sender[order]
    for k, s in _split(sender, len(senders)):
        yield senders[k], X.pack(one[s], two[s])


def _remove(width: int, id_type: pa.DataType):
    def work(rows: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        got = [X.unpack(body, np.uint64, np.uint64) for _, body in sorted(replies.items())]
        known_a = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint64)
        known_b = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.uint64)
        hashes = X.WordHashes()
        n_words, kept, spans = [], [], []
        for text in rows.column("text"):
            words = X.encoded(text.as_py()).split()
            n = len(words)
            n_words.append(n)
            gone = np.zeros(0, np.int64)
            if n >= width and len(known_a):
                a, b = _windows(hashes.of(words), width)
                place = np.minimum(np.searchsorted(known_a, a), len(known_a) - 1)
                hit = np.flatnonzero((known_a[place] == a))
                if len(hit):
                    same = known_b[place[hit]] == b[hit]
                    if not same.all():              # equal first hashes of different windows
                        pairs = set(zip(known_a.tolist(), known_b.tolist(), strict=True))
                        same = np.array([(int(a[i]), int(b[i])) in pairs for i in hit])
                    gone = hit[same]
            if not len(gone):
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                spans.append([])
                continue
            mark = np.zeros(n + 1, np.int32)
            np.add.at(mark, gone, 1)
            np.add.at(mark, gone + width, -1)
            under = np.concatenate([[False], np.cumsum(mark[:n]) > 0, [False]])
            edges = np.flatnonzero(under[1:] != under[:-1])
            spans.append([{"start": int(s), "stop": int(e)} for s, e in edges.reshape(-1, 2)])
            keep = [w for w, out in zip(words, under[1:-1].tolist(), strict=True) if not out]
            kept.append(b" ".join(keep).decode("utf-8", "surrogatepass"))
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table({"id": rows.column("id").cast(id_type), "n_words": pa.array(n_words, pa.int64()),
                         "removed": pa.array(spans, span), "kept": pa.array(kept, pa.string())})
    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WIDTH) -> DataFrame:
    """Per row: id, n_words, removed (word spans start, stop of the maximal
    repeats), kept (the other words, joined by one space)."""
    from pyspark.sql.pandas.types import to_arrow_type
    block = (width + 1) // 2
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_field = rows.schema["id"]
    parts = X.n_parts(docs)
    chunks = X.chunked(rows, X.n_chunks(docs), ["id", "text"])
    hits = stored(X.answer(X.ask(chunks, _ask_probes(width, block, parts)), _answer_probes), "anchor-hits")
    windows = X.ask(chunks, _ask_windows(width, block, parts), hits)
    repeats = stored(X.answer(windows, _answer_windows), "anchor-repeats")
    schema = T.StructType([
        id_field, T.StructField("n_words", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        T.StructField("kept", T.StringType())])
    done = X.finish(chunks, repeats, _remove(width, to_arrow_type(id_field.dataType)), schema)
    return done.withColumnRenamed("id", id_col).withColumn(
        "n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]))
