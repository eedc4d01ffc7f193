"""Byte-level BPE encoding and decoding with a given vocabulary.

A piece of text is merged with a priority queue of (merge rank, position)
over a doubly linked list of symbols: the lowest rank is taken out, entries
whose symbols have changed since are stale and skipped, the two symbols are
joined, and the two new neighbour pairs are queued.  Equal ranks go from left
to right.  Decoding concatenates the vocabulary strings of the ids and reads
the bytes as UTF-8.

The vocabulary file (tokenizers JSON, byte level, no normaliser) is a
parameter; its content travels to the tasks as one broadcast of fixed size.
Special tokens that stand in a text become their own id, as the file asks.
Each Python worker keeps the merged pieces it has met, at most
``CACHE_PIECES`` of them; beyond that those not met lately go, so memory is
bounded and results do not depend on it.

Defined cases: a null or empty text has no ids and decodes to the empty
string; bytes that are no UTF-8 decode to U+FFFD; extra columns pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dqlens.llm.common import free_name, kept, ship_code, tidy

CACHE_PIECES = 200_000

#: fixed values: how the byte-level vocabulary splits a text into pieces
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    all others for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _char_class(wanted, top: int) -> str:
    """Regex ranges of the code points below ``top`` for which ``wanted`` holds."""
    out, start = [], None
    for c in range(top + 1):
        inside = c < top and not 0xD800 <= c < 0xE000 and wanted(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def _is_space(ch: str) -> bool:
    return ch.isspace() and ch not in "\x1c\x1d\x1e\x1f"


def piece_pattern(top: int) -> re.Pattern:
    """The splitting pattern for texts whose code points are below ``top``."""
    letter = _char_class(lambda ch: unicodedata.category(ch)[0] == "L", top)
    number = _char_class(lambda ch: unicodedata.category(ch)[0] == "N", top)
    space = _char_class(_is_space, top)
    return re.compile(f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                      f"|[{space}]+(?![^{space}])|[{space}]+")


class _Pieces(dict):
    """Piece -> ids, made on demand.  Half of the ``limit`` are the pieces met
    last, the other half those of the half before: what is met in neither goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.before = make, max(1, limit // 2), {}

    def __missing__(self, piece):
        if (ids := self.before.get(piece)) is None:
            ids = self.make(piece)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class ByteBPE:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, spec: dict, cache_pieces: int = CACHE_PIECES):
        if spec["model"]["type"] != "BPE" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without a normaliser is needed")
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_alphabet()
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        #: left id -> right id -> rank of the merge; rank -> merged id
        nothing: dict[int, int] = {}
        self.rank = [nothing] * (max(vocab.values()) + 1)
        for rank, (a, b) in enumerate(merges):
            if self.rank[vocab[a]] is nothing:
                self.rank[vocab[a]] = {}
            self.rank[vocab[a]][vocab[b]] = rank
        self.joined = [vocab[a + b] for a, b in merges]
        back = {ch: b for b, ch in letters.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[ch] for ch in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.special = special
        self.special_split = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.latin = piece_pattern(0x250)
        self.beyond_latin = re.compile("[^\x00-ɏ]")
        self._general = None
        self.cache = _Pieces(self.merge_piece, cache_pieces)

    @property
    def general(self) -> re.Pattern:
        if self._general is None:
            self._general = piece_pattern(sys.maxunicode + 1)
        return self._general

    def merge_piece(self, piece: str) -> tuple:
        """Ids of one piece: priority queue over a doubly linked list.  A queue
        entry is rank * length + position; it is stale if the pair that now
        starts at the position has another rank."""
        ranks = self.rank
        byte_id = self.byte_id
        ids = [byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(ids)
        queue = []
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            if (rank := ranks[left].get(right)) is not None:
                queue.append(rank * n + i - 1)
            left = right
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pop, push, joined = heapq.heappop, heapq.heappush, self.joined
        while queue:
            rank, i = divmod(pop(queue), n)
            left, j = ids[i], following[i]
            if left < 0 or j >= n or ranks[left].get(ids[j]) != rank:
                continue
            ids[i] = new = joined[rank]
            ids[j] = -1
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (rank := ranks[new].get(ids[k])) is not None:
                    push(queue, rank * n + i)
            h = before[i]
            if h >= 0 and (rank := ranks[ids[h]].get(new)) is not None:
                push(queue, rank * n + h)
        return tuple([x for x in ids if x >= 0])

    def _plain(self, text: str) -> list[int]:
        pattern = self.general if self.beyond_latin.search(text) else self.latin
        return list(chain.from_iterable(map(self.cache.__getitem__, pattern.findall(text))))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special_split is None or not any(t in text for t in self.special):
            return self._plain(text)
        out: list[int] = []
        for k, part in enumerate(self.special_split.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids) -> str:
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")


def _text_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def load_spec(path: str) -> dict:
    """Read a tokenizers JSON file on the driver (a local library file)."""
    return json.loads(_text_of(path))


def _coder(shared) -> ByteBPE:
    """One coder per Python worker, kept across tasks."""
    return kept(shared.id, lambda: ByteBPE(json.loads(shared.value)))


class _Shared:
    """A vocabulary file's text as a broadcast, with an id that workers can key
    their coder by.  As text it is small: what it is parsed to goes once the coder stands."""

    def __init__(self, spark: SparkSession, text: str):
        self.broadcast = spark.sparkContext.broadcast(text)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _rows_at_once(sizes: list, limit: int = 1 << 20) -> Iterator[range]:
    """Ranges of rows whose sizes (null: none) are about ``limit`` together."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n or 0
        if size >= limit:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(sizes):
        yield range(start, len(sizes))


def encode_frame(docs: DataFrame, vocabulary: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with its token ids (``ids``) and, if asked for, the text that
    the ids decode to (``decoded``).  Names that are taken get an underscore."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = _Shared(spark, _text_of(vocabulary))
    ids_name, text_name = free_name(docs, "ids"), free_name(docs, "decoded")
    fields = list(docs.schema.fields) + [T.StructField(ids_name, T.ArrayType(T.IntegerType(), False))]
    if decode:
        fields.append(T.StructField(text_name, T.StringType()))
    at = docs.columns.index(text_col)

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            texts = batch.column(at)
            for rows in _rows_at_once(pc.binary_length(texts).to_pylist()):
                ids = [coder.encode(t) for t in texts.slice(rows.start, len(rows)).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                arrays = [c.slice(rows.start, len(rows)) for c in batch.columns]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                if decode:
                    arrays.append(pa.array([coder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return docs.mapInArrow(tidy(run, shared.id), T.StructType(fields))
