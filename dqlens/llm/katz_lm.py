"""Language-model scoring by Katz backoff over word bigrams.

Model, learnt from the rows marked for training (words in lower-case ASCII,
one end token per text, which is also the history of a text's first word):

* counts up to ``K`` are discounted by Good-Turing, larger ones kept:
  P(w | h) = d(c) c(h, w) / c(h) for seen bigrams;
* unseen ones back off: P(w | h) = alpha(h) P(w), where alpha(h) is exactly
  (1 - sum of seen P(. | h)) / (1 - sum of P over the words seen after h);
* P(w) = d(c) c(w) / N; the mass that the discounts leave is the probability
  of the unknown word, so words and unknown sum to 1.
* A history (or the unigram level) whose counts are all above ``K`` would
  leave nothing: its total is raised by one instead.

Tables, partitioned by ``part`` and stored in the shared folder: unigrams (one
message per part: word hash, id, count) and bigrams (history, word, count).
The same parts answer the chunks of documents (``exchange``): each chunk asks
for the words and bigrams it holds, once each, and evaluates token by token:
seen bigram, else backoff weight times unigram, else unknown.

A history with more than its fair share of all tokens (N / parts) is split
over several parts by its successors; there are fewer than ``parts`` such
histories, and the sums of just these go through the driver.  Words are told
apart by 64-bit hashes.

Defined cases: a null or empty text is one end token; no training rows: N = 0
and every token is unknown with probability 1; rows whose training mark is
null do not train; null ids are carried; repeated rows count as often as they
occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.llm import exchange as X
from dqlens.llm.common import mix64, stored

K = 5                                   # counts above K are not discounted
END = np.uint64(0x94D049BB133111EB)     # stands for the end token among word hashes
UNKNOWN = np.uint64((1 << 64) - 1)      # id of words that training has not seen
TABLE, STATS, HOT = -1, -2, -3          # receivers of a part's messages that are no chunks
N_SUMS = 2 * (K + 1)


# --------------------------------------------------------------------------
# chunk side
# --------------------------------------------------------------------------

class Tokens:
    """Tokens of a chunk's documents as indices into its sorted words."""

    def __init__(self, rows: pa.Table):
        hashes, held, sizes = X.WordHashes(), [], []
        for text in rows.column("text"):
            words = X.encoded(text.as_py()).lower().split()
            held.append(hashes.of(words))
            held.append(END.reshape(1))
            sizes.append(len(words) + 1)
        flat = np.concatenate(held) if held else np.zeros(0, np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.words, self.word = np.unique(flat, return_inverse=True)
        train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
        self.train = np.repeat(train, self.sizes)
        self.counts = np.bincount(self.word[self.train], minlength=len(self.words))

    def history(self) -> np.ndarray:
        """Index of each token's history; the end token before a text."""
        out = np.empty_like(self.word)
        out[1:] = self.word[:-1]
        if len(out):
            out[0] = np.searchsorted(self.words, END)    # tokens before a text's first are an end
        return out


class Bigrams:
    """The distinct (history, word) pairs a chunk asks for, sorted by part."""

    def __init__(self, tokens: Tokens, ids: np.ndarray, counts: np.ndarray, total: int, parts: int):
        h, w = tokens.history(), tokens.word
        known_h, known_w = ids[h] != UNKNOWN, ids[w] != UNKNOWN
        # an unknown word only needs its history's sums: asked for as (history, nothing)
        nothing = len(tokens.words)
        w = np.where(known_w, w, nothing)
        pair = h.astype(np.int64) * (nothing + 1) + w
        keys, inverse = np.unique(pair[known_h], return_inverse=True)
        seen = np.bincount(inverse[tokens.train[known_h]], minlength=len(keys))
        h, w = keys // (nothing + 1), keys % (nothing + 1)
        self.one = ids[h]
        self.two = np.concatenate([ids, [UNKNOWN]])[w]
        self.two_count = np.concatenate([counts, [0]])[w]
        share = max(1, total // parts)
        splits = (np.maximum(counts[h], 1) + share - 1) // share
        self.hot = splits > 1
        salt = np.where(self.hot, self.two % splits.astype(np.uint64), np.uint64(0))
        part = (mix64(self.one * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.lexsort((self.two, self.one, part))
        self.part = part[order]
        for name in ("one", "two", "two_count", "hot"):
            setattr(self, name, getattr(self, name)[order])
        self.seen = seen[order]
        self.has_history = known_h
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place = place[inverse]                      # of each token with a known history


def _slices(part: np.ndarray, parts: int):
    ends = np.searchsorted(part, np.arange(parts + 1, dtype=part.dtype))
    for p in range(parts):
        if ends[p + 1] > ends[p]:
            yield p, slice(int(ends[p]), int(ends[p + 1]))


def _word_part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _ask_words(parts: int):
    def work(rows: pa.Table):
        tokens = Tokens(rows)
        for p, s in _slices(_word_part(tokens.words, parts), parts):
            yield p, X.pack(tokens.words[s], tokens.counts[s].astype(np.uint64))
    return work


def _known(replies: dict[int, bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    got = [X.unpack(replies[p], np.uint64, np.uint64) for p in range(parts) if p in replies]
    return tuple(np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.uint64) for i in (0, 1))


def _ask_bigrams(total: int, parts: int):
    def work(rows: pa.Table, replies: dict[int, bytes]):
        tokens = Tokens(rows)
        ids, counts = _known(replies, parts)
        b = Bigrams(tokens, ids, counts.astype(np.int64), total, parts)
        for p, s in _slices(b.part, parts):
            first = _firsts(b.one[s])
            yield p, X.pack(b.one[s][first], np.diff(np.append(first, s.stop - s.start)).astype(np.uint32),
                            b.hot[s][first].astype(np.uint8), b.two[s], b.seen[s].astype(np.uint64),
                            b.two_count[s].astype(np.uint64))
    return work


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) \
        if len(sorted_keys) else np.zeros(0, np.int64)


# --------------------------------------------------------------------------
# part side
# --------------------------------------------------------------------------

def _class_sizes(counts: np.ndarray) -> np.ndarray:
    """How many counts equal 1 .. K + 1."""
    small = counts[(counts > 0) & (counts <= K + 1)].astype(np.int64)
    return np.bincount(small, minlength=K + 2)[1:].astype(np.uint64)


def _answer_words(parts: int):
    def work(part: int, messages: dict[int, bytes]):
        senders = list(messages)
        got = [X.unpack(messages[c], np.uint64, np.uint64) for c in senders]
        words, counts = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        distinct, inverse = np.unique(words, return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, inverse, counts)
        seen = total > 0
        ids = np.full(len(distinct), UNKNOWN)
        ids[seen] = np.arange(int(seen.sum()), dtype=np.uint64) * np.uint64(parts) + np.uint64(part)
        at = 0
        for c, (own, _) in zip(senders, got, strict=True):
            where = inverse[at:at + len(own)]
            at += len(own)
            yield c, X.pack(ids[where], total[where])
        yield TABLE, X.pack(distinct[seen], ids[seen], total[seen])
        yield STATS, X.pack(np.concatenate([_class_sizes(total), [total.sum(), np.uint64(seen.sum())]]).astype(np.uint64))
    return work


def _history_sums(one_first: np.ndarray, n: int, counts: np.ndarray, two_counts: np.ndarray) -> np.ndarray:
    """Per history: successors with bigram count 1..K, sum of larger counts;
    successors with unigram count 1..K, sum of larger unigram counts."""
    out = np.zeros((len(one_first), N_SUMS), np.uint64)
    if not n:
        return out
    seen = counts > 0
    for col, values in ((0, counts), (K + 1, two_counts)):
        for r in range(1, K + 1):
            out[:, col + r - 1] = np.add.reduceat((seen & (values == r)).astype(np.uint64), one_first)
        out[:, col + K] = np.add.reduceat(np.where(seen & (values > K), values, 0).astype(np.uint64), one_first)
    return out


def _answer_bigrams(part: int, messages: dict[int, bytes]):
    senders = list(messages)
    got = [X.unpack(messages[c], np.uint64, np.uint32, np.uint8, np.uint64, np.uint64, np.uint64) for c in senders]
    one = np.concatenate([np.repeat(g[0], g[1]) for g in got])
    hot = np.concatenate([np.repeat(g[2], g[1]) for g in got])
    two, counts, two_counts = (np.concatenate([g[i] for g in got]) for i in (3, 4, 5))
    order = np.lexsort((two, one))
    s_one, s_two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (s_one[1:] != s_one[:-1]) | (s_two[1:] != s_two[:-1])]))
    total = np.add.reduceat(counts[order], first)
    d_one, d_two, d_uni, d_hot = s_one[first], s_two[first], two_counts[order][first], hot[order][first]
    where = np.empty(len(order), np.int64)
    where[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    h_first = _firsts(d_one)
    sums = _history_sums(h_first, len(d_one), total, d_uni)
    history_of = np.repeat(np.arange(len(h_first)), np.diff(np.append(h_first, len(d_one))))
    at = 0
    for c, g in zip(senders, got, strict=True):
        own = where[at:at + len(g[3])]
        at += len(g[3])
        starts = np.concatenate([[0], np.cumsum(g[1])[:-1]]).astype(np.int64)
        yield c, X.pack(total[own], *sums[history_of[own[starts]]].T)
    seen = total > 0
    yield TABLE, X.pack(d_one[seen], d_two[seen], total[seen])
    yield STATS, X.pack(_class_sizes(total))
    split = d_hot[h_first] > 0
    if split.any():
        yield HOT, X.pack(d_one[h_first][split], *sums[split].T)


# --------------------------------------------------------------------------
# probabilities
# --------------------------------------------------------------------------

def discounts(sizes) -> np.ndarray:
    """Good-Turing discount factors of counts 0 .. K (index 0 unused) from the
    numbers of counts 1 .. K + 1; 1 where they are undefined or out of (0, 1]."""
    n = [0.0, *map(float, sizes)]
    d = np.ones(K + 1)
    if n[1] <= 0 or (common := (K + 1) * n[K + 1] / n[1]) >= 1:
        return d
    for r in range(1, K + 1):
        if n[r] > 0 and n[r + 1] > 0:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            d[r] = x if 0 < x <= 1 else 1.0
    return d


class Katz:
    """Probabilities from counts; the numbers of a whole model that every
    task needs (a few dozen)."""

    def __init__(self, total: int, distinct: int, unigram_sizes, bigram_sizes):
        self.total, self.distinct = int(total), int(distinct)
        self.d1, self.d2 = discounts(unigram_sizes), discounts(bigram_sizes)
        used = sum(r * int(n) * self.d1[r] for r, n in enumerate(unigram_sizes[:K], 1)) + self.total \
            - sum(r * int(n) for r, n in enumerate(unigram_sizes[:K], 1))
        self.spare = self.total - used <= 0              # nothing left for the unknown word
        self.norm = self.total + 1 if self.spare else self.total
        self.unknown = 1.0 if not self.total else 1 / self.norm if self.spare else (self.total - used) / self.total

    @staticmethod
    def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= K, d[np.minimum(counts, K)], 1.0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self._discounted(counts, self.d1) / self.norm, self.unknown)

    def history(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, alpha) of histories from their sums."""
        r = np.arange(1, K + 1)
        s = sums.astype(np.float64)
        plain = s[:, :K] @ r + s[:, K]
        used = s[:, :K] @ (r * self.d2[1:]) + s[:, K]
        left = plain - used
        spare = left <= 1e-9 * np.maximum(plain, 1)
        total = np.where(spare, plain + 1, plain)
        left = np.where(spare, 1.0, left)
        covered = (s[:, K + 1:2 * K + 1] @ (r * self.d1[1:]) + s[:, 2 * K + 1]) / max(1, self.norm)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = (left / total) / np.maximum(1 - covered, self.unknown)
        return total, np.where(plain > 0, alpha, 1.0)

    def bigram(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        return self._discounted(counts, self.d2) / total


def _score(model: Katz, hot_ids: np.ndarray, hot_sums: np.ndarray, parts: int, id_type: pa.DataType):
    def work(rows: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        tokens = Tokens(rows)
        ids, counts = _known({p: b for p, b in replies.items() if p < parts}, parts)
        counts = counts.astype(np.int64)
        b = Bigrams(tokens, ids, counts, model.total, parts)
        seen, total, alpha = (np.zeros(len(b.one), t) for t in (np.int64, np.float64, np.float64))
        for p, s in _slices(b.part, parts):
            got = X.unpack(replies[parts + p], *[np.uint64] * (1 + N_SUMS))
            seen[s] = got[0]
            first = _firsts(b.one[s])
            sums, hot = np.stack(got[1:], axis=1), b.hot[s][first]
            if hot.any():
                sums[hot] = hot_sums[np.searchsorted(hot_ids, b.one[s][first][hot])]
            times = np.diff(np.append(first, s.stop - s.start))
            total[s], alpha[s] = (np.repeat(x, times) for x in model.history(sums))

        # each token: seen bigram, else alpha times unigram (history known), else unigram
        word_p = model.unigram(counts)
        p = word_p[tokens.word]
        at = b.place
        backed = alpha[at] * p[b.has_history]
        p[b.has_history] = np.where(seen[at] > 0, model.bigram(seen[at], total[at]), backed)
        base = np.log10((counts + 0.1) / (model.total + 0.1 * (model.distinct + 1)))
        known = (counts > 0).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(tokens.sizes)[:-1]]).astype(np.int64)
        fold = lambda v: np.add.reduceat(v, start) if len(start) else v[:0]
        return pa.table({
            "id": rows.column("id").cast(id_type), "train": rows.column("train"),
            "n_tokens": pa.array(tokens.sizes), "n_known": pa.array(fold(known[tokens.word])),
            "train_tokens": pa.array(np.full(len(start), model.total, np.int64)),
            "base_score": pa.array(fold(base[tokens.word])),
            "score": pa.array(fold(np.log10(p)))})
    return work


def _stats(table: DataFrame, n: int) -> np.ndarray:
    """Sum of the parts' statistics: one short row per part."""
    total = np.zeros(n, np.uint64)
    for row in table.where(F.col("chunk") == STATS).select("payload").toLocalIterator():
        total += X.unpack(bytes(row["payload"]), np.uint64)[0]
    return total


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, train, n_tokens, n_known, train_tokens, base_score (add-0.1
    unigrams) and score (log10 probability under the Katz model)."""
    from pyspark.sql.pandas.types import to_arrow_type
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    id_field = rows.schema["id"]
    parts = X.n_parts(docs)
    chunks = X.chunked(rows, X.n_chunks(docs), ["id", "text"])

    unigrams = stored(X.answer(X.ask(chunks, _ask_words(parts)), _answer_words(parts)), "lm-unigrams")
    sizes = _stats(unigrams, K + 3)
    total, distinct = int(sizes[-2]), int(sizes[-1])
    words_of = unigrams.where(F.col("chunk") >= 0)
    bigrams = stored(X.answer(X.ask(chunks, _ask_bigrams(total, parts), words_of), _answer_bigrams), "lm-bigrams")
    model = Katz(total, distinct, [int(x) for x in sizes[:K + 1]], [int(x) for x in _stats(bigrams, K + 1)])

    # split histories: fewer than ``parts`` by construction
    hot: dict[int, np.ndarray] = {}
    for row in bigrams.where(F.col("chunk") == HOT).select("payload").toLocalIterator():
        got = X.unpack(bytes(row["payload"]), *[np.uint64] * (1 + N_SUMS))
        for i, k in enumerate(got[0].tolist()):
            hot[k] = hot.get(k, np.zeros(N_SUMS, np.uint64)) + np.array([g[i] for g in got[1:]], np.uint64)
    hot_ids = np.array(sorted(hot), np.uint64)
    hot_sums = np.array([hot[int(k)] for k in hot_ids], np.uint64).reshape(-1, N_SUMS)

    replies = words_of.union(bigrams.where(F.col("chunk") >= 0).select(
        (F.col("part") + parts).cast("int").alias("part"), "chunk", "payload"))
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([id_field, T.StructField("train", T.BooleanType()), T.StructField("n_tokens", long),
                           T.StructField("n_known", long), T.StructField("train_tokens", long),
                           T.StructField("base_score", double), T.StructField("score", double)])
    done = X.finish(chunks, replies, _score(model, hot_ids, hot_sums, parts, to_arrow_type(id_field.dataType)), schema)
    return done.withColumnRenamed("id", id_col)
