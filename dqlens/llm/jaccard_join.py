"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word n-grams; two link when their Jaccard similarity
reaches a threshold.  Documents with equal sets are one set from the start.

1. Tokens of the matrix.  With sizes up to h, sets that link differ in at most
   k = 2h(1 - t)/(1 + t) n-grams.  The hash range is cut into k + 1 stretches
   and some to spare for empty ones; linked sets agree on at least one whole
   stretch that is not empty.  A set's tokens are the hashes of its stretches, cut for its own size class and for the next one
   (partners' sizes lie in the same or a neighbouring class).  A token stands
   for several n-grams, so passages that many documents share make no tokens
   in common, and no pair that links is missed.
2. Groups.  Sets that share a token are similar; the most connected set of a
   token's sets is its pivot.  Every set is compared with its pivots: that
   finds nearly all links of a cluster with one comparison per set.
3. Matrix.  What could still link are sets that share a token but are in
   different components so far.  Not every token counts: sets that link agree on
   more stretches than the one that is needed, so each set leaves out as many of its
   most common tokens as it can spare, all by one order (``Sets.rarest``).  A passage that
   thousands of documents share mostly goes with those.  The sets of a pivot form groups of about
   ``GROUP`` sets of one size class, and each group is stored with the outline of
   its token union.  A set is held against the groups of the pivots it shares a token
   with: if what it can share with the union is below what a link with the group's
   smallest member needs, the group stays shut.  Only qualifying groups are
   opened and their members compared.  Of two components the smaller one asks.
4. Components of the links, contracted in rounds; each round is written out.

N-grams seldom travel.  A set's sketch counts its n-grams in up to n/2 equal bins
of the hash range, four bits each; the sum of the smaller counts bounds the overlap
of two sets from above.  The outline of a group's union is, bin by bin, the largest
count of any member; held against a set it bounds what the set shares with any of
them.  (The unions themselves, as n-grams, were most of what the operator shuffled.)  Sketches come first
everywhere; only pairs and groups that pass them have their n-grams fetched, from
the text of one document of each set, and are decided exactly.  Of a set's pairs
with pivots one is decided first; the others only if they could still connect
something.

No group is collected whole: document rows pass the shuffle of the tokens one by
one, a group has a bounded number of sets, pivots and counts are aggregates, and
a cluster with a third of all rows costs one comparison per set and one union
check per set and group it is not linked to.  Sets are named by 128 bits of two
hashes; n-grams are told apart by 64.  With its tokens travel 48 bits of a set's name,
since at large inputs each part gets a name for nearly every token; sets that agree in
those become candidates together (that two sets that link do is a chance of 1 in 2^48).

Defined cases: fewer words than ``width``: the whole word sequence is the one
n-gram; no words or a null text: empty set, linked with nothing, its
component is its own id.  A null id never names a component; such rows take
their component's smallest id and only meet others through equal sets.
Repeated rows are equal sets.  Texts of any length are taken whole; one text's
n-grams are held by one task.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.llm import exchange as X
from dqlens.llm.common import forget, mix64, ship_code, sized, small_batches, stored, tidy
from dqlens.session import session_conf

GROUP = 64
GROUP_BYTES = 8192
# texts, sketches and n-grams go to Python and back a few rows at a time
FEW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
FLUSH = 500_000              # tokens that a task holds before it sends them on
WORDS = 60_000               # whose hashes a task holds; beyond that they start anew
PART_BITS = 32               # of a token within its part; a chance match is one more candidate
SHORT = 6                    # bytes of a set's name that travel with its tokens


class Shingler:
    """n-gram sets of texts as sorted arrays of 64-bit hashes."""

    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                        0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)

    def __init__(self, width: int):
        self.width, self.hashes = width, X.WordHashes(WORDS)

    def factor(self, k: int) -> np.uint64:
        return self.FACTORS[k] if k < len(self.FACTORS) else mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        words = X.encoded(text).lower().split()      # bytes: A-Z and ASCII spaces only
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes.of(words)
        width = min(self.width, len(words))
        n = len(words) - width + 1
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total += h[k:n + k] * self.factor(k)
        return np.unique(mix64(total))

    def key(self, grams: np.ndarray) -> bytes:
        """Identity of a set: two independent sums of mixed hashes, 128 bits."""
        return b"".join(mix64(grams ^ salt).sum(dtype=np.uint64).tobytes()
                        for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)))


def size_class(n: int) -> int:
    """Sets of n to 2n n-grams have one class, and sketches of one length."""
    return max(0, n.bit_length() - 2)


def sketch(grams: np.ndarray) -> bytes:
    """How many n-grams lie in each of 2^class equal bins of the hash range, two
    bins a byte; 15 stands for 15 or more."""
    bits = size_class(len(grams))
    bins = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    found = np.minimum(np.bincount(bins, minlength=max(2, 1 << bits)), 15).astype(np.uint8)
    return (found[::2] | (found[1::2] << 4)).tobytes()


def counts(body: bytes) -> np.ndarray:
    packed = np.frombuffer(body, np.uint8)
    c = np.empty(2 * len(packed), np.int64)
    c[::2], c[1::2] = packed & 15, packed >> 4
    c[c == 15] = 1 << 40
    return c


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of the overlap of the sets with these counts."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.minimum(x.reshape(len(y), -1).sum(axis=1), y).sum())


class Stretches:
    """Size classes and the stretch hashes of sets, for threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 31:
            self.low.append(self.high(len(self.low) - 1) + 1)
        self.edges: dict[int, tuple] = {}

    def high(self, c: int) -> int:
        return self.low[c] * self.den // self.num

    def cut(self, c: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Inner edges of the stretches of class ``c``, their salts, and how
        many empty stretches a set may have without naming them."""
        if c not in self.edges:
            least = self.low[max(0, c - 1)]
            k = 2 * self.high(c) * (self.den - self.num) // (self.den + self.num)
            empty = (k + 1) * math.exp(-least / (k + 1)) if k else 0.0
            spare = math.ceil(1.5 * empty + 2 * math.sqrt(empty))
            n = k + 1 + spare
            edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
            self.edges[c] = edges, mix64(np.arange(n, dtype=np.uint64) + np.uint64((c + 1) << 40)), spare
        return self.edges[c]

    def tokens(self, grams: np.ndarray) -> np.ndarray:
        return self.tokens_and_free(grams)[0]

    def tokens_and_free(self, grams: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Of k + 1 + spare stretches, two sets that link agree on spare + 1.
        If either has at most ``spare`` empty ones, they agree on one that is
        not empty; so only sets with more name their empty stretches.  Bit 0 of
        a token tells even from odd classes; for both, how many of its tokens a
        set could go without and still agree on one (none if it names empty ones)."""
        c = bisect_right(self.low, len(grams)) - 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(grams + np.uint64(77)), dtype=np.uint64)])
        out, free = [], [0, 0]
        for j in (c, c + 1):
            edges, salts, spare = self.cut(j)
            at = np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])
            token = mix64((sums[at[1:]] - sums[at[:-1]]) ^ salts)
            token = (token & ~np.uint64(1)) | np.uint64(j & 1)
            full = at[1:] > at[:-1]
            free[j & 1] = max(0, spare - int(len(full) - full.sum()))
            out.append(token if len(full) - full.sum() > spare else token[full])
        return np.concatenate(out), free


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def token_messages(rows: DataFrame, width: int, num: int, den: int, parts: int) -> DataFrame:
    """(part, payload, id, n, s, sketch, even, odd): a row per document with a part
    below 0, and a message with tokens to each of ``parts``."""
    ship_code(rows.sparkSession)
    id_field = rows.schema["id"]
    long, binary = T.LongType(), T.BinaryType()
    schema = T.StructType([T.StructField("part", long), T.StructField("payload", binary), id_field,
                           T.StructField("n", long), T.StructField("s", binary), T.StructField("sketch", binary),
                           T.StructField("even", long), T.StructField("odd", long)])
    names = schema.fieldNames()

    def scan(batches):
        shingler, stretches = Shingler(width), Stretches(num, den)
        held, size, known, id_type, turn = [], 0, {}, None, 0

        def send():
            # sets are numbered in the order of their short names, which then differ by little
            short = np.frombuffer(b"".join(known), np.uint64)[::2] & np.uint64((1 << 8 * SHORT) - 1)
            order = np.argsort(short)
            number = np.empty(len(short), np.uint32)
            number[order] = np.arange(len(short))
            short = short[order]
            tokens = np.concatenate([t for t, _ in held])
            sets = np.repeat(number[[k for _, k in held]], [len(t) for t, _ in held])
            low = np.uint64((1 << PART_BITS) - 1)
            tokens = (((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)) << np.uint64(PART_BITS)) | (tokens & low)
            order = np.argsort(tokens)
            tokens, sets = tokens[order], sets[order]
            ends = np.searchsorted(tokens, np.arange(parts + 1, dtype=np.uint64) << np.uint64(PART_BITS))
            tokens &= low
            found = np.flatnonzero(np.diff(ends))
            body = []
            for p in found:
                # the sets' names once per message, tokens point to them; both as differences
                used, at = np.unique(sets[ends[p]:ends[p + 1]], return_inverse=True)
                body.append(X.pack(np.diff(tokens[ends[p]:ends[p + 1]], prepend=np.uint64(0)), at.astype(np.uint32),
                                   np.diff(short[used], prepend=np.uint64(0))))
            empty = [pa.nulls(len(found), t) for t in (id_type, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(body, pa.binary()), *empty], names)

        for batch in batches:
            ids, id_type = batch.column(0), batch.column(0).type
            n, s, sketches, free = [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingler.of(text)
                name = shingler.key(grams)
                n.append(len(grams))
                s.append(name)
                sketches.append(sketch(grams))
                if len(grams) and name not in known:        # copies in a task are one set
                    tokens, known[name] = stretches.tokens_and_free(grams)
                    held.append((tokens, len(known) - 1))
                    size += len(tokens)
                free.append(known[name] if len(grams) else [0, 0])
            # document rows only pass: they go before the parts, dealt out evenly
            own = -1 - (turn + np.arange(len(n))) % parts
            turn += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.nulls(len(n), pa.binary()), ids, pa.array(n, pa.int64()),
                 pa.array(s, pa.binary()), pa.array(sketches, pa.binary()),
                 *(pa.array([f[k] for f in free], pa.int64()) for k in (0, 1))], names)
            if size >= FLUSH:
                yield send()
                held, size, known = [], 0, {}
        if held:
            yield send()

    return rows.mapInArrow(tidy(scan), schema)


def set_table(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(id, n, s, sketch, even, odd, token, sets): one row per document with token
    null, and one per shared token and set, with the first ``SHORT`` bytes of the
    set's name as s, the token's weight as n and the number of its sets."""
    parts = X.n_parts(rows)
    messages = token_messages(rows, width, num, den, parts)
    long = T.LongType()
    out = T.StructType([*messages.schema.fields[2:], T.StructField("token", long), T.StructField("sets", long)])

    def merged(bodies: list[bytes], id_type) -> pa.RecordBatch:
        got = [X.unpack(p, np.uint64, np.uint32, np.uint64) for p in bodies]
        # the same set in several messages
        short, dense = np.unique(np.concatenate([np.cumsum(g[2], dtype=np.uint64) for g in got]), return_inverse=True)
        starts = np.cumsum([0, *(len(g[2]) for g in got)])
        tokens, sets = _distinct_pairs(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]),
                                       np.concatenate([dense[start + g[1]] for start, g in zip(starts, got)]))
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff(np.concatenate([first, [len(tokens)]]))
        # tokens of a kind (bit 0) with the same sets say the same: one stands for
        # all, named by kind and sets and weighted by their number
        kind = tokens[first] & np.uint64(1)
        name = (mix64(np.add.reduceat(mix64(short)[sets], first)) & ~np.uint64(1)) | kind
        _, where, times = np.unique(np.where(size > 1, name, np.uint64(0)), return_index=True, return_counts=True)
        chosen = np.zeros(len(first), np.int64)
        chosen[where] = times
        chosen[size < 2] = 0
        weight = np.repeat(chosen, size)
        kept = weight > 0
        sets, weight = sets[kept], weight[kept]
        bodies = np.ascontiguousarray(short[sets].view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes()
        s = pa.array([bodies[i:i + SHORT] for i in range(0, len(bodies), SHORT)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(sets), id_type), pa.array(weight), s, pa.nulls(len(sets), pa.binary()),
             *(pa.nulls(len(sets), pa.int64()) for _ in range(2)), pa.array(np.repeat(name, size)[kept].view(np.int64)),
             pa.array(np.repeat(size, size)[kept])], out.fieldNames())

    def merge(batches):
        part, bodies, id_type = None, [], None
        for batch in batches:
            id_type = batch.column(2).type
            alone = batch.filter(pa.compute.is_null(batch.column(1)))
            if alone.num_rows:
                yield pa.RecordBatch.from_arrays([*alone.columns[2:], *(pa.nulls(alone.num_rows, pa.int64()) for _ in range(2))], out.fieldNames())
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body is not None:
                    if p != part and bodies:
                        yield merged(bodies, id_type)
                        bodies = []
                    part = p
                    bodies.append(body)
        if bodies:
            yield merged(bodies, id_type)

    return messages.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(merge), out)


def gram_arrays(rows: DataFrame, width: int) -> DataFrame:
    """(s, to, n, grams) of the (text, name, s, tos) rows whose set is the expected
    one: a row for each of ``tos``, each set once per task."""
    def run(batches):
        shingler, seen = Shingler(width), set()
        for batch in batches:
            s, to, arrays = [], [], []
            for text, name, sid, tos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sid not in seen:
                    grams = shingler.of(text)
                    if shingler.key(grams) == name:
                        seen.add(sid)
                        s += [sid] * len(tos)
                        to += tos
                        arrays += [grams.view(np.int64)] * len(tos)
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int64()), pa.array(to, pa.int64()), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["s", "to", "n", "grams"])
    return rows.select("text", "name", "s", "tos").mapInArrow(tidy(run), "s long, to long, n long, grams array<long>")


class Sets:
    """The sets that share a token, numbered: name, one document, size and sketch
    of each; their n-grams on demand."""

    def __init__(self, rows: DataFrame, table: DataFrame, width: int, num: int, den: int):
        self.rows, self.width, self.num, self.den = rows, width, num, den
        named = table.where("token IS NOT NULL").select(F.col("s").alias("short")).distinct()
        self.table = stored(table.where("token IS NULL").withColumn("short", F.substring("s", 1, SHORT)).join(
            named, "short", "left_semi").groupBy(F.col("s").alias("name")).agg(
            F.min("id").alias("id"), F.max("n").alias("n"), F.max("sketch").alias("sketch"),
            F.max("even").alias("even"), F.max("odd").alias("odd")).withColumn("s", F.monotonically_increasing_id()), "gram-chosen")

    def arrays(self, wanted: DataFrame) -> DataFrame:
        """``gram_arrays`` of (s, tos), from one text of each set."""
        wanted = stored(self.table.select("s", "name", "id").join(wanted, "s"), "gram-wanted")
        return gram_arrays(self.rows.join(sized(wanted), "id"), self.width)

    def grams(self, named: DataFrame) -> DataFrame:
        """(s, n, grams) of the named sets, written down."""
        named = named.select("s").distinct().withColumn("tos", F.array(F.lit(0).cast("long")))
        arrays = stored(self.arrays(named).drop("to"), "gram-arrays")
        # an id that is repeated may have given a set in several tasks
        if arrays.groupBy("s").count().where("count > 1").isEmpty():
            return arrays
        return stored(arrays.dropDuplicates(["s"]), "gram-arrays")

    def rarest(self, shared: DataFrame) -> DataFrame:
        """(token, s) without the tokens of most sets that each set can go without.
        Sets that link agree on one more token than either leaves out here; as all
        go by one order, of those that they agree on the rarest stays with both."""
        by = Window.partitionBy("s", "odd_token").orderBy(F.desc("sets"), "token").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return shared.join(self.table.select("s", "even", "odd"), "s").withColumn(
            "odd_token", F.col("token").bitwiseAND(F.lit(1).cast("long")) == 1).withColumn("up_to", F.sum("weight").over(by)).where(
            F.col("up_to") > F.when(F.col("odd_token"), F.col("odd")).otherwise(F.col("even"))).select("token", "s")

    def sketches(self, name: str) -> DataFrame:
        return self.table.select(F.col("s").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"k_{name}"))

    def close(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs that sizes and sketches let through."""
        num, den = self.num, self.den

        def near(batches):
            for batch in batches:
                a, b, na, ka, nb, kb = (batch.column(c) for c in ("a", "b", "n_a", "k_a", "n_b", "k_b"))
                kept = []
                for x, y, nx, ny in zip(ka.to_pylist(), kb.to_pylist(), na.to_pylist(), nb.to_pylist(), strict=True):
                    most = min(most_shared(counts(x), counts(y)), nx, ny)
                    kept.append(most * den >= (nx + ny - most) * num)
                kept = pa.array(kept, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], ["a", "b"])

        sizes = self.table.select(F.col("s").alias("b"), F.col("n").alias("size_b"))
        both = pairs.select("a", "b").join(sizes, "b").join(self.sketches("a"), "a").where(
            F.least("n_a", "size_b") * den >= F.greatest("n_a", "size_b") * num).drop("size_b").join(self.sketches("b"), "b")
        return stored(both.mapInArrow(tidy(near), "a long, b long"), "gram-close")

    def exact(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs whose similarity reaches the threshold: the n-grams of
        ``a`` go to ``b``, once a pair."""
        right = self.grams(pairs.select(F.col("b").alias("s")))
        left = self.arrays(pairs.groupBy(F.col("a").alias("s")).agg(F.collect_set("b").alias("tos")))
        same = F.size(F.array_intersect("ga", "gb"))
        both = left.select(F.col("s").alias("a"), F.col("to").alias("b"), F.col("n").alias("na"), F.col("grams").alias("ga")).join(
            right.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "b")
        links = stored(both.where(same * self.den >= (F.col("na") + F.col("nb") - same) * self.num).select("a", "b"), "gram-links")
        forget(right)
        return links

    def links(self, pairs: DataFrame) -> DataFrame:
        """Links that connect what the linked ones of these (a, b) pairs do: one
        pair of each ``a`` first, the others if they are still apart."""
        return self.linked(self.close(pairs))

    def linked(self, close: DataFrame) -> DataFrame:
        """``links`` of pairs that are close."""
        one = stored(close.groupBy("a").agg(F.max("b").alias("b")), "gram-first-pairs")
        first = self.exact(one)
        label = components(first)
        side = lambda c: label.select(F.col("s").alias(c), F.col("root").alias(f"root_{c}"))
        rest = close.join(one, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left").where(
            F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        return first.union(self.exact(stored(rest, "gram-other-pairs")))


def components(edges: DataFrame) -> DataFrame:
    """(s, root) of every node of (a, b) edges: in each round a node goes to its
    least neighbour by a hash that changes with the round, then the graph is
    contracted; chains shrink by a constant factor a round."""
    e = stored(edges.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
               "link-edges")
    label = e.select(F.col("u").alias("s")).union(e.select("v")).distinct().withColumn("root", F.col("s"))
    turn = 0
    while not e.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("x"))
        both = e.union(e.select("v", "u"))
        up = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select(
            "u", F.least(F.col("m"), rank("u"))["x"].alias("p"))
        jump = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        up = stored(up.join(jump, "p").select("u", F.col("pp").alias("p")), "link-parents")
        label = stored(label.join(up, label["root"] == up["u"], "left").select(
            "s", F.coalesce("p", "root").alias("root")), "link-labels")
        e = e.join(up.select("u", F.col("p").alias("pu")), "u").join(
            up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        e = stored(e.where("pu != pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
                   .distinct(), "link-edges")
    return label


CELL = ["home", "class", "g"]            # a group: sets of one pivot and size class


def open_groups(shared: DataFrame, home: DataFrame, sets: Sets, links: DataFrame) -> DataFrame:
    """Links between sets of different components that share a token, found
    through the unions of groups (step 3)."""
    num, den = sets.num, sets.den
    label = components(links)
    labelled = home.join(label, "s", "left").withColumn("comp", F.coalesce("root", "s")).drop("root")
    sizes = labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("comp_size"))
    labelled = labelled.join(sizes, "comp").join(sets.table.select(
        "s", "n", F.greatest(F.lit(0), F.length(F.bin("n")) - 2).alias("class")), "s")
    # a group's sketches come to some kilobytes, however long its sets are
    most = F.greatest(F.lit(1), F.least(F.lit(GROUP), F.lit(GROUP_BYTES) / F.pow(F.lit(2.0), F.col("class") - 1)))
    homes = labelled.groupBy("home", "class").agg(F.count(F.lit(1)).alias("n_sets")).select(
        "home", "class", F.ceil(F.col("n_sets") / most).cast("long").alias("n_groups"))
    labelled = stored(labelled.join(homes, ["home", "class"]).select(
        "s", "n", "home", F.struct("comp_size", "comp").alias("rank"), "class",
        F.pmod(F.xxhash64("s", F.lit("group")), F.col("n_groups")).alias("g")), "matrix-sets")

    # tokens whose sets are in several components; which pivots such a set must ask
    marked = sets.rarest(shared).join(labelled.select("s", "home", "rank"), "s")
    mixed = marked.groupBy("token").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi")
    homes_of = marked.select("token", F.col("home").alias("other")).distinct()
    asks = mixed.join(marked, "token").where(F.col("rank") < F.col("hi")).select("token", "s", "rank") \
        .join(homes_of, "token").select("s", "rank", "other").distinct()
    asks = stored(asks, "matrix-asks")

    wanted = labelled.join(asks.select(F.col("other").alias("home")).distinct(), "home", "left_semi")
    groups = stored(wanted.join(sets.table.select("s", "sketch"), "s").groupBy(*CELL).agg(
        F.max("rank").alias("top"), F.min("n").alias("least_n"), F.max("n").alias("most_n"),
        F.sort_array(F.collect_list(F.struct("s", "n", "sketch"))).alias("m")).select(
        *CELL, "top", "least_n", "most_n", F.col("m.s").alias("members"), F.col("m.n").alias("sizes"),
        F.unhex(F.array_join(F.transform("m", lambda x: F.hex(x["sketch"])), "")).alias("body")), "matrix-groups")

    def opened(batches):
        for batch in batches:
            a, b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], None
            for s, n, k, least, members, sizes, body in zip(
                    *(batch.column(c).to_pylist() for c in ("s", "n_s", "k_s", "least_n", "members", "sizes", "body")), strict=True):
                if members != held:                # the rows of a group come together
                    held, inside = members, counts(body).reshape(len(members), -1)
                    # the union has at most what its members have at most, bin by bin
                    union, ids, ns = inside.max(axis=0), np.array(members), np.array(sizes)
                own = counts(k)
                shared = min(most_shared(own, union), n)
                # a link needs an overlap of at least num / (num + den) of both sizes, and num / den of the asker's
                if shared * (num + den) < (n + least) * num or shared * den < n * num:
                    continue
                if len(own) >= inside.shape[1]:
                    both = np.minimum(inside, own.reshape(inside.shape[1], -1).sum(axis=1))
                else:
                    both = np.minimum(inside.reshape(len(ids), len(own), -1).sum(axis=2), own)
                most = np.minimum(np.minimum(both.sum(axis=1), ns), n)
                near = (most * den >= (n + ns - most) * num) & (ids != s)
                b.append(ids[near])
                a.append(np.full(len(b[-1]), s, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    asking = asks.join(sets.sketches("s"), "s")
    probes = asking.join(groups, asking["other"] == groups["home"]).where(
        (F.col("rank") < F.col("top")) & (F.col("n_s") * den >= F.col("least_n") * num)
        & (F.col("most_n") * den >= F.col("n_s") * num))
    found = stored(probes.select("s", "n_s", "k_s", "least_n", "members", "sizes", "body").mapInArrow(
        tidy(opened), "a long, b long"), "matrix-open")
    ranks = lambda c: labelled.select(F.col("s").alias(c), F.col("rank").alias(f"rank_{c}"))
    pairs = stored(found.distinct().join(ranks("a"), "a").join(ranks("b"), "b").where("rank_a < rank_b").select("a", "b"),
                   "matrix-pairs")
    forget(labelled, asks, groups, found)
    return sets.linked(pairs)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                       threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """Per row: id, n_shingles (size of its set), component_id (smallest id
    that its links reach, itself included)."""
    with session_conf(docs.sparkSession, *FEW_ROWS), small_batches(docs.sparkSession):
        return _components(docs, id_col, text_col, width, threshold)


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: tuple[int, int]) -> DataFrame:
    num, den = threshold
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = stored(set_table(rows, width, num, den), "gram-sets")
    sets = Sets(rows, table, width, num, den)
    names = sets.table.select(F.col("name").alias("s"), F.col("s").alias("sid"))
    shorts = sets.table.select(F.substring("name", 1, SHORT).alias("short"), F.col("s").alias("sid"))
    tokens = table.where("token IS NOT NULL").select("token", F.col("s").alias("short"), "n", "sets")
    shared = stored(tokens.join(shorts, "short").groupBy("token", F.col("sid").alias("s")).agg(
        F.sum("n").alias("weight"), F.max("sets").alias("sets")), "gram-shared")
    found = stored(table.where("token IS NULL").select("id", "n", "s").join(names, "s", "left"), "gram-documents")
    forget(table)

    # pivots: of a token's sets, the one with most shared tokens
    degree = shared.groupBy("s").agg(F.sum("weight").alias("degree"))
    known = shared.select("token", "s").join(degree, "s")
    pivots = known.groupBy("token").agg(F.max(F.struct("degree", "s")).alias("pivot"))
    to_pivot = stored(shared.select("token", "s").join(pivots, "token").select(
        "s", F.col("pivot.degree").alias("degree"), F.col("pivot.s").alias("pivot")).distinct(), "gram-pivots")
    home = to_pivot.groupBy("s").agg(F.max(F.struct("degree", "pivot")).alias("h")).select("s", F.col("h.pivot").alias("home"))

    first = sets.links(to_pivot.select(F.col("s").alias("a"), F.col("pivot").alias("b")).where("a != b"))
    label = components(first.union(open_groups(shared, home, sets, first)))
    forget(shared, to_pivot, sets.table)

    # a set that shares no token is a component by itself
    whole = found.join(label, found["sid"] == label["s"], "left").select(
        "id", "n", F.coalesce(F.concat(F.lit("r"), F.coalesce("root", "sid").cast("string")).cast("binary"),
                              F.concat(F.lit("s").cast("binary"), found["s"])).alias("root"))
    least = whole.where("n > 0").groupBy("root").agg(F.min("id").alias("component"))
    done = whole.join(least, "root", "left")
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
