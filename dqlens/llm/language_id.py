"""Language identification by a byte convolutional network in numpy.

Network: byte embedding, convolutions of several widths over the UTF-8 bytes
of a fixed-length window, max pooling over the window, softmax.  It is
trained by Adam on windows of labelled texts and applied to all windows of
every text, many windows at a time; a document's language is the one with
the highest mean log probability over its windows, its score the mean
probability of that language.

Training rows: about ``SAMPLE_PER_LANGUAGE`` rows of each language, chosen by
a hash of the id (a documented bound on what the driver gathers: at most
``MAX_WINDOWS_PER_ROW`` windows of ``WINDOW`` bytes a row, from hashed places
all over the text, of the ``MAX_LANGUAGES`` most frequent labels, so that a junk
label column does not flood it).  Labels are used for training only.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
rows without label, text or id do not train; with fewer than one usable label
every text is ``und``; with a single language all texts with a letter get it;
texts of any length are predicted from all of their windows; an empty table gives
no network and an empty result; extra columns are ignored; repeated rows are
predicted alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.llm.common import give_back, let_go, ship_code

WINDOW = 192                 # bytes
SAMPLE_PER_LANGUAGE = 1500   # rows
MAX_WINDOWS_PER_ROW = 2
MAX_LANGUAGES = 300          # that the network learns: those with most labelled rows
STEPS = 700                  # training steps of 128 windows
EMBEDDING = 8
FILTERS = {2: 16, 3: 16, 4: 16}      # width -> number of filters
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


class ByteCNN:
    """Parameters and forward pass; byte 0 pads short windows."""

    def __init__(self, classes: list[str], seed: int = 7, embedding: int = EMBEDDING,
                 filters: dict[int, int] | None = None):
        rng = np.random.default_rng(seed)
        self.classes = list(classes)
        self.widths = dict(filters or FILTERS)
        total = sum(self.widths.values())
        self.p = {"emb": rng.normal(0, 0.3, (256, embedding))}
        for w, n in self.widths.items():
            self.p[f"conv{w}"] = rng.normal(0, (2 / (w * embedding)) ** 0.5, (w * embedding, n))
            self.p[f"bias{w}"] = np.zeros(n)
        self.p["out"] = rng.normal(0, (1 / total) ** 0.5, (total, len(classes)))
        self.p["out_bias"] = np.zeros(len(classes))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, e: np.ndarray, w: int) -> np.ndarray:
        """Sliding stretches of ``w`` embedded bytes as rows, without a copy.
        Every width looks at as many places as the widest has."""
        b, length, d = e.shape
        s0, s1, s2 = e.strides
        return np.lib.stride_tricks.as_strided(e, (b, length - max(self.widths) + 1, w * d), (s0, s1, s2))

    def tables(self) -> list[np.ndarray]:
        """Per offset, what each byte value adds to each filter: the embedding
        and the convolutions folded together for prediction."""
        d = self.p["emb"].shape[1]
        out = []
        for k in range(max(self.widths)):
            out.append(np.concatenate([
                self.p["emb"] @ self.p[f"conv{w}"][k * d:(k + 1) * d] if k < w
                else np.zeros((256, n), np.float32) for w, n in self.widths.items()], axis=1))
        return [np.ascontiguousarray(t, dtype=np.float32) for t in out]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        places = x.shape[1] - len(tables) + 1
        z = tables[0].take(x[:, :places], axis=0)
        for k, t in enumerate(tables[1:], 1):
            z += t.take(x[:, k:k + places], axis=0)
        bias = np.concatenate([self.p[f"bias{w}"] for w in self.widths])
        return np.maximum(z.max(axis=1) + bias, 0)

    def log_probabilities(self, x: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        z = self.pooled(x, tables) @ self.p["out"] + self.p["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e = self.p["emb"][x]
        cols, best, hidden = {}, {}, []
        for w in self.widths:
            cols[w] = self._columns(e, w)
            z = np.matmul(cols[w], self.p[f"conv{w}"])
            best[w] = z.argmax(axis=1)
            hidden.append(np.take_along_axis(z, best[w][:, None, :], 1)[:, 0, :] + self.p[f"bias{w}"])
        h = np.concatenate(hidden, axis=1)
        a = np.maximum(h, 0)
        z = a @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g = {"out": a.T @ dz, "out_bias": dz.sum(axis=0), "emb": np.zeros_like(self.p["emb"])}
        dh = (dz @ self.p["out"].T) * (h > 0)
        at, d = 0, self.p["emb"].shape[1]
        rows = np.arange(len(y))[:, None]
        for w, n in self.widths.items():
            part = dh[:, at:at + n]
            at += n
            chosen = cols[w][rows, best[w]]                       # rows x filters x (w * d)
            g[f"conv{w}"] = np.einsum("bnk,bn->kn", chosen, part)
            g[f"bias{w}"] = part.sum(axis=0)
            back = part[:, :, None] * self.p[f"conv{w}"].T[None]  # to the embedded bytes
            for k in range(w):
                np.add.at(g["emb"], x[rows, best[w] + k], back[:, :, k * d:(k + 1) * d])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 128,
            rate: float = 1e-2, seed: int = 7) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        step = 0
        while step < steps:
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                pick = order[s:s + batch]
                lr = rate * max(0.05, 1 - step / steps)
                step += 1
                for k, g in self._gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All consecutive windows of a text's bytes, the last one padded."""
    n = max(1, -(-len(data) // size))
    x = np.zeros(n * size, np.uint8)
    x[:len(data)] = np.frombuffer(data, np.uint8)
    return x.reshape(n, size)


def training_windows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str,
                     per_language: int = SAMPLE_PER_LANGUAGE, size: int = WINDOW,
                     places: int = MAX_WINDOWS_PER_ROW) -> pd.DataFrame:
    """Bounded sample (columns lang, w): rows are kept by a hash of their id at
    a rate of ``per_language`` / rows of the language, so nothing is shuffled;
    of a kept row only windows at hashed places travel."""
    text, lang, key = F.col(text_col), F.col(lang_col), F.col(id_col)
    usable = labelled.where(lang.isNotNull() & text.isNotNull() & key.isNotNull() & (F.length(text) > 0))
    # the languages with most rows; ties by name
    counts = {r["lang"]: r["n"] for r in usable.groupBy(lang.alias("lang")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "w": []})
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    data = F.encode(text, "UTF-8")
    place = lambda i: F.pmod(F.xxhash64(key, F.lit(i)), F.greatest(
        F.octet_length(text).cast("long") - F.lit(size), F.lit(0)) + 1).cast("int")
    cut = [F.substring(data, place(i) + 1, F.lit(size)) for i in range(places)]
    rows = usable.where(draw < F.element_at(rate, lang)).select(
        lang.alias("lang"), key.alias("k"), F.explode(F.array_distinct(F.array(*cut))).alias("w"))
    bound = int(len(counts) * (per_language * 1.2 + 200) * places)
    got = rows.limit(bound).toPandas()          # the documented bound, above what the rate lets through
    return got.sort_values(["lang", "k"], kind="stable").reset_index(drop=True)[["lang", "w"]]


def train(sample: pd.DataFrame, size: int = WINDOW) -> ByteCNN | None:
    if not len(sample):
        return None
    classes = sorted(sample["lang"].unique())
    x = np.concatenate([windows(bytes(w), size)[:1] for w in sample["w"]])
    y = sample["lang"].map({c: i for i, c in enumerate(classes)}).to_numpy()
    return ByteCNN(classes).fit(x, y)


def predict_texts(model: ByteCNN | None, texts, size: int = WINDOW, at_once: int = 16):
    """Language and score of each text; whole texts, window by window."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    blocks, owner = [], []
    for i, t in enumerate(texts):
        if t is not None and LETTER.search(t):
            b = windows(t.encode("utf-8", "surrogatepass"), size)
            blocks.append(b)
            owner.append((i, len(b)))
    if not owner:
        return langs, scores
    x = np.concatenate(blocks)
    tables = model.tables()
    logs = np.concatenate([model.log_probabilities(x[s:s + at_once], tables)
                           for s in range(0, len(x), at_once)])
    starts = np.concatenate([[0], np.cumsum([n for _, n in owner])[:-1]])
    counts = np.array([n for _, n in owner])[:, None]
    best = (np.add.reduceat(logs, starts, axis=0) / counts).argmax(axis=1)
    mean = np.add.reduceat(np.exp(logs), starts, axis=0) / counts
    for (i, _), k, p in zip(owner, best, mean, strict=True):
        langs[i], scores[i] = model.classes[k], float(min(1.0, p[k]))
    return langs, scores


def _chunks(texts: list, limit: int = 2 << 20):
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def predictor(model: ByteCNN | None):
    """Pandas UDF text -> struct(lang, score)."""
    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(text: pd.Series) -> pd.DataFrame:
        let_go()
        langs, scores = [], []
        for part in _chunks(text.tolist()):
            got, s = predict_texts(model, part)
            langs += got
            scores += list(s)
        give_back()
        return pd.DataFrame({"lang": langs, "score": scores})
    return predict


def train_on(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> ByteCNN | None:
    return train(training_windows(labelled, id_col, text_col, lang_col))


def predicted(docs: DataFrame, model: ByteCNN | None, text: Column, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` (lang, score)."""
    ship_code(docs.sparkSession)
    return docs.withColumn(name, predictor(model)(text))
