"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word's hash is its place in a table of random index vectors, sparse and ternary. Its word vector is the sum of
the index vectors of its neighbours in all documents, scaled to length 1; the sums are taken where the documents
are stored and added by place, so no word is left out and the table has one size, whatever the corpus holds. A
document is the mean of its words' vectors, of the index vectors of their shapes (how letters, digits and signs
follow each other), and of a few pseudo-words: a word that repeats the one before, a word seen before in the text,
a line seen before, and the text's length. Labelled documents are pooled where they are, too. The network is
trained with numpy on the driver, from their vectors; a temperature found on rows kept apart calibrates its
probabilities. Every document is then scored by itself, where it is stored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import strings, tidy

#: Pseudo-words, counted per word: repeats its neighbour, seen before in the text; then seen lines per line, log of the length, no word at all.
PSEUDO = 5


@dataclass(frozen=True)
class Settings:
    """max_rows: labelled rows that the network is fitted on at most, those of smallest hash. places: of the table of word
    vectors; words whose hashes agree in them share one. window: how far neighbours are from a word."""

    max_rows: int = 8000
    places: int = 1 << 15
    window: int = 2
    dims: int = 48
    nonzero: int = 4
    shapes: int = 256
    shape_dims: int = 64
    hidden: int = 24
    epochs: int = 40
    batch: int = 128
    rate: float = 0.004
    decay: float = 1e-4
    kept_apart: float = 0.2
    seed: int = 1


def index_vectors(count: int, dims: int, nonzero: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a table, where its vector is not zero, and the signs there."""
    rng = np.random.default_rng([seed, count, dims])
    at = rng.random((count, dims), np.float32).argpartition(nonzero - 1, axis=1)[:, :nonzero]
    return at, rng.choice(np.array([-1, 1], np.float32), (count, nonzero))


KINDS = {ord(c): k for cs, k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("abcdefghijklmnopqrstuvwxyz", "a"), ("0123456789", "9")) for c in cs}
RUNS = re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Runs of capitals, small letters, digits, and each sign that is not a letter, once a run."""
    if word.isascii():
        return "a" if word.isalpha() and word.islower() else RUNS.sub(r"\1", word.translate(KINDS))
    return RUNS.sub(r"\1", "".join([("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c for c in word]))


class Codes(dict):
    """A word's place and its shape's (0 if not ``shaped``) as one number. Words are remembered up to a bound, then forgotten."""

    def __init__(self, s: Settings, shaped: bool = True):
        super().__init__()
        self.shapes, self.places, self.shaped, self.bound = s.shapes, s.places, shaped, 200_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.bound:
            self.clear()
        own = zlib.crc32(word.lower().strip(".,").encode("utf-8", "surrogatepass")) % self.places
        sort = zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % self.shapes if self.shaped else 0
        self[word] = code = own * self.shapes + sort
        return code


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray | None = None  # a row for each place
    shape_vectors: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    constant: float | None = 0.5

    def pooled(self, text: str, codes: Codes) -> np.ndarray:
        s = self.settings
        words = text.split()
        out = np.zeros(s.dims + s.shape_dims + PSEUDO, np.float32)
        if not words:
            out[-1] = 1
            return out
        own, sort = np.divmod(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), s.shapes)
        for at in range(0, len(own), 65_536):
            out[: s.dims] += self.vectors[own[at : at + 65_536]].sum(0) / len(words)
        out[s.dims : -PSEUDO] = np.bincount(sort, minlength=s.shapes).astype(np.float32) @ self.shape_vectors / len(words)
        lines = text.split("\n")
        out[-PSEUDO:] = sum(map(eq, words, words[1:])) / len(words), 1 - len(set(words)) / len(words), 1 - len(set(lines)) / len(lines), np.log1p(len(words)) / 8, 0
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self.logits(x.astype(np.float64)) / self.temperature))


def summer(s: Settings, together: int = 1 << 17):
    """From texts, the sums of the neighbours' index vectors of each place that has any, as far as these texts go."""

    def add(sums: np.ndarray, held: list[np.ndarray], at: np.ndarray, sign: np.ndarray) -> None:
        whole = np.concatenate(held)
        for begin in range(0, len(whole), together):
            flat, places, signs = whole[begin : begin + together + s.window], [], []
            for far in range(1, s.window + 1):
                left = np.flatnonzero((flat[:-far] >= 0) & (flat[far:] >= 0) & (np.arange(len(flat) - far) < together))
                a, b = flat[left], flat[left + far]
                places += [(a[:, None] * s.dims + at[b]).ravel(), (b[:, None] * s.dims + at[a]).ravel()]
                signs += [sign[b].ravel(), sign[a].ravel()]
            sums += np.bincount(np.concatenate(places), np.concatenate(signs), len(sums))  # whole numbers, exact in doubles

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = index_vectors(s.places, s.dims, s.nonzero, s.seed)
        codes, sums, held, n = Codes(s, False), np.zeros(s.places * s.dims), [], 0
        apart = np.full(s.window, -1, np.int64)
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):  # few texts at a time as Python strings
            for text in strings(batch.column("_text")):
                words = text.split()
                held += [np.fromiter(map(codes.__getitem__, words), np.int64, len(words)) // s.shapes, apart]
                n += len(words)
                if n >= together:
                    add(sums, held, at, sign)
                    held, n = [], 0
        if held:
            add(sums, held, at, sign)
        table = sums.reshape(s.places, s.dims).astype(np.int64)
        some = np.flatnonzero(table.any(1))
        for k in range(0, len(some), 4096):
            part = some[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(table[part, d]) for d in range(s.dims))], names=["place", *(f"v{d}" for d in range(s.dims))])
        codes.clear()
        tidy()

    return give


def word_vectors(docs: DataFrame, s: Settings, text: str = "text") -> np.ndarray:
    """The table of word vectors, from all documents. The driver gets a row of sums for each place."""
    kinds = ", ".join(f"v{d} long" for d in range(s.dims))
    sums = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(summer(s), f"place int, {kinds}")
    found = sums.groupBy("place").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(s.dims))).toArrow()
    out = np.zeros((s.places, s.dims))
    out[found["place"].to_numpy()] = np.stack([found[f"v{d}"].to_numpy() for d in range(s.dims)], 1)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def trained(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Weights of the two layers, by Adam on the cross entropy."""
    rng = np.random.default_rng(s.seed)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, s.hidden), np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), s.batch):
            own = order[i : i + s.batch]
            h = np.tanh(x[own] @ p[0] + p[1])
            off = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[own]) / len(own)
            back = np.outer(off, p[2]) * (1 - h * h)
            grads = [x[own].T @ back + s.decay * p[0], back.sum(0), h.T @ off + s.decay * p[2], off.sum()]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - s.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross entropy, by golden section over its logarithm."""
    loss = lambda t: float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / np.exp(t))))
    a, b, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def untrained(vectors: np.ndarray, s: Settings = Settings()) -> Model:
    """What pools documents; all its scores are 0.5."""
    at, sign = index_vectors(s.shapes, s.shape_dims, s.nonzero, s.seed)
    shapes = np.zeros((s.shapes, s.shape_dims), np.float32)
    np.add.at(shapes, (np.arange(s.shapes)[:, None], at), sign)
    return Model(s, vectors, shapes)


def fit(model: Model, x: np.ndarray, labels: np.ndarray) -> Model:
    """Train on pooled documents and 0/1 labels, however few. Without rows, or with one label only, all scores are the smoothed
    share of 1. Rows kept apart set the temperature, if they have both labels."""
    y, s = labels.astype(float), model.settings
    model.constant = float((y.sum() + 1) / (len(y) + 2))
    if len(np.unique(y)) < 2:
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    apart = np.random.default_rng(s.seed).random(len(y)) < s.kept_apart
    if len(set(y[~apart])) < 2:  # a label only among those kept apart: train on all
        apart[:] = False
    model.layers = trained((x[~apart] - model.mean) / model.scale, y[~apart], s)
    model.temperature = calibrated(model.logits(x[apart]), y[apart]) if len(set(y[apart])) == 2 else 1.0
    model.constant = None
    return model


def pooler(model: Model):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model.settings)
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            x = [model.pooled(t, codes) for t in strings(batch.column("_text"))]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float32()))], names=[*names, "_x"])
        codes.clear()
        tidy()

    return pool


def scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model.settings)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # few texts at a time as Python strings
                batch = whole.slice(at, 256)
                if model.constant is not None:
                    found = np.full(batch.num_rows, model.constant)
                else:
                    found = model.scores(np.array([model.pooled(t, codes) for t in strings(batch.column("_text"))]))
                names = [c for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.float64())], names=[*names, "score"])
        codes.clear()
        tidy()

    return score


def held_out(doc_id: str) -> Column:
    """Rows that labels are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Word vectors of all documents, and the network of labelled ones outside the held-out ones.

    Of the labels, the ``max_rows`` of smallest hash are used (a bounded sample); an id with both labels counts for
    both. Of documents that share a labelled id, the one whose text has the smallest hash is fitted on.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    chosen = usable.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).distinct().orderBy(F.xxhash64(F.lit("fit"), "_id"), "_label").limit(s.max_rows)
    asked = chosen.toArrow()
    if not asked.num_rows:
        return Model(s)
    model = untrained(word_vectors(docs, s, text), s)
    ids = docs.sparkSession.createDataFrame(asked).select("_id").distinct()
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(ids), "_id")  # at most max_rows rows
    kind = found.schema["_id"].dataType.simpleString()
    pooled = found.withColumn("_hash", F.xxhash64("_text")).mapInArrow(pooler(model), f"_id {kind}, _hash long, _x array<float>")
    one = pooled.groupBy("_id").agg(F.min(F.struct("_hash", "_x")).alias("_one")).select("_id", "_one._x").toArrow()
    x = dict(zip(one["_id"].to_pylist(), one["_x"].to_pylist(), strict=True))
    rows = sorted((i, y) for i, y in zip(asked["_id"].to_pylist(), asked["_label"].to_pylist(), strict=True) if i in x)
    return fit(model, np.array([x[i] for i, _ in rows], float), np.array([y for _, y in rows], int))


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and score, the probability of label 1. A null text is scored as an empty one; any columns may go along."""
    sent = docs.withColumn("_text", F.col(text).cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return sent.mapInArrow(scorer(model), f"{kinds}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Rows are scored alone: repeated rows alike, an empty table to nothing."""
    model = fit_on(docs, labels, s, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = with_score(rows, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
