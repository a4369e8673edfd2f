"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes. Every passage is encoded: counts of
neighbouring byte classes and of words that repeat the word before, then a learned
layer. Gated attention weighs the passages of a document, and a logistic score is read
off their weighted sum. Only documents are labelled; encoder, attention and score are
learned together from those labels.

Fitting uses a bounded sample of labelled documents; scoring reads every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesops import ByteHash, slices, spans, words

PASSAGE = 512
# Bounds of the fitting sample: labelled documents, and bytes of one of them.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64_000
THRESHOLD = 0.7
_HIDDEN, _GATES = 24, 12

_CLASS = np.full(256, 9, np.uint8)  # other signs
_CLASS[:32] = 11
_CLASS[[32, 9, 11, 12, 13]] = 0
_CLASS[10] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "'\"()-"]] = 8
_CLASS[ord("|")] = 10
_CLASSES = 12
FEATURES = _CLASSES**2 + 3


def passages(column) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of a string column, and the index of each one's
    document. Empty and null texts have no passage."""
    data, offsets = spans(column)
    sizes = np.diff(offsets)
    counts = -(-sizes // PASSAGE)
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(sizes)), counts)
    if not len(data):
        return np.zeros((0, FEATURES), np.float32), doc
    row = np.repeat(np.arange(len(sizes)), sizes)
    passage = first[row] + (np.arange(len(data)) - offsets[row]) // PASSAGE
    kinds = _CLASS[data].astype(np.int64)
    same = passage[1:] == passage[:-1]
    cell = (passage[:-1] * _CLASSES + kinds[:-1]) * _CLASSES + kinds[1:]
    n = first[-1]
    pairs = np.bincount(cell[same], minlength=n * _CLASSES**2).reshape(n, -1)
    length = np.bincount(passage, minlength=n)
    starts, ends, word_row = words(data, offsets)
    hashes = ByteHash(5).ranges(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    at = passage[starts]
    found = np.bincount(at, minlength=n)
    repeats = np.bincount(at[again], minlength=n)
    out = np.empty((n, FEATURES), np.float32)
    out[:, : _CLASSES**2] = np.sqrt(pairs / np.maximum(length, 1)[:, None])
    out[:, -3] = repeats / np.maximum(found, 1)
    out[:, -2] = np.minimum(length / np.maximum(found, 1), 40) / 10
    out[:, -1] = length / PASSAGE
    return out, doc


class Model:
    """Encoder, gated attention and score; ``parts`` are plain arrays."""

    NAMES = ("W", "b", "V", "U", "a", "c", "d")

    def __init__(self, parts: dict[str, np.ndarray], mean, scale):
        self.parts, self.mean, self.scale = parts, mean, scale

    def _forward(self, x, first, count):
        p = self.parts
        z = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
        e = (t * s) @ p["a"]
        top = np.maximum.reduceat(e, first)
        w = np.exp(e - np.repeat(top, count))
        w /= np.repeat(np.add.reduceat(w, first), count)
        bag = np.add.reduceat(w[:, None] * z, first, axis=0)
        return z, t, s, w, bag, bag @ p["c"] + p["d"][0]

    def scores(self, x, doc, docs: int) -> np.ndarray:
        """Probability of label 1 for each of ``docs`` documents; one without passages
        has an empty representation and gets the score of the constant term."""
        logit = np.full(docs, self.parts["d"][0], np.float64)
        if len(x):
            count = np.bincount(doc, minlength=docs)
            has = np.flatnonzero(count)
            first = np.concatenate([[0], np.cumsum(count[has])[:-1]])
            logit[has] = self._forward((x - self.mean) / self.scale, first, count[has])[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradient(self, x, first, count, y):
        p = self.parts
        z, t, s, w, bag, logit = self._forward(x, first, count)
        dl = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        dbag = dl[:, None] * p["c"]
        rows = np.repeat(dbag, count, axis=0)
        dw = (rows * z).sum(1)
        de = w * (dw - np.repeat(np.add.reduceat(w * dw, first), count))
        dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
        dz = w[:, None] * rows + dt @ p["V"].T + ds @ p["U"].T
        dh = dz * (1 - z * z)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": z.T @ dt, "U": z.T @ ds,
                "a": ((t * s) * de[:, None]).sum(0), "c": bag.T @ dl, "d": np.array([dl.sum()])}


def fit_arrays(bags: list[np.ndarray], labels: np.ndarray, *, rounds: int = 30, seed: int = 3,
               decay: float = 1e-4) -> Model:
    """Adam over mini-batches of bags; without bags, a model that always says 0.5."""
    rng = np.random.default_rng(seed)
    parts = {
        "W": rng.normal(0, FEATURES**-0.5, (FEATURES, _HIDDEN)), "b": np.zeros(_HIDDEN),
        "V": rng.normal(0, _HIDDEN**-0.5, (_HIDDEN, _GATES)),
        "U": rng.normal(0, _HIDDEN**-0.5, (_HIDDEN, _GATES)),
        "a": rng.normal(0, _GATES**-0.5, _GATES), "c": np.zeros(_HIDDEN), "d": np.zeros(1)}
    if not bags:
        return Model(parts, np.zeros(FEATURES), np.ones(FEATURES))
    everything = np.concatenate(bags)
    model = Model(parts, everything.mean(0, dtype=np.float64), everything.std(0, dtype=np.float64) + 0.02)
    del everything
    first_moment = {k: np.zeros_like(v) for k, v in parts.items()}
    second_moment = {k: np.zeros_like(v) for k, v in parts.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            count = np.array([len(bags[i]) for i in chosen])
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            slope = model.gradient(
                (np.concatenate([bags[i] for i in chosen]) - model.mean) / model.scale,
                first, count, labels[chosen])
            step += 1
            for k in Model.NAMES:
                g = slope[k] + decay * parts[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                parts[k] -= (0.004 * (first_moment[k] / (1 - 0.9**step))
                             / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8))
    return model


def held_out(id_column):
    """Rows whose labels no fitting sees; rows without an id are not among them."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_column="doc_id", text_column="text",
        label_column="quality", sample_rows: int = SAMPLE_ROWS,
        sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample_rows`` labelled documents that are not held out,
    chosen by a hash of their id, of texts up to ``sample_bytes``.

    Labels that are null or contradict each other are left out, as are null ids.
    """
    known = (labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("y"))
             .where("id is not null and y in (0, 1)").where(~held_out("id"))
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other"))
             .where("y = other").select("id", "y")
             .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    # No more rows than sample_rows, so the sample goes to every task.
    sample = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(
        F.octet_length("text").between(1, sample_bytes)).join(F.broadcast(known), "id")

    def encode(batches):
        for batch in batches:
            x, doc = passages(batch.column(1))
            bags = [x[doc == i].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()), pa.array(bags, pa.binary())],
                names=["id", "y", "bag"])

    encoded = sample.select("id", "text", "y").mapInArrow(encode, "id string, y int, bag binary")
    rows = sorted(encoded.dropDuplicates(["id"]).collect(), key=lambda r: r["id"])
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit_arrays(bags, np.array([float(r["y"]) for r in rows]))


def score(docs: DataFrame, model: Model, *, text_column="text", score_column="score") -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1, read from the whole text alone. A column
    of that name in the input is replaced. Null texts score like empty ones, repeated
    texts alike; no rows give no rows."""
    docs = docs.drop(score_column)
    schema = docs.select("*", F.lit(0.0).alias(score_column)).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_column):
                x, doc = passages(part.column(part.schema.get_field_index(text_column)))
                made = model.scores(x, doc, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(made, pa.float64())],
                    names=[*part.schema.names, score_column])

    return docs.mapInArrow(run, schema)
