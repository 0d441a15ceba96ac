"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by its pairs of neighbouring byte classes and how
its words repeat, and a small layer over them. Only documents have labels: gated attention learns which passages decide,
and the document's score is the logistic value of the attention-weighted mean passage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, beside, col, documents, held_out, span_hashes, words

PASSAGE = 64
#: Labelled rows that the model is fitted on at most, chosen by a hash of their id, and the bytes of each that it sees: of longer
#: texts, SAMPLE_PARTS stretches at even distances from the first to the last byte.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_PARTS = 4000, 1 << 15, 8
THRESHOLD = 0.3
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE = 40, 128, 3e-3

_CLASS = np.full(256, 15, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "|", "#*$%&", "'\"", "-_", "()[]{}<>", "/\\:;=@+")):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 0  # bytes of other letters
WIDTH = 256 + 3


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages, and how many each text has (a text without words has one, of zeros)."""
    data, starts, ends, counts = words(texts, lower=False)
    per = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(per) - per
    total = int(per.sum())
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(first, counts) + nth // PASSAGE
    x = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return x, per
    # a passage reaches from its first word to the first word of the next
    opens = np.flatnonzero(np.diff(owner, prepend=-1))
    at = np.append(starts[opens], len(data))
    kind = _CLASS[data[at[0] :]]
    pair = kind.copy()
    pair[:-1] += 16 * kind[1:]
    of = np.repeat(owner[opens], np.diff(at))
    grams = np.bincount(of * 256 + pair, minlength=total * 256).reshape(total, 256).astype(np.float32)
    x[:, :256] = np.sqrt(grams / np.maximum(1, grams.sum(axis=1, keepdims=True)))
    hashes = span_hashes(data, starts, ends)
    n = np.maximum(1, np.bincount(owner, minlength=total))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    distinct = np.bincount(owner[order], weights=fresh, minlength=total)
    x[:, 256] = np.bincount(owner, weights=again, minlength=total) / n
    x[:, 257] = distinct / n
    x[:, 258] = np.bincount(owner, weights=ends - starts, minlength=total) / n / 10
    return x, per


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, per: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        at = np.cumsum(per) - per
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        s = (t * g) @ w["a"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, at), per))
        a = e / np.repeat(np.add.reduceat(e, at), per)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        return self._forward(x, per)["p"] if len(per) else np.zeros(0)

    def gradients(self, x: np.ndarray, per: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of the documents, with respect to all weights."""
        w, f = self.weights, self._forward(x, per)
        begin = np.cumsum(per) - per
        err = (f["p"] - y) / len(per)
        each = np.repeat(err[:, None] * w["c"], per, axis=0)
        da = (each * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begin), per))
        dt = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * each + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ err, "d": np.array([err.sum()])}

    @classmethod
    def fit(cls, x: np.ndarray, per: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        shape = {"W": (WIDTH, HIDDEN), "b": HIDDEN, "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": GATE, "c": HIDDEN, "d": 1}
        w = {k: (rng.normal(0, 0.3 if k in "ac" else 1 / np.sqrt(s[0] if isinstance(s, tuple) else 8), s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        model = cls(w)
        m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
        at = np.cumsum(per) - per
        for _ in range(EPOCHS if len(per) else 0):
            order = rng.permutation(len(per))
            for k in range(0, len(order), BATCH):
                docs = order[k : k + BATCH]
                n = per[docs]
                rows = np.repeat(at[docs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                bx = x[rows]
                grad = model.gradients(bx, n, y[docs])
                step += 1
                for name, g in grad.items():
                    g = g + 1e-4 * w[name]
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    w[name] -= (RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return model


def _stretches(raw: str) -> Column:
    """A binary column of at most SAMPLE_TEXT bytes; of longer values, stretches over the whole of it."""
    size = SAMPLE_TEXT // SAMPLE_PARTS
    n = F.octet_length(raw)
    starts = [F.floor((n - size) * k / (SAMPLE_PARTS - 1)).cast("int") + 1 for k in range(SAMPLE_PARTS)]
    return F.when(n <= SAMPLE_TEXT, F.col(raw)).otherwise(F.concat(*(F.substring(F.col(raw), s, F.lit(size)) for s in starts)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on labels.quality (0 or 1) of at most sample_rows documents that are not held out, chosen by a hash of doc_id.

    Of several labels of a document the least counts, of several texts the least; of texts over SAMPLE_TEXT bytes, stretches
    of that size together are learnt from. Without labels, all scores are 0.5.
    """
    chosen = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_y")).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(sample_rows)
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    # sample_rows small rows, whatever the size of the tables; SAMPLE_TEXT bytes of each reach the driver at most
    near = docs.select("doc_id", raw.alias("raw")).join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", _stretches("raw").alias("raw"))
    rows = near.groupBy("doc_id", "_y").agg(F.min("raw").alias("raw")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.raw))
    if not rows:
        return Model({"W": np.zeros((WIDTH, HIDDEN), np.float32), "b": np.zeros(HIDDEN, np.float32), "V": np.zeros((HIDDEN, GATE), np.float32), "U": np.zeros((HIDDEN, GATE), np.float32), "a": np.zeros(GATE, np.float32), "c": np.zeros(HIDDEN, np.float32), "d": np.zeros(1, np.float32)})
    x, per = zip(*(passages([bytes(r.raw)]) for r in rows))
    return Model.fit(np.concatenate(x), np.concatenate(per), np.array([r._y for r in rows], np.float32))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold) to docs; columns of these names, in any case, are
    replaced, and all others come back unchanged.

    Null and empty texts have one passage of zeros and are scored like it; texts of any length are scored whole. Rows are
    independent of each other, so repeated ones and ties are alike, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    shared = spark.sparkContext.broadcast(model)  # of a fixed size

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        raw = [x or b"" for x in col(batch, "text").cast(pa.binary()).to_pylist()]
        p = shared.value.score(*passages(raw)).astype(np.float64)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return beside(docs, {"score": "double", "predicted": "integer"}, work, 1 << 20)


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")
