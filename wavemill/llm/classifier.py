"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``passage`` words, the last one shorter).
Every passage is encoded as numbers taken from its bytes and words; a learned
layer maps them to an embedding, gated attention (a tanh branch times a sigmoid
branch) gives each passage a weight, the weights add up to one over the
document, and a logistic unit scores the weighted embedding. Only document
labels are used in training.

Training takes at most ``sample`` labelled documents of either class, one row of
each, and no more of them than have ``most_passages`` passages together; both are
parameters. It sees all passages of these documents. Scores come from all passages of
every whole text. Id, language, source and labels are never inputs of a score.

Defined cases: a null or empty text is a bag of one empty passage and gets that
bag's score; labels that are null or contradict each other are not used; with
labels of one class only, every score is that class's share; repeated rows get
equal scores; of rows that share a labelled id, training takes the one whose
features have the least hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, fresh, kept, yielding
from .words import LOWER, NON_SPACE, texts_of, words_of

PASSAGE = 64
BUCKETS = 16

_BYTES = np.arange(256)


def _class_of_byte() -> np.ndarray:
    out = np.zeros(256, np.int64)  # control and the rest
    for k, test in enumerate(
        (
            (_BYTES >= 0x61) & (_BYTES <= 0x7A),
            (_BYTES >= 0x41) & (_BYTES <= 0x5A),
            (_BYTES >= 0x30) & (_BYTES <= 0x39),
            _BYTES == 0x20,
            _BYTES == 0x0A,
            np.isin(_BYTES, list(b"#*$%&<>@^~_=+\\")),
            _BYTES == 0x7C,
            np.isin(_BYTES, list(b"!?")),
            np.isin(_BYTES, list(b".,;:")),
            np.isin(_BYTES, list(b"()[]{}/'\"-")),
            _BYTES >= 0x80,
        ),
        start=1,
    ):
        out[test] = k
    return out


CLASS = _class_of_byte()
N_CLASSES = 12
#: Shares of the byte classes, then: words, mean word length, repeats in the passage, same as the word before, letters-only words, hashed words.
N_FEATURES = N_CLASSES + 6 + BUCKETS


def encode(data: np.ndarray, offsets: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and where each text's passages begin."""
    w = words_of(data, offsets, NON_SPACE, LOWER)
    n_words = np.diff(w.first)
    bags = np.maximum(1, -(-n_words // passage))
    offs = np.concatenate([[0], np.cumsum(bags)])
    total = int(offs[-1])
    out = np.zeros((total, N_FEATURES), np.float32)
    doc_of = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(w.hash)) - w.first[:-1][doc_of]
    bag = offs[:-1][doc_of] + place // passage
    # bytes belong to the passage of the word that begins last before them; leading space to the first
    first_word = np.flatnonzero(np.diff(bag, prepend=-1))
    begins = offsets[:-1].repeat(bags).astype(np.int64)
    if len(first_word):
        later = place[first_word] > 0
        begins[bag[first_word][later]] = w.start[first_word][later]
    ends = np.append(begins[1:], len(data))
    length = np.maximum(ends - begins, 0)
    owner = np.repeat(np.arange(total), length)
    counts = np.bincount(owner * N_CLASSES + CLASS[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    size = np.maximum(length, 1)[:, None]
    out[:, :N_CLASSES] = counts / size
    words = np.bincount(bag, minlength=total)
    some = np.maximum(words, 1)
    out[:, N_CLASSES] = np.log1p(words) / np.log1p(passage)
    out[:, N_CLASSES + 1] = np.bincount(bag, weights=w.end - w.start, minlength=total) / some / 10
    if len(bag):
        order = np.lexsort((w.hash, bag))
        again = (np.diff(bag[order], prepend=-1) == 0) & (np.diff(w.hash[order].view(np.int64), prepend=1) == 0)
        out[:, N_CLASSES + 2] = np.bincount(bag[order][again], minlength=total) / some
        same = np.zeros(len(bag), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (bag[1:] == bag[:-1])
        out[:, N_CLASSES + 3] = np.bincount(bag[same], minlength=total) / some
        upto = np.concatenate([[0], np.cumsum((CLASS[data] == 2).astype(np.int32))])
        capitals = upto[w.end] - upto[w.start]
        out[:, N_CLASSES + 4] = np.bincount(bag[capitals > 1], minlength=total) / some
        bucket = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
        out[:, N_CLASSES + 6 :] = np.bincount(bag * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / some[:, None]
    out[:, N_CLASSES + 5] = words == 0
    return out, offs


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights: embedding (w, b), attention (v, u, a), output (c, d); features are centred and scaled."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
        """All that training needs, from scaled features and where each document's passages begin."""
        p = self.p
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        starts = offs[:-1]
        of = np.repeat(np.arange(len(starts)), np.diff(offs))
        ex = np.exp(e - np.maximum.reduceat(e, starts)[of])
        weight = ex / np.add.reduceat(ex, starts)[of]
        bag = np.add.reduceat(weight[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "of": of, "weight": weight, "bag": bag, "score": _sigmoid(bag @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offs) - 1, self.constant)
        return self.forward(self.scaled(x.astype(float)), offs)["score"]


def train(x: np.ndarray, offs: np.ndarray, y: np.ndarray, hidden: int = 16, gates: int = 8, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the log loss, both classes weighing the same."""
    x = x.astype(float)
    model = Model(x.mean(axis=0) if len(x) else np.zeros(N_FEATURES), (x.std(axis=0) if len(x) else np.ones(N_FEATURES)) + 1e-3)
    if len(set(y.tolist())) < 2:
        model.constant = float(y[0]) if len(y) else 0.5
        return model
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = model.p = {
        "w": rng.normal(0, d**-0.5, (d, hidden)),
        "b": np.zeros(hidden),
        "v": rng.normal(0, hidden**-0.5, (hidden, gates)),
        "u": rng.normal(0, hidden**-0.5, (hidden, gates)),
        "a": rng.normal(0, gates**-0.5, gates),
        "c": rng.normal(0, hidden**-0.5, hidden),
        "d": np.zeros(()),
    }
    weigh = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    z = model.scaled(x)
    for step in range(1, steps + 1):
        f = model.forward(z, offs)
        out = (f["score"] - y) * weigh
        bag = out[:, None] * p["c"]
        per = bag[f["of"]]
        near = (per * f["h"]).sum(axis=1)
        mean = np.add.reduceat(f["weight"] * near, offs[:-1])[f["of"]]
        de = f["weight"] * (near - mean)
        tg = f["t"] * f["g"]
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * tg * (1 - f["g"])
        dh = f["weight"][:, None] * per + dt @ p["v"].T + dg @ p["u"].T
        dz = dh * (1 - f["h"] ** 2)
        grad = {"w": z.T @ dz, "b": dz.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": tg.T @ de, "c": f["bag"].T @ out, "d": out.sum()}
        for k in p:
            g = grad[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(passage: int):
    """Per row: its id, label, and the features of all its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in texts_of(b.column(2)):
                x, offs = encode(data, offsets, passage)
                n = len(offs) - 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(np.diff(offs), pa.int64()), pa.array([x[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], names=["doc_id", "label", "n", "bag"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, most_passages: int = 200_000, passage: int = PASSAGE, text_col: str = "text") -> Model:
    """A model from the labels (doc_id, quality) whose crc32(doc_id as text) mod 4 is not 2."""
    clean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    clean = clean.where("low = high and low in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    take = lambda y: clean.where(F.col("low") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_l"), F.col("low").cast("int").alias("label"))
    chosen = F.broadcast(take(0).union(take(1)))  # at most twice the sample
    rows = docs.select("doc_id", F.col(text_col).alias("text")).join(chosen, F.col("doc_id") == F.col("_l")).select("doc_id", "label", "text")
    bags = rows.mapInArrow(_bags(passage), f"doc_id {dict(rows.dtypes)['doc_id']}, label int, n long, bag binary")
    bags = kept(bags.groupBy("doc_id").agg(F.min(F.struct(F.md5("bag").alias("hash"), "bag", "n", "label")).alias("b")).select("doc_id", "b.*"))
    # in a fixed pseudo-random order, as many whole documents as fit
    sizes = bags.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most twice the sample
    fit_in, held = [], 0
    for r in sizes:
        if held + r["n"] <= most_passages:
            fit_in.append(r["doc_id"])
            held += r["n"]
    got = bags.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fit_in], f"_i {dict(rows.dtypes)['doc_id']}")), F.col("doc_id") == F.col("_i")).orderBy("hash", "doc_id").collect()
    discard(bags)
    x = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in got]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in x])]).astype(int)
    flat = np.concatenate(x) if x else np.zeros((0, N_FEATURES), np.float32)
    return train(flat, offs, np.array([r["label"] for r in got], float))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """The columns in ``keep`` with score (0 to 1, higher: label 1 likelier) and n_passages; a kept column named like these gives way to them."""
    keep = yielding(keep, ("score", "n_passages"))
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias(fresh("_text", keep)))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, data, offsets in texts_of(b.column(n)):
                x, offs = encode(data, offsets, passage)
                scores.append(model.score(x, offs))
                sizes.append(np.diff(offs))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], pa.array(np.concatenate(scores)), pa.array(np.concatenate(sizes))], names=[*keep, "score", "n_passages"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:n]], "score double", "n_passages long"])
    return rows.mapInArrow(run, schema)
