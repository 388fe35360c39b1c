import math
import zlib

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from wavemill.llm import classifier
from wavemill.llm.queries import op8_attention_quality

SCHEMA = "doc_id long, text string, score string, label string"


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, classifier.N_FEATURES))
    offs, y = np.array([0, 3, 4, 9, 12]), np.array([1.0, 0.0, 1.0, 0.0])
    before = classifier.train(x, offs, y, steps=1, rate=1e-9)
    loss = lambda m: -np.mean([np.log(s if t else 1 - s) for s, t in zip(m.score(x, offs), y, strict=True)])
    after = classifier.train(x, offs, y, steps=200)
    assert loss(after) < 0.2 * loss(before)
    f = after.forward(after.scaled(x), offs)
    assert np.allclose(np.add.reduceat(f["weight"], offs[:-1]), 1)


def plain_score(model, passages):
    """The score of one document in plain loops."""
    p, hidden, energy = model.p, [], []
    for x in passages:
        z = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(z[i] * p["w"][i][j] for i in range(len(z))) + p["b"][j]) for j in range(len(p["b"]))]
        t = [math.tanh(sum(h[i] * p["v"][i][j] for i in range(len(h)))) for j in range(len(p["a"]))]
        g = [1 / (1 + math.exp(-sum(h[i] * p["u"][i][j] for i in range(len(h))))) for j in range(len(p["a"]))]
        hidden.append(h)
        energy.append(sum(a * b * c for a, b, c in zip(t, g, p["a"], strict=True)))
    weights = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
    bag = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(bag, p["c"], strict=True)) - float(p["d"])))


def test_scores_against_plain_loops(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["Word", "an", "other!", "x9 #$", "\n", "é"], size=n)) for n in (0, 1, 5, 70, 200, 333)]
    raw = [t.encode() for t in texts]
    x, offs = classifier.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    model = classifier.train(x, offs, np.array([0.0, 1.0, 0.0, 1.0, 0.0, 1.0]), steps=20)
    got = {r["doc_id"]: r["score"] for r in classifier.score(spark.createDataFrame([(i, t, "s", "q") for i, t in enumerate(texts)], SCHEMA), model).collect()}
    for i in range(len(texts)):
        assert abs(got[i] - plain_score(model, x[offs[i] : offs[i + 1]].astype(float))) < 1e-9


def test_training_takes_one_row_of_an_id_and_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda x, offs, y: seen.append((len(x), np.diff(offs).tolist(), y.tolist())))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:4]
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[2], 1), (ids[3], 0)], "doc_id long, quality int")
    rows = [(ids[0], "word " * 6400, "s", "q")] * 50 + [(ids[1], "other " * 640, "s", "q"), (ids[2], "huge " * 64_000, "s", "q"), (ids[3], "small", "s", "q")]
    classifier.fit(spark.createDataFrame(rows, SCHEMA), labels, most_passages=500)
    assert seen[0][0] == 111 and sorted(seen[0][1]) == [1, 10, 100] and sorted(seen[0][2]) == [0, 0, 1]


def test_encoding_does_not_depend_on_the_batch():
    texts = ["", "one two\nTHREE!! | four", "  x " * 100, "é" * 300]
    joined = b"".join(t.encode() for t in texts)
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    x, at = classifier.encode(np.frombuffer(joined, np.uint8), offs, 16)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        own, _ = classifier.encode(raw, np.array([0, len(raw)]), 16)
        assert np.allclose(own, x[at[i] : at[i + 1]])


def test_held_out_accuracy(spark):
    got = op8_attention_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert held > 0.95 and got.count() == 1000


def test_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1)], "doc_id long, quality int")
    rows = [(1, "text", "s", "q"), (1, "text", "s", "q"), (None, None, None, None), (2, "", "s", "q"), (3, "word " * 50_000, "s", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = classifier.score(df, classifier.fit(df, labels)).collect()
    assert len(got) == 5 and all(r["score"] in (0.5, 1.0) for r in got)
    assert {r["n_passages"] for r in got} == {1, 782}
    assert classifier.score(spark.createDataFrame([], SCHEMA), classifier.fit(df, labels.limit(0))).count() == 0


def test_small_tables(spark):
    assert op8_attention_quality(spark, SF).count() == 200
