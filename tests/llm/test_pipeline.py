"""The stages over the smallest tables: each against what its own input asks for."""

import sys
from pathlib import Path

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_mixing import brute as brute_mix  # noqa: E402
from test_rules import brute as brute_stats  # noqa: E402
from test_similarity import brute as brute_links  # noqa: E402
from wavemill.llm import classifier, pieces, rules  # noqa: E402
from wavemill.llm.scratch import kept  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(kept(stage(spark, out[-1], SF)))
    return [[tuple(r) for r in df.collect()] if df.columns == COLUMNS else df for df in out]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "mix", "pieces"]
    assert all(isinstance(s, list) for s in stages[:5])


def test_classifier_keeps_what_it_scores(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [t or "" for _, t, *_ in stages[0]]
    joined, offs = "".join(texts).encode(), np.cumsum([0, *[len(t.encode()) for t in texts]])
    scores = model.score(*classifier.encode(np.frombuffer(joined, np.uint8), offs))
    assert sorted(stages[1]) == sorted(r for r, s in zip(stages[0], scores, strict=True) if s >= 0.7)


def test_rules_keep_what_passes(spark, stages):
    kept_rows = spark.createDataFrame(stages[1], "doc_id long, text string, lang string, source string, n_chars long")
    learned = rules.fit(kept_rows, spark.read.parquet(f"{SF}/labels.parquet"))
    want = []
    for r in stages[1]:
        n, chars, symbols, dups, repeats = brute_stats(r[1])
        text = r[1] or ""
        share = {"mean_word": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "repeat_share": repeats / max(n, 1), "dup_line_share": dups / (text.count("\n") + 1)}
        share |= {"upper_share": sum("A" <= c <= "Z" for c in text) / max(chars, 1), "mark_share": (text.count("!") + text.count("?")) / max(chars, 1)}
        values = [share[f] for f in rules.FEATURES]
        if not (n < 20 or 100 * repeats > 30 * n) and not any(rules._holds(rule, values) for rule in learned):
            want.append(r)
    assert sorted(stages[2]) == sorted(want)


def test_one_of_each_group_stays(stages):
    groups = {r[1] for r in brute_links(stages[2])}
    assert sorted(r[0] for r in stages[3]) == sorted(groups)


def test_mix_repeats_and_drops(stages):
    _, taken = brute_mix([(i, t, lang, s, None) for i, t, lang, s, _ in stages[3]])
    want = {k: v for k, v in taken.items() if v}
    got: dict = {}
    for i, t, _, s, _ in stages[4]:
        got[i, t, s] = got.get((i, t, s), 0) + len([w for w in t.replace("\n", " ").split(" ") if w])
    assert got == want


def test_pieces_of_what_is_left(stages):
    vocabulary = pieces.Pieces(pieces.read_model(pieces.MODEL), 4)
    last = stages[5].collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r[0] for r in stages[4]) and all(r["exact"] for r in last)
    size = {i: len(vocabulary.encode(t)[0]) // 4 for i, t, *_ in stages[4]}
    assert all(r["n_pieces"] == size[r["doc_id"]] for r in last)


def test_columns_of_any_name_stay(spark):
    """Further columns, named as the stages name their own, go through with their rows; null and repeated rows too."""
    names = ["score", "n_passages", "kept", "rule", "n_words", "row", "_text", "_words", "_stay", "_key", "_times", "_turn", "_i", "_s", "_h", "component"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0)], docs.schema)
    rows = docs.unionByName(docs.limit(5)).unionByName(odd)
    mark = lambda c: F.concat_ws(":", F.lit(c), F.coalesce("doc_id", F.lit(-1)))
    plain, more = rows, rows.select("*", *[mark(c).alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = kept(stage(spark, plain, SF)), kept(stage(spark, more, SF))
        assert plain.columns == COLUMNS and more.columns == COLUMNS + names and plain.count() > 0
        assert sorted(map(str, more.select(*COLUMNS).collect())) == sorted(map(str, plain.collect()))
        assert more.where(" or ".join(f"`{c}` is distinct from concat_ws(':', '{c}', coalesce(doc_id, -1))" for c in names)).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, more, SF).count() == more.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, SF))
        assert docs.columns == COLUMNS and docs.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).isEmpty()


def test_run_gives_the_last_stage(spark, stages):
    key = F.concat_ws(":", "doc_id", "n_pieces", "pieces_crc32")
    of = lambda df: sorted(r[0] for r in df.select(key).collect())
    assert of(corpus_pipeline.run(spark, SF)) == of(stages[5])
