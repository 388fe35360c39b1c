import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.llm import rules

SCHEMA = "doc_id long, text string, junk string, rule string, kept string"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #|\né\t", max_size=120), st.lists(st.sampled_from(["a", "b", "c d e f g h i j", "k\n"]), max_size=30).map(" ".join)), min_size=1, max_size=40))
def test_statistics(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_long_texts_and_repeats(spark):
    texts = ["w " * 30_000, " ".join(f"w{i}" for i in range(30_000)), " ".join(f"w{i % 5000}" for i in range(5004)), "same line\nsame line\n\n \nother"]
    df = spark.createDataFrame([(1, t, "", "", "") for t in texts] + [(None, None, None, None, None)] * 2, SCHEMA)
    got = Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.judge(df, []).collect())
    assert got == Counter(brute(t) for t in [*texts, None, None])


def test_covering_finds_the_conjunction():
    rows = []
    for i in range(600):
        a, b, c = i % 10 / 10, i // 10 % 10 / 10, i * 37 % 100 / 100
        rows.append((a, b, c, int(a >= 0.7 and b <= 0.2)))
    found = rules.learn(rows, n_features=3)
    wrong = [r for r in rows if any(rules._holds(rule, r) for rule in found) != bool(r[-1])]
    assert found and not wrong
    assert rules.learn([(0.0, 1.0, 2.0, 0)] * 50, n_features=3) == [] and rules.learn([], n_features=3) == []


def test_few_junk_rows_at_the_end_of_a_feature():
    for n in range(990, 1012):
        rows = [(i / n, 0) for i in range(n)]
        for k in range(9):
            rows.insert(99 * k + 1 + k % 2, (2 + k / 10, 1))
        found = rules.learn(rows, n_features=1)
        assert all(any(rules._holds(rule, r) for rule in found) == bool(r[-1]) for r in rows)


def test_covering_goes_on_after_an_imprecise_rule_and_past_twelve():
    def made(seed):
        rng = random.Random(seed)
        value = lambda **at: tuple(at.get(f"f{i}", rng.random()) for i in range(16))
        rows = [(*value(), 0) for _ in range(3000)]
        rows += [(*value(f0=2 + rng.random()), int(i % 5 > 0)) for i in range(400)]  # a mixed kind: no rule is precise there
        rows += [(*value(**{f"f{k}": 2 + rng.random()}), 1) for k in range(1, 16) for _ in range(20)]
        rng.shuffle(rows)
        return rows

    found, held_out = rules.learn(made(1), n_features=16), made(2)
    caught = lambda r: any(rules._holds(rule, r) for rule in found)
    pure = [r for r in held_out if r[-1] and r[0] < 1]
    clean = [r for r in held_out if not r[-1] and r[0] < 1]
    assert sum(map(caught, pure)) >= 0.8 * len(pure) and sum(map(caught, clean)) <= 0.01 * len(clean)


def test_verdict_is_ordered(spark):
    df = spark.createDataFrame([(1, "### " * 40 + "plain words here", "", "", ""), (2, "plain words " * 20, "", "", ""), (3, "too few", "", "", "")], SCHEMA)
    by = {r["doc_id"]: r for r in rules.judge(df, [[(rules.FEATURES.index("symbol_share"), True, 0.5)], [(rules.FEATURES.index("symbol_share"), True, 0.1)]]).collect()}
    assert by[1]["rule"] == 1 and not by[1]["kept"] and by[2]["rule"] == 0 and by[3]["base_failed"] and not by[3]["kept"]


def test_labels_that_contradict_are_not_used(spark):
    df = spark.createDataFrame([(i, f"some text {i}", "", "", "") for i in range(8)], SCHEMA)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    assert {r["doc_id"] for r in rules.labelled(df.drop("junk"), labels, 5).collect()} <= {3}
    assert rules.fit(df, labels.limit(0)) == []


def test_rows_that_share_an_id_are_learned_once(spark, monkeypatch):
    df = spark.createDataFrame([(0, f"row {i} of one id " * (i % 7 + 1)) for i in range(300)] + [(i, f"text {'x' * i}") for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    monkeypatch.setattr(rules, "learn", lambda rows, **_: rows)
    used = {r["doc_id"] for r in rules.labelled(df.withColumn("junk_", df["doc_id"]), labels, 9).select("doc_id").distinct().collect()}
    got = rules.fit(df, labels, 9)
    assert 0 in used and len(got) == len(used) and rules.fit(df.repartition(5), labels, 9) == got


def test_held_out_junk_and_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    judged = rules.judge(docs, rules.fit(docs, labels)).join(labels, "doc_id").where(held_out).groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r["quality"], r["base_failed"], r["kept"]): r["count"] for r in judged}
    junk = sum(v for k, v in n.items() if k[0] == 0)
    assert junk >= 10 and n.get((0, False, True), 0) <= 0.1 * junk
    assert n.get((1, False, False), 0) <= 0.02 * n[1, False, True]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    rule = [[(rules.FEATURES.index("symbol_share"), True, 0.5)]]
    assert rules.judge(df, rule).count() == 0 and rules.judge(df, []).count() == 0
    assert rules.fit(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")) == []
