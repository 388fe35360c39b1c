import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from wavemill.llm import similarity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return [(r[0], min(least[root(i)], default=None), links[i]) for i, r in enumerate(rows)]


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    common = " ".join(rng.choice(words) for _ in range(30))
    for i in range(150):  # near copies of one text: a dense bucket
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2))):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, common + " " + " ".join(rng.choice(words) for _ in range(60))) for i in range(80)]
    rows += [(300 + i, "Exact, copy of a short text here!") for i in range(20)] + [(330, "exact copy of a short text HERE")]
    rows += [(340, "two words"), (341, "Two words."), (342, None), (343, ""), (344, "..."), (None, "two words"), (None, "alone with no id at all here"), (340, "two words"), (350, "long " * 20_000)]
    return [(i, t, "en", "s", 1) for i, t in rows]


def test_links_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute(rows), key=str)
    got = similarity.join(df).collect()
    assert sorted([(r["doc_id"], r["class_id"], r["n_links"]) for r in got], key=str) == want
    # small buckets and blocks: the same links by more splits, block pairs and deeper leaves
    deep = similarity.join(df, bucket=8, block=16, depth=4, runs=6).collect()
    assert sorted([(r["doc_id"], r["class_id"], r["n_links"]) for r in deep], key=str) == want
    stay = similarity.one_per_class(df)
    assert stay.columns == df.columns and stay.count() == len({r["component"] for r in got})


def test_alike_leaves_of_branches_and_trees_are_dealt_once(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    near = [" ".join(f"x{i}y{rng.random()}" if rng.random() < 0.02 else w for w in base) for i in range(120)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(near)] + [(1000 + i, f"{i} " + " ".join(rng.choice(base) for _ in range(40)), "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    prints = similarity.kept(df.select("doc_id", "text", F.lit("").alias("text_hash")).mapInArrow(similarity._fingerprints(5), "doc_id long, text_hash string, set_id binary, n int, first binary, members binary"))
    leaves = similarity.kept(similarity._leaves(prints.select(F.col("doc_id").alias("c"), "n", "first"), range(4), 2, 8, 4, 0.5))
    placed, own = similarity._dealt(leaves, 16)
    of, groups, together = defaultdict(set), defaultdict(set), set()
    for r in leaves.collect():
        of[r["leaf"]].add(r["c"])
    for r in placed.collect():
        groups[r["leaf"], r["one"], r["other"]].add((r["side"], r["c"]))
    for (_, one, other), held in groups.items():
        together |= {(x, y) for i, x in held for j, y in held if x < y and (one == other or i != j)}
    assert together >= {(x, y) for held in of.values() for x in held for y in held if x < y}  # every pair that shares a leaf
    blocks = [len(h) for h in of.values() if len(h) > 16]
    assert len(blocks) >= 8 and sum(len(h) for h in groups.values()) < sum(len(h) * -(-len(h) // 16) for h in of.values()) / 3
    assert all(len({x for x in r["leaves"] if x < 0}) <= 2 for r in own.collect())
    want = sorted(brute(rows), key=str)
    assert sorted([(r["doc_id"], r["class_id"], r["n_links"]) for r in similarity.join(df, bucket=8, block=16, depth=4).collect()], key=str) == want


def test_pairs_at_exactly_the_threshold(spark):
    pairs = []
    for n, m in ((396, 44), (117, 13), (9, 1), (1035, 115)):  # m of n shingles differ: n - m shared, 0.8 of the union
        words = [f"t{n}w{i}" for i in range(n + 4)]
        pairs += [words, words[:-m] + [f"other{i}" for i in range(m)], words[: -m - 1] + [f"third{i}" for i in range(m + 1)]]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(pairs)]
    got = {r["doc_id"]: r["n_links"] for r in similarity.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: k for r, (_, _, k) in zip(rows, brute(rows), strict=True)} and [got[i] for i in (0, 3, 6, 9)] == [1] * 4


def test_empty(spark):
    assert similarity.join(spark.createDataFrame([], SCHEMA)).count() == 0
    assert similarity.one_per_class(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trees_are_added_until_links_are_found(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    grown = []
    leaves = similarity._leaves
    monkeypatch.setattr(similarity, "_leaves", lambda c, trees, *a: grown.append(trees) or leaves(c, trees, *a))
    got = similarity.join(df, runs=1, branching=1).collect()
    assert sorted([(r["doc_id"], r["class_id"], r["n_links"]) for r in got], key=str) == sorted(brute(rows), key=str)
    assert len(grown) > 1 and [t for r in grown for t in r] == list(range(len(grown)))


def test_share_of_links_found():
    assert similarity._found_share(0, 0, 0) == 1 and similarity._found_share(100, 0, 0) == 1 and similarity._found_share(100, 10, 0) == 100 / 145
    assert similarity._found_share(1000, 10, 44) == 1000 / 1001


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(1000, 1001)] + [(2000, i) for i in range(2001, 2300)], "a long, b long")
    got = {r["c"]: r["root"] for r in similarity.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[1001] == 1000 and {got[i] for i in range(2000, 2300)} == {2000} and len(got) == 343
