import hashlib
import re
from collections import defaultdict

from wavemill.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, target string"


def brute(rows, seed="mix"):
    docs = [(i, t or "", s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s, _ in rows]
    sizes = defaultdict(int)
    for _, _, s, n in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:  # cap, reshare, repeat
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
    h = lambda i, t: hashlib.md5(f"{seed}:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
    line = []
    for s in order:
        at = 0
        own = sorted((h(i, t), i, t, n) for i, t, q, n in docs if q == s and n)
        for turn in range(3):
            for key, i, t, n in own:
                at += n
                line.append((at / target[s], order.index(s), at, n, i, t, s))
    taken, spent = defaultdict(int), 0
    for _, _, _, n, i, t, s in sorted(line, key=lambda x: x[:3]):
        spent += n
        if spent > total:
            break
        taken[i, t, s] += n
    return target, taken


def test_against_brute_force(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", f"s{i % 4}" if i % 11 else None, "x") for i in range(300)] + [(1000 + i, "tiny", "en", "zz", "") for i in range(2)] + [(2000, None, None, "empty", None), (None, " \n", None, None, None)]
    target, taken = brute(rows)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6
    own = {(i, s): taken[i, t or "", s] for i, t, _, s, _ in rows}
    assert {(r["doc_id"], r["source"]): r["taken"] for r in got} == own
    docs = mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA))
    assert docs.columns == ["doc_id", "text", "lang", "source", "target"]
    assert docs.count() == sum(r["times"] for r in got)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c", "en", "s", "")] * 6 + [(2, "d e", "en", "t", "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 7 and all(r["taken"] <= 3 * r["size"] for r in got) and sum(r["taken"] for r in got) <= 20
    assert mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA)).count() == sum(r["times"] for r in got)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "", "", "s", "")], SCHEMA)).first()["taken"] == 0
