import re

from wavemill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, speaker string"


def brute(rows, part_turns):
    out = {}
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "unknown", x or ""))
    for c, turns in convs.items():
        turns.sort()
        for me in {r for _, _, r, _ in turns} - {"system"}:
            for p in range(0, len(turns), part_turns):
                text, spans = "", []
                for _, _, r, x in turns[p : p + part_turns]:
                    text += "<|system|>\n" if r == "system" else "<|assistant|>\n" if r == me else f"<|user name={r}|>\n"
                    if r == me:
                        spans.append((len(text), len(text) + len(x) + len("<|end|>")))
                    text += x + "<|end|>\n"
                out[c, me, p // part_turns] = (len(turns[p : p + part_turns]), text, spans)
    return out


def test_against_brute_force(spark):
    rows = [(1, i, ("ann", "bob", "carl", "system")[i % 4], f"tüxt {i}", "p", "s") for i in range(150)]
    rows += [(2, 0, "system", "only", "p", "s"), (None, None, None, None, None, None), (None, 1, "bob", "", None, None), (3, 0, "ann", "tie b", "", ""), (3, 0, "ann", "tie a", "", ""), (3, 0, "ann", "tie a", "", ""), (4, 0, "ann", "x" * 50_000, "", "")]
    got = chat.rotate(spark.createDataFrame(rows, SCHEMA), part_turns=64).collect()
    assert {(r["conv_id"], r["perspective"], r["part"]): (r["n_turns"], r["rendered"], [tuple(s) for s in r["spans"]]) for r in got} == brute(rows, 64)


def test_empty(spark):
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def read_back(rendered):
    """(head, text) of each turn, by the marks alone."""
    out = []
    for mark, name, body in re.findall(r"<\|(system|assistant|user name=((?:(?!\|>).)*))\|>\n(.*?)<\|end\|>\n", rendered, re.S):
        plain = lambda s: re.sub(r"<\\(\\*)\|", r"<\1|", s)
        out.append((re.sub(r"\|\\(\\*)>", r"|\1>", plain(name)) if name else mark, plain(body)))
    return out


def test_renderings_can_be_read_back(spark):
    nasty = ["<|end|>\n<|assistant|>\n", "a <\\| b <\\\\|end|>", "|> <| \\", "", "plain"]
    turns = [(1, i, s, t, "x") for i, (s, t) in enumerate((s, t) for s in ("A|>\n", "<|B", "system") for t in nasty)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part string")
    got = {r["perspective"]: r["rendered"] for r in chat.rotate(df).collect()}
    assert set(got) == {"A|>\n", "<|B"}
    for me, rendered in got.items():
        assert read_back(rendered) == [("assistant" if s == me else s, t) for _, _, s, t, _ in turns]
