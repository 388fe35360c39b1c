import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import pieces

SCHEMA = "doc_id long, text string, pieces string, score string"
MODEL = pieces.read_model(pieces.MODEL)
V = pieces.Pieces(MODEL, 4)


def every(text):
    """All segmentations of a short string: (score, ids)."""
    if not text:
        return [(0.0, ())]
    out = []
    for n in range(1, len(text) + 1):
        head = text[:n]
        if head in V.piece:
            own = (V.piece[head][0], (V.piece[head][1],))
        elif n == 1:
            raw = head.encode()
            own = (V.byte_score * len(raw), tuple(V.byte[b] for b in raw))
        else:
            continue
        out += [(own[0] + s, own[1] + ids) for s, ids in every(text[n:])]
    return out


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aetn .,\n▁é😀", min_size=1, max_size=9))
def test_n_best_of_whole_texts(text):
    blob, score, others, exact = V.encode(text)
    scores = sorted((s for s, _ in every(" " + text)), reverse=True)[:4]
    assert [score, *[o["score"] for o in others]] == scores and exact
    ids = np.frombuffer(blob, np.int32).tolist()
    assert V.decode(ids) == text
    for o in others:  # the changes make another segmentation of that score
        other = list(ids)
        for c in sorted(o["changes"], key=lambda c: -c["at"]):
            other[c["at"] : c["at"] + c["n"]] = c["ids"]
        assert V.decode(other) == text and other != ids


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_round_trip(text):
    blob, _, _, exact = V.encode(text)
    assert exact and V.decode(np.frombuffer(blob, np.int32)) == text


def test_no_piece_crosses_a_boundary():
    assert all(len(V.cut(p)) == 1 for p in V.piece)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_PARTS", 3)
    small = pieces.Pieces(MODEL, 4)
    text = "the quick brown fox jumps over the lazy dog and the quick cat. " * 3
    assert small.encode(text) == V.encode(text)


def test_table(spark):
    rows = [(1, "Hello wörld\n twice", "x", "y"), (1, "Hello wörld\n twice", "x", "y"), (None, None, None, None), (2, "", "x", "y"), (3, "a" * 30_000, "x", "y"), (4, "word " * 40_000, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    coded = pieces.encode(df)
    got = coded.collect()
    assert len(got) == len(rows) and all(r["exact"] for r in got) and all(len(bytes(r["pieces"])) == 4 * r["n_pieces"] for r in got)
    texts = sorted(r["text"] for r in pieces.decode(coded).collect())
    assert texts == sorted(t or "" for _, t, *_ in rows)
    assert len({zlib.crc32(bytes(r["pieces"])) for r in got if r["doc_id"] == 1}) == 1
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).count() == 0
