import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm.words import ALNUM, LOWER, NON_SPACE, shingles, texts_of, words_of

KINDS = ((NON_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\n\té中.,-9", max_size=40)), max_size=8), st.integers(1, 64))
def test_words_and_shingles(texts, most):
    for kind, pattern in KINDS:
        want = [re.findall(pattern, lower(t)) for t in texts]
        got, sets = [], []
        for _, data, offsets in texts_of(pa.array(texts, pa.string()), most):
            w = words_of(data, offsets, kind, LOWER)
            spans = [lower(bytes(data[a:b]).decode()) for a, b in zip(w.start, w.end, strict=True)]
            got += [spans[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            h, offs = shingles(w, 3)
            sets += [set(h[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        assert got == want
        grams = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in want]
        assert [len(s) for s in sets] == [len(g) for g in grams]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(sets[i] & sets[j]) == len(grams[i] & grams[j])


def test_one_very_long_word():
    text = "x" * 200_000
    for _, data, offsets in texts_of(pa.array([text, "x"])):
        w = words_of(data, offsets, NON_SPACE, LOWER)
        assert len(set(w.hash.tolist())) == len(w.start) and np.isfinite(w.hash.astype(float)).all()
