import re

from wavemill.llm import licenses

SCHEMA = "doc_id long, text string, label string, words string"


def words(text):
    return re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w, starts, labels = words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License.",
    "x Under the MIT-license, under\nthe mit license and CC BY-NC 4.0. Apache License, Version 2.0",
    "under the mit license",  # a letter-like byte class: no break at the no-break space
    "Under The MİT license, Kind",
    "mit license under the",
    "This work is licensed under the GNU General Public License, version 3.",
    "permission is hereby granted without any charge to any person obtaining a copy of this nice software and associated documentation files the software to deal in the software with restriction",
    "All rights reserved.",
    "",
    None,
    "cc by nc " * 3000,
    "a b",
]


def test_base_against_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", "y"), (None, TEXTS[0], None, None)]
    got = licenses.summary(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], key=str) == sorted([(i, *base(t)) for i, t, *_ in rows], key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["labels"] == "gpl-3" and by[5]["score"] == 1.0 and by[5]["n_base"] == 0
    assert "mit" in by[6]["labels"] and 0.6 <= by[6]["score"] < 1
    assert by[7]["labels"] == "all-rights-reserved" and by[8]["score"] == 0.0 and by[8]["labels"] == ""
    assert set(by[1]["base_labels"].split(",")) <= set(by[1]["labels"].split(","))
    assert licenses.summary(spark.createDataFrame([], SCHEMA)).count() == 0
