"""Quality rules as a learned decision list, in built-in functions only.

Statistics of whole texts are array and string expressions. Sequential covering
learns the list from labelled statistics: a rule grows by the threshold with the
highest FOIL gain among all distinct values, is pruned on other rows, and stays if
it is precise enough; what it covers is removed, and the next rule grows on the
rest. A rule that is not precise enough only sets its rows aside: covering goes on
until no rule qualifies. The list becomes one ordered ``when`` chain.

Fitting uses at most ``sample`` labelled documents of either class (a parameter), one
row of each: of rows that share a doc_id, the one whose statistics have the least
hash. The statistics and the verdict cover every row.

Defined cases: a null text is an empty text; labels that are null, or that a
document has in both values, are not used; without labels of both classes the
list is empty and keeps everything; repeated rows get equal results; a kept column
that is named like a result gives way to it, other columns of the input clash with nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, yielding

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8

#: The columns of ``statistics``.
COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_breaks")

#: Statistics that rules may test, as shares where a count would follow the length.
FEATURES = ("mean_word", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the body uses it in a loop."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which the text holds at least twice."""

    def covered(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
        return _let(hashes, lambda h: _let(windows(h), lambda win: _let(F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(win) + F.lit(1.0))).cast("int")) - 1, lambda mask: total(win, mask))))

    def total(win: Column, mask: Column) -> Column:
        # hash and place in one long: sorting brings equal windows together
        keys = F.sort_array(F.transform(win, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

        def twin(k: Column, x: Column, j: Column) -> Column:
            y = F.coalesce(F.get(k, j), F.bitwise_not(x))
            near = x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(mask)) == 0
            return near & (F.get(win, x.bitwiseAND(mask).cast("int")) == F.get(win, y.bitwiseAND(mask).cast("int")))

        def places(k: Column) -> Column:
            # a window without a twin counts as place -1
            marked = F.transform(k, lambda x, j: F.when(twin(k, x, j + 1) | twin(k, x, j - 1), x.bitwiseAND(mask)).otherwise(F.lit(-1).cast("long")))
            return F.sort_array(F.filter(marked, lambda p: p >= 0))

        first = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW).cast("long"), p - acc["last"])).alias("n"))
        return F.aggregate(_let(keys, places), first, add, lambda acc: acc["n"])

    return F.when(F.size(words) > WINDOW, covered(words)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_breaks, and the columns in ``keep``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = yielding(keep, COUNTS)
    whole, words = fresh("_text", keep), fresh("_words", keep)
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias(whole), F.array_remove(F.split(text, SPACE + "+"), "").alias(words))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id",
        *keep,
        F.size(words).cast("long").alias("n_words"),
        (F.length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col(words)).alias("n_repeat_words"),
        F.regexp_count(whole, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(whole, F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(whole, F.lit("\n")).cast("long").alias("n_breaks"),
    )


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / (F.col("n_breaks") + 1),
        "upper_share": F.col("n_upper") / chars,
        "mark_share": F.col("n_marks") / chars,
    }


def _holds(rule: list[tuple], row: tuple) -> bool:
    return all(row[f] >= t if up else row[f] <= t for f, up, t in rule)


def _covered(rule: list[tuple], x: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` the rule holds for."""
    out = np.ones(len(x), bool)
    for f, up, t in rule:
        out &= x[:, f] >= t if up else x[:, f] <= t
    return out


def _best_condition(x: np.ndarray, junk: np.ndarray) -> tuple | None:
    """The (feature, up, threshold) with the highest FOIL gain: every distinct value of every feature is tried, in both directions."""
    n, p0 = len(junk), int(junk.sum())
    base = np.log2(p0 / n)
    best = (1e-9, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values = x[order, f]
        upto = np.concatenate([[0], np.cumsum(junk[order])])
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        end = np.append(first[1:], n)
        for up, p, m in ((True, p0 - upto[first], n - first), (False, upto[end], end)):
            gain = np.where((p > 0) & (m < n), p * (np.log2(np.maximum(p, 1) / m) - base), 0.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, up, float(values[first[k]])))
    return best[1]


def learn(rows: list[tuple], n_features: int = len(FEATURES), precision: float = 0.95, most_rules: int | None = None, most_conditions: int = 4, least: int = 3) -> list[list[tuple]]:
    """Rules for junk from rows of (values..., is junk): every third row prunes, the others grow. A rule has at most ``most_conditions`` conditions.

    ``least`` is the number of junk rows that a rule must cover, ``precision`` the share of junk among all that it covers, after pruning.
    Where no part of a grown rule is that precise, the rows it covers are set aside and covering goes on with the rest; rows set aside
    come back as long as rules are found. It ends when no rule qualifies (or at ``most_rules``, if given).
    """
    out: list[list[tuple]] = []
    if not rows:
        return out
    x, junk = np.array([r[:n_features] for r in rows], float), np.array([r[-1] for r in rows]).astype(int)
    left = np.arange(len(rows))
    aside = np.zeros(len(rows), bool)
    found = False  # whether a rule was found since rows came back
    while most_rules is None or len(out) < most_rules:
        pool = left[~aside[left]]
        grow, prune = pool[np.arange(len(pool)) % 3 > 0], pool[::3]
        rule: list[tuple] = []
        inside = grow
        while len(rule) < most_conditions and 0 < junk[inside].sum() < len(inside):
            if not (c := _best_condition(x[inside], junk[inside])):
                break
            rule.append(c)
            inside = inside[_covered([c], x[inside])]
        if not rule:
            if not found:
                break
            aside[:] = False
            found = False
            continue

        def worth(k: int, rule=rule, prune=prune) -> tuple:
            hit = junk[prune[_covered(rule[:k], x[prune])]]
            return ((2 * hit.sum() - len(hit)) / max(len(hit), 1), k)

        def qualifies(k: int, rule=rule, left=left) -> bool:
            hit = junk[left[_covered(rule[:k], x[left])]]
            return hit.sum() >= least and hit.sum() >= precision * len(hit)

        fit = [k for k in range(1, len(rule) + 1) if qualifies(k)]
        if not fit:
            aside[pool[_covered(rule, x[pool])]] = True
            continue
        out.append(rule[: max(map(worth, fit))[1]])
        left = left[~_covered(out[-1], x[left])]
        found = True
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """The labelled rows of ``docs`` with a column junk: at most ``sample`` documents of either class, in a fixed pseudo-random order."""
    clean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high and low in (0, 1)")
    clean = clean.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    clean = clean.select(F.col("doc_id").alias("_l"), (1 - F.col("low")).cast("int").alias("junk"))
    take = lambda j: clean.where(F.col("junk") == j).orderBy(F.xxhash64("_l"), "_l").limit(sample)
    return docs.join(F.broadcast(take(0).union(take(1))), F.col("doc_id") == F.col("_l")).drop("_l")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, **options) -> list[list[tuple]]:
    """A decision list for ``docs`` (doc_id, text) from ``labels`` (doc_id, quality)."""
    stats = statistics(labelled(docs.select("doc_id", "text"), labels, sample), keep=("junk",))
    values = stats.select("doc_id", "junk", *[c.alias(f"_{n}") for n, c in features().items()])
    order = [F.xxhash64(*[F.col(f"_{n}") for n in FEATURES]).alias("_hash"), *[F.col(f"_{n}") for n in FEATURES]]
    found = values.groupBy("doc_id").agg(F.min(F.struct(*order, "junk")).alias("_row")).select("_row.*").orderBy("_hash", *[f"_{n}" for n in FEATURES], "junk").drop("_hash")
    return learn([tuple(r) for r in found.collect()], **options)


def verdict(rules: list[list[tuple]]) -> tuple[Column, Column]:
    """The list as one ordered conditional: the number of the rule that rejects (0: none), and kept."""
    by = features()
    chain = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for f, up, t in rule:
            test = test & ((by[FEATURES[f]] >= t) if up else (by[FEATURES[f]] <= t))
        chain = F.when(test, i + 1) if chain is None else chain.when(test, i + 1)
    number = F.lit(0) if chain is None else chain.otherwise(0)
    return number, number == 0


def judge(docs: DataFrame, rules: list[list[tuple]], keep: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of every row with base_failed, rule (the number of the rejecting rule, 0 if none) and kept."""
    number, passes = verdict(rules)
    stats = statistics(docs, keep=yielding(keep, ("base_failed", "rule", "kept")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "rule": number.cast("int"), "kept": ~failed & passes})
