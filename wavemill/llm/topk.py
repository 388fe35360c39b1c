"""Exact top-k inner products by three-phase uniform threshold.

A score is a sum over slices of the dimensions. Each slice is a list of its own,
with rows and tasks of its own: the local scores of all vectors in these
dimensions. Local scores count from the list's lowest one for the query, so that
a missing one adds nothing or more.

Phase 1 gathers the k best entries of each list and block, and looks up what these
few have in the other lists; the k-th best of their scores is a safe cutoff.
Phase 2 gives the cutoff to all lists: whatever reaches it must have at least
``cutoff / slices`` in one of them, so the entries at or above that are collected,
and nothing else is a candidate. What an entry has in the lists that name it is a
lower bound of its score, and the bounds may raise the cutoff; a candidate lacks
less than ``cutoff / slices`` in each list that did not name it, and those that
cannot reach the raised cutoff go. Phase 3 looks up the missing local scores of the
rest and keeps the exact k best.

Equal vectors have equal scores for every query and ties go to the smaller id, so
of each vector only the ``k + 1`` rows with the smallest ids can be among the k
best (one may be the query's own); the others are not compared, however many.

Vectors are packed into blocks where they lie; each slice of a block of queries
meets that slice of each block of vectors once, so a task holds a slice of two blocks.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows with a null id; shorter vectors are padded with zeros; of
repeated rows each is a candidate and each is a query of its own, only a query's own
row is not its candidate; a query with fewer candidates gets them all; an empty
table gives no rows; scaled components beyond 2**31 are products of 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, kept

PACKED = "block long, n int, ids binary, rows binary, parts array<binary>"
#: Queries of a block that are compared at once.
AT_ONCE = 256
#: Blocks that queries are dealt into, where there are fewer than fill one.
LEAST_DEALS = 4
LEAST = -(2**62)


def _pack(rows_per_block: int, slices: int, dims: int):
    """Rows (vec_id, row, vector) to blocks: ids, and for each slice a matrix."""
    cuts = np.linspace(0, dims, slices + 1).astype(int)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            nonlocal made
            m = np.zeros((len(held), dims), np.int64)
            for i, (_, _, v) in enumerate(held):
                m[i, : len(v)] = v
            if np.abs(m).max(initial=0) < 2**31:
                m = m.astype(np.int32)
            parts = [np.ascontiguousarray(m[:, a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            ids, rows = (np.array([h[k] for h in held], np.int64).tobytes() for k in (0, 1))
            out = pd.DataFrame({"block": [(task << 32) + made], "n": [len(held)], "ids": [ids], "rows": [rows], "parts": [parts]})
            made += 1
            held.clear()
            return out

        for b in batches:
            for i, r, v in zip(b["vec_id"], b["row"], b["vector"], strict=True):
                held.append((int(i), int(r), np.asarray(v, np.int64)))
                if len(held) == rows_per_block:
                    yield block()
        if held:
            yield block()

    return run


def _matrix(part: bytes, n: int, width: int) -> np.ndarray:
    kind = np.int32 if len(part) == 4 * n * width else np.int64
    return np.frombuffer(part, kind).reshape(n, width)


def _longs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats while every sum is below 2**53."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _lists(widths: list[int], batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(row, first query, local scores, which are the query's own row) for at most ``AT_ONCE`` queries of each slice of two blocks."""
    for batch in batches:
        for r in batch.itertuples():
            width = widths[r.slice]
            q, c, rows, q_rows = _matrix(r.q_part, r.q_n, width), _matrix(r.part, r.n, width), _longs(r.rows), _longs(r.q_rows)
            for at in range(0, r.q_n, AT_ONCE):
                yield r, at, _dot(q[at : at + AT_ONCE], c), q_rows[at : at + AT_ONCE, None] == rows[None, :]


def _packed(q: np.ndarray, c: np.ndarray, local: np.ndarray) -> dict:
    return {"q": [q.astype(np.int32).tobytes()], "c": [c.astype(np.int32).tobytes()], "local": [local.tobytes()]}


_NAMED = "q_block long, block long, first int, slice int, q binary, c binary, local binary"


def _tops(k: int, widths: list[int]):
    """Phase 1: for each query and block the k best entries of a list, and the lowest local score there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, at, local, own in _lists(widths, batches):
            low = local.min(axis=1)
            local = np.where(own, LEAST, local)
            best = np.argpartition(local, r.n - min(k, r.n), axis=1)[:, -min(k, r.n) :]
            score = np.take_along_axis(local, best, axis=1)
            ok = score > LEAST
            yield pd.DataFrame({"q_block": r.q_block, "block": r.block, "first": at, "slice": r.slice} | _packed(np.nonzero(ok)[0], best[ok], score[ok]) | {"low": [low]})

    return run


def _look_up(k: int, slices: int, widths: list[int]):
    """The k best scores of each query among the entries that phase 1 names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q, c, _, _ = _sums(r.lists, slices, r.n)
                total = np.zeros(len(q), np.int64)
                for s in range(slices):
                    total += _products(r, s, widths[s], q, c)
                best = _firsts(q, (-total,), k)
                yield pd.DataFrame({"q_block": r.q_block, "q_at": r.first + q[best], "bound": total[best]})

    return run


def _products(r, s: int, width: int, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Local scores of single entries in one slice."""
    left, right = _matrix(r.q_parts[s], r.q_n, width)[r.first + q], _matrix(r.parts[s], r.n, width)[c]
    return (left.astype(np.int64) * right).sum(axis=1)


def _above(slices: int, widths: list[int]):
    """Phase 2: all entries of a list at or above the uniform threshold, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, at, local, own in _lists(widths, batches):
            bounds = _longs(r.bounds).reshape(r.q_n, slices + 2)[at : at + AT_ONCE]
            local -= bounds[:, 2 + r.slice, None]
            q, c = np.nonzero((local * slices >= bounds[:, :1]) & ~own)
            if len(q):
                yield pd.DataFrame({"q_block": r.q_block, "block": r.block, "first": at, "slice": r.slice} | _packed(q, c, local[q, c]))

    return run


def _sums(lists: list, slices: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries that some lists name: query, vector, sum of what is named, and which lists name them."""
    key = np.concatenate([np.frombuffer(x["q"], np.int32).astype(np.int64) * size + np.frombuffer(x["c"], np.int32) for x in lists])
    local = np.concatenate([_longs(x["local"]) for x in lists])
    of = np.repeat([x["slice"] for x in lists], [len(x["local"]) // 8 for x in lists])
    found, where = np.unique(key, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, local)
    named = np.zeros((len(found), slices), bool)
    named[where, of] = True
    return found // size, found % size, total, named


def _firsts(q: np.ndarray, order: tuple, k: int) -> np.ndarray:
    """Places of the first k of each query in an order (keys as for lexsort)."""
    at = np.lexsort((*order, q))
    begin = np.flatnonzero(np.diff(q[at], prepend=-1))
    rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    return at[rank < k]


def _raised(k: int, slices: int):
    """The k best lower bounds of each query among the entries of phase 2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q, _, total, _ = _sums(r.lists, slices, r.n)
                best = _firsts(q, (-total,), k)
                yield pd.DataFrame({"q_block": r.q_block, "q_at": r.first + q[best], "bound": total[best]})

    return run


def _resolve(k: int, slices: int, widths: list[int]):
    """Phase 3: missing local scores of the candidates that may reach the higher cutoff, and the exact k best of each query and block. A row without score tells how many entries were named and how many looked up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q, c, total, named = _sums(r.lists, slices, r.n)
                n_named = len(q)
                bounds = _longs(r.bounds).reshape(r.q_n, slices + 2)[r.first : r.first + AT_ONCE]
                most = -(-bounds[:, 0] // slices) - 1  # what a list that does not name an entry can add
                may = total + (~named).sum(axis=1) * np.maximum(most[q], 0) >= bounds[q, 1]
                q, c, total, named = q[may], c[may], total[may], named[may]
                for s in range(slices):
                    lacks = np.flatnonzero(~named[:, s])
                    total[lacks] += _products(r, s, widths[s], q[lacks], c[lacks]) - bounds[q[lacks], 2 + s]
                ids, rows = _longs(r.ids), _longs(r.rows)
                best = _firsts(q, (rows[c], ids[c], -total), k)
                q, c = q[best], c[best]
                score = total[best] + bounds[q, 2:].sum(axis=1)
                out = {"query_id": _longs(r.q_ids)[r.first + q], "query_row": _longs(r.q_rows)[r.first + q], "vec_id": ids[c], "row": rows[c], "score": score, "n_named": None, "n_looked_up": None}
                yield pd.DataFrame(out).astype({"n_named": "Int64", "n_looked_up": "Int64"})
                yield pd.DataFrame({"query_id": [0], "query_row": [0], "vec_id": [0], "row": [0], "score": [None], "n_named": [n_named], "n_looked_up": [int((~named).any(axis=1).sum())]}).astype({"score": "Int64"})

    return run


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, slices: int = 2, rows_per_block: int = 4096, queries_per_block: int = 2048, counts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) for the rows where ``is_query(id)`` holds.

    ``counts``, if given, gets the numbers of entries that phase 2 named and phase 3 looked up.
    """
    x = F.transform(vector_col, lambda v: v.cast("double"))
    whole = F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(whole, F.transform(x, lambda v: F.floor(v * scale).cast("long"))).alias("vector"))
    rows = kept(rows.where("vec_id is not null and vector is not null").withColumn("row", F.monotonically_increasing_id()))
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    widths = np.diff(np.linspace(0, dims, slices + 1).astype(int)).tolist()
    alike = Window.partitionBy("same").orderBy("vec_id", "row")
    cands = rows.withColumn("same", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary"), 256)).withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1)
    cands = kept(cands.select("vec_id", "row", "vector").mapInPandas(_pack(rows_per_block, slices, dims), PACKED))
    asked = rows.where(is_query(F.col("vec_id")))
    # dealt by row, so that rows of one id are spread as all others; few queries still make several tasks
    n_asked = asked.count()
    n_deals = max(-(-n_asked // queries_per_block), min(LEAST_DEALS, n_asked), 1)
    queries = asked.repartition(n_deals, F.pmod(F.xxhash64("row"), F.lit(n_deals))).select("vec_id", "row", "vector").mapInPandas(_pack(queries_per_block, slices, dims), PACKED)
    queries = kept(queries.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "n", "ids", "rows", "parts")]))
    # each block of vectors is sent to each block of queries: an equality join on the number of the query block
    numbered = kept(queries.select("q_block").withColumn("pair", F.row_number().over(Window.orderBy("q_block"))))  # a row per block
    n_blocks = numbered.count()

    def met(of_queries: DataFrame) -> DataFrame:
        """Each slice of each block of vectors beside that slice of each block of queries."""
        own = of_queries.select(*[c for c in of_queries.columns if c != "q_parts"], F.posexplode("q_parts").alias("slice", "q_part")).join(numbered, "q_block")
        lists = cands.select("block", "n", "rows", F.posexplode("parts").alias("slice", "part")).withColumn("pair", F.explode(F.sequence(F.lit(1), F.lit(max(n_blocks, 1)))))
        return lists.join(own, ["pair", "slice"]).repartition("block", "pair", "slice")

    group = ["q_block", "block", "first"]

    def named_by(rows: DataFrame) -> DataFrame:
        """The lists of each pair of blocks, and the number of vectors."""
        lists = rows.groupBy(*group).agg(F.collect_list(F.struct("slice", "q", "c", "local")).alias("lists"))  # at most one of each slice
        return lists.join(cands.select("block", "n"), "block")

    def beside_vectors(rows: DataFrame, of_queries: DataFrame) -> DataFrame:
        return rows.join(cands.drop("n"), "block").join(of_queries, "q_block").repartition(*group)

    query = ["q_block", "q_at"]
    kth = lambda bounds: bounds.withColumn("_r", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("bound")))).where(F.col("_r") == k).select(*query, "bound")
    first = kept(met(queries.drop("q_ids")).mapInPandas(_tops(k, widths), f"{_NAMED}, low array<long>"))
    lows = first.select("q_block", "first", "slice", F.posexplode("low").alias("at", "low")).groupBy("q_block", (F.col("first") + F.col("at")).alias("q_at"), "slice").agg(F.min("low").alias("low"))
    of_query = lows.groupBy(*query).agg(F.transform(F.array_sort(F.collect_list(F.struct("slice", "low"))), lambda v: v["low"]).alias("lows"), F.sum("low").alias("lowest"))
    looked_up = beside_vectors(named_by(first), queries).mapInPandas(_look_up(k, slices, widths), "q_block long, q_at int, bound long")
    cutoff = F.greatest(F.coalesce(F.col("bound") - F.col("lowest"), F.lit(0)), F.lit(0))
    told = kept(of_query.join(kth(looked_up), query, "left").select(*query, "lows", cutoff.alias("cutoff")))

    def bounded(higher: DataFrame) -> DataFrame:
        """Blocks of queries with their bounds: for each query the cutoff, the higher cutoff, and the lowest score of each list."""
        by_block = higher.groupBy("q_block").agg(F.collect_list(F.struct("q_at", "cutoff", "higher", "lows")).alias("told"))  # at most queries_per_block of them

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["bounds"] = [_bounds(n, slices, x) for n, x in zip(b["q_n"], b["told"], strict=True)]
                yield b.drop(columns=["told"])

        return queries.join(by_block, "q_block").mapInPandas(place, ", ".join(f"{n} {t}" for n, t in queries.dtypes) + ", bounds binary")

    once = kept(bounded(told.withColumn("higher", F.col("cutoff"))))
    named = kept(named_by(met(once.drop("q_ids")).mapInPandas(_above(slices, widths), _NAMED)))
    raised = kth(named.mapInPandas(_raised(k, slices), "q_block long, q_at int, bound long"))
    higher = told.join(raised, query, "left").withColumn("higher", F.greatest("cutoff", F.coalesce("bound", F.lit(0)))).drop("bound")
    found = beside_vectors(named, kept(bounded(higher))).mapInPandas(_resolve(k, slices, widths), "query_id long, query_row long, vec_id long, row long, score long, n_named long, n_looked_up long")
    if counts is not None:
        found = kept(found)
        counts["named"], counts["looked_up"] = (int(v or 0) for v in found.agg(F.sum("n_named"), F.sum("n_looked_up")).first())
    discard(rows, first)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.where("score is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(n: int, slices: int, told) -> bytes:
    out = np.zeros((n, slices + 2), np.int64)
    for b in told:
        out[b["q_at"], 0], out[b["q_at"], 1], out[b["q_at"], 2:] = b["cutoff"], b["higher"], b["lows"]
    return out.tobytes()
