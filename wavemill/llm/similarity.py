"""N-gram Jaccard join by chosen paths.

A text is the set of its word shingles (five words, in lower case). Texts with
one and the same set are a class, of which one row stands for all. Every class
walks a tree: at a node, ``branching`` sampled coordinates split the sets by the
shingle that comes first under that coordinate's hash (a shared token, sampled
alike for all sets of the node), and a bucket of at most ``bucket`` sets is a
leaf. In a leaf all pairs are compared exactly.

Trees are grown in rounds of ``runs`` until the target ``recall``. It is
estimated from how many trees each link was found in: of links found in one tree
only (f1) and in two (f2), about f1 (f1 - 1) / (2 (f2 + 1)) links were found in
none. A round that adds no link is the last one. All trees draw from the same 32
coordinates, each at most once on a path, so they are not independent, and the
estimate is somewhat high: over the binomial number of coordinates in which a
pair of similarity 0.8 agrees, four trees with a branching of 2 miss it with an
expected probability of about 2.0e-5 at one level, 1.2e-4 at two, 4.5e-4 at four,
1.4e-3 at eight and 3.5e-3 at twelve (computed, with subtrees taken as independent
for a given number).

A node that its children do not thin out (most of its sets are alike) or that
stands at ``depth`` is compared as it is, cut into blocks: each pair of blocks is
a group of its own, so no task gets more than two blocks, and nothing is dropped.
Alike sets meet again in the leaves of other branches and trees: such leaves are
united, where one comparison of the union is less work than one of each, so that
a set is dealt to the blocks of the union once, not to those of every leaf.

A leaf first compares sizes and the first shingles under all 32 coordinates: two
sets of similarity 0.8 agree in fewer than ``agree`` = 13 with probability 4e-7.
Only classes that have a partner by this test fetch their whole sets.

Pairs never become rows. A leaf gives each of its classes the number of its
links, and one edge to the least class that it is linked with there, which is
all that the components need. A pair that meets in several leaves is counted in
the least of them, or in the least union that holds both.

Shingles are 64-bit hashes; sets are told apart by 128 bits, and compared by the
32 low bits of their shingles (two sets of 1000 share one by chance in 1 of 4000
cases, which moves the similarity by 0.001 at most).

Defined cases: a null text is an empty text; texts without words are one class
without links to others; a text of one to four words is one shingle; a null id
takes part, and a class whose ids are all null has class id null; repeated rows
are copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, fresh, kept
from .words import ALNUM, LOWER, mixed, shingles, texts_of, words_of

COORDINATES = 32
#: A node's number: its tree above, then its level, then a hash of its path.
_HASH, _LEVEL = 47, 4
_TREE = _HASH + _LEVEL


def _odd(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


_COORDINATE = _odd(COORDINATES, 0xA0761D6478BD642F)


def _fingerprints(k: int):
    """Per row: id, 128 bits of its shingle set, the first shingle under each coordinate, and the set's 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column, text_hash = b.column(0), b.column(1), b.column(2)
            for at, data, offsets in texts_of(column):
                n = len(offsets) - 1
                grams, offs = shingles(words_of(data, offsets, ALNUM, LOWER), k)
                sets = [np.unique(grams[a:z]) for a, z in zip(offs[:-1], offs[1:], strict=True)]
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if n else grams
                starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                some = sizes > 0
                bits = np.zeros((n, 2), np.uint64)
                first = np.zeros((n, COORDINATES), np.uint32)
                if some.any():
                    s = starts[some]
                    bits[some, 0] = np.add.reduceat(mixed(flat + np.uint64(1)), s)
                    bits[some, 1] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), s)
                    for c, odd in enumerate(_COORDINATE):
                        first[some, c] = (np.minimum.reduceat(flat * odd, s) >> np.uint64(32)).astype(np.uint32)
                bits[:, 0] += sizes.astype(np.uint64)
                low = flat.astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, n),
                        text_hash.slice(at, n),
                        pa.array([x.tobytes() for x in bits], pa.binary()),
                        pa.array(sizes, pa.int32()),
                        pa.array([x.tobytes() for x in first], pa.binary()),
                        pa.array([low[a : a + m].tobytes() for a, m in zip(starts, sizes, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "set_id", "n", "first", "members"],
                )

    return run


def _children(branching: int, level: int):
    """Rows (path, used, c, first) to rows of the next level: the sampled coordinates follow from the path alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            path = b["path"].to_numpy(np.int64).view(np.uint64)
            used = b["used"].to_numpy(np.int64)
            first = np.frombuffer(b"".join(b["first"]), np.uint32).reshape(len(b), COORDINATES)
            above = path >> np.uint64(_TREE) << np.uint64(_TREE) | np.uint64(level << _HASH)
            out = []
            for i in range(branching):
                used = used.copy()
                pick = (mixed(path + np.uint64(i + 1)) % np.uint64(COORDINATES)).astype(np.int64)
                for _ in range(COORDINATES):  # a coordinate splits once on a path, and siblings use different ones
                    taken = (used >> pick) & 1 == 1
                    if not taken.any():
                        break
                    pick = np.where(taken, (pick + 1) % COORDINATES, pick)
                used |= np.int64(1) << pick
                value = first[np.arange(len(b)), pick].astype(np.uint64)
                to = above | mixed(mixed(path * np.uint64(31) + pick.astype(np.uint64)) ^ value) >> np.uint64(64 - _HASH)
                out.append(pd.DataFrame({"parent": b["path"], "path": to.view(np.int64), "used": used, "c": b["c"]}))
            yield pd.concat(out, ignore_index=True)

    return run


def _intersections(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Shared members of the pairs marked in a square matrix: one by one if they are few, else by products of incidence matrices."""
    n = len(sets)
    out = np.zeros((n, n))
    flat = np.concatenate(sets)
    ids, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count > 1  # a shingle of one set is in no intersection
    i, j = np.nonzero(np.triu(pairs))
    if len(i) * 30e-6 < n * n * float(keep.sum()) * 1e-10 + 2e-3:
        for x, y in zip(i, j, strict=True):
            out[x, y] = out[y, x] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return out
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = keep[column]
    row, column = row[shared], (np.cumsum(keep) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for a in range(0, int(keep.sum()), width):
        i, j = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, width), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        out += part @ part.T
    return out


def _candidates(least: float, agree: int, g: dict, i: int, j: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Of the sets i to j, which make one leaf or one pair of its blocks: places of those with a partner by size and first shingles, and which of these are partners.

    A pair is left to the least leaf in which both of its sets are.
    """
    n, first, side = g["n"][i:j], g["first"][i:j], g["side"][i:j]
    # sets whose sizes differ by more than the threshold cannot be similar
    pairs = np.minimum(n[:, None], n[None, :]) >= least * np.maximum(n[:, None], n[None, :]) - 1e-9
    np.fill_diagonal(pairs, False)
    leaf, one, other = g["key"][i]
    if one != other:
        pairs &= side[:, None] != side[None, :]
    if not pairs.any():
        return None
    same = np.zeros(pairs.shape, np.int16)
    for c in range(COORDINATES):
        same += first[:, None, c] == first[None, :, c]
    pairs &= same >= agree
    some = np.flatnonzero(pairs.any(axis=1))
    if not len(some):
        return None
    pairs = pairs[np.ix_(some, some)]
    for own in _by_leaf(g["leaves"], i + some, lambda x: x < leaf).values():
        pairs[np.ix_(own, own)] = False
    left = np.flatnonzero(pairs.any(axis=1))
    return (i + some[left], pairs[np.ix_(left, left)]) if len(left) else None


def _by_leaf(leaves: list, places: np.ndarray, wanted: Callable[[int], bool]) -> dict[int, list[int]]:
    """For each wanted leaf with two or more of the sets at some places: which of them."""
    found: dict[int, list[int]] = {}
    for k, place in enumerate(places):
        for x in leaves[place]:
            if wanted(x):
                found.setdefault(int(x), []).append(k)
    return {x: own for x, own in found.items() if len(own) > 1}


def _trees_in_common(leaves: list, places: np.ndarray) -> np.ndarray:
    """In how many trees each pair of sets shares a leaf."""
    trees: dict[int, np.ndarray] = {}
    for x, own in _by_leaf(leaves, places, lambda x: x >= 0).items():  # no unions
        met = trees.setdefault(x >> _TREE, np.zeros((len(places), len(places)), bool))
        met[np.ix_(own, own)] = True
    return sum((m.astype(np.int16) for m in trees.values()), np.zeros((len(places), len(places)), np.int16))


def _groups(work: Callable[[dict, int, int], tuple | None], names: list[str]):
    """Rows sorted by (leaf, one, other, c) to what ``work`` finds in each group: places of some of its rows, then columns for them. Only the group at hand is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def done(b: pd.DataFrame) -> pd.DataFrame:
            key = b[["leaf", "one", "other"]].to_numpy(np.int64)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            g = {"key": key, "n": b["n"].to_numpy(np.int64), "side": b["side"].to_numpy(), "c": b["c"].to_numpy(np.int64), "copies": b["copies"].to_numpy(np.int64), "leaves": b["leaves"].tolist(), "members": b["members"].tolist() if "members" in b else None}
            g["first"] = np.frombuffer(b"".join(b["first"]), np.uint32).reshape(len(b), COORDINATES)
            out = [got for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True) if j - i > 1 and (got := work(g, i, j))]
            at = np.concatenate([o[0] for o in out]) if out else np.zeros(0, int)
            more = {name: np.concatenate([o[k] for o in out]) if out else [] for k, name in enumerate(names, start=1)}
            return pd.DataFrame({"leaf": key[at, 0], "one": key[at, 1], "other": key[at, 2], "side": g["side"][at], "c": g["c"][at]} | more)

        for b in batches:
            if not len(b):
                continue
            last = (b["leaf"] == b["leaf"].iloc[-1]) & (b["one"] == b["one"].iloc[-1]) & (b["other"] == b["other"].iloc[-1])
            if last.all() and rest and (rest[0][["leaf", "one", "other"]].iloc[0] == b[["leaf", "one", "other"]].iloc[0]).all():
                rest.append(b)
                continue
            whole = b[~last]
            if rest or len(whole):
                yield done(pd.concat([*rest, whole], ignore_index=True))
            rest = [b[last]]
        if rest:
            yield done(pd.concat(rest, ignore_index=True))

    return run


_PLACE = "leaf long, one int, other int, side int, c long"


def _near(least: float, agree: int):
    """The classes of each group that have a partner by size and first shingles."""

    def work(g: dict, i: int, j: int) -> tuple | None:
        got = _candidates(least, agree, g, i, j)
        return (got[0],) if got else None

    return _groups(work, [])


def _compare(least: float, agree: int):
    """The linked classes of each group: links to texts and to rows, links found in one tree and in two, and the least class of their component there."""

    def work(g: dict, i: int, j: int) -> tuple | None:
        got = _candidates(least, agree, g, i, j)
        if not got:
            return None
        some, pairs = got
        n = g["n"][some]
        both = _intersections([np.unique(np.frombuffer(g["members"][k], np.int32)) for k in some], pairs)
        link = pairs & (both * (1 + least) >= least * (n[:, None] + n[None, :]) - 1e-6)
        at = np.flatnonzero(link.any(axis=1))
        if not len(at):
            return None
        link = link[np.ix_(at, at)]
        root = np.arange(len(at))
        while True:
            lower = np.minimum(root, np.where(link, root[None, :], len(at)).min(axis=1))
            if (lower == root).all():
                break
            root = lower
        at = some[at]
        trees = _trees_in_common(g["leaves"], at)
        return at, link.sum(axis=1), link @ g["copies"][at], (link & (trees == 1)).sum(axis=1), (link & (trees == 2)).sum(axis=1), g["c"][at[root]]

    return _groups(work, ["texts", "docs", "once", "twice", "to"])


def _leaves(classes: DataFrame, trees: range, branching: int, bucket: int, depth: int, thin: float) -> DataFrame:
    """(leaf, size, c) of all leaves of some trees with at least two classes."""
    if depth >= 1 << _LEVEL:
        raise ValueError(f"depth must be below {1 << _LEVEL}")
    # "used" holds one bit for each coordinate of a path
    roots = classes.where("n > 0").select(F.explode(F.array(*[F.lit(r).cast("long") for r in trees])).alias("tree"), "c", "first")
    level = roots.select((F.shiftleft("tree", _TREE) + F.shiftrightunsigned(F.xxhash64(F.lit("root"), "tree"), 64 - _HASH)).alias("path"), F.lit(0).cast("long").alias("used"), "c", "first")
    sizes = None  # of the level's nodes
    found: list[DataFrame] = []
    spent: list[DataFrame] = []
    for d in range(1, depth + 1):
        below = kept(level.mapInPandas(_children(branching, d), "parent long, path long, used long, c long"))
        count = kept(below.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("parent").alias("parent")).where("size > 1"))
        spent += [below, count]
        done = F.col("size") <= bucket
        if d == depth:
            done = F.lit(True)
        elif sizes is not None:
            # a child as large as most of its parent: its sets are alike, and no split will thin them out
            count = kept(count.join(sizes, "parent").withColumn("alike", F.col("size") >= thin * F.col("parent_size")).drop("parent_size"))
            spent.append(count)
            done = done | F.col("alike")
        leaves = count.where(done).select("path", "size")
        found.append(below.select("path", "c").join(leaves, "path").select(F.col("path").alias("leaf"), "size", "c"))
        open_nodes = count.where(~done).select("path", F.col("size").alias("parent_size")) if d < depth else None
        if open_nodes is None or open_nodes.isEmpty():
            break
        level = below.join(open_nodes.select("path"), "path").select("path", "used", "c").join(classes.select("c", "first"), "c").select("path", "used", "c", "first")
        sizes = open_nodes.withColumnRenamed("path", "parent")
    out = kept(reduce(DataFrame.union, found).distinct())
    discard(*spent)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(c, root) of the ends of ``edges`` (a, b): the least id of each component.

    Rounds of large stars and small stars, each a grouping and a join; their
    number grows with the logarithm of the longest path. The minima are kept
    before they are joined, so both sides of a join are plain shuffles and
    Spark may split the many edges of one id.
    """
    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = kept(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        lower = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).where("a <> b")
        new = kept(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        discard(edges, least, large, lower)
        edges = new
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("c"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("c"), F.col("b").alias("root")).distinct())


def _found_share(links: int, once: int, twice: int) -> float:
    """The estimated share of links found, from the numbers of those found in any tree, in one and in two."""
    return links / (links + once * max(once - 1, 0) / (2 * (twice + 1))) if links else 1.0


def _unions(leaves: DataFrame, block: int) -> DataFrame:
    """(leaf, union, size) of leaves of more than a block that are compared as a union of several: all pairs of its leaves, and each once.

    A leaf joins that in which most of its sets are, if this joins no other. A set goes by the largest of its leaves. The number of a union is
    negative, below those of all leaves, and the union holds no more pairs than its leaves do.
    """
    big = leaves.where(F.col("size") > block)
    largest = F.max(F.struct("size", "leaf")).over(Window.partitionBy("c"))
    shares = big.withColumn("to", largest["leaf"]).groupBy("leaf", "size", "to").agg(F.count(F.lit(1)).alias("n"))
    joins = kept(shares.where("to <> leaf and 2 * n >= size").groupBy("leaf").agg(F.max_by("to", F.struct("n", "to")).alias("to")))
    joins = joins.join(joins.select(F.col("leaf").alias("to")), "to", "left_anti")
    of = kept(joins.select("leaf", "to").union(joins.select("to", "to").distinct()))
    held = big.join(of, "leaf").select("to", "c").distinct().groupBy("to").agg(F.count(F.lit(1)).alias("whole"))
    parts = big.select("leaf", "size").distinct().join(of, "leaf").groupBy("to").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    worth = held.join(parts, "to").where("whole * whole <= pairs")
    return kept(of.join(worth, "to").select("leaf", (-1 - F.col("to")).alias("union"), F.col("whole").alias("size")))


def _dealt(leaves: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, one, other, side, c): each block of a leaf, or of a union in its place, meets itself and every other one; and (c, leaves) with the unions among them."""
    unions = _unions(leaves, block)
    united = leaves.drop("size").join(unions, "leaf").select(F.col("union").alias("leaf"), "size", "c").distinct()
    own = leaves.union(united).groupBy("c").agg(F.collect_set("leaf").alias("leaves"))  # as many as a class has paths
    placed = leaves.join(unions, "leaf", "left_anti").union(united)
    placed = placed.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("of", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    placed = placed.select("leaf", "c", "of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    return placed.select("leaf", F.least("of", "with").alias("one"), F.greatest("of", "with").alias("other"), F.col("of").alias("side"), "c"), own


def _linked(prints: DataFrame, classes: DataFrame, least: float, recall: float, runs: int, branching: int, bucket: int, depth: int, thin: float, block: int, agree: int) -> DataFrame:
    """(c, texts, docs, to) from leaves: trees are added until the share of links found reaches ``recall``, or they add none."""
    leaves, links_before, trees = None, -1, 0
    while True:
        more = _leaves(classes, range(trees, trees + runs), branching, bucket, depth, thin)
        trees += runs
        leaves = more if leaves is None else kept(leaves.union(more))
        placed, own = _dealt(leaves, block)
        payload = kept(classes.select("c", "n", "first", "copies").join(own, "c"))
        dealt = lambda rows: rows.repartition("leaf", "one", "other").sortWithinPartitions("leaf", "one", "other", "c")
        near = kept(dealt(placed.join(payload, "c")).mapInPandas(_near(least, agree), _PLACE))
        whole = near.join(payload, "c").join(prints.select(F.col("row").alias("c"), "members"), "c")
        met = kept(dealt(whole).mapInPandas(_compare(least, agree), f"{_PLACE}, texts long, docs long, once long, twice long, to long").drop("leaf", "one", "other", "side"))
        discard(payload, near)
        links, once, twice = (int(x or 0) // 2 for x in met.agg(F.sum("texts"), F.sum("once"), F.sum("twice")).first())  # both ends count a link
        if links == links_before or _found_share(links, once, twice) >= recall:
            discard(leaves)
            return met
        links_before = links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, k: int = 5, recall: float = 0.999, runs: int = 4, branching: int = 2, bucket: int = 256, depth: int = 12, thin: float = 0.5, block: int = 512, agree: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least id of its component), copy_id (the least id among texts with its set), n_copies, n_text_links (other sets), n_links (other rows, copies too), text_hash, component."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("text_hash"))
    kind = dict(rows.dtypes)["doc_id"]
    prints = rows.mapInArrow(_fingerprints(k), f"doc_id {kind}, text_hash string, set_id binary, n int, first binary, members binary")
    prints = kept(prints.withColumn("row", F.monotonically_increasing_id()))
    # a class goes by one of its rows
    classes = kept(prints.groupBy("set_id").agg(F.min("row").alias("c"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("first").alias("first")))
    met = _linked(prints, classes, least, recall, runs, branching, bucket, depth, thin, block, agree)
    links = met.groupBy("c").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(met.select(F.col("c").alias("a"), F.col("to").alias("b")))
    known = kept(classes.select("set_id", "c", "copy_id", "copies").join(links.join(roots, "c"), "c", "left").withColumn("component", F.coalesce("root", "c")))
    discard(classes, met)
    named = kept(known.where("root is not null").groupBy("component").agg(F.min("copy_id").alias("class_id")))
    known = kept(known.join(named, "component", "left"))
    known = known.select("set_id", "component", "copy_id", "copies", "texts", "docs", F.when(F.col("root").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"))
    return prints.select("doc_id", "text_hash", "set_id").join(known, "set_id").select(
        "doc_id",
        "class_id",
        "copy_id",
        F.col("copies").alias("n_copies"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).cast("long").alias("n_links"),
        "text_hash",
        "component",
    )


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with the columns of ``docs`` (of any names): that of the least id, ties to the least hash of the text, null ids last."""
    name = fresh("_stay", docs.columns)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")

    def key(doc_id, text_hash):
        return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text_hash).cast("binary"))

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stay = join(docs, **options).groupBy("component").agg(F.min(order).alias("r")).select(key(F.col("r.doc_id"), F.col("r.text_hash")).alias(name))
    rows = docs.withColumn(name, key(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    return rows.join(stay, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
