"""Shards by vector bin packing over bytes, tokens and rows.

Each group (equal texts) is a vector of its share of all bytes, tokens and
rows. Groups are placed from the largest down; a group goes to the shard whose
residual capacity has the highest dot product with that vector, among the shards
with room for it in all three, else in bytes, else with most room in bytes.

One task cannot place billions of groups one by one, so what is placed is
bounded: groups that fill at least ``1 / fine`` of a shard in some dimension are
placed one by one (there are at most ``3 * fine * shards`` of them), all smaller ones in ``bundles`` hash bundles of each direction: a group's direction is whether its texts
are short or long, and sparse or rich in tokens, beside the mean (four steps each), so
that bundles differ and the dot product still has a choice. Only a group with more bytes than a whole shard
(there are fewer of them than shards) is split, as sizes could not be even with it:
its rows are dealt in ``salts`` pieces by a hash of their places in the table, so
that rows equal in every column are split too. Everything else is hashing,
grouping and two joins with those bounded tables.

Defined cases: a null text counts as an empty text (size 1, in one group with
empty texts); null ids are ids like others; repeated rows are rows of one
group; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, kept, running

DIMS = ("size", "tokens", "rows")


def place(items: list[tuple], shards: int) -> list[int]:
    """Shard of each item (bytes, tokens, rows); bytes count double, as they are the law."""
    if not items:
        return []
    demand = np.array(items, float)
    demand = demand / np.maximum(demand.sum(axis=0), 1) * np.array([2.0, 1.0, 1.0])
    residual = np.tile(demand.sum(axis=0) / shards, (shards, 1))
    out = [0] * len(items)
    for i in np.lexsort((np.arange(len(items)), -demand.max(axis=1))):
        d = demand[i]
        fits = (residual >= d - 1e-12).all(axis=1)
        if not fits.any():  # bytes are the law
            fits = residual[:, 0] >= d[0] - 1e-12
        if not fits.any():
            fits = residual[:, 0] >= residual[:, 0].max()
        j = int(np.argmax(np.where(fits, residual @ d, -np.inf)))
        residual[j] -= d
        out[i] = j
    return out


def _direction(total: dict) -> Column:
    """Which of 16 directions (bytes : tokens : rows) the texts of a group of ``size`` and ``tokens`` a row have; ``total`` has the sums."""
    step = lambda have, mean: F.when(have < mean / 2, 0).when(have < mean, 1).when(have < 2 * mean, 2).otherwise(3)
    length = step(F.col("size") / F.col("rows"), F.lit(total["size"] / max(total["rows"], 1)))
    return 4 * length + step(F.col("tokens") / F.col("size"), F.lit(total["tokens"] / max(total["size"], 1)))


def pack(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bundles: int = 4096, fine: int = 128, salts: int = 256) -> DataFrame:
    """id_col, size, tokens, text_crc32, shard, slot; slots are gapless from 0 within each shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group"),
    )
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens")]
    groups = kept(rows.groupBy("group").agg(*sums, F.count(F.lit(1)).alias("rows")))
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMS]).first()
    too_large = F.col("size") * shards > total["size"]
    bundle = (_direction(total.asDict()) * bundles + F.pmod(F.xxhash64("group"), F.lit(bundles))).cast("int")
    fills = F.greatest(*[F.col(d) / F.lit(float(max(total[d], 1))) for d in DIMS]) * shards

    split = [r[0] for r in groups.where(too_large).select("group").collect()]  # fewer than shards
    pieces = rows.where(F.col("group").isin(split)) if split else rows.limit(0)
    pieces = pieces.groupBy("group", salt.alias("salt")).agg(*sums, F.count(F.lit(1)).alias("rows"))
    whole = groups.where((fills >= 1 / fine) & ~too_large).withColumn("salt", F.lit(-1))
    small = groups.where(fills < 1 / fine).groupBy(bundle.alias("salt")).agg(*sums, F.sum("rows").alias("rows")).withColumn("group", F.lit(None).cast("string"))
    names = ["group", "salt", *DIMS]
    items = sorted(pieces.select(names).union(whole.select(names)).union(small.select(names)).collect(), key=lambda r: (r["group"] or "", r["salt"]))
    where = place([(r["size"], r["tokens"], r["rows"]) for r in items], shards)
    spark = docs.sparkSession
    table = spark.createDataFrame([(r["group"], r["salt"], j) for r, j in zip(items, where, strict=True)], "g string, s int, to int")
    by_group = table.where("g is not null")
    by_bundle = table.where("g is null").select(F.col("s").alias("bundle"), F.col("to").alias("to_bundle"))
    placed = (
        rows.withColumn("rows", F.lit(1)).withColumns({"bundle": bundle, "salt": salt})
        .join(F.broadcast(by_group), (F.col("group") == F.col("g")) & ((F.col("s") == -1) | (F.col("s") == F.col("salt"))), "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .select("doc_id", "size", "tokens", "text_crc32", F.coalesce("to", "to_bundle").alias("shard"))
    )
    out = running(placed, ["shard"], ["doc_id", "text_crc32", "size"], {}, "slot")
    discard(rows, groups)
    return out
