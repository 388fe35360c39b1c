"""Recordings as chunks: what lies across a border reaches both sides by one grouping, and no row holds a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import partitions

CHANNEL = ("case", "file", "channel")


def shortest(chunks: DataFrame, keys: tuple[str, ...] = CHANNEL) -> int:
    """The length of the shortest chunk that another one follows; 0 if none does."""
    sizes = chunks.groupBy(*keys).agg(F.collect_list(F.struct("start_sample", F.size("samples").alias("n"))).alias("of"))  # a few numbers for each chunk
    followed = F.filter("of", lambda c: c["start_sample"] < F.array_max(F.transform("of", lambda o: o["start_sample"])))
    return sizes.agg(F.min(F.array_min(F.transform(followed, lambda c: c["n"])))).first()[0] or 0


def with_halo(chunks: DataFrame, before: int, after: int, least: int | None = None, keys: tuple[str, ...] = CHANNEL) -> DataFrame:
    """Each chunk (keys, chunk_idx, start_sample, samples) with the ``before`` samples that precede it and the ``after`` that follow.

    ``n_samples`` is the chunk's own length and ``lead`` how many samples of ``samples`` lie
    before it; fewer than asked for only at the ends of a recording. Each chunk sends its tail to the next one
    and its head to the one before; to more of them if the shortest chunk that another follows
    (``least``, found by a pass if not given) is shorter than what is asked for.
    Chunks of a channel must be numbered without gaps and follow each other without gaps.
    """
    wanted = max(before, after)
    if least is None and wanted:
        least = shortest(chunks, keys)
    reach = -(-wanted // least) if wanted and least else 0
    size = F.size("samples")
    own = F.struct(F.col("chunk_idx").alias("to"), F.lit(True).alias("own"), F.col("start_sample").cast("long").alias("at"), F.col("samples").alias("x"))
    from_ = F.greatest(F.lit(0), size - before)
    tail = lambda d: F.struct((F.col("chunk_idx") + d).alias("to"), F.lit(False).alias("own"), (F.col("start_sample") + from_).cast("long").alias("at"), F.slice("samples", from_ + 1, F.lit(before)).alias("x"))
    head = lambda d: F.struct((F.col("chunk_idx") - d).alias("to"), F.lit(False).alias("own"), F.col("start_sample").cast("long").alias("at"), F.slice("samples", F.lit(1), F.lit(after)).alias("x"))
    pieces = [own, *[tail(d) for d in range(1, reach + 1) if before], *[head(d) for d in range(1, reach + 1) if after]]
    sent = chunks.where("samples is not null").select(*keys, F.explode(F.array(*pieces)).alias("p")).withColumn("chunk_idx", F.col("p.to"))
    # what follows takes far more time than its bytes tell, so that tasks must not be merged by their size
    tasks = 2 * max(partitions(chunks.sparkSession), chunks.sparkSession.sparkContext.defaultParallelism)
    met = sent.repartition(tasks, *keys, "chunk_idx").groupBy(*keys, "chunk_idx").agg(
        F.max(F.when(F.col("p.own"), F.struct("p.at", F.size("p.x").alias("n")))).alias("me"),
        F.array_sort(F.collect_list(F.struct("p.at", "p.x"))).alias("of"),  # the chunk and at most ``reach`` pieces on each side
    ).where("me is not null")
    # a piece from farther away than the next chunk may lie outside of what was asked for
    near = F.filter("of", lambda p: (p["at"] + F.size(p["x"]) > F.col("me.at") - before) & (p["at"] < F.col("me.at") + F.col("me.n") + after))
    # pieces of several chunks follow each other, but for those that are longer than needed and shorter than their chunk
    met = met.withColumn("of", near)
    first, whole = F.col("of")[0]["at"], F.flatten(F.transform("of", lambda p: p["x"]))
    begin = F.greatest(F.col("me.at") - before, first)
    cut = F.slice(whole, (begin - first + 1).cast("int"), (F.col("me.at") - begin + F.col("me.n") + after).cast("int"))
    return met.select(*keys, "chunk_idx", F.col("me.at").alias("start_sample"), F.col("me.n").alias("n_samples"), (F.col("me.at") - begin).cast("int").alias("lead"), cut.alias("samples"))
