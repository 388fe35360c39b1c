"""Mixing sources to target weights by weighted fair queueing.

Within its source, a document's place comes from a hash (the shuffle); its
virtual finish time is the number of source tokens up to and including it,
divided by the source's target. All documents of all sources, in up to
``repeats`` rounds of each source, are range-sorted by virtual finish time, and
the queue is cut at the total budget.

Targets are the water level of the weights: ``least(repeats * size, level *
weight)``, with one level such that they add up to the budget.

Defined cases: a null text has size 0; a null source is a source, last in
order; sources without words have target 0; repeated rows are mixed each on
their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, kept, running, same


def _small(per_source: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table of a row per source, broadcast if it is counted to be small; else Spark joins it by shuffle and splits large sources."""
    return F.broadcast(per_source) if per_source.limit(rows + 1).count() <= rows else per_source


def targets(sizes: DataFrame, weights: int = 3, repeats: int = 3) -> DataFrame:
    """From (source, source_size) to (source, source_size, rank, target), for any number of sources."""
    ranked = running(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"], {}, "rank")
    ranked = ranked.withColumn("weight", (F.col("rank") % weights + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    ranked = kept(ranked.withColumn("ratio", F.col("most") / F.col("weight")))
    whole = ranked.agg(F.sum("source_size").cast("double").alias("t"), F.sum("weight").alias("w")).first()
    level = 0.0
    if whole["t"]:
        climbing = running(ranked, [], ["ratio", "rank"], {"most_upto": "most", "weight_upto": "weight"}, "at")
        open_level = (F.lit(whole["t"]) - (F.col("most_upto") - F.col("most"))) / (F.lit(whole["w"]) - (F.col("weight_upto") - F.col("weight")))
        level = climbing.withColumn("level", open_level).where("ratio >= level").agg(F.min_by("level", "at").alias("level")).first()["level"]
    return ranked.select("source", "source_size", "rank", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: int = 3, repeats: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, text_hash (of the text, as a key beside the id)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(text.cast("binary")).alias("text_hash"),
    )
    rows = kept(rows.withColumn("shuffle", F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_hash")).cast("binary"))))
    goal = kept(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    budget = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    queued = running(rows, ["source"], ["shuffle"], {"upto": "size"}, "at").drop("at")
    keyed = goal.select(F.col("source").alias("of"), "source_size", "rank", "target")
    queued = kept(queued.join(_small(keyed), same(F.col("source"), F.col("of"))).drop("of"))
    tags = queued.where("size > 0 and target > 0").select("rank", "size", "source_size", "target", "upto", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"))
    tags = tags.withColumn("served", F.col("turn") * F.col("source_size") + F.col("upto"))
    tags = tags.select("rank", "size", "served", (F.col("served") / F.col("target")).alias("finish"))
    # what starts after the latest possible cut cannot be taken: at this virtual time every source has had its target
    latest = queued.where("size > 0 and target > 0").agg(F.max(F.col("size") / F.col("target"))).first()[0] or 0.0
    line = running(tags.where(F.col("finish") <= 1.0 + 2 * latest), [], ["finish", "rank", "served"], {"spent": "size"}, "at")
    cut = kept(line.where(F.col("spent") <= budget).groupBy("rank").agg(F.max("served").alias("last_served")))
    # a source's queue is served in order, so one number per source tells which of its documents were taken how often
    done = queued.join(_small(cut.withColumnRenamed("rank", "r")), F.col("rank") == F.col("r"), "left")
    turns = sum((F.when(F.col("upto") + t * F.col("source_size") <= F.coalesce("last_served", F.lit(-1)), 1).otherwise(0) for t in range(repeats)), F.lit(0))
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * turns).cast("long").alias("taken"), "text_hash", turns.alias("times"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with the columns of ``docs``.

    Texts are joined back on id, source and hash of the text. Rows equal in all
    three are one row here, repeated as often as the mix takes them together; their
    other columns are those of any one of them. Columns of ``docs`` may have any names.
    """
    i, s, h, times, key, turn = (fresh(c, docs.columns) for c in ("_i", "_s", "_h", "_times", "_key", "_turn"))
    id_col, text_col, source_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    taken = mix(docs, **options).where("times > 0").groupBy("doc_id", "source", "text_hash").agg(F.sum("times").cast("int").alias(times))
    taken = taken.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("text_hash").alias(h), times)
    rows = docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).dropDuplicates([id_col, source_col, key])
    hit = rows.join(taken, same(F.col(id_col), F.col(i)) & same(F.col(source_col), F.col(s)) & (F.col(key) == F.col(h)))
    return hit.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(turn)).select(*docs.columns)
