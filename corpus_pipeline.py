"""A corpus pipeline of five stages over ``documents``; counted as part of ``wavemill.llm``.

Each stage but the last returns rows of its input with all their columns, further ones too,
whatever their names (``doc_id``, ``text`` and ``source`` are read). Defined cases: a null text is an empty text,
which has no words, so the fixed limits of the quality rules drop it; null ids and null sources are values like others;
repeated rows are scored and judged each and are one group of copies, of which one row stays; among equal texts the
least id stays, null last. A document that the mix takes several times is encoded as often. An empty table gives an empty result at every stage:
without labels of both classes the classifier scores every text alike and the list of rules is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import classifier, mixing, pieces, rules, similarity
from wavemill.llm.queries import digest
from wavemill.llm.scratch import kept


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct("*").alias("row"))
    return classifier.score(rows, model, keep=("row",), text_col="row.text").where("score >= 0.7").select("row.*")


def drop_failing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list and the fixed limits keep."""
    learned = rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return rules.judge(rows, learned, keep=("row",)).where("kept").select("row.*")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return similarity.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of every document and the next best, as digests."""
    return digest(pieces.encode(docs))


STAGES = [("quality classifier", drop_poor), ("quality rules", drop_failing), ("n-gram Jaccard join", drop_similar), ("mix", mix_sources), ("pieces", encode_pieces)]

#: Trained scores and sampled paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
