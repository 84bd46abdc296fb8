"""A corpus made ready for training: stages over ``documents``, each over all that the one before kept.

Every stage but the last returns the columns of its input; ``n_chars``, where there is one,
follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.columns import TEMP
from tallyforge.llm import bpe, cotrain, linededup, mixture, simhash
from tallyforge.operators.ordered import durable

TOKENIZER = "byte_bpe_50k.json"

ROW = TEMP + "row"

#: Rows of an Arrow batch. Spark's default of 10,000 is for short rows: of whole texts, a worker and the executor would
#: hold tens of megabytes each at a time.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Have the session hand texts to Python workers in batches that take little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good; it learns from the ``labels`` in ``sf_dir``."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.score(docs, cotrain.fit(docs, labels)).filter("kept").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    small_batches(spark)
    kept = linededup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays, the first of those with the smallest id.

    Shingles and distance are those of ``simhash.near_duplicates``. Rows without an id stay only where no row of
    their component has one, one for each component; texts without words are one component. ``docs`` is stored once
    with a number for each row, so rows go by themselves and never by an id that others share.
    """
    small_batches(spark)
    numbered = durable(docs.withColumn(ROW, F.monotonically_increasing_id()))
    members = durable(simhash.near_duplicates(numbered, ROW).select(ROW, "component_id"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW).alias("row"))
    ids = numbered.select(ROW, "doc_id").join(members, ROW)
    groups = ids.groupBy("component_id").agg(F.min(order)["row"].alias("first"), F.count("*").alias("n")).filter("n > 1")
    # The rows that go are few, so texts seldom have to be shuffled to take them out.
    gone = members.join(groups, "component_id").filter(F.col(ROW) != F.col("first")).select(ROW)
    return numbered.join(durable(gone), ROW, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights."""
    return mixture.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its id, source, text, token ids (little-endian unsigned 32-bit) and their number."""
    small_batches(spark)
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "source", "text", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, given the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the fitted classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None
