"""Training-data pipeline over ``documents``: quality, near duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import mixing, neardup, packing, quality, suffix
from evalspark.llm.common import cut_lineage, small_batches, table
from evalspark.llm.queries import vocabulary

#: A passage of just over 50 words is a repeat, however few bytes it has; so is one of suffix.LENGTH bytes.
PASSAGE_WORDS = suffix.PASSAGE_WORDS
#: The stages share their executors' memory, so a worker remembers fewer units of the tokenizer than where it packs alone.
REMEMBERED = 300_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the rated ones among them."""
    small_batches(spark)
    rated = table(spark, sf_dir, "labels").select("doc_id", quality.rating().alias("grade"))
    model = quality.fit(quality.training_sample(docs, rated))
    return quality.graded(docs, model).where("__kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return neardup.one_per_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 51 words, or of 400 bytes, that start elsewhere as well; n_chars follows the text."""
    small_batches(spark)
    out = suffix.without_repeats(docs, words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in windows of 2048."""
    small_batches(spark)
    return packing.pack(packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"), keep_ids=False, remembered=REMEMBERED))


STAGES = [("quality", keep_good), ("near_duplicates", one_of_each), ("repeats", cut_repeats), ("mixing", mix_sources), ("packing", pack_windows)]

#: SQL can state neither the fitted classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
