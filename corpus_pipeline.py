"""A training corpus in five stages; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm import mixing, ngram_join, pii, sp_tokens, toxicity
from railbird.llm.common import stored
from railbird.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts match nothing and stay. Repeated rows score alike: all stay or all go. An empty table, or one without
    labels, learns nothing and keeps every text without a seed insult. All columns are kept, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.learn(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Null texts and texts without a word are no copies and stay. Rows that repeat the smallest id with the same words stay
    once. A null id stays only where its group has no other. All columns are kept, whatever their names.
    """
    return ngram_join.one_of_each(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; n_chars follows the text.

    Null and empty texts stay as they are (n_chars null and 0), repeated rows stay, very long texts take linear time. All
    columns are kept, whatever their names; without a column n_chars none is added.
    """
    masked = pii.detect(docs, pii.learn(docs), redact=True)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have no words; they come along with whole copies of their source only. Of repeated rows as many are taken as the target asks for. A null source is a
    source of its own. All columns are kept, whatever their names.
    """
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text.

    Null and empty texts are the begin and end id. Repeated rows stay; other columns are not carried.
    """
    return sp_tokens.encode(docs, tokenizer_file(), with_text=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_private),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The stages learn models and compare texts by hashes, which SQL cannot express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
