"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm import chat, collocations, embed_dedup, license_scan, lm, media, mixing, ngram_join, pii, sp_tokens, toxicity, warc, whitening
from railbird.plans.stored import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary file on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.learn(docs))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokens.encode(_table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False, with_text=False)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.pictures(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("image_id", "vec_id")


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, folder)
    r = warc.read(spark, folder, with_payload=False)
    kind = dict(pages.dtypes)["page_id"]
    return r.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


_QUERIES: dict[str, Query] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_pii": op3_pii,
    "op4_ngram_join": op4_ngram_join,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_media_copies": op9_media_copies,
    "op10_chat_rotation": op10_chat_rotation,
    "op11_warc": op11_warc,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
_ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": embed_dedup.ORACLE,
    "op2_license_scan": license_scan.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op10_chat_rotation": chat.ORACLE,
    "op11_warc": warc.ORACLE,
    "op12_collocations": collocations.ORACLE,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
