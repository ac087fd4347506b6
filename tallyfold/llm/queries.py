"""The queries of the training-data operators, each a thin digest of its operator's real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat_format, collocations, decontaminate, kneser_ney, language, license_scan, media_gif, packing, quality, sentence_pieces, simhash, toxicity
from .common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out(documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.digests(media_gif.gif_columns(documents(spark, sf_dir)))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(documents(spark, sf_dir)).drop("expressions")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encode(documents(spark, sf_dir)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality, op2_decontaminate, op3_kneser_ney, op4_media, op5_toxicity, op6_simhash, op7_license, op8_language, op9_packing, op10_chat, op11_sentencepiece, op12_collocations, op13_centroids)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat": chat_format.ROTATE_SQL, "op12_collocations": collocations.MINE_SQL, "op13_centroids": centroids.cluster_sql()}
