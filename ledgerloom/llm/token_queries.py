"""Queries of problems 6 to 8: token ids, mixing of sources, splitting of long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import mix
from ledgerloom.llm.splitting import pieces
from ledgerloom.llm.tokens import Encoder, encode
from ledgerloom.runtime import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of tokens and whether decoding gives back its bytes."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = Encoder(spark).with_bytes(encoded, "ids", "bytes")
    return decoded.select("doc_id", F.size("ids").alias("n_tokens"), (F.col("bytes") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("same"))


def p6_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what every document's ids decode to."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return Encoder(spark).with_bytes(encoded, "ids", "bytes").select("doc_id", F.md5("bytes").alias("digest"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that were cut."""
    return pieces(table(spark, sf_dir, "documents"), with_text=False).filter("piece_no = 1").select("doc_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p6_digests": p6_digests, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_pieces": p8_pieces}
SQL = {"p6_digests": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"}
