"""Queries p7 to p9 over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .encoding import encode_texts
from .leaks import leaked_items
from .residue import residue_documents

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least twelve successive words of an item."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold template residue, filler, an error message or a script notice."""
    return residue_documents(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p9_found)}
SQL: dict[str, str] = {}
