"""Queries of the problem on mixing sources."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.mixing import mixture
from factloom.session import table

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("FACTLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _mix(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), vocabulary=str(Path(tokenizers) / "byte_bpe_50k.tiktoken"), pattern=PATTERN)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
