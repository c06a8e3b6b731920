"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing sources to target weights and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
docs, of any name, with their values unchanged. No stage needs ids to be unique or not null; an empty table passes every
stage as an empty table; texts of any length are treated whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brevispark.llm import exact_dedup, langid, minhash, mixing, packing
from brevispark.llm.common import shared_dir
from brevispark.llm.tokens import byte_bpe_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised: null, empty and letterless texts, and scores under 0.35.

    The model learns from the rows of docs with a language that are not held out; where nothing can be learned, all go.
    Repeated rows are judged alike and stay; ties of scores go to the first language by name.
    """
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of equal texts, that with the largest id; null and empty texts are one text.

    Of rows that share the text and the largest id any one stays; a null id stays only where its group has no other.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, 80 % or more), that with the smallest id.

    Null and wordless texts and null ids are in no group and stay; rows that share an id stay or go together.
    """
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their targets; null sources are one source.

    A document without words counts as size 0 and is taken as often as any other of its source; rows that share an id
    share a draw; reruns agree.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence (see packing.pack), instead of the columns of docs.

    Null texts are packed as empty texts, so with their end id; null ids are kept; repeated rows are packed each for itself.
    """
    return packing.pack(docs, byte_bpe_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Language models, MinHash and tokenizers have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
