"""From raw documents to packed training sequences.

``STAGES`` lists the stages in turn. Each takes ``(spark, docs, sf_dir)``; all but
the last return the columns of ``documents``. What a stage returns is written as
Parquet and read again as the next one's ``docs``.

All stages take whole tables and whole texts, however long. Nulls in any column, repeated rows and ids, and extra
columns of any name are defined for each stage below; an empty table gives an empty
one, with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import mixing, packing, simhash, suffix_dedup, toxicity
from tidegraph.llm.common import documents, labels, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator accepts.

    Null and empty texts are accepted; rows with equal texts are judged alike, whatever their
    ids; rows without an id, or with a repeated one, are judged by their texts. Other columns stay as they are.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each SimHash component.

    A null id is larger than all others. Of rows that share an id, or have none, each is judged by its
    text; of equal rows one stays. Null and empty texts are one component. Other columns stay as they are.
    """
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that 100-byte strings repeat from earlier ones.

    A null text becomes an empty one; n_chars follows the text, other columns stay as they are. Rows
    that repeat an id come in the order of a hash of their texts, rows without one last; of equal rows the first keeps its text.
    """
    out = suffix_dedup.remove_repeats(docs, with_text=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as came in, with every source at the same expected share.

    A null source is a source; rows without an id draw as the empty id does, and rows that repeat an id draw
    alike. Texts, null or not, and other columns are copied as they are.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their places in sequences.

    A null or empty text has the end id alone; ids may be null or repeat, and each copy of a row is
    packed. Other columns are left out.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("poisson_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has neither the learned models nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = materialize(stage(spark, out, sf_dir), f"stage-{name}")
    return out
