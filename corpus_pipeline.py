"""From documents to packed training sequences, in stages that each apply one operator.

Every stage reads what its predecessor wrote: toxic documents go, of near copies one stays, sources
are mixed to their targets, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veritrace.llm import mixing, packing, severity, simhash
from veritrace.llm.common import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model, fitted on the labelled ones of docs, rejects.

    Null and empty texts are clean and stay, as all rows do where nothing is labelled; texts are
    read whole, however long; rows that repeat stay or go together; an empty table gives none.
    Columns stay as they are, whatever their names.
    """
    model = severity.fit(docs, table(spark, sf_dir, "labels"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no name clashes with the scores'
    scored = severity.score(plain, model, id_col=f"c{docs.columns.index('doc_id')}", text_col=f"c{docs.columns.index('text')}")
    return scored.filter("not rejected").select(*plain.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, similarity 0.8 or more.

    The one with the smallest id stays. Null, empty and blank texts are copies of each other; a text
    of fewer than five words is one shingle; texts are read whole. Of rows that repeat an id and
    text one stays; rows with a null id stay; an empty table gives none. Columns stay as they are.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    A row at its source's threshold is cut to the words that are left. A null source is a source,
    the last; null and empty texts have no words, so the mix takes none of them; rows that repeat,
    and ties of the hash, share what is left at the threshold; an empty table gives none. Columns
    stay as they are.
    """
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens, with their ids (column ids).

    A null text is empty and is its end id alone; longer texts are cut, and every token of every
    row, repeated ones too, is in one piece; an empty table gives none. Other columns are left out.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The model, the minima and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
