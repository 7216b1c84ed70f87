"""A corpus pipeline: toxic documents go, then copies, then near copies; sources are mixed and the rest is packed.

Every stage keeps all columns of its input, whatever they are called. Null text counts as empty. Empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exactdup, mixing, neardup, packing, toxicity
from gridloom.llm.common import fresh, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on the labels outside the held-out fold.

    Rows with a null id are scored like others. Where there is no label to learn from, nothing is known to be toxic and all documents stay.
    """
    labels = toxicity.sampled_labels(table(spark, sf_dir, "labels"))
    if labels.join(docs, "doc_id", "left_semi").isEmpty():
        return docs
    model, name = toxicity.train(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    return toxicity.scored(docs, model, name=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of equal texts, once; a null id only where no other has the text."""
    return exactdup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates, with all rows of that id; rows without an id stay.

    Links by plain similarity count beside those by TF-IDF, so that copies of a large group go as those of a small one do.
    """
    gone = neardup.near_duplicates(docs, plain=True).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mixture takes: none, one or two; rows without words are not taken twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces in sequences of at most 1024 tokens; a document that comes twice is packed twice."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
