"""The corpus pipeline: documents without toxic ones, repeated lines and near copies, mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
one's docs. All but the last return the columns of documents; n_chars follows the text.

In every stage: a null text counts as empty, an empty table gives an empty one, further columns of docs go, rows of equal
text fare alike but where a stage says which of them stays, and texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm import bpe, lines, mixing, near_dedup, toxicity
from chainlens.llm.common import stored, table
from chainlens.llm.queries import SEED, SHARE, VOCABULARY, WEIGHTS, levels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model is fitted to the labelled rows. Null and empty texts, and null ids, stay; a score of 0.5 goes."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more of them share but for the largest id's. A null text becomes empty; rows sharing the largest id all keep the line, those without an id never do."""
    out = lines.deduplicated(docs.select(*COLUMNS), out="line_")
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies. Rows without an id stay; of rows that share one, one stays; empty texts are equal, so one of them stays."""
    return near_dedup.deduplicated(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one epoch at most, chosen to the target weights. A null lang or source is a leaf of its own; rows that share id and leaf go together; texts without words cost nothing."""
    return mixing.mixed(docs, levels(), WEIGHTS, seed=SEED, share=SHARE, max_epochs=1).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, in as many rows as there are; an empty or null text has none."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: A field of words' features and a chain's marginals, near copies and merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
