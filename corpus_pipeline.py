"""Documents to packed training sequences: toxic documents go, repeated lines go, one document of each group of near
copies stays, documents with benchmark passages go, and what is left is packed.

Every stage takes (spark, docs, sf_dir), with all that the stage before kept as ``docs``, and returns a DataFrame, which is
written to the shared folder as Parquet and read again as the next one's ``docs``. All stages but the last return the
columns of ``documents``. Nulls, empty texts and tables, repeated rows and further columns are as each operator
defines them: a null text counts as empty, repeated rows of one text are near copies, so one of them stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outskirt.llm import decontaminate, lines, nearcopies, packing, toxicity
from outskirt.llm.queries import RANKS
from outskirt.llm.shared import shared_folder, stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, scores below 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less repeated lines; ``n_chars`` is that of the new text."""
    out = lines.drop_repeated_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8), the one with the smallest id."""
    return nearcopies.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item is half covered by tiles."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, in the order of the Hilbert curve."""
    docs = docs.select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
