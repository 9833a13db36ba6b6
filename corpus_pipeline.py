"""The training-corpus pipeline: documents without toxic ones, near copies, benchmark passages and personal data, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents, whatever further columns these have. :func:`run` writes every stage's rows to the shared folder and
reads them for the next; what a stage wrote for itself is deleted when its rows are written, and its input when the next
stage has read it.

Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontaminate, near_copies, packing, pii, toxicity
from tracemill.llm.common import dropped, scratch, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5, by a model of the labelled rows among ``docs``; null and empty texts score as one word
    without letters; repeated rows go or stay together; without labels all stay."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity of 0.8 at least) the row with the smallest id, once. Null, empty
    and blank texts are one group; of rows with one id and one text one stays; of rows with one id and alike texts the one
    with the least hash; a row without id stays only where no near copy of it has one."""
    return near_copies.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words less than a twentieth are hit by windows of test items; null and empty texts have no words and
    stay; repeated rows go or stay together; without items all stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in the text, and n_chars by the new length; a null text stays null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its token ids; a null text is empty, an empty one a piece of the end mark; repeated rows are
    packed each."""
    return packing.pack(docs, packing.default_tokenizer(), payload=("ids_crc32", "ids"), known_words=100_000)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]
#: No SQL: the stages learn, hash and search; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir), name)
            made -= {path for path in made if f"/{name}-" in path}
        if before is not None:
            dropped(before)
        before = docs
    return docs
