"""From raw documents to training tokens: the stages in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolane.llm import bpe, decontaminate, registry, simhash_dedup, suffix_dedup, toxicity
from chronolane.llm.common import DOC_ID, TEXT, small_batches, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5; null and empty texts score like any other text without toxic words."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~registry.held_out()))
    return docs.where(toxicity.scored(model, F.col(TEXT)) < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles alike by 0.8 or more), the one with the smallest id; documents without an id stay.

    A row goes for its text, not for its id: of rows that share an id the ones with other texts stay.
    """
    small_batches(spark)
    groups = simhash_dedup.similar_texts(docs)
    losers = groups.where("not first").select(DOC_ID, F.col("text_name").alias("_text")).distinct()
    named = docs.where(F.col(DOC_ID).isNotNull()).withColumn("_text", simhash_dedup.text_name())
    kept = named.join(losers, [DOC_ID, "_text"], "left_anti")
    # Rows alike in id and text are copies of each other; all but one of them go.
    again = F.row_number().over(Window.partitionBy(DOC_ID, "_text").orderBy(DOC_ID))
    once = kept.withColumn("_again", again).where(F.col("_again") == 1).select(docs.columns)
    return once.unionAll(docs.where(F.col(DOC_ID).isNull()))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without every passage of 50 words or more, and 200 bytes or more, that occurs twice; n_chars follows the text.

    50 words of the corpus are 250 to 500 bytes but for very short words. A
    character of which only some bytes are covered stays, so that texts stay UTF-8.
    """
    small_batches(spark)
    return suffix_dedup.cut_texts(docs, length=200, least_words=50)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a document without an id is never matched, so it stays."""
    small_batches(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(DOC_ID).distinct()
    return docs.join(found, DOC_ID, "left_anti").select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of the text that they decode to; null and empty texts have no ids."""
    small_batches(spark)
    words = registry.vocabulary()
    return bpe.encode_and_decode(docs, words).select(
        DOC_ID,
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col(TEXT).cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", to_tokens),
]

#: The stages have no SQL form; each one's operator is tested against brute force, round trips or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
