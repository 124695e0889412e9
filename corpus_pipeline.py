"""From documents to packed training sequences: every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import jaccard, langid, packing, pii
from equilens.llm.common import Tables, read_table
from equilens.llm.queries import surrogate_key, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of whole texts that go to Python at once, at most; ten thousand of them fill a worker's memory.
BATCH_ROWS = 512


def with_small_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in small batches; stages run after their function has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are in a language; those without a letter or unlike every language go.

    A null or empty text goes, whatever its other columns; a null language only means that nothing is learned from the
    row. Equal cosines go to the language first by name, repeated rows are judged alike, an empty table stays empty, and
    a table without any labelled text keeps nothing, since no language is known. Other columns are dropped.
    """
    with_small_batches(spark)
    prototypes = langid.train(langid.training_rows(docs))
    return langid.in_language(docs, prototypes, langid.least_score(docs, prototypes)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class: links at a similarity of 0.8 or more over five-word shingles.

    Documents without words and those without an id stay, and so do repeated rows of the one that stays; of equal texts
    that with the smallest id is the one. A document is its id and its text: of different texts with one id each is judged
    by itself, in the order of their hashes. An empty table stays empty; other columns are dropped.
    """
    with_small_batches(spark)
    docs = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two")).alias("document"))
    named = docs.where("doc_id is not null")
    classes = jaccard.join(named, 5, 80, 100, "document")
    gone = classes.where("n_shingles > 0 and document != component_id").select("document").distinct()
    return named.join(gone, "document", "left_anti").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in the place of personal data; all documents stay.

    A null text stays null, with a null number of characters; equal entities get equal surrogates in all rows, repeated
    rows are replaced alike, an empty table stays empty; other columns are dropped.
    """
    replaced = pii.replace(docs, surrogate_key(spark))
    return replaced.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    A null text is packed as its end alone; repeated rows and null ids are packed like any other; an empty table gives
    no pieces.
    """
    with_small_batches(spark)
    pieces = packing.pack(docs, tokenizer(), tokenizer("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("surrogates", surrogates), ("pack", pack)]

#: Neither the language profiles nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = read_table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
