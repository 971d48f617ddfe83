"""From raw documents to encoded ones: five stages, each written as Parquet and read again.

Each stage function takes (spark, docs, sf_dir), with docs as its predecessor left them, and
returns the rows that it keeps, in the columns of documents; the last one returns each
document's encoding. Documents are told apart by doc_id and text, so that repeated doc_ids
don't lose or double one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontamination, language_id, line_dedup, ngram_join
from tracelake.llm.shared import discard, if_small, kept_until_exit, shared_dir, stored, unused, written

#: A prediction below this probability is a rejection, as `und` is.
LANGUAGE_SCORE = 0.5


def _id(docs: DataFrame):
    return F.struct(docs["doc_id"], F.xxhash64(docs["doc_id"], docs["text"]).alias("h"))


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The docs with (left_semi) or without (left_anti) an id (struct column `i`) in ids."""
    ids = if_small(ids.select(F.col("i.doc_id").alias("__d"), F.col("i.h").alias("__h")))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__d"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == ids["__h"]), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or without a likely language go."""
    model = language_id.fit(language_id.learnable(docs))
    lang, score = unused(docs, "lang_pred", "score")
    kept = language_id.predict(docs, model, lang_pred=lang, score=score).where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one; a document of which no non-blank line is left goes."""
    kept = line_dedup.deduplicated(docs, exact_short=True).where("n_dropped = 0 or n_left > 0")
    columns = [F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by n-gram similarity."""
    found = ngram_join.similar_documents(docs.select(_id(docs).alias("i"), "text"), doc_id="i")
    kept = stored(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("i")).agg(F.count("*").alias("n")))
    once = _only(docs, kept.where("n = 1"), "left_semi")
    repeated = kept.where("n > 1")
    return once if repeated.isEmpty() else once.unionByName(_only(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.phrase_hits(docs.select(_id(docs).alias("i"), "text"), items, doc_id="i")
    return _only(docs, stored(found.where("size(spans) > 0").select(F.col("doc_id").alias("i"))), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, ends, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return bpe.encoded(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: Most stages have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has written besides its result goes when it ends, its input when the next one ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for number, (_, stage) in enumerate(STAGES):
        before = written()
        path = f"{base}/{number}"
        stage(spark, docs, sf_dir).write.parquet(kept_until_exit(spark, path))
        discard(spark, *(written() - before - {path}), *([f"{base}/{number - 1}"] if number else []))
        docs = spark.read.parquet(path)
    return docs
