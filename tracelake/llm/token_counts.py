"""Token counts as delta-maintained rollups.

A rollup holds additive totals (documents, tokens) by source, language and tokenizer
version. A batch of changes is reduced to signed sums per key before anything is written:

    insert   +1 document   +n_tokens
    delete   -1 document   -n_tokens
    revise    0 documents  +n_tokens - old_tokens

and committed by a file named after the batch id, which one writer alone can make and which
says where the sums are. A batch that is delivered again, or by two writers at once, finds
that file and changes nothing; a run that dies before leaves the totals as they were. Totals are the sum of the last snapshot and of the batches
that it doesn't cover; `compact` writes a new snapshot, committed in the same way, and keeps
the batches' files, so that late repeats stay without effect.

Null sources, languages and versions are keys of their own; null counts are 0. Keys whose
documents and tokens are all 0 are left out of the totals.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import filesystem, names_in, put_once, text_at

from .shared import kept_until_exit, shared_dir, stored

KEY = ("source", "lang", "tokenizer")
CHANGES = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer versions that plain expressions can count.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) sums of rows (op, source, lang, tokenizer, n_tokens, old_tokens)."""
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    sign = F.when(sign.isNull(), F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null"))))).otherwise(sign)
    rows = changes.select(*KEY, sign.cast("long").alias("n_docs"), F.when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(n).alias("n_tokens"))
    return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at, self._fs = filesystem(spark, self.path)

    def _names(self, folder: str) -> list[str]:
        return names_in(self.spark, f"{self.path}/{folder}")

    def _commit(self, df: DataFrame, folder: str, name: str) -> bool:
        """Writes rows to a folder of their own and names it in the file of the commit, which one writer alone can make."""
        made = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/rows/{made}")
        if put_once(self.spark, f"{self.path}/{folder}/{name}", made):
            return True
        self._fs.delete(self._at(f"{self.path}/rows/{made}"), True)
        return False

    def _rows(self, folder: str, name: str) -> str:
        return f"{self.path}/rows/{text_at(self.spark, f'{self.path}/{folder}/{name}')}"

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch of changes; False if a batch of this id has been committed before."""
        name = f"{hashlib.sha256(batch_id.encode()).hexdigest()}"
        if name in self._names("batches"):
            return False
        return self._commit(signed(changes), "batches", name)

    def compact(self) -> None:
        """Folds all committed batches into a snapshot."""
        batches = self._names("batches")
        covered = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        name = f"{len(self._names('snapshots')):08d}"
        rows = self._sums(batches).select(*KEY, "n_docs", "n_tokens", F.lit(None).cast("string").alias("batch"))
        self._commit(rows.unionByName(covered, allowMissingColumns=True), "snapshots", name)

    def _sums(self, batches: list[str]) -> DataFrame:
        snapshots = self._names("snapshots")
        parts, rest = [], batches
        if snapshots:
            last = self.spark.read.parquet(self._rows("snapshots", snapshots[-1]))
            known = {r.batch for r in last.where("batch is not null").select("batch").collect()}
            rest = [b for b in batches if b not in known]
            parts.append(last.where("batch is null").drop("batch"))
        if rest:
            parts.append(self.spark.read.schema(CHANGES).parquet(*(self._rows("batches", b) for b in rest)))
        rows = self.spark.createDataFrame([], CHANGES)
        for p in parts:
            rows = rows.unionByName(p)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens)."""
        return self._sums(self._names("batches")).where("n_docs <> 0 or n_tokens <> 0")


def history(docs: DataFrame) -> DataFrame:
    """op3: the totals after a corpus's life.

    All documents are loaded (and the load is delivered twice), counted again by a second
    tokenizer version, revised to their text without its first line, and all copies of a
    text but the one of the smallest doc_id are deleted.
    """
    spark = docs.sparkSession
    shorter = F.regexp_replace("text", r"\A[^\n]*\n?", "")
    text = F.col("text")
    counted = stored(docs.select("doc_id", "source", "lang", F.sha2(text.cast("binary"), 256).alias("same"), tokens(text, "words-1").alias("one"), tokens(shorter, "words-1").alias("less"), tokens(text, "pieces-2").alias("two")))

    def changes(rows: DataFrame, op: str, tokenizer: str, n: str, old: Column | None = None) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"), (F.lit(0) if old is None else old).cast("long").alias("old_tokens"))

    rollup = TokenRollup(spark, kept_until_exit(spark, shared_dir(spark)))
    for _ in range(2):
        rollup.apply("load", changes(counted, "insert", "words-1", "one"))
    rollup.apply("second tokenizer", changes(counted, "insert", "pieces-2", "two"))
    rollup.compact()
    rollup.apply("first lines", changes(counted, "revise", "words-1", "less", F.col("one")))
    # lower() leaves a digest as it is; written so, both sides of the join are plain shuffles, of which adaptive execution splits the copies of one text
    first = counted.groupBy("same").agg(F.min("doc_id").alias("first")).where("same is not null").select(F.lower("same").alias("same"), "first")
    copies = counted.join(first, "same").where("doc_id > first")
    rollup.apply("copies", changes(copies, "delete", "words-1", "less").unionByName(changes(copies, "delete", "pieces-2", "two")))
    return rollup.totals()


def _duck_tokens(text: str, tokenizer: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '{TOKENIZERS[tokenizer]}')), 0)"


ORACLE = rf"""
WITH c AS (
  SELECT source, lang, {_duck_tokens("regexp_replace(text, '^[^\n]*\n?', '')", 'words-1')} AS less, {_duck_tokens('text', 'pieces-2')} AS two,
         text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text) AS copy
  FROM documents),
t AS (
  SELECT source, lang, 'words-1' AS tokenizer, less AS n FROM c WHERE NOT copy
  UNION ALL SELECT source, lang, 'pieces-2', two FROM c WHERE NOT copy)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM t GROUP BY ALL
"""
