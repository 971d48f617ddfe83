r"""Document fingerprints: Merkle trees over sections, paragraphs and cells, in native expressions.

A text is cut, without loss, into sections (lines up to and with the blank lines after
them), sections into paragraphs (lines), paragraphs into cells of CELL code points. A
paragraph's node is the MD5 of its text, a section's node the MD5 of its paragraphs' nodes,
the root the SHA-256 of the sections' nodes. The fingerprint keeps the root and the tree of
cell hashes (8 hex digits):

    root ":" section { "/" section }      section = paragraph { ";" paragraph }

Equal roots mean equal texts; where roots differ, differing branches tell the sections and
paragraphs that changed, and the share of common cells says how alike the texts are.

The neighbour of each document in doc_id order is found without a global sort in one task:
doc_ids are cut into buckets at quantiles of a bounded sample, each bucket gets a copy of
the first row of the next one, and a window within the bucket does the rest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, stored

CELL = 32
SAMPLE = 100_000
BUCKETS = 20_000
_SECTION = r"(?:[^\n]++\n?)++\n*+|\n++"
_PARAGRAPH = r"[^\n]*+\n|[^\n]++"
_CELL = rf"[^\n]{{1,{CELL}}}\n?|\n"


def tree(text: Column) -> Column:
    """struct(root, sections): sections of paragraphs of cell hashes."""

    def paragraph(p):
        cells = F.transform(F.regexp_extract_all(p, F.lit(_CELL), F.lit(0)), lambda c: F.substring(F.md5(c.cast("binary")), 1, 8))
        return F.struct(F.md5(p.cast("binary")).alias("node"), cells.alias("cells"))

    return F.transform(F.regexp_extract_all(text, F.lit(_SECTION), F.lit(0)), lambda s: F.transform(F.regexp_extract_all(s, F.lit(_PARAGRAPH), F.lit(0)), paragraph))


def root(sections: Column) -> Column:
    nodes = F.transform(sections, lambda s: F.md5(F.array_join(F.transform(s, lambda p: p["node"]), "").cast("binary")))
    return F.sha2(F.array_join(nodes, "").cast("binary"), 256)


def shape(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p["cells"], "")), ";")), "/")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    sections = tree(F.coalesce(text, F.lit("")))
    return F.concat(root(sections), F.lit(":"), shape(sections))


def cells(fingerprint: Column) -> Column:
    """The distinct cell hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring(fingerprint, 66, 1 << 30), F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column, a_cells: Column | None = None, b_cells: Column | None = None) -> Column:
    """1 for equal roots, else the Dice share of common cells, below 1."""
    x, y = cells(a) if a_cells is None else a_cells, cells(b) if b_cells is None else b_cells
    total = F.size(x) + F.size(y)
    dice = 2 * F.size(F.array_intersect(x, y)).cast("double") / F.greatest(total, F.lit(1))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(F.least(dice, F.lit(0.999999)))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (section, paragraph), from 0, of the paragraphs of a whose branch isn't in b."""
    parts = F.split(F.regexp_replace(F.substring(b, 66, 1 << 30), "/", ";"), ";")
    sections = F.split(F.substring(a, 66, 1 << 30), "/")
    found = F.transform(sections, lambda s, i: F.filter(F.transform(F.split(s, ";"), lambda p, j: F.when(~F.array_contains(parts, p), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull()))
    return F.flatten(found)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next): each row with the text of the next row in key order; after the last comes the first.

    Rows with equal keys are ordered by a hash of the text; null keys come first. A null text counts as empty.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    wanted = min(BUCKETS, 4 * partitions(docs.sparkSession))
    sample = sorted(r.k for r in rows.where("k is not null").select("k").orderBy(F.xxhash64("k")).limit(min(SAMPLE, 40 * wanted)).collect())
    bounds = sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)}) if sample else []
    cut = F.from_json(F.lit(json.dumps(bounds, default=str)), f"array<{kind}>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))))
    # binary search: the number of bounds that aren't above the key
    bucket = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(bounds)) & (F.get(cut, p + s - 1) <= F.col("k")), p + s).otherwise(p)) if bounds else F.lit(0)
    rows = rows.withColumn("b", bucket)
    first = rows.groupBy("b").agg(F.min(F.struct(F.col("k").isNotNull().alias("n"), "k", F.xxhash64("t").alias("h"))).alias("f"))
    around = Window.orderBy("b")  # over the buckets, of which there are BUCKETS at most
    first = stored(first.select(F.coalesce(F.lag("b").over(around), F.max("b").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"), "b", "f"))
    edges = rows.join(F.broadcast(first), "b").where(F.col("k").eqNullSafe(F.col("f.k")) & (F.xxhash64("t") == F.col("f.h")))
    edges = edges.groupBy(F.col("to").alias("b")).agg(F.first("t").alias("t")).select(F.lit(None).cast(kind).alias("k"), "t", "b", F.lit(1).alias("edge"))
    order = Window.partitionBy("b").orderBy("edge", F.asc_nulls_first("k"), F.xxhash64("t"))
    both = rows.withColumn("edge", F.lit(0)).unionByName(edges)
    return both.withColumn("next", F.lead("t").over(order)).withColumn("order", F.struct("b", "edge", "k"))


def digests(docs: DataFrame) -> DataFrame:
    """op5: each document's fingerprint, its edited text's, and their likenesses."""
    rows = with_next(docs).withColumn("n", F.char_length("t")).withColumn("m", F.floor(F.col("n") / 2).cast("int"))
    rows = rows.withColumn("e", F.concat(F.expr("substring(t, 1, n - m)"), F.expr("substring(next, 1, m)")))
    rows = rows.withColumn("f", fingerprint(F.col("t"))).withColumn("fe", fingerprint(F.col("e")))
    order = Window.partitionBy("b").orderBy("edge", F.asc_nulls_first("k"), F.xxhash64("t"))
    rows = rows.select("k", "b", "edge", "t", "n", "f", "fe", F.sha2(F.col("e").cast("binary"), 256).alias("sha")).withColumn("fn", F.lead("f").over(order)).where("edge = 0")
    return rows.select(
        F.col("k").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("f").alias("fingerprint"), F.col("fe").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("fe")).alias("near_edited"), likeness(F.col("f"), F.col("fn")).alias("near_next"),
    )


def _duck_fingerprint(text: str) -> str:
    section, paragraph, cell = r"(?:[^\n]+\n?)+\n*|\n+", r"[^\n]*\n|[^\n]+", rf"[^\n]{{1,{CELL}}}\n?|\n"
    nodes = f"list_transform(regexp_extract_all({text}, '{section}'), lambda s: md5(array_to_string(list_transform(regexp_extract_all(s, '{paragraph}'), lambda p: md5(p)), '')))"
    leaves = f"list_transform(regexp_extract_all({text}, '{section}'), lambda s: array_to_string(list_transform(regexp_extract_all(s, '{paragraph}'), lambda p: array_to_string(list_transform(regexp_extract_all(p, '{cell}'), lambda c: md5(c)[1:8]), '')), ';'))"
    return f"sha256(array_to_string({nodes}, '')) || ':' || array_to_string({leaves}, '/')"


def _duck_near(a: str, b: str) -> str:
    x, y = (f"list_distinct(regexp_extract_all({f}[66:], '[0-9a-f]{{8}}'))" for f in (a, b))
    return f"CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0::DOUBLE ELSE least(2 * len(list_intersect({x}, {y}))::DOUBLE / greatest(len({x}) + len({y}), 1), 0.999999::DOUBLE) END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d),
e AS (SELECT doc_id, t, n, substr(t, 1, n - n // 2) || substr(x, 1, n // 2) AS e FROM n),
f AS (SELECT doc_id, n, e, {_duck_fingerprint('t')} AS f, {_duck_fingerprint('e')} AS fe FROM e),
g AS (SELECT *, coalesce(lead(f) OVER (ORDER BY doc_id), first_value(f) OVER (ORDER BY doc_id)) AS fn FROM f)
SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, f AS fingerprint, fe AS edited_fingerprint,
       {_duck_near('f', 'fe')} AS near_edited, {_duck_near('f', 'fn')} AS near_next
FROM g
"""
