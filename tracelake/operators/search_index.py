"""A stored inverted index for full-text search, kept current by segments.

A posting is (token, key, at, n): where a token stands in a row, each place a number that
holds the column above 32 bits of position, and the row's length in tokens. A segment's
postings are ranged and sorted by token, so that Parquet's row-group bounds prune a query's
read to its words and prefixes; a token that many rows hold is spread over several files.
Words, phrases, prefixes, beginnings, columns and NEAR are decided on the places alone: no
text is read or tokenised to answer a query.

`refresh` compares the table with what is indexed by a hash of its columns and writes a new
segment of what differs, with the keys that are gone; a posting holds unless a later segment
names its key. A full refresh puts one segment in the place of all. Segments are published
by compare-and-set, as the versions of `merge.Store`.
"""

from __future__ import annotations

import functools
import itertools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import storage
from tracelake.operators import search
from tracelake.operators.merge import Conflict

_COLUMN = 32


def postings(table: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(token, key, at, n) of each row."""
    counted = table.select(F.col(key).alias("key"), F.array(*(search.tokens(c) for c in columns)).alias("__t"))
    counted = counted.withColumn("n", F.aggregate("__t", F.lit(0), lambda a, t: a + F.size(t)))
    words = counted.select("key", "n", F.posexplode("__t").alias("__c", "__w")).select("key", "n", "__c", F.posexplode("__w").alias("__p", "token"))
    place = F.shiftleft(F.col("__c").cast("long"), _COLUMN) + F.col("__p")
    return words.groupBy("token", "key").agg(F.array_sort(F.collect_list(place)).alias("at"), F.first("n").alias("n"))


def _lengths(table: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, n, h) of each row: its tokens, and a hash of what is indexed."""
    n = functools.reduce(lambda a, b: a + b, (F.size(search.tokens(c)) for c in columns))
    return table.select(F.col(key).alias("key"), n.alias("n"), F.xxhash64(*columns).alias("h"))


class Index:
    """The index of some columns of a table whose key is unique and not null, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, key: str, *columns: str):
        self.spark, self.path, self.key, self.columns = spark, path.rstrip("/"), key, columns

    def _segments(self) -> list[dict]:
        """What the segments since the last full one say, oldest first."""
        names = storage.names_in(self.spark, f"{self.path}/segments")
        found: list[dict] = []
        for name in reversed(names):
            told = json.loads(storage.text_at(self.spark, f"{self.path}/segments/{name}")) | {"number": int(name)}
            if told["columns"] != [self.key, *self.columns]:
                raise ValueError(f"{self.path} indexes {told['columns']}")
            found.insert(0, told)
            if told["full"]:
                break
        return found

    def _read(self, segments: list[dict], part: str) -> DataFrame:
        read = [self.spark.read.parquet(f"{self.path}/{s['folder']}/{part}").withColumn("segment", F.lit(s["number"])) for s in segments]
        return functools.reduce(DataFrame.unionByName, read)

    def _indexed(self, segments: list[dict]) -> DataFrame:
        """(key, old_n, old_h) of the rows that the segments hold."""
        rows = self._read(segments, "rows")
        if len(segments) > 1:
            rows = rows.groupBy("key").agg(F.max_by("n", "segment").alias("n"), F.max_by("h", "segment").alias("h"))
        return rows.where("n is not null").select("key", F.col("n").alias("old_n"), F.col("h").alias("old_h"))

    def refresh(self, table: DataFrame, full: bool = False) -> bool:
        """Brings the index to the table's rows; False if nothing differs. `full` writes it anew, as one segment."""
        segments = self._segments()
        number = segments[-1]["number"] + 1 if segments else 1
        full = full or not segments
        folder = f"parts/{number:012d}-{uuid.uuid4().hex}"
        if full:
            _lengths(table, self.key, self.columns).withColumn("old_n", F.lit(None).cast("int")).write.parquet(f"{self.path}/{folder}/rows")
            fresh, before = table, {"rows": 0, "tokens": 0}
        else:
            now = table.select(F.col(self.key).alias("key"), F.xxhash64(*self.columns).alias("now"))
            differs = now.join(self._indexed(segments), "key", "full").where(~F.col("now").eqNullSafe(F.col("old_h")))
            keys = storage.written(differs.select("key", "old_n", F.col("now").isNull().alias("gone")))
            if keys.isEmpty():
                return False
            fresh = table.join(keys.where("not gone").select(F.col("key").alias("__k")), F.col(self.key) == F.col("__k"), "left_semi")
            keys.join(_lengths(fresh, self.key, self.columns), "key", "left").select("key", "n", "h", "old_n").write.parquet(f"{self.path}/{folder}/rows")
            before = segments[-1]
        found = postings(fresh, self.key, self.columns).repartitionByRange("token", "key").sortWithinPartitions("token", "key")
        found.write.parquet(f"{self.path}/{folder}/postings")
        tokens = lambda c: F.coalesce(F.sum(c), F.lit(0))
        change = self.spark.read.parquet(f"{self.path}/{folder}/rows").agg((F.count("n") - F.count("old_n")).alias("rows"), (tokens("n") - tokens("old_n")).alias("tokens")).first()
        told = {"columns": [self.key, *self.columns], "folder": folder, "full": full, "rows": before["rows"] + change["rows"], "tokens": before["tokens"] + change["tokens"]}
        if not storage.put_once(self.spark, f"{self.path}/segments/{number:012d}", json.dumps(told)):
            at, fs = storage.filesystem(self.spark, self.path)
            fs.delete(at(f"{self.path}/{folder}"), True)
            raise Conflict(f"segment {number} is another writer's")
        if full:
            self._expire()
        return True

    def _expire(self) -> None:
        """Deletes the segments before the last full one but one, which readers that began with that don't need."""
        at, fs = storage.filesystem(self.spark, self.path)
        told = [json.loads(storage.text_at(self.spark, f"{self.path}/segments/{name}")) for name in storage.names_in(self.spark, f"{self.path}/segments")]
        fulls = [i for i, s in enumerate(told) if s["full"]]
        for s in told[: fulls[-2]] if len(fulls) > 1 else []:
            fs.delete(at(f"{self.path}/{s['folder']}"), True)

    def current(self, table: DataFrame) -> bool:
        """Whether the index holds the table's rows as they are."""
        segments = self._segments()
        if not segments:
            return False
        now = table.select(F.col(self.key).alias("key"), F.xxhash64(*self.columns).alias("now"))
        return now.join(self._indexed(segments), "key", "full").where(~F.col("now").eqNullSafe(F.col("old_h"))).isEmpty()

    def _held(self, tree, segments: list[dict]) -> tuple[DataFrame, dict]:
        """(key, n, a column of places per word of the query), and the columns' names by (word, whether it's a prefix)."""
        slots: dict[tuple[str, bool], str] = {}
        for x in search.leaves(tree):
            for i, w in enumerate(x.words):
                slots.setdefault((w, x.prefix and i == len(x.words) - 1), f"__s{len(slots)}")
        asked = {k: F.col("token").startswith(k[0]) if k[1] else F.col("token") == k[0] for k in slots}
        found = self._read(segments, "postings").where(functools.reduce(lambda a, b: a | b, asked.values()))
        if len(segments) > 1:
            later = self._read(segments[1:], "rows").groupBy(F.col("key").alias("__k")).agg(F.max("segment").alias("__last"))
            found = found.join(later, F.col("key") == F.col("__k"), "left").where("__last is null or segment >= __last")
        places = [F.flatten(F.collect_list(F.when(asked[k], F.col("at")))).alias(name) for k, name in slots.items()]
        return found.groupBy("key").agg(F.first("n").alias("n"), *places), slots

    def _starts(self, term: search.Phrase, slots: dict) -> Column:
        """The places at which a phrase begins."""
        found = None
        for i, w in enumerate(term.words):
            at = F.col(slots[w, term.prefix and i == len(term.words) - 1])
            moved = _moved(at, -i) if i else at
            found = moved if found is None else F.array_intersect(found, moved)
        if term.columns is not None:
            within = [i for i, c in enumerate(self.columns) if c.lower() in term.columns]
            found = F.filter(found, lambda p: F.shiftright(p, _COLUMN).isin(within))
        return F.filter(found, lambda p: p.bitwiseAND(F.lit((1 << _COLUMN) - 1)) == 0) if term.first else found

    def ranked(self, tree) -> DataFrame:
        """(key, rank) of the rows that match: negated BM25 over the whole index, the lower the better."""
        terms = list(dict.fromkeys(x for x in search.leaves(tree) if x.words))
        segments = self._segments()
        if not segments:
            raise ValueError(f"{self.path} holds no index yet: refresh() it")
        if not terms:
            return self._read(segments, "rows").select("key", F.lit(0.0).alias("rank")).where("false")
        held, slots = self._held(tree, segments)
        names = {t: f"__b{i}" for i, t in enumerate(terms)}
        rows = held.select("key", "n", *(self._starts(t, slots).alias(name) for t, name in names.items()))
        stats = rows.agg(*(F.count_if(F.size(name) > 0).alias(f"__d{i}") for i, name in enumerate(names.values())))
        found = rows.where(_matches(tree, names)).join(F.broadcast(stats))  # stats is one row
        count, mean, score = segments[-1]["rows"], segments[-1]["tokens"] / max(1, segments[-1]["rows"]), F.lit(0.0)
        for i, name in enumerate(names.values()):
            f, d = F.size(name).cast("double"), F.col(f"__d{i}")
            idf = F.greatest(F.log((F.lit(count) - d + 0.5) / (d + 0.5)), F.lit(search.IDF_FLOOR))
            score = score + idf * f * (search.K1 + 1) / (f + search.K1 * (1 - search.B + search.B * F.col("n") / F.lit(mean)))
        return found.select("key", (-score).alias("rank"))

    def hits(self, table: DataFrame, tree) -> DataFrame:
        """The rows of the table that match, with `rank`."""
        return table.join(self.ranked(tree).withColumnRenamed("key", "__key"), F.col(self.key) == F.col("__key")).drop("__key")


def _matches(tree, names: dict) -> Column:
    if isinstance(tree, search.Op):
        left, right = _matches(tree.left, names), _matches(tree.right, names)
        return left & ~right if tree.name == "not" else left & right if tree.name == "and" else left | right
    if isinstance(tree, search.Near):
        return functools.reduce(lambda a, b: a | b, (_in_order(order, tree.distance, names) for order in itertools.permutations(tree.phrases)))
    return F.size(names[tree]) > 0 if tree.words else F.lit(False)


def _in_order(phrases: tuple, distance: int, names: dict) -> Column:
    """Whether the phrases stand in this order, at most `distance` tokens between one and the next."""
    ends = None
    for x in phrases:
        starts = F.col(names[x])
        if ends is not None:
            starts = _close(starts, ends, distance)
        ends = _moved(starts, len(x.words))
    return F.size(ends) > 0


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p + by)


def _close(starts: Column, ends: Column, distance: int) -> Column:
    """The starts that come at most `distance` tokens after one of the ends."""
    return F.filter(starts, lambda s: F.exists(ends, lambda e: (s >= e) & (s - e <= distance)))
