"""Full-text search: tokenizer, query language, BM25, snippets.

A row's tokens are kept as one blank-separated string, so that a term, a prefix or a phrase
is a pattern over it and its frequency a native count. Matching and ranking are one scan and
one aggregate (row count, mean length, rows per phrase) whose single row is joined back; no
row leaves the JVM and nothing is exploded. Statistics are those of the whole table: scope
filters come after matching.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import predicates as p

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
WORD = r"[\p{L}\p{N}\p{Co}]+"


@functools.cache
def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the letters without: by Unicode decomposition."""
    pairs = []
    for c in itertools.chain(range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and not any(unicodedata.category(x) == "Mn" for x in base[:1]):
            pairs.append((chr(c), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text) -> Column:
    source, target = _folds()
    return F.lower(F.translate(F.regexp_replace(p.as_column(text), r"[̀-ͯ]", ""), source, target))


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def tokens(text) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(p.as_column(text), F.lit(""))), F.lit(WORD), F.lit(0))


def words_of(text: str) -> list[str]:
    return [fold(m) for m in re.findall(r"[^\W_]+", text)]


@dataclass(frozen=True)
class Phrase:
    """Consecutive words, the last one perhaps a prefix; `first`: at a column's beginning only; `columns`: in these only."""

    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: frozenset[str] | None = None

    def pattern(self) -> str:
        return "^" * self.first + "".join(f" {w}" for w in self.words) + ("[^ ]*" if self.prefix else "") + "(?= )"

    def counted(self) -> str:
        """A pattern found once for each place at which the phrase begins, places that overlap too."""
        return self.pattern() if len(self.words) < 2 else f"(?={self.pattern()})"


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int
    columns: frozenset[str] | None = None

    def pattern(self) -> str:
        gap = rf"(?: [^ ]+){{0,{self.distance}}}"
        bodies = [[f"{''.join(f' {w}' for w in x.words)}{'[^ ]*' if x.prefix else ''}" for x in order] for order in itertools.permutations(self.phrases)]
        return "(?:" + "|".join(gap.join(b) for b in bodies) + ")(?= )"


@dataclass(frozen=True)
class Op:
    name: str
    left: object
    right: object


class QuerySyntaxError(ValueError):
    pass


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()*+:^,{}-])|([^\s"()*+:^,{}-]+))')


def within_columns(tree, columns: frozenset[str]):
    """The tree, looked for in these columns only."""
    if isinstance(tree, Op):
        return Op(tree.name, within_columns(tree.left, columns), within_columns(tree.right, columns))
    if isinstance(tree, Near):
        tree = replace(tree, phrases=tuple(within_columns(x, columns) for x in tree.phrases))
    return replace(tree, columns=columns if tree.columns is None else tree.columns & columns)


class _Parser:
    def __init__(self, text: str, columns: tuple[str, ...] = ()):
        self.columns = tuple(c.lower() for c in columns)
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise QuerySyntaxError(text[at:])
            if m[1] is not None:
                self.items.append(("string", m[1].replace('""', '"')))
            elif m[2]:
                self.items.append((m[2], m[2]))
            else:
                if not re.fullmatch(r"[\w\u0080-\U0010ffff\x1a]+", m[3]):
                    raise QuerySyntaxError(m[3])
                self.items.append(("word", m[3]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else ("end", "")

    def take(self, kind: str):
        item = self.peek()
        if item[0] != kind:
            raise QuerySyntaxError(f"expected {kind}")
        self.at += 1
        return item[1]

    def parse(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise QuerySyntaxError("unexpected text")
        return tree

    def either(self):
        left = self.both()
        while self.peek() == ("word", "OR"):
            self.at += 1
            left = Op("or", left, self.both())
        return left

    def both(self):
        left = self.without()
        while self.peek() == ("word", "AND"):
            self.at += 1
            left = Op("and", left, self.without())
        return left

    def without(self):
        left = self.series()
        while self.peek() == ("word", "NOT"):
            self.at += 1
            left = Op("not", left, self.series())
        return left

    def series(self):
        left = self.unit()
        while self.peek()[0] in ("word", "string", "(", "^", "{", "-") and self.peek()[1] not in ("OR", "AND", "NOT"):
            left = Op("and", left, self.unit())
        return left

    def unit(self):
        if self.peek()[0] == "(":
            self.at += 1
            tree = self.either()
            self.take(")")
            return tree
        if self.peek()[0] in ("-", "{") or (self.peek()[0] in ("word", "string") and self.peek(1)[0] == ":"):
            return self.in_columns()
        if self.peek()[0] == "^":
            self.at += 1
            return replace(self.phrase(), first=True)
        if self.peek() == ("word", "NEAR") and self.peek(1)[0] == "(":
            return self.near()
        return self.phrase()

    def in_columns(self):
        """`name : x`, `{a b} : x`, and with a minus before it, all other columns."""
        but = self.peek()[0] == "-"
        self.at += but
        names = []
        if self.peek()[0] == "{":
            self.at += 1
            while self.peek()[0] in ("word", "string"):
                names.append(self.take(self.peek()[0]))
            self.take("}")
        else:
            names.append(self.take("string" if self.peek()[0] == "string" else "word"))
        self.take(":")
        names = [x.lower() for x in names]
        if unknown := [x for x in names if x not in self.columns]:
            raise QuerySyntaxError(f"no such column: {unknown[0]}")
        return within_columns(self.unit(), frozenset(c for c in self.columns if (c in names) != but))

    def near(self):
        self.at += 2
        found, distance = [], 10
        while self.peek()[0] in ("word", "string"):
            found.append(self.phrase())
        if self.peek()[0] == ",":
            self.at += 1
            distance = int(self.take("word"))
        self.take(")")
        if not found or len(found) > 5:
            raise QuerySyntaxError("NEAR takes one to five phrases")
        found = [x for x in found if x.words]
        return Near(tuple(found), distance) if found else Phrase(())

    def phrase(self):
        words = []
        while True:
            kind, text = self.peek()
            if kind not in ("word", "string") or (kind == "word" and text in ("AND", "OR", "NOT")):
                raise QuerySyntaxError("expected a phrase")
            self.at += 1
            words += words_of(text)
            if self.peek()[0] != "+":
                break
            self.at += 1
        star = self.peek()[0] == "*"
        self.at += star
        return Phrase(tuple(words), star)


def parse(text: str, columns: tuple[str, ...] = ("uuid", "session_id", "text")):
    """The query's tree: phrases, prefixes, ^, column filters, NEAR, AND, OR, NOT, parentheses; raises QuerySyntaxError, also for a column that isn't one of `columns`."""
    return _Parser(text, columns).parse()


def safe_query(text: str, joiner: str = "and"):
    """The first 12 words as plain terms; None if there is none."""
    terms = [Phrase((w,)) for w in words_of(text)[:12]]
    return functools.reduce(lambda a, b: Op(joiner, a, b), terms) if terms else None


def leaves(tree) -> list:
    if isinstance(tree, Op):
        return [*leaves(tree.left), *leaves(tree.right)]
    return list(tree.phrases) if isinstance(tree, Near) else [tree]


def _matches(tree, texts: dict[str, Column]) -> Column:
    if isinstance(tree, Op):
        left, right = _matches(tree.left, texts), _matches(tree.right, texts)
        return left & ~right if tree.name == "not" else left & right if tree.name == "and" else left | right
    if isinstance(tree, Phrase) and not tree.words:
        return F.lit(False)
    return functools.reduce(lambda a, b: a | b, (t.rlike(tree.pattern()) for t in _where(tree, texts)), F.lit(False))


def _where(term, texts: dict[str, Column]) -> list[Column]:
    """The token strings that a term may stand in; columns that hold no tokens aren't among them."""
    return [t for c, t in texts.items() if term.columns is None or c.lower() in term.columns]


def ranked(table: DataFrame, tree, *columns: str) -> DataFrame:
    """The rows of table that match, with `rank`: negated BM25, the lower the better."""
    terms = list(dict.fromkeys(x for x in leaves(tree) if x.words))
    texts = {c: F.col(f"__text{i}") for i, c in enumerate(columns)}
    rows = table.withColumns({f"__tokens{i}": tokens(c) for i, c in enumerate(columns)}).withColumn("__n", functools.reduce(lambda a, b: a + b, (F.size(f"__tokens{i}") for i in range(len(columns)))))
    rows = rows.withColumns({f"__text{i}": F.concat(F.lit(" "), F.array_join(f"__tokens{i}", " "), F.lit(" ")) for i in range(len(columns))}).drop(*(f"__tokens{i}" for i in range(len(columns))))
    for i, t in enumerate(terms):
        rows = rows.withColumn(f"__f{i}", functools.reduce(lambda a, b: a + b, (F.regexp_count(x, F.lit(t.counted())) for x in _where(t, texts)), F.lit(0)))
    stats = rows.agg(F.count("*").alias("__rows"), F.avg("__n").alias("__mean"), *(F.count_if(F.col(f"__f{i}") > 0).alias(f"__d{i}") for i in range(len(terms))))
    found = rows.where(_matches(tree, texts)).join(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"__f{i}").cast("double"), F.col(f"__d{i}")
        idf = F.greatest(F.log((F.col("__rows") - d + 0.5) / (d + 0.5)), F.lit(IDF_FLOOR))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__n") / F.col("__mean")))
    return found.withColumn("rank", -score).select(*table.columns, "rank")


def _tree(text: str):
    try:
        return parse(text)
    except (QuerySyntaxError, ValueError):
        return safe_query(text)


def search(
    messages: DataFrame, sessions: DataFrame, text: str, limit: int | None = None, session_id: str | None = None, project: str | None = None, project_path: str | None = None, after: str | None = None,
    before: str | None = None, cwd: str | None = None, source: str | None = None, include_meta: bool = False, include_inactive: bool = False, snippet_tokens: int | None = None, fallback: str | None = None, index=None,
) -> DataFrame:
    """The best hits with their session, by a scan or by a `search_index.Index` of the messages' text; see `tools.neighbours_in_time` for what surrounds them."""
    n = p.limit_of(limit, 20)
    if snippet_tokens is not None and not 1 <= snippet_tokens <= 64:
        raise ValueError("search() snippet_tokens must be from 1 to 64")

    def run(tree) -> DataFrame:
        s = sessions.select(F.col("id").alias("session_id"), "title", "project", "project_path", "started_at", F.col("source").alias("session_source"))
        if tree is None:
            return messages.withColumn("rank", F.lit(0.0)).join(s, "session_id", "left").where("false")
        found = (ranked(messages, tree, "text") if index is None else index.hits(messages, tree)).join(s, "session_id", "left").where(p.is_visible(include_inactive=include_inactive))
        if not include_meta:
            found = found.where(p.not_meta())
        for c in p.scope({"session_id": "session_id", "project": "project", "timestamp": "timestamp"}, session_id=session_id, project=project, after=after, before=before):
            found = found.where(c)
        if project_path is not None:
            found = found.where(F.col("project_path") == project_path)
        if cwd is not None:
            found = found.where(p.like_nocase("cwd", cwd))
        return found.where(p.source_is(source, "source", "session_source"))

    tree = _tree(text)
    found = run(tree).orderBy("rank", "uuid").limit(n)
    if fallback == "or" and found.isEmpty():
        tree = safe_query(text, "or")
        found = run(tree).orderBy("rank", "uuid").limit(n)
    if snippet_tokens is not None and tree is not None:
        found = found.withColumn("text_length", F.length("text")).withColumn("text", snippet(tree, snippet_tokens)("text")).withColumn("is_snippet", F.lit(True))
    return found


def snippet(tree, size: int):
    """A pandas UDF for the few rows of a page: the window of `size` tokens with the most different terms, then the most terms."""
    terms = [x for x in leaves(tree) if x.words]

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: best_window(t, terms, size))

    return cut


def best_window(text: str | None, terms: list[Phrase], size: int) -> str | None:
    if text is None:
        return None
    spans = [(m.start(), m.end(), fold(m[0])) for m in re.finditer(r"[^\W_]+", text)]
    if len(spans) <= size:
        return text
    hits: list[tuple[int, int, int]] = []
    for k, term in enumerate(terms):
        w = len(term.words)
        for i in range(len(spans) - w + 1):
            own = [spans[i + j][2] for j in range(w)]
            if own[:-1] == list(term.words[:-1]) and (own[-1].startswith(term.words[-1]) if term.prefix else own[-1] == term.words[-1]):
                hits.append((i, i + w, k))
    best, at = (-1, 0), 0
    for start in sorted({0, *(max(0, min(h[0], len(spans) - size)) for h in hits)}):
        inside = [h for h in hits if h[0] >= start and h[1] <= start + size]
        value = (len({h[2] for h in inside}), len(inside))
        if value > best:
            best, at = value, start
    low = spans[at][0] if at else 0
    high = spans[at + size - 1][1] if at + size < len(spans) else len(text)
    return ("…" if at else "") + text[low:high] + ("…" if at + size < len(spans) else "")


def search_memories(memories: DataFrame, sessions: DataFrame, text: str, limit: int | None = None, index=None, **scope) -> DataFrame:
    """Active memories by safe-term AND over path and summary, best first, then newest; `index`: as in search()."""
    from tracelake.operators import memories as m

    m.assert_english(text, "memories() query")
    tree = safe_query(text)
    if tree is None:
        return memories.withColumn("rank", F.lit(0.0)).where("false")
    found = (ranked(memories, tree, "path", "summary") if index is None else index.hits(memories, tree)).where("deleted_at is null")
    columns = {"session_id": "session_id", "project": "project", "timestamp": "created_at"}
    if any(scope.get(k) for k in ("branch", "source")):
        found = found.join(sessions.select(F.col("id").alias("session_id"), "git_branch", F.col("source").alias("session_source")), "session_id", "left")
        columns |= {"branch": "git_branch", "source": "session_source"}
    for c in p.scope(columns, **scope):
        found = found.where(c)
    return found.select(*memories.columns, "rank").orderBy("rank", F.desc_nulls_last("created_at"), "id").limit(p.limit_of(limit, 50))


def postings(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """(token, key, tf, n): an inverted index to write out, clustered by token."""
    every = functools.reduce(F.concat, [tokens(c) for c in columns]) if len(columns) > 1 else tokens(columns[0])
    rows = table.select(F.col(key).alias("key"), every.alias("t")).select("key", F.size("t").alias("n"), F.explode("t").alias("token"))
    return rows.groupBy("token", "key").agg(F.count("*").alias("tf"), F.first("n").alias("n"))


def invoking_session(messages: DataFrame, calls: DataFrame, nonce: str, collision: str = "10 seconds") -> DataFrame:
    """At most one row: the session that holds the nonce last, unless another held it at nearly the same time."""
    own = messages.where(F.contains(F.coalesce("text", F.lit("")), F.lit(nonce))).select("session_id", "timestamp")
    tools = calls.where(p.literal_in("input_json", nonce)).join(messages.select(F.col("uuid").alias("message_uuid"), "timestamp"), "message_uuid").select("session_id", "timestamp")
    last = own.union(tools).groupBy("session_id").agg(F.max("timestamp").alias("at")).where("at is not null")
    top = last.orderBy(F.desc("at"), "session_id").limit(2)
    rolled = top.agg(F.max(F.struct("at", "session_id")).alias("a"), F.min("at").alias("second"), F.count("*").alias("n"))
    apart = F.try_to_timestamp("a.at") - F.try_to_timestamp("second") > F.expr(f"interval {collision}")
    return rolled.where((F.col("n") == 1) | apart).select("a.session_id", "a.at")
