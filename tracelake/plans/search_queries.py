"""Registered queries: full-text search and what surrounds a hit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import storage
from tracelake.operators import search as x
from tracelake.operators import tools
from tracelake.operators.search_index import Index
from tracelake.plans.registry import query


def _bm25(source: str, key: str, text: str, terms: list[str]) -> str:
    """CTEs toks, stats and ranked (key, hits, rank) of single terms; patterns are matched on the token string."""
    patterns = ", ".join(f"len(list_filter(t, lambda w: w = '{w}')) AS f{i}" for i, w in enumerate(terms))
    counts = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((r - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    return f"""toks AS (SELECT *, len(t) AS n, {patterns} FROM (SELECT *, regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source})),
    stats AS (SELECT count(*) AS r, avg(n) AS mean, {counts} FROM toks),
    ranked AS (SELECT toks.*, -({part}) AS rank FROM toks, stats)"""


_VIEW = "coalesce(visibility, 'visible') = 'visible' AND coalesce(is_meta, 0) = 0"
_HITS = f"hits AS (SELECT uuid, ranked.session_id, timestamp, rank FROM ranked LEFT JOIN sessions s ON s.id = ranked.session_id WHERE f0 > 0 AND f1 > 0 AND {_VIEW} ORDER BY rank, uuid LIMIT 20)"
_MS = ("messages", "sessions")


@query("X1_search", f", {_bm25('messages', 'uuid', 'text', ['the', 'and'])}, {_HITS} SELECT uuid, session_id, timestamp, round(rank, 6) AS rank FROM hits", _MS)
def x1(t):
    return x.search(t.messages, t.sessions, "The AND and").select("uuid", "session_id", "timestamp", F.round("rank", 6).alias("rank"))


@query("X2_search_boolean", f", {_bm25('messages', 'uuid', 'text', ['die', 'der', 'the'])} SELECT uuid, round(rank, 6) AS rank FROM ranked WHERE (f0 > 0 OR f2 > 0) AND NOT f1 > 0 AND {_VIEW} ORDER BY ranked.rank, uuid LIMIT 50", ("messages",))
def x2(t):
    return x.search(t.messages, t.sessions, "(die OR the) NOT der", limit=50).select("uuid", F.round("rank", 6).alias("rank"))


@query("X2_search_phrase_prefix", """, toks AS (SELECT uuid, visibility, is_meta, concat(' ', array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' '), ' ') AS t FROM messages)
    SELECT uuid FROM toks WHERE contains(t, ' of the ') AND regexp_matches(t, ' an[^ ]* ') AND coalesce(visibility, 'visible') = 'visible' AND coalesce(is_meta, 0) = 0""", ("messages",))
def x2p(t):
    return x.search(t.messages, t.sessions, '"of the" an*', limit=100_000_000).select("uuid")


@query("X2_search_columns", """, toks AS (SELECT uuid, visibility, is_meta, concat(' ', array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' '), ' ') AS t FROM messages)
    SELECT uuid FROM toks WHERE (starts_with(t, ' the ') OR contains(t, ' die ')) AND coalesce(visibility, 'visible') = 'visible' AND coalesce(is_meta, 0) = 0""", ("messages",))
def x2c(t):
    """Column filters and beginnings: only `text` holds tokens, so what is asked of other columns finds nothing."""
    return x.search(t.messages, t.sessions, '^the OR {text uuid} : die OR - text : the OR uuid : and', limit=100_000_000).select("uuid")


_NEAR = """near AS (SELECT h.uuid AS hit, m.uuid, m.timestamp, m.ingest_seq, row_number() OVER (PARTITION BY h.uuid ORDER BY abs(epoch_us(cast(m.timestamp AS TIMESTAMP)) - epoch_us(cast(h.timestamp AS TIMESTAMP))) NULLS FIRST, m.ingest_seq) AS k
    FROM hits h JOIN messages m ON m.session_id = h.session_id AND m.uuid <> h.uuid WHERE coalesce(m.visibility, 'visible') = 'visible' AND coalesce(m.is_meta, 0) = 0)"""


@query("X3_J12_W2_search_context", f", {_bm25('messages', 'uuid', 'text', ['the', 'and'])}, {_HITS}, {_NEAR} SELECT hit, row_number() OVER (PARTITION BY hit ORDER BY timestamp NULLS FIRST, ingest_seq)::INTEGER AS k, uuid, timestamp FROM near WHERE k <= 6", _MS)
def x3(t):
    return tools.neighbours_in_time(x.search(t.messages, t.sessions, "the and"), t.messages)


def _messages_index(t) -> Index:
    index = Index(t.spark, storage.scratch(t.spark), "uuid", "text")
    index.refresh(t.messages)
    return index


@query("X1_stored_index", f", {_bm25('messages', 'uuid', 'text', ['the', 'and'])}, {_HITS} SELECT uuid, session_id, timestamp, round(rank, 6) AS rank FROM hits", _MS)
def x1_stored(t):
    return x.search(t.messages, t.sessions, "the and", index=_messages_index(t)).select("uuid", "session_id", "timestamp", F.round("rank", 6).alias("rank"))


@query("X2_stored_phrase_prefix", """, toks AS (SELECT uuid, visibility, is_meta, concat(' ', array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' '), ' ') AS t FROM messages)
    SELECT uuid FROM toks WHERE ((contains(t, ' of the ') AND regexp_matches(t, ' an[^ ]* ')) OR starts_with(t, ' die ')) AND coalesce(visibility, 'visible') = 'visible' AND coalesce(is_meta, 0) = 0""", ("messages",))
def x2_stored(t):
    return x.search(t.messages, t.sessions, '("of the" an*) OR ^die', limit=100_000_000, index=_messages_index(t)).select("uuid")


@query("X5_stored_memories", f", {_bm25('memories', 'id', chr(39) + chr(39) + ' || path || chr(32) || summary', ['the', 'src1'])} SELECT id, created_at, round(rank, 6) AS rank FROM ranked WHERE f0 > 0 AND f1 > 0 AND deleted_at IS NULL ORDER BY ranked.rank, created_at DESC, id LIMIT 50", ("memories",))
def x5_stored(t):
    index = Index(t.spark, storage.scratch(t.spark), "id", "path", "summary")
    index.refresh(t.memories)
    return x.search_memories(t.memories, t.sessions, "the src1", index=index).select("id", "created_at", F.round("rank", 6).alias("rank"))


@query("M13_index_refresh", f", {_bm25('messages', 'uuid', 'text', ['the', 'die'])} SELECT uuid, round(rank, 6) AS rank FROM ranked WHERE f0 > 0 OR f1 > 0", ("messages",))
def m13(t):
    """An index of an earlier state, in which rows had other texts, were missing or have gone since, brought to the present one."""
    index = Index(t.spark, storage.scratch(t.spark), "uuid", "text")
    kind = F.pmod(F.xxhash64("uuid"), F.lit(4))
    before = t.messages.where(kind != 0).withColumn("text", F.when(kind == 1, F.concat(F.lit("the die "), "text")).otherwise(F.col("text")))
    index.refresh(before.unionByName(before.withColumn("uuid", F.concat("uuid", F.lit("-gone")))))
    index.refresh(t.messages)
    return index.ranked(x.parse("the OR die")).select(F.col("key").alias("uuid"), F.round("rank", 6).alias("rank"))


_SNIPPETS = """, page AS (SELECT h.uuid, m.text, regexp_extract_all(m.text, '[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]+') AS parts FROM hits h JOIN messages m USING (uuid)),
    cells AS (SELECT uuid, unnest(parts) AS part, unnest(range(len(parts))) AS i, len(parts) AS n FROM page),
    words AS (SELECT uuid, i, n, regexp_extract(part, '[\\p{L}\\p{N}]+$') AS w, sum(length(part)) OVER (PARTITION BY uuid ORDER BY i) AS stop FROM cells),
    terms AS (SELECT *, strip_accents(lower(w)) AS word FROM words WHERE strip_accents(lower(w)) IN ('the', 'and')),
    starts AS (SELECT uuid, 0 AS s FROM page UNION SELECT uuid, greatest(0, least(i, n - 12)) FROM terms),
    valued AS (SELECT s.uuid, s.s, count(DISTINCT t.word) AS different, count(t.word) AS every FROM starts s LEFT JOIN terms t ON t.uuid = s.uuid AND t.i >= s.s AND t.i < s.s + 12 GROUP BY 1, 2),
    best AS (SELECT uuid, s FROM valued QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY different DESC, every DESC, s) = 1),
    cuts AS (SELECT p.uuid, p.text, len(p.parts) AS n, b.s, CASE WHEN b.s > 0 THEN l.stop - length(l.w) ELSE 0 END::BIGINT AS low, CASE WHEN b.s + 12 < len(p.parts) THEN r.stop ELSE length(p.text) END::BIGINT AS high
      FROM page p JOIN best b USING (uuid) LEFT JOIN words l ON l.uuid = p.uuid AND l.i = b.s LEFT JOIN words r ON r.uuid = p.uuid AND r.i = b.s + 11)
    SELECT uuid, CASE WHEN n <= 12 THEN text ELSE concat(CASE WHEN s > 0 THEN '…' ELSE '' END, substring(text, low + 1, high - low), CASE WHEN s + 12 < n THEN '…' ELSE '' END) END AS text, length(text)::INTEGER AS text_length, true AS is_snippet FROM cuts"""


@query("X4_F19_snippets", f", {_bm25('messages', 'uuid', 'text', ['the', 'and'])}, {_HITS}{_SNIPPETS}", _MS)
def x4(t):
    return x.search(t.messages, t.sessions, "the and", snippet_tokens=12).select("uuid", "text", "text_length", "is_snippet")


@query("X5_memory_search", f", {_bm25('memories', 'id', chr(39) + chr(39) + ' || path || chr(32) || summary', ['the', 'src1'])} SELECT id, created_at, round(rank, 6) AS rank FROM ranked WHERE f0 > 0 AND f1 > 0 AND deleted_at IS NULL ORDER BY ranked.rank, created_at DESC, id LIMIT 50", ("memories",))
def x5(t):
    return x.search_memories(t.memories, t.sessions, "the src1").select("id", "created_at", F.round("rank", 6).alias("rank"))


@query("X6_tokenizer", "SELECT doc_id, w AS token, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS w FROM documents) GROUP BY 1, 2")
def x6(t):
    return x.postings(t.raw("documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "token", "tf")


@query("X7_A17_invoking_session", """, l AS (SELECT session_id, max(timestamp) AS seen FROM (SELECT session_id, timestamp FROM messages WHERE contains(text, 'ation') UNION ALL
    SELECT c.session_id, m.timestamp FROM tool_calls c JOIN messages m ON m.uuid = c.message_uuid WHERE contains(lower(c.input_json), 'ation')) GROUP BY 1 HAVING max(timestamp) IS NOT NULL),
    r AS (SELECT *, row_number() OVER (ORDER BY seen DESC, session_id) AS k, lead(seen) OVER (ORDER BY seen DESC, session_id) AS second FROM l)
    SELECT session_id, seen AS "at" FROM r WHERE k = 1 AND (second IS NULL OR cast(seen AS TIMESTAMP) - cast(second AS TIMESTAMP) > INTERVAL 10 SECOND)""", ("messages", "tool_calls"))
def x7(t):
    return x.invoking_session(t.messages, t.tool_calls, "ation")
