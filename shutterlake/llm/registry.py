"""The queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from . import chat, fingerprint, langid, linededup, ngram_join, packing, pieces, sharding, topk, warc
from .common import table


def queries():
    return {
        "op1_fingerprint": lambda spark, d: fingerprint.op1(table(spark, d, "documents")),
        "op2_packing": lambda spark, d: packing.op2(table(spark, d, "documents")),
        "op3_linededup": lambda spark, d: linededup.op3(table(spark, d, "documents")),
        "op4_ngram_join": lambda spark, d: ngram_join.op4(table(spark, d, "documents")),
        "op5_sharding": lambda spark, d: sharding.op5(table(spark, d, "documents")),
        "op6_warc": lambda spark, d: warc.op6(spark, table(spark, d, "pages")),
        "op7_langid": lambda spark, d: langid.op7(table(spark, d, "documents")),
        "op8_pieces": lambda spark, d: pieces.op8(table(spark, d, "documents")),
        "op9_topk": lambda spark, d: topk.op9(table(spark, d, "embeddings")),
        "op10_chat": lambda spark, d: chat.op10(table(spark, d, "conversations")),
    }


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS first FROM p),
g AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(hex, k * 5 + 1, 5))::INTEGER) AS n FROM d)
SELECT page_id, strlen(h) AS payload_bytes,
  list_aggregate(list_transform(n, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id)::INTEGER AS rank, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
QUALIFY rank <= 5
"""


def chat_sql() -> str:
    escaped = "length(regexp_replace({}, '([<\\[])(\\\\*)(" + chat.CONTROL + ")', '\\1\\\\\\2\\3', 'g'))"
    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
WITH rows_ AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(n, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + {escaped.format("role")} + {escaped.format("text")})::BIGINT AS formatted_chars,
  '{chat.fingerprint(["turn", "role", "text"])}' AS layout
FROM rows_ GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": WARC_SQL, "op9_topk": TOP_K_SQL, "op10_chat": chat_sql()}
