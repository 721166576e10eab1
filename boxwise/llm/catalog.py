"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import importlib.util
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.llm import bpe, decontaminate, divergence, edit_embedding, forest, jaccard_join, kneser_ney, langid, quotes, repair, substrings, surrogates, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: The key of surrogates; a real run passes its own in BOXWISE_KEY.
KEY = os.environ.get("BOXWISE_KEY", "boxwise-default-key").encode()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers lie; BOXWISE_TOKENIZERS names another folder."""
    folder = os.environ.get("BOXWISE_TOKENIZERS")
    if folder is None:
        folder = os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), bpe.tokenizer_text(spark, vocabulary_path()))


@query
def op1_edit_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return edit_embedding.fingerprint_with_next(table(spark, folder, "documents"))


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(out, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op7_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace(table(spark, folder, "documents"), KEY).select("doc_id", "n_entities", "text")


@query
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read(spark, warc.archive(table(spark, folder, "pages")))


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest, CAST(greatest(1, ceil(strlen(h) / 65536e0)) AS BIGINT) AS c FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest),
r AS (SELECT d.*, CASE WHEN f.first < d.page_id THEN f.first END AS refers FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
 refers AS refers_to, CASE WHEN refers IS NULL THEN c ELSE 1 END AS n_chunks FROM r
"""


@query
def op8_quotations(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(table(spark, folder, "conversations")).drop("text")


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


@query
def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.duplicates(table(spark, folder, "documents"))


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, CAST(sum(n) AS HUGEINT) + count(*) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
w AS (SELECT g.lang, g.source, coalesce(x.n, 0) + coalesce(v.v, 0) AS whole FROM g LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL) x USING (lang, source)
 LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) v USING (lang)),
p AS (SELECT w.lang, w.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // w.whole AS p, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // l.whole AS q
 FROM w JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = w.lang AND c.source = w.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
 ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repairs(table(spark, folder, "conversations"))


ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS label FROM conversations),
-- CRC-32 by bits: every character of a label is ASCII; -1 shifts a bit out
h AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(label, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
 lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS fate FROM c),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
 unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(text), copy) AS pos,
 right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS final FROM d),
f AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
 WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- the cheapest edits to each state, as six digits of cost and the audit; null is out of reach
w AS (SELECT conv_id, 0 AS pos, '000000' AS d0, CAST(NULL AS VARCHAR) AS d1, '000002I' AS d2, '000004II' AS d3 FROM s
 UNION ALL SELECT m.conv_id, m.pos, n0, n1, least(n2, {n0+2I}, {n1+2I}, {n3+2I}), least(n3, {n2+2I}, {n0+4II}, {n1+4II})
 FROM (SELECT w.conv_id, f.pos, {d0+3D} AS n0, least({d1+3D}, CASE WHEN k AND i = 's' THEN {d0+tK} END) AS n1,
  least({d2+3D}, CASE WHEN k AND i = 'u' THEN least({d0+tK}, {d1+tK}, {d3+tK}) END, CASE WHEN k THEN least({d0+rR}, {d1+rR}, {d3+rR}) END) AS n2,
  least({d3+3D}, CASE WHEN k AND i = 'a' THEN {d2+tK} END, CASE WHEN k THEN {d2+rR} END) AS n3
  FROM w JOIN (SELECT conv_id, pos, left(role, 1) AS i, fault IS NULL OR fault = 'truncated' AS k, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END AS r FROM f) f
  ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1) m),
b AS (SELECT conv_id, least(arg_max(d0, pos), arg_max(d3, pos)) AS best FROM w GROUP BY conv_id),
-- the edits once more, now with their lines
e AS (SELECT conv_id, substr(best, 7) AS audit, 0 AS k, 0 AS pos, 0 AS state, CAST(NULL AS VARCHAR) AS line FROM b
 UNION ALL SELECT e.conv_id, e.audit, e.k + 1, e.pos + CASE WHEN x = 'I' THEN 0 ELSE 1 END,
 CASE WHEN x = 'D' THEN state WHEN x = 'K' AND left(f.role, 1) = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
 CASE x WHEN 'D' THEN NULL WHEN 'K' THEN f.role || ':' || f.text ELSE CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN x = 'R' THEN f.text ELSE '' END END
 FROM (SELECT *, substr(audit, k + 1, 1) AS x FROM e WHERE k < length(audit)) e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos + 1),
r AS (SELECT conv_id, any_value(audit) AS audit, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS hash FROM e GROUP BY conv_id)
SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
 CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(best, 6), '0') AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id
"""
ORACLES["op11_conversation_repair"] = re.sub(
    r"\{(\w\d)\+(\w)(\w+)\}", r"lpad(CAST(CAST(left(\1, 6) AS INT) + \2 AS VARCHAR), 6, '0') || substr(\1, 7) || '\3'", ORACLES["op11_conversation_repair"]
)


@query
def op13_embedding_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(table(spark, folder, "embeddings"))


ORACLES["op13_embedding_forest"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT r, r AS s FROM v UNION SELECT c.r, l.y FROM c JOIN l ON l.x = c.s),
m AS (SELECT c.r, min(o.vec_id) AS component_id FROM c JOIN v o ON o.r = c.s GROUP BY c.r)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m ON m.r = v.r
"""
