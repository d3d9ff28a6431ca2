"""Queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlquarry.llm import encoding, leaks, mainbody, near_duplicates, personal, repeated_lines, residue, stuffing, tokens
from crawlquarry.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Three words and 0.6 as TESTDATA states; 70 bands of 6 rows find a pair at 0.65 with a probability of 0.996.
P4 = near_duplicates.Settings(width=3, threshold=0.6, min_words=50, bands=70, rows=6)

#: Edits in twelve words that p9_passages allows; p9_found, whose definition asks for exact runs, looks one edit around them and then checks the run.
P9_EDITS, P9_Q, P9_FOUND_EDITS = 2, 12, 1


def p1_found(spark, d):
    return repeated_lines.repeated_lines(table(spark, d, "pages"), table(spark, d, "page_content")).select("url_hash", "line_no")


def p1_clean(spark, d):
    return repeated_lines.without_repeated_lines(table(spark, d, "pages"), table(spark, d, "page_content"))


def _p4(spark, d):
    texts = table(spark, d, "page_content").select(F.col("url_hash").alias("key"), F.col("content").alias("text"))
    return near_duplicates.near_duplicates(texts, P4)


def p4_found(spark, d):
    return near_duplicates.key_pairs(_p4(spark, d)).select(F.col("key_a").alias("url_hash_a"), F.col("key_b").alias("url_hash_b"))


def p4_groups(spark, d):
    return near_duplicates.duplicate_groups(_p4(spark, d)).withColumnRenamed("key", "url_hash")


def p2_found(spark, d):
    return p2_measures(spark, d).select("url_hash")


def p2_measures(spark, d):
    return stuffing.stuffed_pages(table(spark, d, "page_content"), table(spark, d, "pages"))


def p5_found(spark, d):
    return p5_reasons(spark, d).select("url_hash")


def p5_reasons(spark, d):
    return residue.residue(table(spark, d, "page_content"), table(spark, d, "pages"))


def p6_found(spark, d):
    content, pages = table(spark, d, "page_content"), table(spark, d, "pages")
    out = stuffing.stuffed_pages(content, pages).select("url_hash").unionByName(residue.residue(content, pages).select("url_hash"))
    return mainbody.site_lines(content, pages).join(out, "url_hash", "left_anti")


def p6_bodies(spark, d):
    return mainbody.main_bodies(table(spark, d, "page_content"), table(spark, d, "pages"))


def p7_found(spark, d):
    return p7_restored(spark, d).select("url_hash")


def p7_restored(spark, d):
    return encoding.garbled_pages(table(spark, d, "page_content"))


def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"), VOCABULARY)


def p9_found(spark, d):
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=P9_FOUND_EDITS).where("run >= 12").select("doc_id", "item_id")


def p9_passages(spark, d):
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), q=P9_Q, edits=P9_EDITS)


def p10_found(spark, d):
    return personal.personal_data(table(spark, d, "documents")).select("doc_id", "kind", "matched")


def p10_redacted(spark, d):
    documents = table(spark, d, "documents")
    return personal.redacted(documents, personal.personal_data(documents))


_P1_LINES = r"""
WITH h AS (SELECT url_hash, min(lower(host)) AS host FROM pages GROUP BY url_hash),
d AS (SELECT c.url_hash, h.host, c.content FROM page_content c JOIN h ON h.url_hash = c.url_hash),
n AS (SELECT host, count(*) AS n_pages FROM d GROUP BY host),
l AS (SELECT url_hash, host, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS line_no FROM d),
k AS (SELECT *, regexp_replace(lower(line), '[ \t0-9]', '', 'g') AS k FROM l),
f AS (SELECT host, k, count(DISTINCT url_hash) AS docs FROM k WHERE length(regexp_replace(k, '[^\p{L}]', '', 'g')) >= 4 GROUP BY host, k),
g AS (SELECT f.host, f.k, f.docs FROM f JOIN n ON n.host = f.host WHERE f.docs >= 5 AND f.docs * 10 >= n.n_pages)
"""

_P9_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))
SELECT DISTINCT dg.doc_id, ig.item_id FROM dg JOIN ig ON ig.g = dg.g"""

_SQL = {
    "p9_found": _P9_SQL,
    "p1_found": _P1_LINES + "SELECT k.url_hash, k.line_no FROM k JOIN g ON g.host = k.host AND g.k = k.k",
    "p1_clean": _P1_LINES
    + """, gone AS (SELECT k.url_hash, k.line_no FROM k JOIN g ON g.host = k.host AND g.k = k.k),
    r AS (SELECT url_hash, count(*) AS removed FROM gone GROUP BY url_hash),
    kept AS (SELECT k.url_hash, string_agg(k.line, chr(10) ORDER BY k.line_no) AS content FROM k
             WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.url_hash = k.url_hash AND gone.line_no = k.line_no) GROUP BY k.url_hash)
    SELECT c.url_hash, coalesce(kept.content, '') AS content, CAST(coalesce(r.removed, 0) AS INT) AS removed
    FROM page_content c LEFT JOIN kept ON kept.url_hash = c.url_hash LEFT JOIN r ON r.url_hash = c.url_hash""",
}

_QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p4_found, p4_groups, p2_found, p2_measures, p5_found, p5_reasons, p6_found, p6_bodies, p7_found, p7_restored, p8_ids, p9_found, p9_passages, p10_found, p10_redacted)}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
