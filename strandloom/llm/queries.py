"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import conversation_repair, decontaminate, embedding_dedup, html_text, lm_score, mixing, packing, secrets, simhash, token_counts, toxicity, url_filter
from strandloom.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, lexicon, keep=["doc_id"]).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_hits")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near_span=decontaminate.NEAR_SPAN)
    return decontaminate.digest(found)


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.mix(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_url_filter": op2_url_filter,
        "op3_html_text": op3_html_text,
        "op4_toxicity": op4_toxicity,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_lm_score": op6_lm_score,
        "op7_simhash": op7_simhash,
        "op8_secrets": op8_secrets,
        "op9_packing": op9_packing,
        "op10_decontamination": op10_decontamination,
        "op11_source_mixing": op11_source_mixing,
        "op12_conversation_repair": op12_conversation_repair,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP5 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE list_aggregate(embedding, 'count') = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.v FROM r JOIN l ON l.u = r.reach),
    c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id), n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

_OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    q AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, len(w[i:i + 9]) AS n FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
    x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM q) l, unnest(range(1, len(w) - n + 2)) u(i)),
    h AS (SELECT doc_id, i, n, item_id FROM x JOIN q USING (g, n)),
    p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id),
    k AS (SELECT DISTINCT item_id, list_sort(list_distinct(w[i:i + 9])) AS t FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
    o AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) u(p)), f AS (SELECT x, count(*) AS n FROM o GROUP BY x),
    a AS (SELECT t, arg_min(x, (n, x)) AS x FROM (SELECT DISTINCT t, unnest(t) AS x FROM k) JOIN f USING (x) GROUP BY t HAVING count(*) = len(t)),
    z AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM a JOIN k USING (t) JOIN o USING (x) JOIN d USING (doc_id), unnest(range(greatest(p - 19, 1), p + 1)) u(s) WHERE list_has_all(w[s:s + 19], t) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_near, 0) AS n_near, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN z USING (doc_id)"""

_OP11 = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        (CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
    s AS (SELECT source, source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
    f AS (SELECT *, row_number() OVER o AS i, (1.5::DOUBLE * sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(CAST(source_size AS DOUBLE) * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) * 2 / w, source NULLS LAST)),
    l AS (SELECT arg_min(level, i) AS level FROM f WHERE CAST(source_size AS DOUBLE) * 2 >= level * w),
    t AS (SELECT source, source_size, CASE WHEN CAST(source_size AS DOUBLE) * 2 < l.level * w THEN CAST(source_size AS DOUBLE) * 2 ELSE l.level * w END AS target FROM s, l),
    k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / CAST(source_size AS DOUBLE)) AS BIGINT) ELSE 0 END AS whole FROM t),
    z AS (SELECT g.source, size, target - whole * CAST(source_size AS DOUBLE) - CAST(coalesce(sum(m * size) OVER (PARTITION BY g.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS open,
        CAST(sum(m * size * size) OVER (PARTITION BY g.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS below
        FROM (SELECT source, size, count(*) AS m FROM d WHERE size > 0 GROUP BY source, size) g JOIN k ON k.source IS NOT DISTINCT FROM g.source),
    c AS (SELECT source, min(size) FILTER (open * size >= below) AS sure, arg_max(open / below, size) FILTER (open * size < below) AS c, arg_max(open, size) FILTER (open * size < below) AS left_words FROM z GROUP BY source),
    r AS (SELECT doc_id, d.source, size, source_size, target, whole, left_words, size >= coalesce(sure, size + 1) AS certain,
        CASE WHEN size > 0 AND c * size > 0 AND size < coalesce(sure, size + 1) THEN (u / (1 - u)) / ((c * size) / (1 - c * size)) END AS q FROM d JOIN k ON k.source IS NOT DISTINCT FROM d.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM d.source),
    o AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q / (1 + q), doc_id, size ROWS UNBOUNDED PRECEDING) - size END AS before FROM r)
    SELECT doc_id, size, source_size, target, whole + CAST(certain OR coalesce(before + size / 2.0::DOUBLE <= left_words, false) AS BIGINT) AS copies,
        (whole + CAST(certain OR coalesce(before + size / 2.0::DOUBLE <= left_words, false) AS BIGINT)) * size AS taken FROM o"""

_OP12 = """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
    k AS (SELECT *, coalesce('=' || conv_id, '') AS k, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
    d AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(place) + 1), lambda i: CAST(ascii(substr(place, i, 1)) AS BIGINT))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 20 AS draw FROM k, crc),
    e AS (SELECT k, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM d, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) u(copy) WHERE draw <> 0),
    n AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text)) AS i FROM e),
    f AS (SELECT *, lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
        WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM n),
    nxt(s, x, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    ins(s, m, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
    edit AS (SELECT DISTINCT m, 'D' AS letter, m AS t, 2 AS cost, NULL AS x FROM ins UNION ALL SELECT s, 'K', t, 0, x FROM nxt UNION ALL SELECT s, 'R', t, 1, NULL FROM nxt WHERE x <> 's'),
    walk AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit FROM f UNION ALL
        SELECT k, i + 1, t, best.cost, best.audit FROM (SELECT w.k, w.i, edit.t, min({'cost': w.cost + 5 * n + edit.cost + CASE WHEN fault = 3 AND letter <> 'D' THEN 5 ELSE 0 END, 'audit': w.audit || repeat('I', n) || letter}) AS best
            FROM walk w JOIN f ON f.k = w.k AND f.i = w.i + 1 JOIN ins ON ins.s = w.s JOIN edit ON edit.m = ins.m AND (x IS NULL OR x = initial) AND (letter = 'D' OR fault NOT IN (1, 2)) GROUP BY w.k, w.i, edit.t)),
    a AS (SELECT k, min({'cost': cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS best FROM walk JOIN (SELECT k, max(i) AS i FROM f GROUP BY k) USING (k, i) GROUP BY k),
    l AS (SELECT k, p, substr(best.audit, p, 1) AS letter FROM a, unnest(range(1, len(best.audit) + 1)) u(p)),
    m AS (SELECT *, count(*) FILTER (letter <> 'I') OVER o AS i, count(*) FILTER (letter <> 'D') OVER o AS j FROM l WINDOW o AS (PARTITION BY k ORDER BY p)),
    r AS (SELECT m.k, j, letter, role, initial, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, bool_or(j = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY m.k) AS sys FROM m LEFT JOIN f ON f.k = m.k AND f.i = m.i WHERE letter <> 'D'),
    h AS (SELECT k, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN j % 2 = CASE WHEN sys THEN 0 ELSE 1 END THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS repaired FROM r GROUP BY k),
    g AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k)
    SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
    FROM (SELECT k, any_value(conv_id) AS conv_id FROM k GROUP BY k) LEFT JOIN g USING (k) LEFT JOIN a USING (k) LEFT JOIN h USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_embedding_dedup": _OP5, "op10_decontamination": _OP10, "op11_source_mixing": _OP11, "op12_conversation_repair": _OP12}
