"""The numbered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, context_tree, conversation_trie, decontaminate, filter_audit, html_mincut, jaccard_join, langid, mixing, piece_bpe, substring_dedup, toxicity, warc
from .common import fold, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored, _ = toxicity.learn_and_score(docs, read(spark, sf_dir, "labels"), max_labelled=4000)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, max_rows=6000))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=85)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.captures_of(read(spark, sf_dir, "pages"))
    found = warc.with_content(warc.resolve_revisits(records), records)
    header = lambda name: F.col("headers")[name].alias(f"header_{name.lower()}")
    return found.select("record_id", "url_key", "at", "outcome", "response_id", header("Date"), header("ETag"), header("Server"), F.sha2("body", 256).alias("body_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10)
    return hits.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_mincut.extract(pages, html_mincut.fit(pages, max_pages=500))


def op10_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(read(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = piece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_main_text": op9_html_main_text,
    "op10_context_tree_score": op10_context_tree_score,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rn
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
         CAST(source_size * 2.0 AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lvl
  FROM w),
t AS (SELECT *, least(cap, max(lvl) OVER () * weight) AS target FROM l),
b AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(b.epochs * p.size + greatest(0, least(p.size, b.budget - b.epochs * b.source_size - p.before)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id,
             CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS group_size,
             row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) AS nth FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(text) AS text_sha256 FROM g
""",
    "op5_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT md5(win) AS h, min(doc_id) AS first_doc FROM p GROUP BY 1),
h AS (SELECT DISTINCT p.doc_id, i + k AS pos
      FROM p JOIN f ON md5(p.win) = f.h, (SELECT unnest(range(0, 50)) AS k) WHERE f.first_doc < p.doc_id),
r AS (SELECT doc_id, list(pos) AS gone FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w
         ELSE [w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(gone, j)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op7_warc_revisits": r"""
WITH p AS (
  SELECT page_id, substr(md5(coalesce(html, '')), 1, 16) AS tag, url, html,
    CASE WHEN regexp_matches(url, '(?i)^https?://') THEN
      regexp_replace(regexp_replace(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)$', ''), '^www\.', '')
      || regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref|sessionid)(=|$)'))), '&'), ''), '')
    ELSE url END AS k FROM pages),
r AS (SELECT page_id AS rid, k, page_id * 10 AS rat, html,
             CASE WHEN page_id % 6 <> 0 THEN tag END AS retag, CASE WHEN page_id % 6 <> 1 THEN 'm' || tag END AS rchange,
             CASE WHEN page_id % 6 <> 2 THEN 'd' || tag END AS rdigest FROM p),
v AS (SELECT page_id, k, page_id * 10 + CASE WHEN page_id % 11 = 0 THEN -5 ELSE 25 END AS "at",
             CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END || tag AS mark FROM p),
j AS (SELECT v.*, r.* EXCLUDE (k),
             coalesce(CASE WHEN page_id % 4 = 0 THEN mark END = retag, CASE WHEN page_id % 4 = 1 THEN 'm' || mark END = rchange,
                      CASE WHEN page_id % 4 = 2 THEN 'd' || mark END = rdigest) AS agrees
      FROM v ASOF LEFT JOIN r ON v.k = r.k AND v."at" > r.rat)
SELECT page_id * 2 + 1 AS record_id, k AS url_key, "at",
       CASE WHEN rid IS NULL THEN 'missing' WHEN agrees THEN 'resolved' WHEN NOT agrees THEN 'changed' ELSE 'unvalidated' END AS outcome,
       rid * 2 AS response_id,
       CASE WHEN agrees THEN 'revisit' || page_id END AS header_date,
       CASE WHEN agrees THEN CASE WHEN page_id % 4 = 0 THEN 'W/' || mark ELSE retag END END AS header_etag,
       CASE WHEN agrees THEN 'response' END AS header_server,
       CASE WHEN agrees THEN sha256(html) END AS body_sha256
FROM j
""",
    "op8_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS win
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS win
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
m AS (SELECT p.doc_id, p.k, p.i, v.item_id FROM p JOIN v ON p.win = v.win AND p.k = v.k),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, (SELECT unnest(range(0, 10)) AS j) WHERE j < k GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
""",
    "op11_conversation_trie": r"""
WITH RECURSIVE bits(b, k, v) AS (  -- the 256 remainders of CRC-32
  SELECT b, 0, b FROM (SELECT unnest(range(0, 256)) AS b)
  UNION ALL SELECT b, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
o AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
c AS (
  SELECT conv_id, own, xor(4294967295, list_reduce([CAST(ascii(ch) AS BIGINT) FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')],
           lambda a, ch: xor(a >> 8, t[xor(a & 255, ch) + 1]), CAST(4294967295 AS BIGINT))) % 4 AS h FROM o, crc),
b AS (
  SELECT c.conv_id, list_concat(coalesce(a.own[1:c.h], []), c.own[c.h + 1:]) AS s
  FROM c LEFT JOIN o a ON a.conv_id = c.conv_id - c.conv_id % 20),
p AS (
  SELECT conv_id, d, len(s) AS n, md5(CAST(s[1:d] AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(s[1:d - 1] AS VARCHAR)) END AS pk,
         CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].x, '[^ 	-
]+')) ELSE 0 END AS w
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM b)),
n AS (
  SELECT d, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends
  FROM p GROUP BY 1, 2),
ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
u AS (SELECT DISTINCT x.d, x.k, y.d AS yd, y.k AS yk FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d >= x.d),
t AS (
  SELECT u.d, u.k, count(*) FILTER (WHERE ch.k IS NULL) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
  FROM u JOIN n ON n.d = u.yd AND n.k = u.yk LEFT JOIN ch ON ch.d = u.yd AND ch.k = u.yk GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM n JOIN t ON t.d = n.d AND t.k = n.k LEFT JOIN ch ON ch.d = n.d AND ch.k = n.k LEFT JOIN n m ON m.d = n.d - 1 AND m.k = n.pk
""",
    "op13_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id AS of, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN g ON g.of = d.doc_id),
m AS (SELECT part, fails, list_sum([CAST(x AS INT) FOR x IN fails]) AS n_fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, e.i, h.i] AS ord FROM l a, l b, l c, l e, l h
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, h.i])) = 5),
s AS (SELECT ord, array_to_string(['ABCDE'[i] FOR i IN ord], '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
x AS (
  SELECT part, filter_order, step, ord[step] AS i, n, good, toxic, n_fails, fails[ord[step]] AS fail,
         list_sum([CAST(fails[j] AS INT) FOR j IN ord[1:step - 1]]) > 0 AS gone FROM m, s),
r AS (
  SELECT part, filter_order, step, i,
         sum(CASE WHEN NOT coalesce(gone, false) AND NOT fail THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT coalesce(gone, false) AND fail THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN coalesce(gone, false) AND fail THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fail AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT coalesce(gone, false) AND fail AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT coalesce(gone, false) AND fail AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM r
""",
}
