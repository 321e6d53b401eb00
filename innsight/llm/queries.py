"""Registered queries of the corpus operators and their DuckDB oracles.

Each query applies its operator, with production parameters, to the whole
table and derives the digest columns of its contract from the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import (ball_tree, bpe, chat, decontaminate, embeddings, filter_audit, language, licenses, line_dedup,
                          near_dup, page_diff, sharding, substring)

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
-- a row without a place is a dialogue of its own
k AS (SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN 0
                     ELSE row_number() OVER (ORDER BY conv_id, turn, role, text) END AS own FROM t),
p AS (SELECT DISTINCT conv_id, own, role AS participant FROM k WHERE role <> 'system'),
s AS (
  SELECT k.conv_id, k.own, p.participant, k.turn, k.role, k.text,
    coalesce(k.role = p.participant, false) AS target,
    CASE WHEN k.role = p.participant THEN '<|im_start|>assistant' || chr(10)
         WHEN k.role = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || regexp_replace(coalesce(k.role, 'unknown'), '[\\r\\n]', ' ', 'g')
              || chr(10) END AS head,
    replace(replace(k.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
      || '<|im_end|>' || chr(10) AS body
  FROM k JOIN p ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.own = p.own)
SELECT conv_id, own = 0 AS placed, participant, count(*) AS n_turns,
  count(*) FILTER (target) AS n_target_turns,
  string_agg(head || body, '' ORDER BY turn, role NULLS FIRST, text) AS rendered,
  string_agg(length(head) || '-,' || length(body) || CASE WHEN target THEN '+' ELSE '-' END, ','
             ORDER BY turn, role NULLS FIRST, text) AS mask
FROM s GROUP BY conv_id, own, participant
"""


@query("op1_chat_perspectives", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    return r.select("conv_id", (F.col("part") >= 0).alias("placed"), "participant", "n_turns", "n_target_turns", "rendered",
                    chat.mask_text().alias("mask"))


def _license_sql() -> str:
    tpls = licenses.templates()
    info = ", ".join(f"({t['tpl']}, '{t['label']}', {t['base']}, {t['grams']}, {t['slack']}, "
                     f"{t['votes']}, CAST({t['need']} AS DOUBLE))" for t in tpls)
    pos = ", ".join(f"({t['tpl']}, {i}, '{t['words'][i]}', '{t['words'][i + 1]}')"
                    for t in tpls for i in range(t["grams"]))
    return f"""
WITH info(tpl, label, base, grams, slack, votes, need) AS (VALUES {info}),
pos(tpl, tpos, w1, w2) AS (VALUES {pos}),
w AS (SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i + 1] AS w1, ws[i + 2] AS w2
      FROM (SELECT doc_id, ws, unnest(range(len(ws) - 1)) AS i FROM w)),
hit AS (SELECT g.doc_id, pos.tpl, g.i AS place, pos.tpos, g.i - pos.tpos AS diag
        FROM g JOIN pos ON g.w1 = pos.w1 AND g.w2 = pos.w2),
d AS (SELECT doc_id, tpl, diag, count(DISTINCT tpos) AS n FROM hit GROUP BY ALL),
v AS (SELECT d.*, info.* EXCLUDE (tpl),
        coalesce(diag - lag(diag) OVER (PARTITION BY doc_id, d.tpl ORDER BY diag) > slack, false) AS jump
      FROM d JOIN info ON d.tpl = info.tpl WHERE slack > 0 OR n >= votes),
r AS (SELECT *, sum(jump::INT) OVER (PARTITION BY doc_id, tpl ORDER BY diag) AS run FROM v),
h AS (SELECT hit.*, run, label, base, grams, slack, need
      FROM hit JOIN r ON hit.doc_id = r.doc_id AND hit.tpl = r.tpl AND hit.diag = r.diag),
f AS (SELECT x.doc_id, x.tpl, x.label, x.base, x.grams, x.need, x.run, x.place AS first,
        count(DISTINCT y.tpos) AS covered
      FROM (SELECT DISTINCT doc_id, tpl, label, base, grams, slack, need, run, place FROM h) x
      JOIN h y ON x.doc_id = y.doc_id AND x.tpl = y.tpl AND x.run = y.run
        AND y.place BETWEEN x.place AND x.place + x.grams + 2 * x.slack - 1 GROUP BY ALL),
s AS (SELECT * FROM f WHERE covered >= need * grams
      QUALIFY row_number() OVER (PARTITION BY doc_id, tpl, run ORDER BY covered DESC, first) = 1),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word,
        max(first) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        max(CAST(covered AS DOUBLE) / grams) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""


@query("op2_license_scan", _license_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_documents(table(spark, sf_dir, "documents"))


LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
           FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_lines", "n_dropped",
                    F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_sampled_splitters")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return r.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids.select("doc_id", "n_tokens", "ids"), ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_simhash_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


@query("op6_icws_near_dup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.mark_near_duplicates(table(spark, sf_dir, "documents"), edits=True).select(
        "doc_id", "class_id", "kept")


@query("op8_cross_parsing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _substring_sql() -> str:
    return """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                      lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(ws[i + 1:i + 20], ' ')) AS h,
               md5(array_to_string(ws[i + 1:i + 20], ' ')) AS m
        FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) AS n FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
kept AS (SELECT word.doc_id, count(gone.p) AS n_removed,
           string_agg(word, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS text
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id),
-- lengths of repeats: the first document of each text, windows of 20, 40, 80 ... words
firsts AS (SELECT min(doc_id) AS doc_id, ws FROM (SELECT w.doc_id, ws, text FROM w JOIN documents d ON w.doc_id = d.doc_id)
           GROUP BY text, ws),
lengths AS (SELECT unnest([20, 40, 80, 160, 320, 640, 1280, 2560, 5120, 10240, 20480]) AS n),
long AS (SELECT doc_id, n, md5(array_to_string(ws[i + 1:i + n], ' ')) AS m
         FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM firsts, lengths WHERE len(ws) >= n)),
longest AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, n, count(*) OVER (PARTITION BY n, m) AS k FROM long)
            WHERE k > 1 GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256, CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_repeat
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN longest ON w.doc_id = longest.doc_id
"""


@query("op9_doubling_substring_dedup", _substring_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup_substrings(docs, 20).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "longest_repeat")


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a AS id, a AS seen FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.seen = l.a),
c AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.id LEFT JOIN c ON e.vec_id = c.id
"""


@query("op10_embedding_near_dup", VECTORS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))


FILTERS_SQL = """
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, i AS step, substr(o, i, 1) AS f, left(o, i - 1) AS before
          FROM orders, (SELECT unnest(range(1, 6)) AS i)),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic
      FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
      FROM documents),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT part, o AS filter_order, step, f AS filter, fails, good, toxic, n, contains(fails, f) AS hit,
        before <> '' AND length(translate(before, fails, '')) < length(before) AS gone
      FROM cells, steps),
r AS (SELECT part, filter_order, step, filter,
        coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept,
        coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
        coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
        coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS good_lost,
        coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r
"""


@query("op13_filter_interactions", FILTERS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SEARCH_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS u, doc_id, list_filter(string_split_regex(
             translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS nd, sum(len(ws))::BIGINT AS nt FROM t),
q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
c AS (SELECT u, doc_id, len(ws)::BIGINT AS n, w, count(*) AS tf
      FROM (SELECT u, doc_id, ws, unnest(ws) AS w FROM t) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
d AS (SELECT w, CAST(floor(1000 * ln((2 * max(nd) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS wt
      FROM c, s GROUP BY w),
r AS (SELECT item_id, u, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::BIGINT
        AS score
      FROM q JOIN c ON q.w = c.w JOIN d ON q.w = d.w, s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM r WHERE score > 0) WHERE rank <= 10
"""


@query("op12_ball_tree_search", SEARCH_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_page_differencing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract_main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars", "n_shared")
