"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import bin_slack, conversation_repair, crf, hilbert, line_dedup, merkle, packing, pii, poisson_mix, quality_rules, simhash, topk
from cartwise.llm import url_templates
from cartwise.session import stage

REGISTRY: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", "text", "lang")
    measured = stage(quality_rules.measure(docs).drop("text"), "measured")
    cutoffs = quality_rules.calibrate(measured, _read(spark, sf, "labels"))
    judged = quality_rules.judge(measured, cutoffs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op2_impact_topk(spark: SparkSession, sf: str) -> DataFrame:
    whole = stage(topk.whole_vectors(_read(spark, sf, "embeddings"), "vec_id", "embedding"), "vectors")
    index = stage(topk.build_index(whole), "impact-index")
    return topk.search(index, whole.filter("vec_id % 50 = 0"), 5)


@query
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_read(spark, sf, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf, "documents").select("doc_id", "text"))
    base = pii.of_kinds(F.col("pii"), *pii.BASE)
    counts = [F.size(pii.of_kinds(F.col("pii"), kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


@query
def op5_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _read(spark, sf, "documents").select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sharded = hilbert.hilbert_shards(docs, ["lang", "source", "size"], ["doc_id", "text_crc32", "size"], 8)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.fingerprint_table(_read(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf, "documents").select("doc_id", "text"))


@query
def op8_crf_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = crf.train(docs, _read(spark, sf, "labels").filter(~held_out))
    scored = crf.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_poisson_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    copies = poisson_mix.mix(docs, poisson_mix.tempered_targets(docs))
    return copies.select("doc_id", "source", "copy", "shuffle_key")


#: Verdict, domain, start of path.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query
def op10_url_templates(spark: SparkSession, sf: str) -> DataFrame:
    pages = _read(spark, sf, "pages")
    judged = url_templates.judge_urls(pages, URL_RULES, url_templates.looks_bad(F.col("html")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("bad_share", 6).alias("bad_share"))


@query
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "conversations")
    fixed = conversation_repair.repair(conversation_repair.damage(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", conversation_repair.name(F.col("conv_id")))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = every.join(fixed.conversations, "conv", "left").join(conversation_repair.digests(fixed.turns), "conv", "left")
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    doc_id, text = F.col("doc_id"), F.col("text")
    tampered = F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    others = [doc_id, F.col("source"), F.col("lang"), F.col("n_chars")]
    digests = _read(spark, sf, "documents").select(
        doc_id.alias("key"), "source", merkle.leaf_digest(*others, text).alias("leaf"), merkle.leaf_digest(*others, tampered).alias("claimed"))
    manifest = merkle.build(stage(digests, "digests"), "key", "source", "leaf")
    proved = merkle.climb(manifest.leaves, manifest.nodes)
    root = F.lit(manifest.root).cast("string")
    return proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == root).alias("verified"))


@query
def op13_bin_slack(spark: SparkSession, sf: str) -> DataFrame:
    return bin_slack.pack(_read(spark, sf, "documents")).drop("ids")


ORACLE["op1_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, chr(1)) AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g,
  unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
often AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often WHERE c > 1) GROUP BY 1),
m AS (SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
long AS (SELECT doc_id, lang, unnest(['symbols', 'capitals', 'repeated_lines', 'repeated_words', 'word_length']) AS rule, unnest([
  1000 * n_symbols / nullif(n_words, 0), 1000 * n_capitals / nullif(word_chars, 0), 1000 * n_dup_lines / nullif(n_lines, 0),
  1000 * n_repeat_words / nullif(n_words, 0), 10 * word_chars / nullif(n_words, 0)]) AS v FROM m),
vals AS (SELECT doc_id, lang, rule, trunc(least(1000, coalesce(v, 0)))::INT AS v FROM long),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
counts AS (SELECT lang, rule, v, count(*) AS n FROM vals JOIN good USING (doc_id) GROUP BY ALL),
sizes AS (SELECT lang, rule, sum(n) AS n, count(*) OVER () AS tests FROM counts GROUP BY lang, rule),
cdf AS (SELECT lang, rule, i, tests, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02::DOUBLE) + (n - i) * ln(0.98::DOUBLE)))
  OVER (PARTITION BY lang, rule ORDER BY i) AS c FROM sizes, range(0, 100000) r(i) WHERE i <= least(n, ceil(n * 0.02))),
allowed AS (SELECT lang, rule, max(i) AS k FROM cdf WHERE c <= 0.05 / tests GROUP BY ALL),
reach AS (SELECT lang, rule, v, sum(n) OVER (PARTITION BY lang, rule ORDER BY v DESC) AS r FROM counts),
cutoffs AS (SELECT lang, rule, greatest(max(v), CASE rule WHEN 'symbols' THEN 100 WHEN 'repeated_lines' THEN 500 WHEN 'word_length' THEN 120 ELSE 300 END) AS cut
  FROM reach JOIN allowed USING (lang, rule) WHERE r > k GROUP BY lang, rule),
failed AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position(['symbols', 'capitals', 'repeated_lines', 'repeated_words', 'word_length'], rule)) AS failed_rules
  FROM vals JOIN cutoffs USING (lang, rule) WHERE v > cut GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM m LEFT JOIN failed USING (doc_id)
"""

ORACLE["op2_impact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLE["op9_poisson_mix"] = """
WITH counts AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, (sum(n) OVER ())::DOUBLE * weight / (sum(weight) OVER ()) / n AS rate FROM counts),
pmf AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
        FROM rates, range(0, 400) AS r(k) WHERE k <= rate + 10 * sqrt(rate) + 24),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
drawn AS (SELECT doc_id, source, (('0x' || substr(md5('42:' || doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, count(*) AS n FROM drawn d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u GROUP BY ALL),
copies AS (SELECT doc_id, source, unnest(range(1, n + 1))::INT AS copy FROM counted)
SELECT doc_id, source, copy, ('0x' || substr(md5('42-order:' || doc_id || ':' || copy), 1, 12))::BIGINT AS shuffle_key FROM copies
"""

#: CRC-32 of a decimal or ASCII string ``s`` of a row, with ``t`` from ``CRC_TABLE``.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t"""
CRC = """xor(list_reduce(list_transform(string_split(s, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
d AS (SELECT *, doc_id::VARCHAR AS s FROM documents),
twofold AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN {CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM d, crc),
hashed AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
  coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS claimed FROM twofold),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
up(source, lvl, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY pos) FROM leaves GROUP BY source
  UNION ALL SELECT source, lvl + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM up WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM up WHERE len(nodes) = 1),
top(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY rank) FROM subroots
  UNION ALL SELECT lvl + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM top WHERE len(nodes) > 1),
climb(r, lvl, pos, h, proof) AS (
  SELECT r, 0, pos, claimed, '' FROM leaves
  UNION ALL SELECT c.r, c.lvl + 1, c.pos // 3, sha256(lft || c.h || rgt), c.proof || lft || rgt
  FROM (SELECT k.*, array_to_string(nodes[k.pos - k.pos % 3 + 1:k.pos], '') AS lft, array_to_string(nodes[k.pos + 2:k.pos - k.pos % 3 + 3], '') AS rgt, len(nodes) AS n
        FROM climb k JOIN leaves l USING (r) JOIN up ON up.source IS NOT DISTINCT FROM l.source AND up.lvl = k.lvl) c(r, lvl, pos, h, proof, lft, rgt, n) WHERE n > 1),
crossed AS (SELECT r, rank, h, proof FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl DESC) AS last FROM climb) JOIN leaves USING (r)
  JOIN subroots ON subroots.source IS NOT DISTINCT FROM leaves.source WHERE last = 1),
climb2(r, lvl, pos, h, proof) AS (
  SELECT r, 0, rank, h, proof FROM crossed
  UNION ALL SELECT c.r, c.lvl + 1, c.pos // 3, sha256(lft || c.h || rgt), c.proof || lft || rgt
  FROM (SELECT k.*, array_to_string(nodes[k.pos - k.pos % 3 + 1:k.pos], '') AS lft, array_to_string(nodes[k.pos + 2:k.pos - k.pos % 3 + 3], '') AS rgt, len(nodes) AS n
        FROM climb2 k JOIN top USING (lvl)) c(r, lvl, pos, h, proof, lft, rgt, n) WHERE n > 1),
ended AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl DESC) AS last FROM climb2)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM ended JOIN leaves USING (r) JOIN subroots ON subroots.source IS NOT DISTINCT FROM leaves.source, (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1) WHERE last = 1
"""

ORACLE["op11_conversation_repair"] = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
dealt AS (SELECT *, {CRC} % 20 AS fault FROM said, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM dealt WHERE fault <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'd'
  WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
  left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nth) AS before FROM numbered),
moves(q, word, told, cost, t) AS (VALUES (0, '', '', 0, 0), (0, 'I', 'u', 5, 2), (0, 'II', 'ua', 10, 3), (1, '', '', 0, 1), (1, 'I', 'u', 5, 2), (1, 'II', 'ua', 10, 3),
  (2, '', '', 0, 2), (2, 'I', 'a', 5, 3), (3, '', '', 0, 3), (3, 'I', 'u', 5, 2)),
steps AS (SELECT q, word || e.op AS word, told || e.r AS told, cost + e.c AS cost, e.t2 AS s, op, i AS needs FROM moves JOIN (VALUES
  (0, 'D', '-', 2, 0, ''), (1, 'D', '-', 2, 1, ''), (2, 'D', '-', 2, 2, ''), (3, 'D', '-', 2, 3, ''),
  (0, 'R', 'u', 1, 2, ''), (1, 'R', 'u', 1, 2, ''), (2, 'R', 'a', 1, 3, ''), (3, 'R', 'u', 1, 2, ''),
  (0, 'K', 'k', 0, 1, 's'), (0, 'K', 'k', 0, 2, 'u'), (1, 'K', 'k', 0, 2, 'u'), (3, 'K', 'k', 0, 2, 'u'), (2, 'K', 'k', 0, 3, 'a')) e(t1, op, r, c, t2, i) ON t1 = t),
best(conv_id, nth, state, way) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'told': ''}} FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL SELECT conv_id, nth, state, min(way) FROM (
    SELECT b.conv_id, f.nth, p.s AS state, {{'cost': b.way.cost + p.cost + CASE WHEN f.fault = 't' AND op <> 'D' THEN 5 ELSE 0 END,
      'audit': b.way.audit || p.word, 'told': b.way.told || p.told}} AS way
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.nth = b.nth + 1
    JOIN steps p ON p.q = b.state AND (op = 'D' OR f.fault IN ('.', 't') AND (op = 'R' OR needs = f.i))) GROUP BY ALL),
ended AS (SELECT b.conv_id, min({{'cost': way.cost + m.cost, 'audit': way.audit || m.word, 'told': way.told || m.told}}) AS way FROM best b
  JOIN (SELECT conv_id, max(nth) AS nth FROM best GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.nth = b.nth
  JOIN moves m ON m.q = b.state AND (m.t = 3 OR m.t = 0) GROUP BY b.conv_id),
letters AS (SELECT conv_id, unnest(range(1, length(way.audit) + 1)) AS n, way FROM ended),
edits AS (SELECT conv_id, n, way.audit[n] AS op, way.told[n] AS told, sum((way.audit[n] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY n) AS nth FROM letters),
lines AS (SELECT e.conv_id, n, CASE WHEN op = 'K' THEN f.role WHEN e.told = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE f.text END AS line
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.nth = e.nth WHERE op <> 'D'),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS text FROM lines GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (nth > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.way.cost, 0)::BIGINT AS cost, coalesce(e.way.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""
