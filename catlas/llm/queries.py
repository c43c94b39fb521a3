"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, click_windows, decontam, fill_middle, language_net, mixing, ngram_join, pii, quality_crf, quality_forest, secret_scan, sharding, token_rollup


#: The setting that names the folder of public vocabularies, and the folder where it is unset.
TOKENIZERS_SETTING, TOKENIZERS = "spark.catlas.tokenizers", "/opt/tokenizers"
#: Batches that copies of clicks come in.
BATCHES = 10


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixture.copies().select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).cast("long").alias("taken"))


def _tokenizers(spark: SparkSession) -> dict:
    path = spark.conf.get(TOKENIZERS_SETTING, TOKENIZERS)
    try:
        return token_rollup.tokenizers_at(path)
    except OSError as error:
        raise ValueError(f"set {TOKENIZERS_SETTING} to a folder that holds byte_bpe_50k.tiktoken: {error}") from None


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.follow(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), _tokenizers(spark))


def op3_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with words alone, which SQL can count."""
    return token_rollup.follow(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), {"words-1": token_rollup.words})


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_read(spark, sf_dir, "documents"), leaves=24)
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    score = quality_crf.scorer(quality_crf.train(docs, _read(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", quality_crf.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    judge = quality_forest.judge(quality_forest.train(docs, _read(spark, sf_dir, "labels")))
    return docs.select("doc_id", judge("text").alias("v")).select("doc_id", *[f"v.{c}" for c in (*quality_forest.STATS, "base_failed", "kept", "anomaly")])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"], x["end"])), ",")
    ranks = F.transform("base", lambda x: x["rank"])
    counts = [(F.size("base") - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(named("base").cast("binary"), 256).alias("base_sha256"), named(every).alias("spans"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan_all(_read(spark, sf_dir, "documents"))
    found = F.col("found")
    return rows.select(
        "doc_id",
        *[secret_scan.number(found, k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.spans(found, secret_scan.BASE).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spans(found).alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches, exact ones among them: each term of a window stands at most NEAR_SLACK words off its place."""
    found = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), slack=decontam.NEAR_SLACK)
    return found.select(F.col("id").alias("doc_id"), "n_words", F.col("n_hit").alias("n_near"), F.array_join("items", ",").alias("near_items"), (F.col("n_hit") > 0).alias("near"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("group").alias("class_id"), "n_links", "n_copies")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = language_net.held_out(F.col("doc_id"))
    predict = language_net.predictor(language_net.train(docs, ~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), predict("text").alias("v")).select("doc_id", "held_out", "v.lang_pred", "v.score")


def op12_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_windows.deduplicate(click_windows.copies(_read(spark, sf_dir, "clicks"), BATCHES), BATCHES)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(_read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_crf": op2_quality_crf,
    "op3_token_counts": op3_token_counts,
    "op3_word_counts": op3_word_counts,
    "op4_sharding": op4_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_personal_data": op6_personal_data,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op9_near_matches": op9_near_matches,
    "op10_ngram_join": op10_ngram_join,
    "op11_language": op11_language,
    "op12_click_windows": op12_click_windows,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL = {
    "op3_word_counts": r"""
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS docs, coalesce(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 0)::BIGINT AS tokens
FROM documents GROUP BY source, lang
""",
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id AS id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
r AS (
  SELECT *, row_number() OVER (ORDER BY src) AS rk, source_size::DOUBLE * 2 AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][((rk - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM r),
l AS (
  SELECT *, (budget - (sum(cap) OVER o - cap)) / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w WINDOW o AS (ORDER BY cap / weight, src ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT src, source_size,
         CASE WHEN cap / weight <= lvl THEN cap ELSE max(CASE WHEN cap / weight > lvl THEN lvl END) OVER () * weight END AS target
  FROM l),
e AS (SELECT *, row_number() OVER (PARTITION BY src, k) AS j FROM d),
q AS (
  SELECT e.*, source_size, target, sum(size) OVER (PARTITION BY e.src ORDER BY k, j ROWS UNBOUNDED PRECEDING) AS sent
  FROM e JOIN t USING (src)),
c AS (
  SELECT q.*, copy, (sent + copy * source_size)::DOUBLE / target AS finish
  FROM q CROSS JOIN (VALUES (0), (1)) AS v(copy) WHERE target > 0),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, src, copy, k, j ROWS UNBOUNDED PRECEDING) AS upto FROM c),
n AS (SELECT src, k, j, count(*) AS copies FROM u WHERE upto <= (SELECT floor(sum(target) + 1e-6) FROM t) GROUP BY src, k, j)
SELECT q.id AS doc_id, q.size AS size, q.source_size AS source_size, q.target AS target,
       (coalesce(n.copies, 0) * q.size)::BIGINT AS taken
FROM q LEFT JOIN n USING (src, k, j)
""",
    "op9_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
""",
    "op7_chat_formatting": r"""
WITH t AS (  -- no dialogue of the test tables passes chat.MAX_BYTES, so all are whole: block 0
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
e AS (
  SELECT t.*, speaker, role = speaker AS own,
         '<|' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || replace(replace(replace(role, '|>', '| >'), '<|', '< |'), chr(10), ' ') END || '|>' || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
w AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM e)
SELECT conv_id, speaker, 0::BIGINT AS block, count(*) AS n_turns, string_agg(head || body, '' ORDER BY upto) AS text,
       coalesce(string_agg(CASE WHEN own THEN (upto - length(body)) || ':' || upto END, ',' ORDER BY upto), '') AS mask,
       coalesce(sum(CASE WHEN own THEN length(body) END), 0)::BIGINT AS n_masked
FROM w GROUP BY conv_id, speaker
""",
    "op8_secret_scan": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS (
  SELECT r, t, 0 AS rank, 'assign' AS kind, 8 AS least, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
         regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g,
         string_split_regex(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM d
  UNION ALL SELECT r, t, 1, 'access', 16, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, t, 2, 'hex', 32, regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), string_split_regex(t, '[0-9a-f]{32,}') FROM d
  UNION ALL SELECT r, t, 3, 'github', 1, regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}'), regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}'), string_split_regex(t, 'gh[pousr]_[A-Za-z0-9]{36,}') FROM d
  UNION ALL SELECT r, t, 4, 'private_key', 1, regexp_extract_all(t, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,4}-----END [A-Z0-9 ]*PRIVATE KEY-----)?'), regexp_extract_all(t, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,4}-----END [A-Z0-9 ]*PRIVATE KEY-----)?'), string_split_regex(t, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,4}-----END [A-Z0-9 ]*PRIVATE KEY-----)?') FROM d),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM x WHERE len(m) > 0),
f AS (
  SELECT r, rank, kind, length(array_to_string(gaps[1:k], '')) + length(array_to_string(m[1:k - 1], '')) AS s, length(m[k]) AS n
  FROM i WHERE length(g[k]) >= least),
a AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(CASE WHEN rank < 3 THEN kind || ':' || s || ':' || (s + n) END, ',' ORDER BY s, rank) AS base,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
""",
    "op12_click_windows": r"""
WITH RECURSIVE
tab AS (  -- crc32's table, from its polynomial
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
j AS (
  SELECT k.*, unnest(range(0, greatest(coalesce(click_id % 3, 0), 0) + 1)) AS j, floor(epoch_us(arrived_at) / 3600000000)::BIGINT AS arrived
  FROM clicks AS k WHERE arrived_at IS NOT NULL),
c AS (
  SELECT j.*, xor(list_reduce(list_transform(string_split(coalesce(click_id::VARCHAR, '') || ':' || j, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS c
  FROM j, tab),
l AS (SELECT *, arrived + 6 * j * (c % 10) AS hour, arrived + 6 * j * (c % 10) + (c // 10) % 200 AS l FROM c),
b AS (
  SELECT click_id, hour, ((l - min(l) OVER ()) * 10) // (max(l) OVER () - min(l) OVER () + 1) AS batch,
         sha256(concat(client_id::VARCHAR, '|', kind, '|', floor(100 * value + 0.5)::BIGINT::VARCHAR, '|', epoch_us(ts)::VARCHAR, '|', props, '|', c % 3)) AS hash
  FROM l),
m AS (SELECT k AS batch, (SELECT max(hour) FROM b WHERE b.batch < k) AS m FROM range(0, 11) AS r(k)),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY click_id ORDER BY b.batch, hour, hash) AS n
  FROM b JOIN m USING (batch) WHERE m IS NULL OR hour >= m - 24),
w AS (
  SELECT click_id, n, batch, hour, hash, hour AS start_hour, n AS opener, batch AS since FROM o WHERE n = 1
  UNION ALL
  SELECT o.click_id, o.n, o.batch, o.hour, o.hash, CASE WHEN same THEN start_hour ELSE o.hour END, CASE WHEN same THEN opener ELSE o.n END, CASE WHEN same THEN since ELSE o.batch END
  FROM (SELECT w.*, x.mx FROM w LEFT JOIN (SELECT batch, m AS mx FROM m) AS x USING (batch)) AS w
  JOIN (SELECT o.*, m FROM o JOIN m USING (batch)) AS o ON o.click_id IS NOT DISTINCT FROM w.click_id AND o.n = w.n + 1,
       LATERAL (SELECT o.hour <= start_hour + 48 AND (o.batch = w.batch OR start_hour + 48 >= o.m - 24) AS same) AS s),
g AS (
  SELECT click_id, opener, min(start_hour) AS start_hour, arg_min(hash, n) AS hash, count(*) - 1 AS n_repeats, max(batch) AS last, max(n) AS last_n FROM w GROUP BY click_id, opener),
f AS (
  SELECT click_id, opener, count(*) AS n_conflicts, sum(xor(list_reduce(list_transform(string_split(w.hash, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295::BIGINT), 4294967295)) AS crc
  FROM w JOIN g USING (click_id, opener), tab WHERE w.hash <> g.hash GROUP BY click_id, opener)
SELECT g.click_id, g.start_hour,
       least(coalesce((SELECT min(m.batch - 1) FROM m WHERE m.batch > g.last AND g.start_hour + 48 < m.m - 24), 9), coalesce(o.batch, 9))::BIGINT AS closed_batch,
       g.n_repeats::BIGINT AS n_repeats, coalesce(f.n_conflicts, 0)::BIGINT AS n_conflicts, coalesce(f.crc, 0)::BIGINT AS conflict_crc, g.hash
FROM g LEFT JOIN f ON f.click_id IS NOT DISTINCT FROM g.click_id AND f.opener = g.opener
LEFT JOIN o ON o.click_id IS NOT DISTINCT FROM g.click_id AND o.n = g.last_n + 1
""",
    "op13_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4, len(u) AS n FROM d),
p AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM x),
c AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
""",
}
