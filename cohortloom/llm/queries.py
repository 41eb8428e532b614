"""The registered queries of the twelve operators, with their DuckDB SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, delta_lloyd, language_id, packing, positional_index, robust_quality, runtime, secret_ledger, simhash_gph, tiered_shards, tokenbin, toxicity, warc

BYTE_BPE, WORD_BPE, RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
#: Of so many arrivals of about one size at least a tier's fill is in one tier: something is merged at every scale.
ARRIVALS = 2 * tiered_shards.FAN_IN - 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.fold_of(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.work_folder(spark, "tokens")
    tokenbin.write_store(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE))
    return tokenbin.read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ARRIVALS arrivals, by a hash of doc_id, then compacted; read from the newest manifest."""
    docs, folder = _table(spark, sf_dir, "documents"), runtime.work_folder(spark, "shards")
    store = tiered_shards.TieredStore(spark, folder)
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "text", "lang", "source", "n_chars")


def drafts(docs: DataFrame) -> DataFrame:
    """A version of the corpus before the table's: a third of the documents with another text, a seventh not there yet, the others as they are."""
    h = F.xxhash64("doc_id")
    edited = F.when(F.pmod(h, F.lit(3)) == 0, F.concat_ws("\n", F.lit("draft"), "text")).otherwise(F.col("text"))
    return docs.where((F.pmod(h, F.lit(7)) != 0) | F.col("doc_id").isNull()).select("doc_id", edited.alias("text"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the corpus on one ledger, drafts and the table: the second scans edited and new texts alone. The findings of the second's paths."""
    docs, ledger = _table(spark, sf_dir, "documents"), f"{runtime.work_folder(spark, 'secrets')}/ledger"
    secret_ledger.commit(drafts(docs), ledger, "first")
    secret_ledger.commit(docs, ledger, "second")
    paths = secret_ledger.paths(spark, ledger, docs.schema["doc_id"].dataType.simpleString()).where("version = 'second'")
    spans = secret_ledger.spans_of(spark, ledger)
    kinds = F.array(*[F.lit(r[0]) for r in secret_ledger.RULES])
    told = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    report = spans.select("blob", *[count(k).alias(f"n_{r[0]}") for k, r in enumerate(secret_ledger.RULES)], told.alias("spans"))
    out = paths.join(report, "blob", "left").withColumn("spans", F.coalesce("spans", F.lit("")))
    return out.select("doc_id", *[F.coalesce(f"n_{r[0]}", F.lit(0)).cast("long").alias(f"n_{r[0]}") for r in secret_ledger.RULES], F.sha2("spans", 256).alias("base_sha256"), "spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = language_id.fold_of(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels.where(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.round_trip(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gph.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", "n_hit", n("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), positional_index.contaminated().alias("contaminated"), n("near_items").alias("n_near_items"), F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"))


def op10_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_quality.assess(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    found = byte_pairs.decode(byte_pairs.encode(_table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta_lloyd.with_inertia(delta_lloyd.cluster(_table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _lloyd_sql(k: int = delta_lloyd.K, rounds: int = delta_lloyd.ROUNDS, dim: int = delta_lloyd.DIM) -> str:
    """Plain Lloyd rounds, one after the other, each with all distances; of a distance and a number the smallest d * k + c is the nearest."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({delta_lloyd.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{delta_lloyd.SALT}' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('{delta_lloyd.SALT}' || vec_id), v) <= {k})",
    ]
    nearest = f"SELECT r, min(CAST(list_sum(list_transform(range(1, {dim + 1}), lambda i: (kept.v[i] - m.v[i]) * (kept.v[i] - m.v[i]))) AS BIGINT) * {k} + m.c) AS best FROM kept, c%d m GROUP BY r"
    for n in range(rounds):
        steps += [
            f"a{n} AS MATERIALIZED ({nearest % n})",
            f"s{n} AS (SELECT best % {k} AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{n} JOIN kept USING (r), range(1, {dim + 1}) t(i) GROUP BY ALL)",
            f"g{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c)",
            f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(g{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN g{n} USING (c))",
        ]
    last = f"f AS MATERIALIZED (SELECT r, best % {k} AS c, best // {k} AS d FROM ({nearest % rounds}))"
    return "WITH " + ",\n".join([*steps, last]) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM f JOIN kept USING (r) JOIN c{rounds} USING (c)"""


QUERIES = {f.__name__: f for f in (op1_language_id, op2_tokenbin, op3_tiered_shards, op4_secret_ledger, op5_toxicity, op6_warc, op7_simhash_gph, op8_packing, op9_positional_index, op10_robust_quality, op11_byte_pairs, op12_delta_lloyd)}

ORACLE_SQL = {
    "op3_tiered_shards": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "op4_secret_ledger": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p(kind, rnk, pat, grp, fewest) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 16),
  ('hex', 2, '[0-9a-f]{32,}', 0, 32)),
m AS (
  SELECT r, 'assign' AS kind, 0 AS rnk, 8 AS fewest, regexp_extract_all(text, (SELECT pat FROM p WHERE rnk = 0)) AS hits,
         regexp_extract_all(text, (SELECT pat FROM p WHERE rnk = 0), 2) AS vals, string_split_regex(text, (SELECT pat FROM p WHERE rnk = 0)) AS gaps FROM d
  UNION ALL SELECT r, 'access', 1, 16, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 'hex', 2, 32, regexp_extract_all(text, '[0-9a-f]{32,}'), regexp_extract_all(text, '[0-9a-f]{32,}'), string_split_regex(text, '[0-9a-f]{32,}') FROM d),
e AS (SELECT r, kind, rnk, fewest, unnest(range(1, len(hits) + 1)) AS k, hits, vals, gaps FROM m WHERE len(hits) > 0),
s AS (SELECT r, kind, rnk, fewest, k, length(hits[k]) AS hit, length(vals[k]) AS val,
        sum(length(hits[k]) + length(gaps[k])) OVER (PARTITION BY r, rnk ORDER BY k) AS stop FROM e),
f AS (SELECT r, kind, rnk, CAST(stop - hit AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE val >= fewest),
a AS (SELECT r, count(*) FILTER (rnk = 0) AS n_assign, count(*) FILTER (rnk = 1) AS n_access, count(*) FILTER (rnk = 2) AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rnk) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, coalesce(page_id = first, first IS NULL) AS own, first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(hex, 1 + 5 * i // 4, 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT own THEN first END AS refers_to
FROM h
""",
    "op9_positional_index": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM benchmark),
i AS (SELECT item, least(13, len(v)) AS n, v, unnest(range(1, len(v) - least(13, len(v)) + 2)) AS k FROM b WHERE len(v) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(v, k, k + n - 1), ' ') AS gram FROM i),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS gram FROM places),
hits AS (SELECT r, n, k, item FROM grams JOIN windows USING (n, gram)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
terms AS (SELECT DISTINCT unnest(v) AS word FROM b),
posts AS MATERIALIZED (SELECT r, pos, word FROM (SELECT r, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d) SEMI JOIN terms USING (word)),
counts AS (SELECT word, count(*) AS c FROM posts GROUP BY word),
w AS MATERIALIZED (SELECT row_number() OVER () AS win, item, n, v, k - 1 AS s FROM (SELECT DISTINCT item, n, v, k FROM i)),
places_of AS MATERIALIZED (SELECT win, item, n, q, word FROM (SELECT win, item, n, unnest(range(s, s + n)) AS q, unnest(v[s + 1 : s + n]) AS word FROM w)),
ranked AS (SELECT win, item, n, list({'q': q, 'word': word} ORDER BY c, q) AS l FROM places_of JOIN counts USING (word) GROUP BY ALL),
anchors AS (SELECT win, item, n, l[1].q AS p1, l[1].word AS t1, coalesce(l[2].q, l[1].q) AS p2, coalesce(l[2].word, l[1].word) AS t2 FROM ranked WHERE 100 * len(l) >= NEAR_PERCENT * n),
lined AS MATERIALIZED (SELECT DISTINCT a.r, win, item, n, a.pos - p1 AS delta FROM anchors JOIN posts a ON a.word = t1 JOIN posts o ON o.r = a.r AND o.word = t2 AND o.pos - p2 - a.pos + p1 BETWEEN -SLOP AND SLOP),
met AS (SELECT DISTINCT lined.r, lined.win, lined.item, lined.n, lined.delta, f.q FROM lined JOIN places_of f USING (win) JOIN posts p ON p.r = lined.r AND p.word = f.word AND p.pos - f.q - lined.delta BETWEEN -SLOP AND SLOP),
near AS (SELECT r, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_names FROM (SELECT DISTINCT r, item FROM (SELECT r, item, win, n, delta, count(*) AS c FROM met GROUP BY ALL) WHERE 100 * c >= NEAR_PERCENT * n) GROUP BY r)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near_names, '')) AS near_items_sha256
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
""".replace("NEAR_PERCENT", str(positional_index.NEAR_PERCENT)).replace("SLOP", str(positional_index.SLOP)),
    "op12_delta_lloyd": _lloyd_sql(),
}
