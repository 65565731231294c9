"""The queries of the operators and of the pipeline, and the SQL that checks those which SQL can express."""

import corpus_pipeline
from pyspark.sql import functions as F

from mainstreet.llm import blocks, decontamination, embeddings, infill, language, manifest, minhash, mixing, neighbours, quality, repeats, scoring, sharding, toxicity

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = blocks.remainder(F.col("doc_id"), 5) == 0
    detector = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), detector)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@query("op3_mixing")
def op3_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"))


_REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, p, array_slice(b, p, p + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS p FROM d WHERE n >= 50) t
), firsts AS (
  SELECT s, min(doc_id) AS low FROM w GROUP BY s
), gone AS (
  SELECT w.doc_id, w.p, CASE WHEN w.p <= lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) + 50 THEN 0 ELSE 1 END AS first
  FROM w JOIN firsts f ON f.s = w.s WHERE f.low < w.doc_id
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 49 AS z FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone) t
  GROUP BY doc_id, g
), cut AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM spans
  UNION ALL
  SELECT s.doc_id, max(z) + 1, max(n) FROM spans s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id
), kept AS (
  SELECT cut.doc_id, string_agg(hex(array_slice(b, a, z)), '' ORDER BY a) AS h FROM cut JOIN d ON d.doc_id = cut.doc_id
  WHERE z >= a GROUP BY cut.doc_id
), totals AS (
  SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN t.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256
FROM d LEFT JOIN totals t ON t.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""


@query("op8_suffix_array", _REPEATS_SQL)
def op8_suffix_array(spark, sf_dir):
    return repeats.digests(table(spark, sf_dir, "documents"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = blocks.remainder(F.col("doc_id"), 7) == 2
    model, counted = scoring.fit(docs.where(~held_out))
    return scoring.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, counted)


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    placed = sharding.place(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = blocks.remainder(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held_out))
    named = language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return named.select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = blocks.remainder(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# Ids, pairs that are linked both ways, and the ids that can be reached along them.
_GROUPS = """,
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), groups AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

_EMBEDDINGS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9
){_GROUPS}
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, least(v.vec_id, coalesce(low, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(low, v.vec_id) AS kept
FROM v LEFT JOIN groups ON groups.a = v.vec_id"""


@query("op6_embeddings", _EMBEDDINGS_SQL)
def op6_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


_MINHASH_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])
    WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS sh FROM w
), each AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM each p JOIN each q ON p.x = q.x AND p.doc_id <> q.doc_id
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
){_GROUPS}
SELECT s.doc_id, len(sh) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id, s.doc_id <= coalesce(low, s.doc_id) AS kept
FROM s LEFT JOIN groups ON groups.a = s.doc_id"""


@query("op7_minhash", _MINHASH_SQL)
def op7_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


_INFILL_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
), h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
    array_to_string(u[greatest(a, b) + 1:n], '') AS suf
  FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p"""


@query("op11_infill", _INFILL_SQL)
def op11_infill(spark, sf_dir):
    made = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(), 256).alias("restored_sha256"),
    )


_MANIFEST_SQL = """
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN n_chars IS NOT NULL AND crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS told
  FROM (SELECT doc_id, source, lang, n_chars, text, TAMPER AS crc FROM documents) t
), e AS (
  SELECT doc_id, lang, sha256(PARTS(n_chars)) AS leaf, sha256(PARTS(told)) AS tampered FROM d
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM e
), up AS (
  SELECT lang, 0 AS lv, i AS j, m, leaf AS h FROM l
  UNION ALL
  SELECT lang, lv + 1, j // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM up WHERE m > 1 GROUP BY lang, lv, j // 2, m
), subs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM up WHERE m = 1
), over_subs AS (
  SELECT 0 AS lv, i AS j, m, subroot AS h FROM subs
  UNION ALL
  SELECT lv + 1, j // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM over_subs WHERE m > 1 GROUP BY lv, j // 2, m
), steps AS (
  SELECT l.lang, l.i, up.lv AS step, l.i // (1 << up.lv) % 2 AS slot, s.h
  FROM l JOIN (SELECT DISTINCT lang, lv FROM up WHERE m > 1) up ON up.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lv = up.lv AND s.j = xor(l.i // (1 << up.lv), 1)
  UNION ALL
  SELECT l.lang, l.i, 100 + o.lv, x.i // (1 << o.lv) % 2, s.h
  FROM l JOIN subs x ON x.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT lv FROM over_subs WHERE m > 1) o ON true
    LEFT JOIN over_subs s ON s.lv = o.lv AND s.j = xor(x.i // (1 << o.lv), 1)
), paths AS (
  SELECT lang, i, list({'slot': slot, 'h': coalesce(h, '')} ORDER BY step) AS path, string_agg(h, '' ORDER BY step) AS proof FROM steps GROUP BY lang, i
), folded AS (
  SELECT l.lang, l.i, 0 AS k, tampered AS h, path FROM l LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i
  UNION ALL
  SELECT lang, i, k + 1, sha256(CASE WHEN path[k + 1].slot = 1 THEN path[k + 1].h || h ELSE h || path[k + 1].h END), path
  FROM folded WHERE k < coalesce(len(path), 0)
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN subs x ON x.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM over_subs WHERE m = 1) r ON true
  LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i
  JOIN folded f ON f.lang IS NOT DISTINCT FROM l.lang AND f.i = l.i AND f.k = coalesce(len(p.path), 0)"""

# DuckDB has no crc32, so it is worked out bit by bit: the digits of the id, then eight steps a byte.
_CRC_SQL = """(SELECT xor(list_reduce(list_prepend(4294967295, flatten([[CAST(ascii(ch) AS BIGINT) + 1000, -1, -1, -1, -1, -1, -1, -1, -1]
  for ch in string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '')])),
  lambda c, x: CASE WHEN x >= 1000 THEN xor(c, x - 1000) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295))"""


def _parts_sql(chars):
    one = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"
    return " || ".join(one.format(c) for c in ("doc_id", "source", "lang", chars, "text"))


for _chars in ("n_chars", "told"):
    _MANIFEST_SQL = _MANIFEST_SQL.replace(f"PARTS({_chars})", _parts_sql(_chars))
_MANIFEST_SQL = _MANIFEST_SQL.replace("TAMPER", _CRC_SQL)


@query("op12_manifest", _MANIFEST_SQL)
def op12_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chars = F.when(blocks.remainder(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    told = manifest.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), chars, F.col("text")])
    tree = manifest.documents(docs, told.alias("told"))
    folded = tree.withColumn("folded_root", manifest.fold(F.col("told")))
    return folded.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_neighbours")
def op13_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.fit(vectors), vectors.where(F.col("vec_id") % 20 == 0))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
