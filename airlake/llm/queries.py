"""Registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm import bpe, embedding_dedup, exact_dedup, licenses, minhash, packing, quality, sharding, substring_dedup, toxicity, vector_codes, warc, whitening
from airlake.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bag_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.with_ids_crc(packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op3_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode_documents(encoded, ranks).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, lexicon).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_warc_derivatives(spark, sf_dir):
    return warc.derive_records(warc.responses_of_pages(_table(spark, sf_dir, "pages")))


def op7_license_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    scan = licenses.license_scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"), templates)
    return scan.withColumnRenamed("id", "doc_id").withColumn("own_score", F.round("own_score", 6))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_links(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark, sf_dir):
    return sharding.kd_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bag_minhash, op2_packing, op3_bpe, op4_substring_dedup, op5_toxicity, op6_warc_derivatives, op7_license_scan,
        op8_exact_dedup, op9_embedding_dedup, op10_quality, op11_vector_codes, op12_whitening, op13_sharding, pipeline,
    )
}



def _codes_sql(rounds: int = 4) -> str:
    """Assignments and means of vector parts, one round below the other."""
    sql = """
WITH v AS (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS (SELECT vec_id, label, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS a FROM v, range(4) t(part)
), b0 AS (SELECT part, rn - 1 AS entry, a AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rn FROM p) WHERE rn <= 256)"""
    near = """
), a{k} AS (
  SELECT vec_id, part, any_value(label) AS label, any_value(a) AS a, first(entry ORDER BY d, entry) AS entry, min(d) AS d
  FROM (SELECT p.*, entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(a, c)]) AS d FROM p JOIN b{k} USING (part)) GROUP BY vec_id, part"""
    mean = """
), u{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS c FROM (
    SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (
      SELECT part, entry, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry
), b{n} AS (SELECT part, entry, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN u{k} u USING (part, entry)"""
    sql = sql.rstrip(")")
    for k in range(rounds):
        sql += near.format(k=k) + mean.format(k=k, n=k + 1)
    return sql + near.format(k=rounds) + f"""
), r AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM r
"""


def _tree_sql(levels: int = 3) -> str:
    """Cuts of all nodes of a level at the row whose middle byte passes half of the node's bytes; CRC-32 by its table."""
    dims = ("source", "lang")
    text = lambda c: f"CASE WHEN {c} IS NULL THEN -1 ELSE CAST('0x' || rpad(substr(hex(encode({c})), 2 * {c}_shared + 1, 14), 14, '0') AS BIGINT) END"
    shared = ", ".join(
        f"""(SELECT coalesce(max(i), 0) FROM range(1, 100) t(i) WHERE i <= octet_length(encode(l{c})) AND i <= octet_length(encode(h{c}))
      AND substr(hex(encode(l{c})), 1, 2 * i) = substr(hex(encode(h{c})), 1, 2 * i)) AS {c}_shared"""
        for c in dims
    )
    sql = f"""
WITH e AS (SELECT {", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in dims)} FROM documents
), g AS (SELECT {shared} FROM e
), k AS (SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), n0 AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h AS BIGINT) for h in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
      lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) AS text_crc32,
    {text("source")} AS d0, {text("lang")} AS d1, octet_length(encode(coalesce(text, ''))) + 1 AS d2, coalesce(doc_id, -1) AS d3, 0 AS node
  FROM documents, g, k
), w AS (SELECT {", ".join(f"greatest(1, max(d{i}) - min(d{i})) AS w{i}" for i in range(4))} FROM n0"""
    for j in range(levels):
        share = [f"(max(d{i}) - min(d{i})) / any_value(w{i})" for i in range(4)]
        axis = " ".join(f"WHEN {share[i]} = greatest({', '.join(share)}) THEN {i}" for i in range(3))
        sql += f"""
), s{j} AS (SELECT node, sum(size) AS w, CASE {axis} ELSE 3 END AS axis FROM n{j}, w GROUP BY node
), c{j} AS (
  SELECT n.*, s.w, sum(size) OVER (PARTITION BY node ORDER BY CASE axis WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, doc_id) AS upto FROM n{j} n JOIN s{j} s USING (node)
), n{j + 1} AS (SELECT doc_id, size, text_crc32, d0, d1, d2, d3, 2 * node + CAST(2 * upto - size >= w AS INTEGER) AS node FROM c{j}"""
    return sql + f"""
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(node AS INTEGER) AS shard, row_number() OVER (PARTITION BY node ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM n{levels}
"""


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licenses.TEMPLATES)

ORACLE_SQL = {
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
), k AS (
  SELECT plain, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY plain
)
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, sha256(d.plain) AS text_sha256
FROM d JOIN k USING (plain)
""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
""",
    "op7_license_scan": rf"""
WITH f AS (
  SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text FROM documents
), raw AS (
  SELECT doc_id, 'line' AS kind, generate_subscripts(string_split(text, chr(10)), 1) AS nth, unnest(string_split(text, chr(10))) AS value FROM f
  UNION ALL
  SELECT doc_id, 'paragraph', generate_subscripts(string_split_regex(text, '\n[^\p{{L}}\p{{N}}]*\n'), 1), unnest(string_split_regex(text, '\n[^\p{{L}}\p{{N}}]*\n')) FROM f
  UNION ALL
  SELECT doc_id, 'file', 0, text FROM f
), units AS (
  SELECT doc_id, kind, nth, terms FROM (
    SELECT doc_id, kind, nth, regexp_extract_all(lower(value), '[\p{{L}}\p{{N}}]+(?:\.\p{{N}}+)*') AS terms FROM raw
    WHERE kind <> 'paragraph' OR contains(value, chr(10))) WHERE len(terms) > 0
), t(license, text) AS (VALUES {_TEMPLATE_ROWS}),
tt AS (SELECT license, text, term, count(*) AS c FROM (
  SELECT license, text, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:\.\p{{N}}+)*')) AS term FROM t) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM units WHERE kind = 'line'),
words AS (SELECT doc_id, kind, nth, term, count(*) AS c FROM (SELECT doc_id, kind, nth, unnest(terms) AS term FROM units) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT (doc_id, nth)) AS df FROM words WHERE kind = 'line' AND term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT term, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), total),
tw AS (SELECT license, text, term, c * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT license, text, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
lw AS (
  SELECT doc_id, kind, nth, term, c * coalesce(idf, ln(1.0 + n) + 1) AS w
  FROM words LEFT JOIN idf USING (term), total
), ln AS (SELECT doc_id, kind, nth, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
m AS (
  SELECT doc_id, kind, nth, license, round(sum(lw.w * tw.w) / (any_value(ln.norm) * any_value(tn.norm)), 9) AS cosine
  FROM lw JOIN tw USING (term) JOIN ln USING (doc_id, kind, nth) JOIN tn USING (license, text) GROUP BY doc_id, kind, nth, license, text
), own AS (
  SELECT doc_id, first(license ORDER BY cosine DESC, license) AS own_license, max(cosine) AS own_score FROM m WHERE cosine >= 0.8 GROUP BY doc_id
), r AS (
  SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own_license, own_score FROM f LEFT JOIN own USING (doc_id)
), g AS (
  SELECT dir AS above, first(license ORDER BY cosine DESC, license) AS given
  FROM r JOIN m USING (doc_id) WHERE kind = 'file' AND cosine >= 0.8 GROUP BY dir
), near AS (
  SELECT doc_id, first(above ORDER BY length(above) DESC) AS above, first(given ORDER BY length(above) DESC) AS given
  FROM r JOIN g ON above = '' OR dir = above OR starts_with(dir, above || '/') WHERE own_license IS NULL GROUP BY doc_id
)
SELECT r.doc_id, r.path, own_license, round(own_score, 6) AS own_score, coalesce(own_license, given) AS license, above AS inherited_from
FROM r LEFT JOIN near USING (doc_id)
""",
    "op11_vector_codes": _codes_sql(),
    "op13_sharding": _tree_sql(),
}
