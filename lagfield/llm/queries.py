"""Named queries of the operators of this package over the given tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagfield.llm import (
    best_fit,
    exact_dedup,
    importance,
    language,
    orchard_codes,
    packed_ids,
    piece_codec,
    pivot_search,
    quality,
    secret_scan,
    shards,
    simhash,
    toxicity,
)
from lagfield.llm.common import BLANK, table


def op1_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op2_piece_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    encoded = piece_codec.encode_documents(docs)
    return encoded.withColumn("decoded", piece_codec.decode_column(F.col("ids"))).select(
        "doc_id",
        "n_ids",
        "score",
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.length("decoded").cast("long").alias("decoded_chars"),
    )


def op3_best_fit_packing(spark, sf_dir):
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op4_rendezvous_shards(spark, sf_dir):
    sharded = shards.shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )


def op5_exact_dedup(spark, sf_dir):
    rows = exact_dedup.find_copies(table(spark, sf_dir, "documents"))[0]
    return rows.select(
        F.col("record.id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        exact_dedup.stays().alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op6_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_near_duplicates(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language_profiles(spark, sf_dir):
    return language.identify_documents(table(spark, sf_dir, "documents"))


def op9_packed_ids(spark, sf_dir):
    return packed_ids.digest_rows(packed_ids.write_packed(table(spark, sf_dir, "documents")))


def op10_compression_bands(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_pivot_top_k(spark, sf_dir):
    return pivot_search.search(table(spark, sf_dir, "embeddings"))


def op12_orchard_codes(spark, sf_dir):
    return orchard_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_piece_codec,
        op3_best_fit_packing,
        op4_rendezvous_shards,
        op5_exact_dedup,
        op6_toxicity,
        op7_simhash_near_duplicates,
        op8_language_profiles,
        op9_packed_ids,
        op10_compression_bands,
        op11_pivot_top_k,
        op12_orchard_codes,
        op13_importance_resampling,
    )
}

_INTEGER_VECTORS = """
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""


def _product_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Brute force: every part against every entry, ``rounds`` times and once more."""
    steps = [
        "WITH" + _INTEGER_VECTORS,
        f"""cut AS MATERIALIZED (
  SELECT vec_id, label, p AS part, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v
  FROM v, range({parts}) AS r(p)
)""",
        f"""first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries})""",
        "b0 AS MATERIALIZED (SELECT part, entry, v AS e FROM first JOIN cut USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, any_value(v) AS v, min(CAST(d AS BIGINT) * {entries} + entry) AS nearest
  FROM (
    SELECT vec_id, cut.part, v, entry,
           list_inner_product(v, v) + list_inner_product(e, e) - 2 * list_inner_product(v, e) AS d
    FROM cut JOIN b{k} ON cut.part = b{k}.part
  ) GROUP BY vec_id, part
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT part, entry, list(floor(total / n) ORDER BY pos) AS e FROM (
    SELECT part, nearest % {entries} AS entry, pos, sum(v[pos]) AS total, count(*) AS n
    FROM a{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS pos) GROUP BY ALL
  ) GROUP BY part, entry
)""")
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b{k}.part, b{k}.entry, coalesce(m{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN m{k} USING (part, entry)
)""")
    return ",\n".join(steps) + f""",
found AS (
  SELECT vec_id, string_agg(printf('%02x', nearest % {entries}), '' ORDER BY part) AS code,
         CAST(sum(nearest // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(e) AS x, unnest(range(len(e))) AS pos FROM b{rounds})
)
SELECT found.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM found JOIN v USING (vec_id), digest
"""

ORACLE_SQL = {
    "op5_exact_dedup": rf"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', ' ', 'g')) AS text_sha256 FROM documents
), grouped AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM normal JOIN grouped USING (text_sha256)
""",
    "op11_pivot_top_k": f"""
WITH {_INTEGER_VECTORS}, scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op12_orchard_codes": _product_codes_sql(),
    # CRC-32 bit by bit: each byte enters the register, and eight shifts follow; once for each distinct word.
    "op13_importance_resampling": r"""
WITH split AS MATERIALIZED (
  SELECT doc_id, 'd' AS side,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
  UNION ALL
  SELECT item_id, 't',
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), counted AS MATERIALIZED (
  SELECT doc_id, side, word, count(*) AS n FROM (SELECT doc_id, side, unnest(words) AS word FROM split) GROUP BY ALL
), spelled AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)
), hashed AS MATERIALIZED (
  SELECT word,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
           lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                 lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))
         )) % 10000 AS bucket
  FROM spelled
), sums AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 't') AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000)) / ((coalesce(s, 0) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM sums, totals
), weighed AS (
  SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket)
  WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weighed USING (doc_id) WHERE side = 'd'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
""",
}
