"""The corpus queries, one for each operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import anchors, exact_search, kdmeans, langid, mixing, packing, phrases, quality, secrets, simhash, sketch, suffixes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_neighbours(table(spark, sf_dir, "documents"))


def op7_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_search.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = anchors.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # lies at the top of the repository

    return run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_suffixes, op2_packing, op3_secrets, op4_langid, op5_quality, op6_sketch, op7_exact_search, op8_simhash, op9_warc, op10_mixing, op11_anchors, op12_kdtree, op13_phrases)}


OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM d GROUP BY source
), c AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS level FROM c
), b AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY level, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY level, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS water
  FROM l
), t AS (
  SELECT *, CASE WHEN level <= water THEN CAST(cap AS DOUBLE)
            ELSE w * first_value(water) OVER (ORDER BY level <= water, level, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target
  FROM b
), e AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t
), p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.budget, least(3, e.budget // greatest(e.source_size, 1)) AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN epochs >= 3 THEN 0 ELSE greatest(0, least(size, budget - epochs * source_size - before)) END AS BIGINT) AS taken
FROM p
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), w AS (
  SELECT n, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS total,
         CASE WHEN generate_subscripts(words, 1) + 34 <= len(words)
              THEN sha256(array_to_string(list_slice(words, generate_subscripts(words, 1), generate_subscripts(words, 1) + 34), ' ')) END AS passage
  FROM d
), r AS (
  SELECT *, passage IS NOT NULL AND count(*) OVER (PARTITION BY passage) > 1 AS again FROM w
), c AS (
  SELECT *, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM r
), g AS (
  SELECT n, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY n
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (n)
"""


def _op12() -> str:
    """Ten rounds, one after the other; sums and products of integers below 2 ** 53 are exact in doubles."""
    own = "list_inner_product(v.w, v.w) - 2 * list_inner_product(v.w, c.w) + list_inner_product(c.w, c.w)"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "h AS (SELECT w, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), w) - 1 AS cluster FROM v)",
        "c0 AS MATERIALIZED (SELECT cluster, w FROM h WHERE cluster < 8)",
    ]
    for i in range(11):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT n, vec_id, w, cluster, distance FROM (SELECT v.n, v.vec_id, v.w, c.cluster, {own} AS distance,"
            f" row_number() OVER (PARTITION BY v.n ORDER BY {own}, c.cluster) AS place FROM v CROSS JOIN c{i} c) WHERE place = 1)"
        )
        if i < 10:
            steps.append(
                f"m{i} AS (SELECT cluster, list(x ORDER BY dim) AS w FROM (SELECT cluster, dim, floor(sum(x) / count(*)) AS x"
                f" FROM (SELECT cluster, unnest(w) AS x, generate_subscripts(w, 1) AS dim FROM a{i}) GROUP BY cluster, dim) GROUP BY cluster)"
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.w, c.w) AS w FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a10 a JOIN c10 c USING (cluster)
"""
    )


OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), o AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(list_slice(words, i, i + size - 1), ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS size)
), f AS MATERIALIZED (
  SELECT lang, phrase, size, count(*) AS f FROM o GROUP BY ALL
), t AS (
  SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 10
), k AS (
  SELECT *, unnest(range(1, size)) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(k.words, 1, k.k), ' ')
         JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(k.words, k.k + 1, k.size), ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, array_to_string(list_slice(words, 1, 2), ' ') AS phrase, a FROM c WHERE size = 3
    UNION ALL SELECT lang, array_to_string(list_slice(words, 2, 3), ' '), a FROM c WHERE size = 3
  ) GROUP BY ALL
), r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * b.a
)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, r.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM r JOIN t USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_search": OP7, "op9_warc": OP9, "op10_mixing": OP10, "op11_anchors": OP11, "op12_kdtree": _op12(), "op13_phrases": OP13}
