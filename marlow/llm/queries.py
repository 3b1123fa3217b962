"""The queries of this folder, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlow.llm import bpe, centroids, langid, license_scan, mpeg, near_vectors, neighbours, ngram_join, packing, pii, substring, suffix, token_alignment
from marlow.llm._io import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "scores")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passages(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit(license_scan.sample(docs))).drop("text")


def op8_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


_ALL = (op1_pii, op2_near_vectors, op3_bpe, op4_language, op5_suffix_dedup, op6_ngram_join, op7_license_scan, op8_mpeg, op9_packing, op10_substring_dedup, op11_centroid_clustering, op12_token_alignment, op13_neighbours)
QUERIES = {f.__name__: f for f in _ALL}

# Checksums, tokens, trained models, learned bounds and spans of one chosen source are beyond SQL: their
# queries are compared with brute force in tests/llm.
def _clusters_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Every round as tables of its own: distances to all centroids, the nearest, floors of the means."""
    steps = [
        f"x AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {scale}) AS BIGINT)) AS p FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, p) - 1 AS j, p FROM (SELECT sha256('{seed}:' || vec_id) AS h, p FROM x WHERE vec_id IS NOT NULL ORDER BY h, p LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS (SELECT i, any_value(vec_id) AS vec_id, any_value(p) AS p, arg_min(j, o) AS j, min(o).d AS d FROM (SELECT x.i, x.vec_id, x.p, c.j, {{'d': list_sum(list_transform(list_zip(x.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'j': c.j}} AS o FROM x, c{r} c) GROUP BY i)"
        )
        if r < rounds:
            steps.append(f"m{r} AS (SELECT j, list(f ORDER BY e) AS p FROM (SELECT j, e, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM (SELECT j, unnest(range(1, {dims + 1})) AS e, unnest(p) AS v FROM a{r}) GROUP BY j, e) GROUP BY j)")
            steps.append(f"c{r + 1} AS (SELECT c.j, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN m{r} m USING (j))")
    last = f"SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (j)"
    return "WITH " + ",\n".join(f"{s.split(' AS ', 1)[0]} AS MATERIALIZED {s.split(' AS ', 1)[1]}" for s in steps) + "\n" + last


ORACLES: dict[str, str] = {
    "op11_centroid_clustering": _clusters_sql(centroids.CLUSTERS, centroids.ROUNDS, centroids.DIMS, centroids.SCALE, centroids.SEED),
    "op13_neighbours": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            GROUP BY vec_id
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 10
    """,
    "op2_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
        ), reach AS (SELECT a AS vec_id, b AS far FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.far = l.a),
        low AS (SELECT vec_id, min(far) AS far FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT x.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(x.vec_id, coalesce(low.far, x.vec_id)) AS component_id,
            x.vec_id = least(x.vec_id, coalesce(low.far, x.vec_id)) AS kept
        FROM embeddings x LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
    "op6_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        links AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * k >= 4 * (p.n + q.n - k)
        ), reach AS (SELECT a AS doc_id, b AS far FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.far = l.a),
        low AS (SELECT doc_id, min(far) AS far FROM reach GROUP BY doc_id), c AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a),
        k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS copy_id FROM w WHERE len(w) > 0)
        SELECT d.doc_id, least(d.doc_id, coalesce(low.far, d.doc_id)) AS class_id, coalesce(k.copy_id, d.doc_id) AS copy_id, coalesce(c.n, 0)::BIGINT AS n_links,
            d.doc_id = least(d.doc_id, coalesce(low.far, d.doc_id)) AS kept
        FROM documents d LEFT JOIN low USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w WHERE len(w) >= 50)),
        hit AS (SELECT doc_id, s FROM x QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
        gone AS (SELECT doc_id, list(DISTINCT i) AS i FROM (SELECT doc_id, unnest(range(s, s + 50)) AS i FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(i), 0)::BIGINT AS n_removed,
            sha256(CASE WHEN i IS NULL THEN array_to_string(w, ' ') WHEN len(i) = len(w) THEN '' ELSE array_to_string(list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(i, j))), lambda j: w[j]), ' ') END) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)
    """,
}
