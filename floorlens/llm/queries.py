"""Registered queries of the numbered operators, with SQL where it says them."""

from __future__ import annotations

import public_tokenizers

from . import (
    bm25_search, byte_bpe, class_lm, crf_language, decontaminate, html_cut, licence_scan, merkle_manifest, near_dedup, neighbour_graph,
    rule_quality, suffix_dedup, table_kmeans,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name, sql=None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


@query(
    "op4_near_dedup",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w),
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT a AS doc_id, a AS other FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.other),
c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY 1)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(least, s.doc_id) AS component_id,
       coalesce(least, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c USING (doc_id)
""",
)
def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op7_decontaminate",
    r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
       FROM benchmark, low),
win AS (SELECT DISTINCT item_id, least(len(words), 10) AS n,
               array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS g
        FROM iw, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS t(i) WHERE len(words) > 0),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
       FROM documents, low),
occ AS (SELECT doc_id, i, k.n, array_to_string(words[i : i + k.n - 1], ' ') AS g
        FROM dw, (SELECT DISTINCT n FROM win) AS k, unnest(range(1, len(words) - k.n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, win.n, item_id FROM occ JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
               string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""",
)
def op7_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query("op9_class_lm")
def op9_class_lm(spark, sf_dir):
    return class_lm.score(table(spark, sf_dir, "documents")).drop("perplexity")


@query("op1_crf_language")
def op1_crf_language(spark, sf_dir):
    return crf_language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op5_rule_quality")
def op5_rule_quality(spark, sf_dir):
    return rule_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_licence_digest", licence_scan.sql())
def op10_licence_digest(spark, sf_dir):
    return licence_scan.report(table(spark, sf_dir, "documents"))


@query("op6_html_cut")
def op6_html_cut(spark, sf_dir):
    return html_cut.report(table(spark, sf_dir, "pages"))


@query("op8_bm25_search")
def op8_bm25_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bm25_search.top_k(docs, docs.where("doc_id % 50 = 0"))


def _kmeans_sql(rounds: int) -> str:
    """One nearest-centroid join and one update for each round, then the last join."""
    parts = [
        """v AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64, false)),
x AS (SELECT row, unnest(range(64)) AS d, unnest(list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT)) AS value FROM v),
first AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT)) - 1 AS k
          FROM v ORDER BY k LIMIT 16),
c0 AS (SELECT k, d, value FROM first JOIN x USING (row))"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""s{r} AS (SELECT row, k, sum((x.value - c.value) * (x.value - c.value))::BIGINT AS distance FROM x JOIN c{r} AS c USING (d) GROUP BY row, k),
a{r} AS (SELECT row, k, distance FROM s{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, k) = 1),
m{r} AS (SELECT k, d, (sum(value) - ((sum(value) % count(*)) + count(*)) % count(*)) // count(*) AS value FROM a{r} JOIN x USING (row) GROUP BY k, d),
c{r + 1} AS (SELECT k, d, coalesce(m.value, c.value)::BIGINT AS value FROM c{r} AS c LEFT JOIN m{r} AS m USING (k, d))"""
        )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT v.vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, h.mark AS centroid_sha256
FROM a{rounds} JOIN v USING (row)
JOIN (SELECT k, sha256(string_agg(value::VARCHAR, ',' ORDER BY d)) AS mark FROM c{rounds} GROUP BY k) AS h USING (k)"""
    )


@query("op11_table_kmeans", _kmeans_sql(table_kmeans.ROUNDS))
def op11_table_kmeans(spark, sf_dir):
    return table_kmeans.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_neighbour_graph")
def op12_neighbour_graph(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbour_graph.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query(
    "op13_merkle_manifest",
    """
WITH RECURSIVE crc AS (
  SELECT [list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
          FOR b IN range(256)] AS tab),
d AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, [ord(z)::BIGINT FOR z IN string_split(doc_id::VARCHAR, '')]),
                lambda c, z: xor(c >> 8, tab[(xor(c, z) & 255) + 1]))) % 3 = 0 AS struck FROM documents, crc),
f AS (
  SELECT doc_id, lang, struck, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
leaf AS (
  SELECT doc_id, h, CASE WHEN struck THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE h END AS got,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g
  FROM (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h FROM f)),
up AS (
  SELECT g, 0 AS level, i, h, count(*) OVER (PARTITION BY g) AS n FROM leaf
  UNION ALL
  SELECT g, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY g, level, i // 8, n),
ends AS (SELECT g, h AS subroot, max(level) OVER (PARTITION BY g) AS height FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, g - 1 AS i, subroot AS h, count(*) OVER () AS n FROM ends
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
runs AS (
  SELECT g, level, i // 8 AS run, string_agg(h, '' ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT g, height + level, i // 8, string_agg(h, '' ORDER BY i) FROM top, (SELECT g, height FROM ends) WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, h, i AS r, g, 0 AS level, i, height, got AS acc, '' AS beside FROM leaf JOIN ends USING (g)
  UNION ALL
  SELECT doc_id, h, r, g, level + 1, place // 8, height, sha256(hs[: place % 8 * 64] || acc || hs[place % 8 * 64 + 65 :]),
         beside || hs[: place % 8 * 64] || hs[place % 8 * 64 + 65 :]
  FROM (SELECT *, CASE WHEN level = height THEN g - 1 ELSE i END AS place FROM walk) JOIN runs USING (g, level) WHERE run = place // 8)
SELECT doc_id, w.h AS leaf, subroot, root, sha256(beside) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM walk AS w JOIN ends USING (g), root WHERE level = w.height + (SELECT max(level) FROM top)
""",
)
def op13_merkle_manifest(spark, sf_dir):
    return merkle_manifest.report(table(spark, sf_dir, "documents"))
