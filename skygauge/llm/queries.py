"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.llm.centroids import centroid_clusters
from skygauge.llm.counting import token_counts
from skygauge.llm.extract import extract
from skygauge.llm.forest import near_vectors
from skygauge.llm.jaccard import jaccard_join
from skygauge.llm.middle import digests
from skygauge.llm.mixing import MOST, mix, sized
from skygauge.llm.nearest import nearest
from skygauge.llm.packing import pack
from skygauge.llm.pii import find
from skygauge.llm.quality import score, train
from skygauge.llm.rules import judge
from skygauge.llm.storage import land, table
from skygauge.llm.text import WORD_PATTERN
from skygauge.llm.warc import derive, responses


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).drop("text", "lang", "class_distance", "common_distance")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages")))
    shown = made.withColumns({"content_length": F.length("block").cast("long"), "content": F.col("block").cast("string")})
    return shown.drop("headers", "block")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).drop("text_hash")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    mixed = mix(land(docs, "sizes"))
    at = [F.get("passes", F.lit(k))["position"] for k in range(MOST)]
    places = [F.round(p + 1e-9, 6).alias(f"position_{k + 1}") for k, p in enumerate(at)]
    return mixed.repartitionByRange(at[0], "doc_id").sortWithinPartitions(at[0], "doc_id").select("doc_id", "size", "source_size", "target", "taken", *places)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_quality_classifier, op3_quality_rules, op4_personal_data, op5_best_fit_packing, op6_token_counts, op7_warc_derivatives, op8_ngram_jaccard_join, op9_mix_sources, op10_embedding_near_dedup, op11_nearest_neighbours, op12_fill_in_middle, op13_centroid_clustering)}

ORACLE_SQL: dict[str, str] = {}

#: Near-copy links of gram sets, by comparing every two texts that share a gram, and their components.
ORACLE_SQL["op8_ngram_jaccard_join"] = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(text, '{WORD_PATTERN}') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, chr(10))]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(10))) END) AS gram
    FROM words
), counts AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM shared JOIN counts p ON p.doc_id = x JOIN counts q ON q.doc_id = y WHERE 5 * s >= 4 * (p.n + q.n - s)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1
), degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, component_id, coalesce(n_links, 0) AS n_links, doc_id = component_id AS kept
FROM documents JOIN lowest ON lowest.x = doc_id LEFT JOIN degree ON degree.x = doc_id
"""

ORACLE_SQL["op9_mix_sources"] = f"""
WITH sized AS (
    SELECT doc_id, coalesce('=' || source, '~') AS src, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '')) AS code
    FROM documents
), total AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1
), ranked AS (
    SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM total
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER t, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER t, 0)) AS own
    FROM ranked WINDOW t AS (ORDER BY cap::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT src, w, source_size, least(cap::DOUBLE, w * max(CASE WHEN w * own <= cap THEN own END) OVER ()) AS target FROM levels
), placed AS (
    SELECT doc_id, w, size, source_size, target, floor(target + 0.5)::BIGINT AS to_take,
        (sum(size) OVER (PARTITION BY src ORDER BY code, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
    FROM sized JOIN targets USING (src)
), read AS (
    SELECT *, list_transform([0, 1, 2], lambda k: greatest(0, least(size, to_take - before - k * source_size))) AS taken_by_pass FROM placed
), shares AS (
    SELECT *, list_transform([1, 2, 3], lambda k: CASE WHEN taken_by_pass[k] > 0
        THEN (before + (k - 1) * source_size + taken_by_pass[k] / 2.0) / greatest(to_take, 1)::DOUBLE END) AS share FROM read
), timed AS (
    SELECT *, list_transform(share, lambda s: round(1e-9 + CASE w WHEN 1 THEN 1.5 - sqrt(2.25 - 2 * s) WHEN 2 THEN s ELSE sqrt(0.25 + 2 * s) - 0.5 END, 6)) AS place FROM shares
)
SELECT doc_id, size, source_size, target, list_sum(taken_by_pass)::BIGINT AS taken, place[1] AS position_1, place[2] AS position_2, place[3] AS position_3
FROM timed
"""


#: Links of usable vectors by comparing every two rows, and their components.
ORACLE_SQL["op10_embedding_near_dedup"] = """
WITH RECURSIVE rows AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
    SELECT vec_id, list_transform(v, lambda c: c / sqrt(list_inner_product(v, v))) AS u FROM rows
    WHERE len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(v, v) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM usable a, usable b WHERE a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= 0.9
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM rows UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1
), degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, component_id, coalesce(n_links, 0) AS n_links, vec_id = component_id AS kept
FROM rows JOIN lowest ON lowest.x = vec_id LEFT JOIN degree ON degree.x = vec_id
"""

#: Inner products of every query with every other row.
ORACLE_SQL["op11_nearest_neighbours"] = """
WITH usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
    FROM usable q, usable c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""

#: Units by a pattern without look-around, sections by their ends, digests of the strings put together.
ORACLE_SQL["op12_fill_in_middle"] = """
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS code FROM documents
), cut AS (
    SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || code[1:8])::BIGINT AS h1, ('0x' || code[9:16])::BIGINT AS h2,
        ('0x' || code[17:24])::BIGINT AS h3, ('0x' || code[25:32])::BIGINT AS h4
    FROM given
), placed AS (
    SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""

_ASSIGNED = """a{k} AS (
    SELECT rid, vec_id, v, cluster, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS place FROM (
            SELECT rid, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM vectors, c{k}
        )
    ) WHERE place = 1
)"""
_MOVED = """s{k} AS (
    SELECT cluster, d, sum(x) AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{k}) GROUP BY 1, 2
), m{k} AS (SELECT cluster, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY d) AS c FROM s{k} GROUP BY 1
), c{next} AS (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster)
)"""
#: Rounds written out one after the other.
ORACLE_SQL["op13_centroid_clustering"] = f"""
WITH vectors AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
    SELECT row_number() OVER (ORDER BY code) - 1 AS cluster, v AS c FROM (SELECT sha256('2:' || vec_id) AS code, v FROM vectors ORDER BY code LIMIT 40)
), {", ".join(_ASSIGNED.format(k=k) + ", " + _MOVED.format(k=k, next=k + 1) for k in range(5))}, {_ASSIGNED.format(k=5)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (cluster)
"""
