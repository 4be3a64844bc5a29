"""Document retrieval over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.plans import catalogue as cat
from secflow.plans import detection as det
from secflow.plans import retrieval as rt
from secflow.queries import tables as t
from secflow.queries.registry import Section
from secflow.sources.telemetry import telemetry

section = Section()


def docs(spark, sf):
    return rt.unique_documents(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text"))


UNIQUE = "uq AS MATERIALIZED (SELECT d.doc_id, source, text FROM documents d WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text))"
section.add("rag_chunks", lambda spark, sf: rt.chunks(docs(spark, sf)).selectExpr(
    "doc_id", "chunk_no", "cast(length(chunk) as bigint) as chars", "md5(cast(chunk as binary)) as body"),
    f"""{t.with_(UNIQUE)} SELECT doc_id, i::INT AS chunk_no, length(substr(text, i * 450 + 1, 500)) AS chars, md5(substr(text, i * 450 + 1, 500)) AS body
FROM (SELECT *, unnest(range(greatest(1, ceil((length(text) - 50) / 450)::BIGINT))) AS i FROM uq)""")
_TOK = "[\\p{L}\\p{N}_.-]{2,}"
TFIDF = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM uq), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
voc AS MATERIALIZED (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 20000),
wt0 AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM uq)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term)),
wt AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wt0)"""


def rag_tfidf(spark, sf):
    weights, _ = rt.tfidf(docs(spark, sf))
    top = det.first_rows(weights.withColumn("w", F.round("w", 6)), ["doc_id"], [F.col("w").desc(), F.col("term")], 5)
    return top.selectExpr("doc_id", "rank", "term", "w")


section.add("rag_tfidf", rag_tfidf, f"""{t.with_(UNIQUE, TFIDF)} SELECT doc_id, rank, term, round(w, 6) AS w FROM
(SELECT doc_id, term, w, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, term) AS rank FROM wt) WHERE rank <= 5""")


def rag_cosine_topk(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rt.nearest(vectors, rt.label_centroids(vectors), 5)


section.add("rag_cosine_topk", rag_cosine_topk, """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
q AS (SELECT label AS query, i, avg(x) AS y FROM e GROUP BY ALL), qn AS (SELECT query, sqrt(sum(y * y)) AS n FROM q GROUP BY 1), vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
s AS (SELECT query, vec_id, round(sum(x * y) / any_value(qn.n) / any_value(vn.n), 6) AS score FROM e JOIN q USING (i) JOIN qn USING (query) JOIN vn USING (vec_id) GROUP BY ALL)
SELECT query, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")


def semantic(spark, sf, k=6):
    corpus = docs(spark, sf)
    weights, terms = rt.tfidf(corpus)
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as query_id", "text", "concat('src', item_id % 20) as anchor")
    asked = rt.weigh(rt.term_counts(queries, "query_id"), terms, "query_id")
    return corpus, queries, rt.similar(weights, asked, k)


SIMILAR = f"""qt AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM benchmark) GROUP BY ALL),
qw0 AS (SELECT query_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM uq)) / (1 + df)) + 1) AS w FROM qt JOIN voc USING (term)), qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM qw0),
sc AS (SELECT query_id, doc_id, round(sum(w * qw), 8) AS score FROM wt JOIN qw USING (term) GROUP BY ALL),
sem AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 6),
anc AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN (SELECT source, min(doc_id) AS doc_id FROM uq GROUP BY 1) ON source = 'src' || (item_id % 20))"""
section.add("union_context", lambda spark, sf: (lambda c, q, s: rt.anchors(c, q).selectExpr("query_id", "doc_id", "0 as priority").unionByName(
    s.selectExpr("query_id", "doc_id", "1 as priority")).groupBy("query_id", "doc_id").agg(F.min("priority").alias("priority")))(*semantic(spark, sf)),
    f"""{t.with_(UNIQUE, TFIDF, SIMILAR)} SELECT query_id, doc_id, min(p)::INT AS priority FROM (SELECT query_id, doc_id, 0 AS p FROM anc UNION ALL SELECT query_id, doc_id, 1 FROM sem) GROUP BY ALL""")


def rag_grounded(spark, sf):
    corpus, queries, similar = semantic(spark, sf)
    return rt.grounded(rt.anchors(corpus, queries), similar, 4)


section.add("rag_grounded", rag_grounded, f"""{t.with_(UNIQUE, TFIDF, SIMILAR)} SELECT query_id, doc_id, p::INT AS priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, r, doc_id) AS rank FROM (
SELECT query_id, doc_id, min(p) AS p, arg_min(r, p) AS r FROM (SELECT query_id, doc_id, 0 AS p, 0 AS r FROM anc UNION ALL SELECT query_id, doc_id, 1, rank FROM sem) GROUP BY ALL)) WHERE rank <= 4""")


def rag_lsa(spark, sf):
    vectors = rt.latent_vectors(docs(spark, sf))
    return vectors.selectExpr("doc_id", "size(vector) as dims", "round(sqrt(aggregate(vector, 0D, (a, x) -> a + x * x)), 4) as length")


section.add("rag_lsa", rag_lsa)


def rag_query_text(spark, sf):
    events = telemetry(spark, sf)
    return rt.query_text(events, det.rule_matches(events))


section.add("rag_query_text", rag_query_text, f"""{t.with_(t.TEL, f"h AS ({t.hits_sql(cat.PER_EVENT)})", "r AS (SELECT event_id, array_to_string(list_sort(list_distinct(list(technique || ' ' || title))), ' ') AS rules FROM h GROUP BY 1)")}
SELECT event_id, concat_ws(' ', rules, left(command_line, 200), process_name, category || ' ' || action, CASE WHEN dst_port <> 0 THEN 'port ' || dst_port END) AS query FROM tel LEFT JOIN r USING (event_id)""")
