"""Registered vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import neighbours as N
from docsift.operators import vectors as V
from docsift.plans.registry import query
from docsift.session import scratch_dir
from docsift.sources.fixtures import Fixtures, with_fixtures
from docsift.sources.tables import read_table

QUERY_DOC = 7
MORE_LIKE_DOC = 11

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def cos_sql(a: str, b: str) -> str:
    return f"coalesce(nullif(isnan({_COS.format(a=a, b=b)}), true)::INT * 0 + {_COS.format(a=a, b=b)}, -1.0)"


def _knn_sql(doc: int, k: int) -> str:
    return f"""
SELECT c.id, c.name,
       round(CASE WHEN e.embedding IS NULL THEN -1.0 ELSE coalesce({_COS.format(a='e.embedding', b='q.v')}, -1.0) END, 6)
       AS similarity
FROM corpus c LEFT JOIN (SELECT * FROM emb WHERE model_id = 1 AND start = 0) e ON c.id = e.id,
     (SELECT embedding AS v FROM emb WHERE id = {doc} AND model_id = 1 AND start = 0) q
ORDER BY CASE WHEN e.embedding IS NULL THEN -1.0 ELSE coalesce({_COS.format(a='e.embedding', b='q.v')}, -1.0) END DESC, c.id LIMIT {k}"""

def _shown(df):
    """Similarities with the digits that the check compares."""
    return df.withColumn("similarity", F.round("similarity", 6))



@query("knn_exact", "V2/V1/J5/O4", with_fixtures(["corpus", "emb"], _knn_sql(QUERY_DOC, 20)))
def knn_exact(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    q = V.vector_of(fx.emb, QUERY_DOC)
    return _shown(V.knn_exact(fx.corpus.select("id", "name"), fx.emb, q, 20))


@query("more_like", "V4", with_fixtures(["corpus", "emb"], _knn_sql(MORE_LIKE_DOC, 10)))
def more_like(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return _shown(V.more_like(fx.corpus.select("id", "name"), fx.emb, MORE_LIKE_DOC, 10))


@query("knn_join", "V5", with_fixtures(["emb"], f"""
SELECT qid, id, similarity, rank FROM (
  SELECT q.id AS qid, e.id, round({_COS.format(a='q.embedding', b='e.embedding')}, 6) AS similarity,
         row_number() OVER (PARTITION BY q.id ORDER BY {_COS.format(a='q.embedding', b='e.embedding')} DESC,
                            e.id) AS rank
  FROM (SELECT * FROM emb WHERE model_id = 1 AND start = 0 AND id % 50 = 0) q,
       (SELECT * FROM emb WHERE model_id = 1 AND start = 0) e
  WHERE q.id <> e.id)
WHERE rank <= 5"""))
def knn_join(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    queries = fx.emb.where(F.col("id") % 50 == 0).select("id").distinct()
    return _shown(V.knn_join(queries, fx.emb, 5).select("qid", "id", "similarity", "rank"))


ANN_TABLES, ANN_BITS, ANN_PROBES = 3, 4, 5  # of the two searches below; by default they follow from the table


def _approx_sql(where: str = "true", dims: int = 64) -> tuple[str, str]:
    """The same hash tables, and of each the buckets of least cost."""
    planes = N.hash_planes(dims, ANN_TABLES, ANN_BITS)
    dot = "list_dot_product(CAST({v} AS DOUBLE[]), {p}::DOUBLE[])"
    margins = [[dot.format(v="embedding", p=p.tolist()) for p in table] for table in planes]
    buckets = ", ".join("(" + " + ".join(f"({m} >= 0)::INT * {1 << j}" for j, m in enumerate(t)) + f") AS b{i}" for i, t in enumerate(margins))
    sides = ", ".join(f"{m} AS m{i}_{j}" for i, t in enumerate(margins) for j, m in enumerate(t))
    cost = lambda i: " + ".join(f"CASE WHEN ((b >> {j}) & 1) <> (m{i}_{j} >= 0)::INT THEN m{i}_{j} * m{i}_{j} ELSE 0 END"
                                for j in range(ANN_BITS))
    probed = " OR ".join(f"v.b{i} IN (SELECT b FROM range(0, {1 << ANN_BITS}) t(b), q ORDER BY {cost(i)}, b LIMIT {ANN_PROBES})"
                         for i in range(ANN_TABLES))
    sim = f"coalesce({_COS.format(a='v.embedding', b='q.embedding')}, -1.0)"
    return f"""
SELECT v.id, round({sim}, 6) AS similarity FROM vec v, q WHERE {probed}
ORDER BY {sim} DESC, v.id LIMIT 20""", f"""vec AS (
  SELECT id, embedding, {buckets} FROM emb WHERE model_id = 1 AND start = 0 AND {where}),
q AS (SELECT embedding, {sides} FROM emb WHERE model_id = 1 AND start = 0 ORDER BY id LIMIT 1)"""


def _approx(spark, sf_dir, docs=None):
    fx = Fixtures(spark, sf_dir)
    first = fx.emb.where((F.col("model_id") == 1) & (F.col("start") == 0)).orderBy("id").select("embedding").first()
    index = N.write_neighbour_index(fx.emb, scratch_dir(spark, "neighbours"), tables=ANN_TABLES, bits=ANN_BITS, probes=ANN_PROBES)
    return _shown(N.knn_approx(index, [float(x) for x in first[0]], 20, candidates=None, docs=docs(fx) if docs else None))


@query("knn_approx", "V3", with_fixtures(["emb"], *_approx_sql()))
def knn_approx(spark, sf_dir):
    return _approx(spark, sf_dir)


@query("knn_approx_filtered", "V3", with_fixtures(["corpus", "emb"], *_approx_sql(
    "id IN (SELECT id FROM corpus WHERE size >= 1000000)")))
def knn_approx_filtered(spark, sf_dir):
    return _approx(spark, sf_dir, lambda fx: fx.corpus.where(F.col("size") >= 1000000).select("id"))


def _recall(spark, sf_dir):
    """Per query vector (every id divisible by 50, of all vectors): how many of
    its 10 exact neighbours the fitted index finds, and the share of the stored
    rows that it reads."""
    vec = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit(1).alias("model_id"), F.lit(0).alias("start"), "embedding")
    index = N.write_neighbour_index(vec, scratch_dir(spark, "neighbours"))
    asked = vec.where(F.col("id") % 50 == 0)
    exact = V.knn_join(asked.select("id"), vec, 10).select("qid", "id")
    found = N.knn_approx_join(index, asked, 10).select("qid", "id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["qid", "id"], "left").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return hits.join(N.probed_share(index, asked), "qid")


@query("knn_approx_recall", "V3/V5")
def knn_approx_recall(spark, sf_dir):
    rows = _recall(spark, sf_dir)
    return rows.select("qid", "n_exact", "n_found", F.round(F.col("n_found") / F.col("n_exact"), 4).alias("recall"),
                       F.round("share", 4).alias("read_share"))


@query("knn_approx_recall_holds", "V3/V5", """
SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, count(*) FILTER (vec_id % 50 = 0) * least(10, count(*) - 1) AS n_exact,
       true AS recall_holds
FROM embeddings""")
def knn_approx_recall_holds(spark, sf_dir):
    """Whether nine of ten exact neighbours are found, over all queries."""
    rows = _recall(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n_exact").alias("n_exact"),
                    (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("recall_holds"))


@query("best_chunk", "V6", with_fixtures(["emb"], f"""
SELECT id, start, similarity FROM (
  SELECT e.id, e.start, round({_COS.format(a='e.embedding', b='q.v')}, 6) AS similarity,
         row_number() OVER (PARTITION BY e.id ORDER BY {_COS.format(a='e.embedding', b='q.v')} DESC, e.start)
         AS rn
  FROM (SELECT * FROM emb WHERE model_id = 2) e,
       (SELECT embedding AS v FROM emb WHERE id = {QUERY_DOC} AND model_id = 1 AND start = 0) q)
WHERE rn = 1"""))
def best_chunk(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return _shown(V.best_chunk(fx.emb, V.vector_of(fx.emb, QUERY_DOC)))


@query("check_dims", "V7", with_fixtures(["emb", "model"], """
SELECT e.id, e.model_id, e.start, CAST(len(e.embedding) AS INT) AS length, m.size AS dims
FROM (SELECT id, CASE WHEN id % 40 = 1 THEN 9 ELSE model_id END AS model_id, start,
             CASE WHEN id % 25 = 3 THEN embedding[1:60] ELSE embedding END AS embedding FROM emb) e
LEFT JOIN model m ON e.model_id = m.id
WHERE m.size IS NULL OR len(e.embedding) <> m.size"""))
def check_dims(spark, sf_dir):
    """Some vectors cut short, some of an unknown model."""
    fx = Fixtures(spark, sf_dir)
    cut = F.when(F.col("id") % 25 == 3, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    emb = fx.emb.withColumn("embedding", cut).withColumn("model_id", F.when(F.col("id") % 40 == 1, 9).otherwise(F.col("model_id")))
    return V.check_dims(emb, fx.model)


@query("vector_to_json", "V8", with_fixtures(["emb"], """
SELECT id, model_id, start,
       '[' || array_to_string(list_transform(embedding, lambda x: printf('%.4f', CAST(x AS DOUBLE))), ',') || ']'
       AS json
FROM emb"""))
def vector_to_json(spark, sf_dir):
    e = Fixtures(spark, sf_dir).emb
    return e.select("id", "model_id", "start", V.vector_to_json("embedding", 4).alias("json"))


@query("has_embedding", "F9", with_fixtures(["corpus", "emb"], """
SELECT id FROM corpus c WHERE EXISTS (SELECT 1 FROM emb e WHERE e.id = c.id AND e.model_id = 2)"""))
def has_embedding(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return V.has_embedding(fx.corpus.select("id"), fx.emb, 2)


@query("vectors_as_map", "A19", with_fixtures(["emb", "model"], """
SELECT e.id, string_agg(m.path, ',' ORDER BY m.path) AS models, count(*) AS n_vectors,
       string_agg(array_to_string(list_transform(e.embedding, lambda x: printf('%.4f', CAST(x AS DOUBLE))), ','), ';' ORDER BY m.path) AS vectors
FROM emb e JOIN model m ON e.model_id = m.id WHERE e.start = 0 GROUP BY e.id"""))
def vectors_as_map(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    m = V.vectors_as_map(fx.emb, fx.model)
    return m.select("id", F.array_join(F.map_keys("vectors"), ",").alias("models"),
                    F.size("vectors").cast("long").alias("n_vectors"),
                    F.array_join(F.transform(F.map_values("vectors"), lambda v: F.array_join(F.transform(
                        v, lambda x: F.format_string("%.4f", x.cast("double"))), ",")), ";").alias("vectors"))


@query("export_documents", "J3", with_fixtures(["corpus", "mime", "tags", "emb", "model"], """
SELECT c.id,
       '{"name":' || to_json(c.name) || CASE WHEN i.mime IS NULL THEN '' ELSE ',"mime":' || to_json(i.mime) END
       || CASE WHEN t.tags IS NULL THEN '' ELSE ',"tag":' || to_json(t.tags) END || '}' AS json,
       v.models, v.vectors
FROM corpus c JOIN idx i ON c.id = i.id
LEFT JOIN (SELECT id, list_sort(list_distinct(list(tag))) AS tags FROM tags GROUP BY id) t ON c.id = t.id
LEFT JOIN (SELECT e.id, string_agg(m.path, ',' ORDER BY m.path) AS models,
                  string_agg(array_to_string(list_transform(e.embedding, lambda x: printf('%.4f', CAST(x AS DOUBLE))), ','), ';'
                             ORDER BY m.path) AS vectors
           FROM emb e JOIN model m ON e.model_id = m.id WHERE e.start = 0 GROUP BY e.id) v ON c.id = v.id""",
    __import__("docsift.plans.common", fromlist=["IDX_CTE"]).IDX_CTE))
def export_documents(spark, sf_dir):
    from docsift.plans.common import doc_index

    fx = Fixtures(spark, sf_dir)
    d = doc_index(fx)
    out = V.export_documents(d, fx.tags, fx.emb, fx.model, ["name", "mime"])
    parsed = F.from_json("json", "struct<name:string,mime:string,tag:array<string>,"
                                 "emb:map<string,array<float>>>")
    return out.select("id", parsed.alias("r")).select(
        "id", F.to_json(F.struct(F.col("r.name").alias("name"), F.col("r.mime").alias("mime"),
                                 F.col("r.tag").alias("tag"))).alias("json"),
        F.array_join(F.map_keys("r.emb"), ",").alias("models"),
        F.array_join(F.transform(F.map_values("r.emb"), lambda v: F.array_join(F.transform(
            v, lambda x: F.format_string("%.4f", x.cast("double"))), ",")), ";").alias("vectors"))


@query("more_like_stored", "V4/V2", with_fixtures(["corpus", "emb"], _knn_sql(MORE_LIKE_DOC, 10)))
def more_like_stored(spark, sf_dir):
    from docsift.plans.common import search_index

    return _shown(search_index(spark, sf_dir).more_like(MORE_LIKE_DOC, 10))
