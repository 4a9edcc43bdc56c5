"""Catalog entries: exact kNN and the SMOTE family (B7, B9-B11) over the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as B
from ..operators.neighbors import knn
from ..sources import fixtures as fx
from .registry import query

VEC_SQL = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, CAST(label = 0 AS INTEGER) AS target
                   FROM embeddings),
m AS (SELECT * FROM v WHERE target = 1)"""


def vecs(spark, sf):
    return fx.vectors(spark, sf).withColumnRenamed("vec_id", "id")


@query("b07_knn_minority", f"""
WITH {VEC_SQL},
pairs AS (SELECT a.id, b.id AS nn_id, list_distance(a.f, b.f) AS dist FROM m a JOIN m b ON a.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, nn_id) AS INTEGER) AS rank FROM pairs)
SELECT id, nn_id, dist, rank FROM r WHERE rank <= 5""", dbl=("dist",))
def b07k(spark, sf):
    v = vecs(spark, sf)
    mino = v.filter("target = 1")
    return knn(mino, mino, 5, cell_size=20)


@query("b07_knn_minority_vs_all", f"""
WITH {VEC_SQL},
pairs AS (SELECT a.id, b.id AS nn_id, list_distance(a.f, b.f) AS dist FROM m a JOIN v b ON a.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, nn_id) AS INTEGER) AS rank FROM pairs)
SELECT id, nn_id, dist, rank FROM r WHERE rank <= 10""", dbl=("dist",))
def b07a(spark, sf):
    v = vecs(spark, sf)
    return knn(v.filter("target = 1"), v, 10, cell_size=50)


@query("b07_smote_counts", f"""
WITH {VEC_SQL},
c AS (SELECT count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0) AS n0 FROM v)
SELECT 1 AS target, 0 AS is_synthetic, n1 AS n FROM c
UNION ALL SELECT 0, 0, n0 FROM c
UNION ALL SELECT 1, 1, CAST(floor(0.33 * n0) - n1 AS BIGINT) FROM c WHERE floor(0.33 * n0) > n1""")
def b07c(spark, sf):
    s = B.smote(vecs(spark, sf), ratio=0.33, k=5)
    return s.groupBy("target", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("b07_smote_rows")
def b07r(spark, sf):
    """Synthetic rows themselves (hash-seeded: rows-only check)."""
    return B.smote(vecs(spark, sf), ratio=0.33, k=5).filter("is_synthetic = 1")


@query("b10_borderline_smote_counts", f"""
WITH {VEC_SQL},
c AS (SELECT count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0) AS n0 FROM v)
SELECT 1 AS target, 0 AS is_synthetic, n1 AS n FROM c
UNION ALL SELECT 0, 0, n0 FROM c
UNION ALL SELECT 1, 1, CAST(floor(0.33 * n0) - n1 AS BIGINT) FROM c WHERE floor(0.33 * n0) > n1""")
def b10(spark, sf):
    s = B.borderline_smote(vecs(spark, sf), ratio=0.33, k=5, m=10)
    return s.groupBy("target", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("b11_smote_tomek_counts")
def b11(spark, sf):
    s = B.smote_tomek(vecs(spark, sf), ratio=0.33, k=5)
    return s.groupBy("target", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("b08_balance_warning_path", f"""
WITH {VEC_SQL},
c AS (SELECT count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0) AS n0 FROM v),
g AS (SELECT n1, n0, n1 >= 6 AND n1 < 0.4 * n0 AS balanced, CAST(floor(0.5 * n0) AS BIGINT) AS up FROM c)
SELECT 1 AS target, 0 AS is_synthetic, n1 AS n FROM g
UNION ALL SELECT 0, 0, CASE WHEN balanced THEN least(n0, CAST(floor(up / 0.75) AS BIGINT)) ELSE n0 END FROM g
UNION ALL SELECT 1, 1, up - n1 FROM g WHERE balanced AND up > n1""")
def b08(spark, sf):
    """Guard + SMOTE(.5) + undersample(.75) on the vectors: class counts."""
    s = B.balance(vecs(spark, sf), path="warning")
    return s.groupBy("target", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


def _nn_all_sql(k):
    return f"""
WITH {VEC_SQL},
pairs AS (SELECT a.id, b.id AS nn_id, b.target AS nt, list_distance(a.f, b.f) AS dist FROM m a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nn_id) AS rank FROM pairs),
nm AS (SELECT id, count(*) FILTER (WHERE nt <> 1) AS n_maj FROM r WHERE rank <= {k} GROUP BY id)"""


@query("b09_adasyn_allocation", _nn_all_sql(5) + """,
c AS (SELECT count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0) AS n0 FROM v),
s AS (SELECT id, n_maj / 5.0 AS r FROM nm)
SELECT id, r, CAST(round_even(r / (SELECT sum(r) FROM s) * (SELECT floor(0.33 * n0) - n1 FROM c), 0) AS BIGINT) AS g
FROM s""", dbl=("r",))
def b09a(spark, sf):
    return B.adasyn_allocation(vecs(spark, sf), ratio=0.33, k=5)


@query("b10_borderline_danger", _nn_all_sql(10) + """
SELECT id, n_maj, n_maj >= 5.0 AND n_maj < 10 AS danger FROM nm""")
def b10d(spark, sf):
    return B.borderline_danger(vecs(spark, sf), m=10)


@query("b09_adasyn_counts", _nn_all_sql(5) + """,
c AS (SELECT count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0) AS n0 FROM v),
s AS (SELECT id, n_maj / 5.0 AS r FROM nm),
g AS (SELECT sum(CAST(round_even(r / (SELECT sum(r) FROM s) * (SELECT floor(0.33 * n0) - n1 FROM c), 0) AS BIGINT)) AS g FROM s)
SELECT 1 AS target, 0 AS is_synthetic, n1 AS n FROM c
UNION ALL SELECT 0, 0, n0 FROM c
UNION ALL SELECT 1, 1, CAST(g AS BIGINT) FROM g WHERE g > 0""")
def b09(spark, sf):
    s = B.adasyn(vecs(spark, sf), ratio=0.33, k=5)
    return s.groupBy("target", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))
