"""Plan-shape guards: no cartesian products, nested-loop joins or row-at-a-time Python UDFs in any
relational query; hash-seeded generation is independent of the input partitioning."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
SKIP = ("m0", "m1", "s14", "a28", "p32", "st01", "b08", "b09_adasyn_counts", "b10_borderline_smote", "b11",
        "op", "pipeline")  # eager queries with tests of their own


def test_no_pairwise_or_python_row_operators(spark):
    import __spark_entry__ as E

    for name, fn in E.queries().items():
        if name.startswith(SKIP):
            continue
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for bad in FORBIDDEN:
            assert bad not in plan, f"{name} plans {bad}"


def test_candidates_independent_of_partitioning(spark):
    from outagelens.plans import warning_features as WF
    from outagelens.plans.catalog_features import warning_inputs

    o, _, _ = warning_inputs(spark, SF_SMALL)
    a = WF.candidates(o.repartition(1))
    b = WF.candidates(o.repartition(7, "county_fips"))
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0
    assert a.filter(F.col("target") == 0).count() == a.filter(F.col("target") == 1).count()
