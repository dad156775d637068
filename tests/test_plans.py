"""Plan assertions: no single-partition step over unaggregated rows, no Python
in the feature plan, filters and projections reach the scan."""

from tests.conftest import SF_SMALL
from txsentinel.operators.features import add_velocity_features
from txsentinel.operators.profile import normal_only
from txsentinel.plans import flow as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_has_no_single_partition_and_no_python(spark):
    p = plan(P.engineered(spark, SF_SMALL))
    assert "SinglePartition" not in p
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p


def test_velocity_windows_share_one_exchange(spark):
    lab = P.labelled(spark, SF_SMALL)
    p = plan(add_velocity_features(lab, strategy="window").select("tx_frequency_24h"))
    assert p.count("Exchange hashpartitioning(customer_id") <= 2  # union side + window


def test_ranged_velocity_never_clusters_on_customer_alone(spark):
    from txsentinel.session import materialize
    lab = materialize(P.labelled(spark, SF_SMALL), "lab")
    p = plan(add_velocity_features(lab, strategy="ranged").select("tx_frequency_24h"))
    assert "hashpartitioning(customer_id" not in p


def test_filter_and_projection_pushed_to_scan(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    df = normal_only(ev.withColumnRenamed("event_id", "is_fraud")).select("value")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,0)]" in p
    assert "ReadSchema: struct<event_id:bigint,value:double>" in p


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    """Features cleaned, scaled and clipped into one array were a method that ran in the interpreter."""
    from txsentinel.session import prepare
    limit = "spark.sql.codegen.hugeMethodLimit"
    prepare(spark)
    assert spark.conf.get(limit) == "8000"
    spark.conf.set(limit, "4000")       # a session's own value stays
    try:
        assert prepare(spark).conf.get(limit) == "4000"
    finally:
        spark.conf.set(limit, "8000")
