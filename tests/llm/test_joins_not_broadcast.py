"""Joins whose rows grow with the table are never broadcast, whatever the planner takes the tables' sizes for."""

from voluma.llm import components, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_joins(spark, tmp_path):
    spark.range(100).selectExpr("id * 7919 as fp").write.parquet(f"{tmp_path}/fps")
    shown = plan(simhash.near_links(spark.read.parquet(f"{tmp_path}/fps")))
    assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_component_joins(spark, tmp_path):
    spark.range(100).selectExpr("id + 1 as u", "id as v").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    shown = plan(components._small_star(components._large_star(edges).distinct()))
    assert "SortMergeJoin" in shown and "Broadcast" not in shown
