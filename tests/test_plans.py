"""Plans of the headline operators: pushdown, pruning, partial work before each shuffle."""

import re

from pyspark.sql import functions as F

from brindle import functions as E, operators as O, sources as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def line(spark):
    return S.read_parquet(spark, f"{SF}/lineitem.parquet")


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(O.select(O.filter_rows(line(spark), F.col("l_quantity") > 10), "l_orderkey", "l_returnflag"))
    assert "GreaterThan(l_quantity,10.0)" in p
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>", p)
    assert "Exchange" not in p


def test_groups_are_merged_before_the_shuffle(spark):
    p = plan(O.group_by(line(spark), "l_suppkey", {"s": E.sum_("l_quantity"), "n": E.count()}))
    assert "partial_sum" in p and p.count("Exchange") == 1


def test_sort_with_limit_keeps_few_rows(spark):
    p = plan(O.limit(O.sort(line(spark), O.desc("l_extendedprice"), "l_orderkey"), 5))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p


def test_top_per_group_limits_groups_before_the_shuffle(spark):
    p = plan(O.top_per_group(line(spark), ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey"], 2))
    assert p.count("WindowGroupLimit") == 2
    p = plan(O.unique(line(spark), ["l_suppkey"], order="l_orderkey"))
    assert p.count("WindowGroupLimit") == 2


def test_expressions_stay_in_the_jvm(spark):
    df = spark.read.parquet(f"{SF}/part.parquet").select(E.trim("p_name").alias("t"), E.replace("p_type", "A", "b", all_=False).alias("r"), E.pad("p_brand", 20).alias("p"), E.round_half_up("p_retailprice", 1).alias("n"))
    assert not re.search("Python|Arrow|Pandas", plan(df))


def test_join_strategy_is_left_to_the_optimizer(spark):
    import inspect

    from brindle.operators import joins

    assert "broadcast(" not in inspect.getsource(joins)
    small = spark.read.parquet(f"{SF}/nation.parquet")
    assert "BroadcastHashJoin" in plan(O.inner_join(spark.read.parquet(f"{SF}/customer.parquet"), small, "c_nationkey", "n_nationkey"))
