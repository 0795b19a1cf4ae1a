"""Semantics that the star-schema tables do not show: nulls, ties, CSV rules, charts, windows, errors."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from brindle import errors, functions as E, operators as O, sources as S, storage, types as BT
from brindle.plans.builder import from_schema
from brindle.plans import introspect
from brindle.plot import plot
from brindle.plot.scales import domain_of, linear_scale, nice_ticks, ordinal_scale
from brindle.streaming import sessions, stream_table, windowed


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_schema_helpers():
    s = BT.make_schema({"a": "int8", "b": "uint64", "c": "string"})
    assert s["b"].dataType == T.DecimalType(20, 0)
    assert BT.is_schema_equal(s, BT.make_schema({"a": "int8", "b": "uint64", "c": "string_dict"}))
    assert BT.compare_schemas(s, BT.drop_columns(s, ["c"])) == ["3 columns against 2"]
    assert BT.get_column_names(BT.rename_column(s, "a", "z")) == ["z", "b", "c"]
    assert BT.get_column_index(s, "c") == 2 and BT.has_column(s, "a")
    assert "a: int8?" in BT.format_schema(s)
    for bad in ({}, {"": "int8"}, {"x" * 300: "int8"}, {"a": "int7"}):
        with pytest.raises(errors.SchemaError):
            BT.make_schema(bad)
    with pytest.raises(errors.SchemaError):
        BT.make_schema([("a", "int8"), ("a", "int8")])
    with pytest.raises(errors.ColumnError):
        BT.get_column(s, "nope")


def test_division_rounding_and_casts(spark):
    df = spark.createDataFrame([(-2.5, 0, "12.9 "), (2.5, 2, "x"), (None, 3, None)], "v double, k int, t string")
    got = rows(df.select(E.round_half_up("v"), E.div("v", F.col("k")), E.mod(F.lit(-7), F.col("k")), E.cast_to("t", "int32", T.StringType())))
    assert got == [(-2.0, None, None, 12), (3.0, 1.25, -1, None), (None, None, -1, None)]
    words = spark.createDataFrame([("Yes",), (" off ",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in rows(words.select(E.cast_to("t", "boolean", T.StringType())))] == [True, False, None, None]
    big = spark.createDataFrame([("9223372036854775807",), ("1e3",), ("nan",)], "t string")
    assert [r[0] for r in rows(big.select(E.cast_to("t", "int64", T.StringType())))] == [9223372036854775807, 1000, None]


def test_predicates_with_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert rows(df.filter(E.not_(F.col("a") == 1))) == [(None,), (3,)]
    assert rows(df.filter(F.col("a") != 1)) == [(3,)]
    assert rows(df.filter(E.is_in("a", [1, None]))) == [(1,), (None,)]
    assert rows(df.filter(E.is_in("a", []))) == []


def test_text(spark):
    df = spark.createDataFrame([(" a b﻿",), ("aXaX",), ("",), (None,)], "t string")
    assert [r[0] for r in rows(df.select(E.trim("t")))] == ["a b", "aXaX", "", None]
    assert [r[0] for r in rows(df.select(E.replace("t", "X", "yy", all_=False)))][1] == "ayyaX"
    assert [r[0] for r in rows(df.select(E.pad("t", 3, "*")))][1:3] == ["aXaX", "***"]
    assert [r[0] for r in rows(df.select(E.substring("t", 1, 2)))][1] == "Xa"
    assert rows(spark.range(1).select(E.parse_json(F.lit('{"b": 1, "a": [2]}')), E.parse_json(F.lit("null")), E.parse_json(F.lit("{"))))[0] == ('{"a":[2],"b":1}', None, None)


def test_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 3, 1), dt.datetime(2024, 3, 1, 2))], "a timestamp_ntz, b timestamp_ntz")
    got = rows(df.select(E.day_of_week("a"), E.diff_days("a", "b"), E.truncate_date("a", "week"), E.truncate_date("a", "day"), E.to_date(F.lit("30/02/2024"), "DD/MM/YYYY"), E.format_date("a", "YYYY.MM.DD")))
    assert got == [(0, 1, dt.date(2024, 2, 26), dt.date(2024, 3, 3), None, "2024.03.03")]
    with pytest.raises(errors.BrindleError):
        E.truncate_date("a", "decade")


def test_sort_nulls_and_tail(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 5), (4, None)], "id int, v int")
    ids = lambda *k: [r[0] for r in rows(O.sort(df, *k))]
    assert ids("v", "id") == [3, 1, 2, 4]
    assert ids(O.desc("v"), "id") == [1, 3, 2, 4]
    assert ids(O.asc("v").nulls_first(), "id") == [2, 4, 3, 1]
    assert [r[0] for r in rows(O.tail(df, 2, keys=[O.asc("v"), O.asc("id")]))] == [2, 4]
    assert rows(O.tail(df.limit(0), 3)) == []
    assert len(rows(O.tail(df, 9))) == 4


def test_joins(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (3, "d")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (4, "w")], "k int, v string")
    assert len(rows(O.inner_join(a, b, "k"))) == 4
    assert O.inner_join(a, b, "k").columns == ["k", "v", "v_right"]
    assert sorted(rows(O.right_join(a, b, "k")), key=str) == sorted([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "y"), (None, None, "z"), (4, None, "w")], key=str)
    assert sorted(rows(O.anti_join(a, b, "k")), key=str) == [(3, "d"), (None, "c")]
    assert rows(O.semi_join(a, b, "k")) == [(1, "a"), (1, "b")]
    assert O.cross_join(a, b).columns == ["k", "v", "k_right", "v_right"]
    with pytest.raises(errors.SchemaError):
        O.inner_join(a.withColumn("v_right", F.lit(1)), b, "k")
    with pytest.raises(errors.BrindleError):
        O.join(a, b, "k", how="sideways")


def test_groups(spark):
    df = spark.createDataFrame([("A", 10), ("A", None), (None, 5), ("B", None)], "k string, v int")
    got = {r[0]: tuple(r)[1:] for r in O.group_by(df, "k", {"s": E.sum_("v"), "n": E.count("v"), "u": E.count_unique("v"), "sd": E.std("v"), "med": E.median("v")}).collect()}
    assert got == {"A": (10.0, 1, 2, None, 10.0), None: (5.0, 1, 1, None, 5.0), "B": (None, 0, 1, None, None)}
    assert rows(O.sort(O.group_by(df, "k").count(), "k")) == [("A", 2), ("B", 1), (None, 1)]
    assert O.scalar_mean(df, "v") == 7.5
    with pytest.raises(errors.BrindleError):
        O.group_by(df, [])
    many = spark.range(5000).withColumn("g", F.col("id") % 2500)
    assert O.group_by(many, "g").count().count() == 2500


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=25))
def test_fill(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(3)
    forward, backward, kept = [], [], None
    for v in values:
        forward.append(kept := v if v is not None else kept)
    kept = None
    for v in reversed(values):
        backward.append(kept := v if v is not None else kept)
    for fill, want in ((O.fill_forward, forward), (O.fill_backward, backward[::-1])):
        assert [r[1] for r in sorted(rows(fill(df, "v", "i")))] == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 9))), max_size=30))
def test_fill_in_split_groups(spark, values):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(values)], "i int, k string, v int").repartition(3)
    for fill in (O.fill_forward, O.fill_backward):
        assert sorted(rows(fill(df, "v", "i", by="k", split_groups=True))) == sorted(rows(fill(df, "v", "i", by="k")))


def test_fill_backward_takes_no_square_of_a_group(spark, monkeypatch):
    """A frame up to the last row is read anew for each row."""
    plans, write = [], storage.materialised
    monkeypatch.setattr("brindle.operators.rows.materialised", lambda df: plans.append(O.explain(df)) or write(df))
    values = [(i, "ab"[i % 7 == 0], i if i % 400 == 150 else None) for i in range(2000)]
    df = spark.createDataFrame(values, "i int, k string, v int").repartition(3)
    for order, ahead in (("i", 1), (F.desc("i"), -1)):
        for more in ({}, {"by": "k"}, {"by": "k", "split_groups": False}):
            want, kept = [], {}
            for i, k, v in values[::-ahead]:
                group = k if more else None
                kept[group] = v if v is not None else kept.get(group)
                want.append((i, k, kept[group]))
            got = O.fill_backward(df, "v", order, **more)
            plans.append(O.explain(got))
            assert got.columns == df.columns and sorted(rows(got)) == sorted(want)
    assert len(plans) == 10 and "unboundedpreceding" in "".join(plans) and not any("unboundedfollowing" in p for p in plans)


def test_cleaning(spark):
    df = spark.createDataFrame([(1, None, "[1,2]"), (2, 5, "[]"), (None, 6, "x")], "a int, b int, j string")
    assert rows(O.drop_null(df, ["a"]))[0][0] == 1 and O.drop_null(df).count() == 1
    assert rows(O.fill_null(df, "a", 0))[2][0] == 0
    assert rows(O.count_nulls(df, ["a", "b"])) == [(1, 1)]
    assert O.has_any_null(df) and not O.has_any_null(df, ["j"])
    assert [r[2] for r in rows(O.explode_json(df, "j"))] == ["1", "2", "x"]
    assert O.sample(df, 0).count() == 0 and O.sample(df, 2).count() == 3
    assert rows(O.cast(df, "a", "string"))[0][0] == "1"
    with pytest.raises(errors.SchemaError):
        O.drop(df, "a", "b", "j")
    with pytest.raises(errors.SchemaError):
        O.rename(df, {"a": "b"})
    with pytest.raises(errors.ColumnError):
        O.select(df, "nope")


def test_sets(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    assert O.concat(a, a).count() == 6 and O.union(a, a).count() == 2
    assert O.unique(a, ["k"]).count() == 2
    with pytest.raises(errors.SchemaError):
        O.concat(a, a.withColumnRenamed("v", "w"))


def test_csv_files(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id;name;flag;n\n1; "a;b" ;yes;300\n 2 ;;no;7\nx;c;;\n4;"d ""q""";T;5\n')
    schema = {"id": "int32", "name": "string", "flag": "boolean", "n": "uint8"}
    got = rows(S.read_csv(spark, str(p), schema, delimiter=";"))
    assert got == [(1, "a;b", True, None), (2, None, False, 7), (None, "c", None, None), (4, 'd "q"', True, 5)]
    assert rows(S.read_csv(spark, str(p), schema, delimiter=";", skip_rows=2, projection=[0])) == [(None,), (4,)]
    assert rows(S.read_csv(spark, str(p), schema, delimiter=";", defaults=True))[1] == (2, "", False, 7)
    assert rows(S.read_csv(spark, str(p), schema, delimiter=";", max_rows=1, filter=F.col("id") > 1)) == [(2, None, False, 7)]
    cached = lambda **more: rows(S.read_csv(spark, str(p), schema, delimiter=";", cache_dir=str(tmp_path / "cache"), **more))
    assert sorted(cached(), key=str) == sorted(got, key=str) and len(list((tmp_path / "cache").iterdir())) == 1
    assert cached(projection=[0], filter=F.col("id") > 1) == [(2,), (4,)] and len(list((tmp_path / "cache").iterdir())) == 1
    assert cached(defaults=True)[1][1] == "" and len(list((tmp_path / "cache").iterdir())) == 2
    S.write_csv(spark.range(3), str(tmp_path / "out"))
    assert S.read_csv(spark, str(tmp_path / "out"), {"id": "int64"}).count() == 3


def test_cache(spark, tmp_path):
    src, cache = str(tmp_path / "src"), str(tmp_path / "cache")
    calls = []

    def read():
        calls.append(1)
        return spark.read.parquet(src)

    spark.range(3).write.parquet(src)
    assert S.cached_read(spark, src, read, cache).count() == 3 and S.cached_read(spark, src, read, cache).count() == 3
    assert len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(src)
    assert S.cached_read(spark, src, read, cache).count() == 5 and len(calls) == 2


def test_memory_sources(spark):
    assert [r[0] for r in rows(S.range_frame(spark, 0, 10, 2))] == [0, 2, 4, 6, 8]
    assert [r[0] for r in rows(S.range_frame(spark, 3, 0, -1))] == [3, 2, 1]
    with pytest.raises(errors.BrindleError):
        S.range_frame(spark, 0, 1, 0)
    with pytest.raises(errors.BrindleError):
        S.from_columns(spark, {"a": [1], "b": []})
    assert S.from_columns(spark, {"a": [1, None], "b": ["x", "y"]}).dtypes == [("a", "bigint"), ("b", "string")]
    assert S.empty(spark, {"a": "date"}).count() == 0
    assert O.to_columns(S.from_records(spark, [{"a": 1}, {}], {"a": "int32"})) == {"a": [1, None]}


def test_pipeline_builder_and_introspection(spark):
    schema = BT.make_schema({"k": "string", "v": "int32"})
    p = from_schema(schema).filter(F.col("v") > 1).group_by("k", {"n": E.count()}).sort("k")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema)
    out = p.execute(df)
    assert [tuple(r) for r in out["rows"]] == [("a", 1), ("b", 1)] and out["rows_in"] == 3
    with pytest.raises(Exception):
        from_schema(schema).select("nope").build(spark)
    assert introspect.infer_type(spark, F.col("v") > 1, schema) == T.BooleanType()
    assert introspect.is_aggregate(spark, E.sum_("v"), schema) and not introspect.is_aggregate(spark, F.col("v") + 1, schema)
    with pytest.raises(errors.TypeMismatch):
        introspect.validate(spark, F.col("zzz"), schema)
    assert O.reduce(df, lambda a, r: a + r["v"], 0) == 6


def test_pushdown(spark):
    df = S.read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], F.col("l_quantity") > 49)
    plan = O.explain(df)
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_comment" not in plan
    assert "l_tax" not in plan.split("ReadSchema")[1]


def test_charts(spark):
    df = spark.createDataFrame([("jan", 3, 1.0), ("feb", -1, 2.0), ("<mar>", 4, None)], "m string, s int, v double")
    for chart in (plot(df).bar("m", "s", title="t & u"), plot(df).bar("m", "s", horizontal=True), plot(df).line("m", "s", show_points=True), plot(df).scatter("v", "s"), plot(df).histogram("s", bins=4)):
        svg = chart.to_svg()
        assert svg.startswith("<svg") and svg.endswith("</svg>") and "<mar>" not in svg
        assert chart.to_vega_lite()["data"]["values"]
        assert chart.to_json()["kind"] == chart.kind
    assert [y for _, y in plot(df).histogram("s", bins=5).series[0].points] == [1, 0, 0, 0, 2, 0]
    assert plot(df.limit(0)).histogram("s").to_svg()
    assert rows(O.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 2)) == [(0, 1.0, 2.0, 0), (1, 2.0, 3.0, 2)]
    assert nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10] and domain_of([]) == (0, 1) and domain_of([0, 0]) == (0, 1)
    assert linear_scale((0, 10), (0, 100))(5) == 50 and linear_scale((1, 1), (0, 10))(1) == 5
    place, band = ordinal_scale(["a", "b"], (0, 10))
    assert (place("b"), band, place("?")) == (7.5, 5, 0)


def test_streaming_equals_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    table = spark.read.parquet(src)
    aggregates = {"n": E.count()}
    batch = windowed(table, "ts", ["event_type"], aggregates, "6 hours")
    stream = windowed(stream_table(spark, src, table.schema), "ts", ["event_type"], aggregates, "6 hours", late="1 hour")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("windows"))) == sorted(rows(batch))
    assert sessions(table, "ts", ["user_id"], aggregates, "30 minutes").agg(F.sum("n")).first()[0] == table.count()
