"""Times the headline queries on $BENCH_SF_DIR (default sf0.1) with local[$BENCH_CPUS] and prints one JSON line.

Sources are opened once (their times stand apart); each query runs once to warm up, then $BENCH_RUNS times (default 5), and its figure is the median. Results go to the no-op sink, so that
every row is made.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F

import brindle.functions as E
import brindle.operators as O
import brindle.sources as S

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 4)))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
CSV = "/tmp/brindle-bench-lineitem.csv"


CSV_SCHEMA = {"l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int32", "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "string"}

c = F.col
OPEN = {
    "lineitem": lambda s: S.read_parquet(s, f"{SF}/lineitem.parquet"),
    "orders": lambda s: S.read_parquet(s, f"{SF}/orders.parquet"),
    "part": lambda s: S.read_parquet(s, f"{SF}/part.parquet"),
    "csv": lambda s: S.read_csv(s, CSV, CSV_SCHEMA),
}
COMPLEX = lambda: (c("l_quantity") > 25) & (c("l_discount") < 0.05) & E.starts_with("l_returnflag", "R")
QUERIES = {
    "parquet_filter": lambda t: t["lineitem"].filter(c("l_quantity") > 25),
    "parquet_complex_filter": lambda t: t["lineitem"].filter(COMPLEX()),
    "parquet_select_3": lambda t: O.select(t["lineitem"], "l_orderkey", "l_quantity", "l_returnflag"),
    "parquet_limit_100k": lambda t: O.limit(t["lineitem"], 100_000),
    "csv_filter": lambda t: t["csv"].filter(c("l_quantity") > 25),
    "csv_select_3": lambda t: O.select(t["csv"], "l_orderkey", "l_quantity", "l_returnflag"),
    "csv_complex_filter": lambda t: t["csv"].filter(COMPLEX()),
    "string_predicates": lambda t: t["part"].filter(E.contains("p_type", "BRASS") | E.ends_with("p_name", "e") | E.is_in("p_brand", ["Brand#11", "Brand#12"])),
    "global_aggregate": lambda t: O.aggregate(t["lineitem"], {"total": E.sum_("l_extendedprice"), "mean": E.avg("l_quantity"), "n": E.count()}),
    "group_sum_avg": lambda t: O.group_by(t["lineitem"], ["l_returnflag", "l_linestatus"], {"total": E.sum_("l_extendedprice"), "mean": E.avg("l_quantity"), "n": E.count()}),
    "group_count_many": lambda t: O.group_by(t["lineitem"], "l_partkey").count(),
    "join": lambda t: O.inner_join(O.select(t["lineitem"], "l_orderkey", "l_extendedprice"), O.select(t["orders"], "o_orderkey", "o_orderpriority"), "l_orderkey", "o_orderkey"),
    "sort": lambda t: O.sort(t["lineitem"], O.desc("l_extendedprice"), "l_orderkey", "l_linenumber"),
    "sort_limit": lambda t: O.limit(O.sort(t["lineitem"], O.desc("l_extendedprice"), "l_orderkey", "l_linenumber"), 100),
    "flagship_sales": lambda t: flagship(t["lineitem"]),
}


def flagship(df):
    df = df.transform(O.filter_rows, c("l_quantity") > 10).transform(O.with_column, "tax", c("l_extendedprice") * 0.1)
    return O.group_by(df, "l_returnflag", {"total": E.sum_("l_extendedprice"), "tax": E.avg("tax"), "n": E.count()}).transform(O.sort, O.desc("n")).transform(O.limit, 10)


def timed(run) -> float:
    """The median of RUNS runs after one that warms up."""
    taken = []
    for _ in range(RUNS + 1):
        began = time.perf_counter()
        run()
        taken.append(time.perf_counter() - began)
    return round(statistics.median(taken[1:]), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.adaptive.enabled", "true").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    S.write_csv(OPEN["lineitem"](spark).withColumn("l_shipdate", c("l_shipdate").cast("string")), CSV, mode="overwrite")
    opened = {name: timed(lambda f=f: f(spark)) for name, f in OPEN.items()}
    tables = {name: f(spark) for name, f in OPEN.items()}
    rows = {"lineitem": tables["lineitem"].count(), "part": tables["part"].count()}
    times = {name: timed(lambda make=make: make(tables).write.format("noop").mode("overwrite").save()) for name, make in QUERIES.items()}
    read = {k: rows["part"] if k == "string_predicates" else min(rows["lineitem"], 100_000) if k == "parquet_limit_100k" else rows["lineitem"] for k in times}
    source = {k: "csv" if k.startswith("csv") else "part" if k == "string_predicates" else "lineitem" for k in times}
    rates = {k: round(read[k] / v) for k, v in times.items()}
    opening = {k: round(read[k] / (v + opened[source[k]])) for k, v in times.items()}  # as if each query opened its source anew
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "open": opened, "rows_per_sec": rates, "rows_per_sec_with_opening": opening, "rows": rows["lineitem"], "sf": SF, "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
