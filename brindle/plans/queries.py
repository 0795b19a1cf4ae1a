"""Named queries over the star-schema tables, each with equivalent SQL.

Sums and means are rounded on both sides, as the order of additions differs; nulls come from nullif, as the tables have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as E, operators as O, sources as S
from ..streaming import sessions, stream_table, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 4):
    return F.round(c, digits)


@query(
    """SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS total_price, ROUND(AVG(l_extendedprice * 0.1), 4) AS avg_tax, COUNT(*) AS n
    FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag ORDER BY n DESC LIMIT 10"""
)
def flagship_sales(spark, sf_dir):
    """filter, computed column, group-by, sort, limit."""
    df = table(spark, sf_dir, "lineitem").transform(O.filter_rows, F.col("l_quantity") > 10).transform(O.with_column, "tax", F.col("l_extendedprice") * 0.1)
    out = O.group_by(df, "l_returnflag", {"total_price": r(E.sum_("l_extendedprice"), 2), "avg_tax": r(E.avg("tax")), "n": E.count()})
    return out.transform(O.sort, O.desc("n")).transform(O.limit, 10)


# predicates


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_totalprice <= 300000 AND o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'")
def filter_compare(spark, sf_dir):
    c = F.col
    p = E.and_(c("o_totalprice") > 150000, c("o_totalprice") <= 300000, c("o_orderstatus") != "F", c("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "orders").transform(O.filter_rows, p).transform(O.select, "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def filter_between(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(E.between("l_quantity", 10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NULLIF(o_orderstatus, 'P') IN ('O', 'X') OR NULLIF(o_orderstatus, 'P') IS NULL")
def filter_is_in(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    return df.filter(E.is_in("s", ["O", "X", None])).select("o_orderkey", "o_orderstatus")


@query(
    """SELECT o_orderkey FROM orders WHERE NOT COALESCE(NULLIF(o_orderstatus, 'F') = 'O' OR o_totalprice > 200000, FALSE)"""
)
def filter_logic_not(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("F")))
    return df.filter(E.not_(E.or_(F.col("s") == "O", F.col("o_totalprice") > 200000))).select("o_orderkey")


@query("SELECT SUM(CASE WHEN NULLIF(o_orderstatus, 'F') IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls, SUM(CASE WHEN NULLIF(o_orderstatus, 'F') IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS others FROM orders")
def filter_null_checks(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return df.agg(F.count_if(F.col("s").isNull()).alias("nulls"), F.count_if(F.col("s").isNotNull()).alias("others"))


@query("SELECT p_partkey, p_type FROM part WHERE (p_type LIKE '%BRASS' OR p_type LIKE 'PROMO%' OR contains(p_type, 'ANODIZED')) AND p_brand LIKE 'Brand#1%' AND regexp_matches(p_type, '[A-Z]+')")
def string_predicates(spark, sf_dir):
    p = E.or_(E.ends_with("p_type", "BRASS"), E.starts_with("p_type", "PROMO"), E.contains("p_type", "ANODIZED"))
    return table(spark, sf_dir, "part").filter(p & E.like("p_brand", "Brand#1%") & E.regexp_match("p_type", "[A-Z]+")).select("p_partkey", "p_type")


@query("SELECT c_custkey, c_acctbal > 0 AS positive, (c_acctbal > 0 AND c_mktsegment = 'BUILDING') AS chosen FROM customer")
def predicate_as_value(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "customer").transform(O.with_columns, {"positive": c("c_acctbal") > 0, "chosen": (c("c_acctbal") > 0) & (c("c_mktsegment") == "BUILDING")}).select("c_custkey", "positive", "chosen")


@query("SELECT event_id FROM events WHERE value * 2 > 100 AND event_id % 7 = 3")
def filter_callable(spark, sf_dir):
    """A predicate in Python on batches."""
    return table(spark, sf_dir, "events").select("event_id", "value").transform(O.filter_rows, lambda b: (b["value"] * 2 > 100) & (b["event_id"] % 7 == 3)).select("event_id")


# projection


@query("SELECT n_name AS nation, n_nationkey FROM nation")
def project_rename(spark, sf_dir):
    return table(spark, sf_dir, "nation").transform(O.rename, {"n_name": "nation", "unknown": "x"}).transform(O.drop, "n_regionkey", "unknown").transform(O.select, "nation", "n_nationkey")


@query("SELECT c_name AS name, c_acctbal AS balance FROM customer")
def project_select_as(spark, sf_dir):
    return O.select_as(table(spark, sf_dir, "customer"), {"name": "c_name", "balance": "c_acctbal"})


# expressions


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS a, l_extendedprice - l_discount AS s, ROUND(l_extendedprice * l_discount, 4) AS m,
      ROUND(l_extendedprice / NULLIF(l_linenumber - 1, 0), 4) AS d, (l_orderkey - 100) % NULLIF(l_linenumber - 1, 0) AS r,
      (l_orderkey // NULLIF(CAST(l_linenumber - 1 AS BIGINT), 0)) AS q, -l_quantity AS n FROM lineitem"""
)
def arith_div_mod(spark, sf_dir):
    c = F.col
    zero = c("l_linenumber") - 1
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", E.add("l_extendedprice", c("l_tax")).alias("a"), E.sub("l_extendedprice", c("l_discount")).alias("s"), r(E.mul("l_extendedprice", c("l_discount"))).alias("m"),
        r(E.div("l_extendedprice", zero)).alias("d"), E.mod(c("l_orderkey") - 100, zero).alias("r"), E.int_div("l_orderkey", zero).alias("q"), E.neg("l_quantity").alias("n"),
    )


@query(
    """SELECT c_custkey, FLOOR(c_acctbal * 10 + 0.5) / 10 AS r1, FLOOR(c_acctbal + 0.5) AS r0, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, ABS(c_acctbal) AS a,
      ROUND(SQRT(ABS(c_acctbal)), 6) AS s, ROUND(POW(c_acctbal, 2), 2) AS p FROM customer"""
)
def math_funcs(spark, sf_dir):
    b = "c_acctbal"
    return table(spark, sf_dir, "customer").select(
        "c_custkey", E.round_half_up(b, 1).alias("r1"), E.round_half_up(b).alias("r0"), E.floor(b).alias("f"), E.ceil(b).alias("c"), E.abs_(b).alias("a"),
        r(E.sqrt(E.abs_(b)), 6).alias("s"), r(E.pow_(b, 2), 2).alias("p"),
    )


@query(
    """SELECT p_partkey, CAST(LENGTH(p_name) AS BIGINT) AS n, SUBSTR(p_name, 3, 4) AS mid, SUBSTR(p_name, 3) AS rest, UPPER(p_name) AS up, LOWER(p_type) AS low,
      REGEXP_REPLACE('\t ' || p_name || '  ', '^\\s+|\\s+$', '', 'g') AS trimmed, REPLACE(p_name, 'a', '__') AS every,
      REGEXP_REPLACE(p_type, 'E', '_') AS once, p_brand || '/' || p_type AS joined,
      CASE WHEN LENGTH(p_brand) < 12 THEN LPAD(p_brand, 12, '*') ELSE p_brand END AS padded, CASE WHEN LENGTH(p_type) < 12 THEN RPAD(p_type, 12, '-') ELSE p_type END AS padded_right,
      CAST(STRLEN(p_name) AS BIGINT) AS bytes, CAST(INSTR(p_type, 'S') - 1 AS BIGINT) AS at, SUBSTR(p_type, 2, 3) AS range13 FROM part"""
)
def string_funcs(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", E.length("p_name").cast("long").alias("n"), E.substring("p_name", 2, 4).alias("mid"), E.substring("p_name", 2).alias("rest"), E.upper("p_name").alias("up"), E.lower("p_type").alias("low"),
        E.trim(F.concat(F.lit("\t "), c("p_name"), F.lit("  "))).alias("trimmed"), E.replace("p_name", "a", "__").alias("every"), E.replace("p_type", "E", "_", all_=False).alias("once"),
        E.concat("p_brand", F.lit("/"), "p_type").alias("joined"), E.pad("p_brand", 12, "*").alias("padded"), E.pad("p_type", 12, "-", "right").alias("padded_right"),
        E.byte_length("p_name").cast("long").alias("bytes"), E.index_of("p_type", "S").cast("long").alias("at"), E.substring_range("p_type", 1, 4).alias("range13"),
    )


@query("SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS n, CAST(STRLEN(text) AS BIGINT) AS bytes, LOWER(SUBSTR(text, 1, 8)) AS start FROM documents")
def string_lengths_unicode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.code_points("text").cast("long").alias("n"), E.byte_length("text").cast("long").alias("bytes"), E.lower(E.substring("text", 0, 8)).alias("start"))


@query(
    """SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, quarter(ts) AS q, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS w FROM events"""
)
def date_parts(spark, sf_dir):
    parts = {"y": E.year, "m": E.month, "d": E.day, "q": E.quarter, "h": E.hour, "mi": E.minute, "s": E.second, "w": E.day_of_week}
    return table(spark, sf_dir, "events").select("event_id", *(f("ts").cast("long").alias(n) for n, f in parts.items()))


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS later, CAST(o_orderdate AS DATE) - 7 AS before,
      CAST(FLOOR((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-06-15 12:00:00')) / 86400000.0) AS BIGINT) AS elapsed FROM orders"""
)
def date_arith(spark, sf_dir):
    since = F.lit("1995-06-15 12:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", E.add_days("o_orderdate", 30).alias("later"), E.sub_days("o_orderdate", 7).alias("before"), E.diff_days("o_orderdate", since).alias("elapsed"))


@query("SELECT event_id, " + ", ".join(f"CAST(date_trunc('{p}', ts) AS DATE) AS t_{p}" for p in ("day", "week", "month", "quarter", "year")) + " FROM events")
def date_trunc(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *(E.truncate_date("ts", p).alias(f"t_{p}") for p in ("day", "week", "month", "quarter", "year")))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS text, strftime(o_orderdate, '%d %b %Y') AS named, CAST(o_orderdate AS DATE) AS back, CAST(NULL AS DATE) AS bad FROM orders"""
)
def date_parse_format(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", E.format_date("o_orderdate", "DD/MM/YYYY HH:mm").alias("text"), E.format_date("o_orderdate", "DD MMM YYYY").alias("named"))
    return df.select("*", E.to_date("named", "DD MMM YYYY").alias("back"), E.to_date(F.lit("31/02/2020 x"), "DD/MM/YYYY").alias("bad"))


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS class,
      COALESCE(NULLIF(o_orderstatus, 'F'), NULLIF(o_orderpriority, '5-LOW'), 'none') AS first_known FROM orders"""
)
def cond_when_coalesce(spark, sf_dir):
    c = F.col
    label = E.when(c("o_totalprice") > 300000, "high").when(c("o_totalprice") > 100000, "mid").otherwise("low")
    known = E.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none"))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("class"), known.alias("first_known"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(TRUNC(l_extendedprice) AS INTEGER) AS whole, CAST(l_orderkey AS DOUBLE) AS dbl, CAST(l_linenumber AS VARCHAR) AS text,
      CAST(TRUNC(TRY_CAST(' 12.7 ' AS DOUBLE)) AS INTEGER) AS parsed, CAST(NULL AS INTEGER) AS bad, l_returnflag = 'N' AS flag, CAST(l_linenumber > 3 AS INTEGER) AS bit, CAST(NULL AS TINYINT) AS over FROM lineitem"""
)
def cast_matrix(spark, sf_dir):
    from pyspark.sql import types as T

    word = F.when(F.col("l_returnflag") == "N", " Yes ").otherwise("off")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", E.cast_to("l_extendedprice", "int32", T.DoubleType()).alias("whole"), E.cast_to("l_orderkey", "float64").alias("dbl"), E.cast_to("l_linenumber", "string").alias("text"),
        E.cast_to(F.lit(" 12.7 "), "int32", T.StringType()).alias("parsed"), E.cast_to(F.lit("abc"), "int32", T.StringType()).alias("bad"), E.cast_to(word, "boolean", T.StringType()).alias("flag"),
        E.cast_to(F.col("l_linenumber") > 3, "int32").alias("bit"), E.cast_to(F.lit(300), "int8").alias("over"),
    )


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS compact, CAST(NULL AS VARCHAR) AS bad, '7' AS scalar FROM events")
def parse_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", E.parse_json("props").alias("compact"), E.parse_json(F.lit("{oops")).alias("bad"), E.parse_json(F.lit(" 7 ")).alias("scalar"))


@query("SELECT n_nationkey, CAST(5 AS SMALLINT) AS small, CAST(1.5 AS DOUBLE) AS num, 'x' AS text, TRUE AS flag FROM nation")
def literals(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", E.typed_lit(5, "int16").alias("small"), E.typed_lit(1.5, "float64").alias("num"), E.lit("x").alias("text"), E.lit(True).alias("flag"))


# aggregates

AGGS = """ROUND(SUM(CAST({v} AS DOUBLE)), 2) AS total, ROUND(AVG({v}), 4) AS mean, COUNT({v}) AS n, COUNT(*) AS all_rows, MIN({v}) AS low, MAX({v}) AS high,
  ROUND(STDDEV_SAMP({v}), 4) AS sd, ROUND(VAR_SAMP({v}), 2) AS var, ROUND(MEDIAN({v}), 4) AS med, COUNT(DISTINCT {v}) AS kinds"""


def _aggs(v):
    return {
        "total": r(E.sum_(v), 2), "mean": r(E.avg(v)), "n": E.count(v), "all_rows": E.count(), "low": E.min_(v), "high": E.max_(v),
        "sd": r(E.std(v)), "var": r(E.variance(v), 2), "med": r(E.median(v)), "kinds": E.count_distinct(v),
    }


@query("SELECT " + AGGS.format(v="l_quantity") + " FROM lineitem")
def agg_all(spark, sf_dir):
    return O.aggregate(table(spark, sf_dir, "lineitem"), _aggs("l_quantity"))


@query("SELECT l_returnflag, l_linestatus, " + AGGS.format(v="l_extendedprice") + " FROM lineitem GROUP BY ALL")
def group_multi_key(spark, sf_dir):
    return O.group_by(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], _aggs("l_extendedprice"))


@query("SELECT l_suppkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(MAX(l_quantity * 2 + 1), 2) AS most FROM lineitem GROUP BY l_suppkey")
def group_expr_agg(spark, sf_dir):
    c = F.col
    return O.group_by(table(spark, sf_dir, "lineitem"), "l_suppkey", {"revenue": r(E.sum_(c("l_extendedprice") * (1 - c("l_discount"))), 2), "most": r(E.max_(c("l_quantity") * 2 + 1), 2)})


def _shortcut(name, sql):
    def f(spark, sf_dir):
        g = O.group_by(table(spark, sf_dir, "events"), "event_type")
        return g.count() if name == "count" else getattr(g, name)("value").transform(lambda d: d.withColumn(d.columns[1], r(F.col(f"`{d.columns[1]}`"), 2)))

    f.__name__ = f"group_shortcut_{name}"
    query(f"SELECT event_type, {sql} FROM events GROUP BY event_type")(f)


for _name, _sql in (("count", 'COUNT(*) AS "count"'), ("min", 'ROUND(MIN(value), 2) AS "min(value)"'), ("max", 'ROUND(MAX(value), 2) AS "max(value)"'), ("mean", 'ROUND(AVG(value), 2) AS "mean(value)"'), ("sum", 'ROUND(SUM(value), 2) AS "sum(value)"')):
    _shortcut(_name, _sql)


@query("SELECT NULLIF(o_orderstatus, 'F') AS status, COUNT(*) AS n, COUNT(NULLIF(o_orderstatus, 'F')) AS known, ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def group_null_key(spark, sf_dir):
    """A null key is a group; a group without values has a null sum."""
    df = table(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F"))).withColumn("price", F.when(F.col("status").isNotNull(), F.col("o_totalprice")))
    return O.group_by(df, "status", {"n": E.count(), "known": E.count("status"), "total": r(E.sum_("price"), 2)})


@query("SELECT event_type, arg_min(user_id, event_id) AS first_user, arg_max(user_id, event_id) AS last_user, arg_min(NULLIF(value, 0), event_id) AS first_value FROM events GROUP BY event_type")
def first_last_by_order(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("v", F.nullif("value", F.lit(0.0)))
    return O.group_by(df, "event_type", {"first_user": E.first("user_id", "event_id"), "last_user": E.last("user_id", "event_id"), "first_value": E.first("v", "event_id")})


@query("SELECT event_type, COUNT(DISTINCT user_id) + MAX(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 0 END) AS users, COUNT(DISTINCT NULLIF(user_id % 10, 0)) + 1 AS endings FROM events GROUP BY event_type")
def count_distinct(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("e", F.nullif(F.col("user_id") % 10, F.lit(0)))
    return O.group_by(df, "event_type", {"users": E.count_distinct("user_id"), "endings": E.count_unique("e")})


@query("SELECT MIN(o_orderpriority) AS low_text, MAX(o_orderpriority) AS high_text, CAST(MIN(o_orderdate) AS DATE) AS low_date, CAST(MAX(o_orderdate) AS DATE) AS high_date FROM orders")
def agg_min_max_text_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return O.aggregate(df, {"low_text": E.min_("o_orderpriority"), "high_text": E.max_("o_orderpriority"), "low_date": E.min_("d"), "high_date": E.max_("d")})


@query("SELECT l_returnflag, COUNT(CASE WHEN l_linestatus = 'O' THEN 1 END) AS \"O\", COUNT(CASE WHEN l_linestatus = 'F' THEN 1 END) AS \"F\" FROM lineitem GROUP BY l_returnflag")
def group_pivot(spark, sf_dir):
    return O.group_by(table(spark, sf_dir, "lineitem"), "l_returnflag").pivot("l_linestatus", ["O", "F"], E.count()).fillna(0)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def top_n_per_group(spark, sf_dir):
    return O.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 2).select("o_custkey", "o_orderkey", "o_totalprice")


# joins


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return O.inner_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
def join_left(spark, sf_dir):
    return O.left_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 250000"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@query("SELECT k, l.c_name, r.n FROM (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 3 = 0) l RIGHT JOIN (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) r USING (k)")
def join_right_same_key(spark, sf_dir):
    left = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").transform(O.select_as, {"k": "c_custkey", "c_name": "c_name"})
    right = O.group_by(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), "k", {"n": E.count()})
    return O.right_join(left, right, "k")


@query("SELECT COALESCE(l.k, r.k) AS k, l.v AS v, r.v AS v_right FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15) l FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey > 8) r ON l.k = r.k")
def join_full_suffix(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    left = n.filter("n_nationkey < 15").transform(O.select_as, {"k": "n_nationkey", "v": "n_name"})
    return O.full_join(left, n.filter("n_nationkey > 8").transform(O.select_as, {"k": "n_nationkey", "v": "n_regionkey"}), "k")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark, sf_dir):
    return O.semi_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT o_orderkey, NULLIF(o_custkey % 10, 0) AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 5 AND n_nationkey = NULLIF(o_custkey % 10, 0))")
def join_anti_null_keys(spark, sf_dir):
    """Rows with a null key have no match and are kept."""
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("k"))
    right = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("k"))
    return O.anti_join(left, right, "k")


@query("SELECT a.r_regionkey, a.r_name, b.r_regionkey AS r_regionkey_2, b.r_name AS r_name_2 FROM region a CROSS JOIN region b")
def join_cross(spark, sf_dir):
    a = table(spark, sf_dir, "region")
    return O.cross_join(a, a, "_2")


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_suppkey = o.o_custkey")
def join_multi_key(spark, sf_dir):
    return O.join(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), ["l_orderkey", "l_suppkey"], ["o_orderkey", "o_custkey"]).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT a.k, COUNT(*) AS pairs FROM (SELECT user_id AS k FROM events) a JOIN (SELECT user_id AS k FROM events) b ON a.k = b.k GROUP BY a.k")
def join_fan_out(spark, sf_dir):
    """A many-to-many join of the whole table."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return O.group_by(O.join(e, e, "k"), "k", {"pairs": E.count()})


@query("SELECT n_name, r_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL ORDER BY revenue DESC, n_name LIMIT 5")
def join_chain_group_sort_limit(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    df = O.join(O.join(O.join(t("lineitem"), t("supplier"), "l_suppkey", "s_suppkey"), t("nation"), "s_nationkey", "n_nationkey"), t("region"), "n_regionkey", "r_regionkey")
    out = O.group_by(df, ["n_name", "r_name"], {"revenue": r(E.sum_(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)})
    return O.limit(O.sort(out, O.desc("revenue"), "n_name"), 5)


# sets


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def union_all(spark, sf_dir):
    a = O.select_as(table(spark, sf_dir, "nation"), {"k": "n_nationkey", "v": "n_name"})
    b = O.select_as(table(spark, sf_dir, "region"), {"k": "r_regionkey", "v": "r_name"})
    return a.transform(O.concat, b).transform(O.union_all, b)


@query("SELECT event_type, user_id % 5 AS u FROM events UNION SELECT event_type, user_id % 7 FROM events")
def union_distinct(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return O.union(e.select("event_type", (F.col("user_id") % 5).alias("u")), e.select("event_type", (F.col("user_id") % 7).alias("u")))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").transform(O.distinct)


@query("SELECT user_id, event_id, value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def unique_keep_first(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value").transform(O.unique, ["user_id"], order="event_id")


@query("SELECT NULLIF(user_id % 4, 0) AS u, event_type, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY NULLIF(user_id % 4, 0), event_type ORDER BY event_id DESC) = 1")
def unique_keep_last_null_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.nullif(F.col("user_id") % 4, F.lit(0)).alias("u"), "event_type", "event_id")
    return O.drop_duplicates(e, ["u", "event_type"], order="event_id", keep="last")


# order


def _sorted(name, key, sql):
    def f(spark, sf_dir):
        """The whole table with its order as a column."""
        df = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("n"))
        return df.transform(O.sort, key, O.asc("c_custkey")).transform(O.number_rows, "at", 1)

    f.__name__ = f"sort_{name}"
    query(f"SELECT c_custkey, NULLIF(c_nationkey, 3) AS n, ROW_NUMBER() OVER (ORDER BY NULLIF(c_nationkey, 3) {sql}, c_custkey) AS at FROM customer")(f)


_sorted("asc_nulls_last", O.asc("n"), "ASC NULLS LAST")
_sorted("desc_nulls_last", O.desc("n"), "DESC NULLS LAST")
_sorted("asc_nulls_first", O.asc("n").nulls_first(), "ASC NULLS FIRST")
_sorted("desc_nulls_first", O.desc("n").nulls_first(), "DESC NULLS FIRST")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").transform(O.sort, O.desc("o_totalprice"), "o_orderkey").transform(O.limit, 25)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail_n(spark, sf_dir):
    return O.tail(table(spark, sf_dir, "orders").select("o_orderkey"), 7, keys="o_orderkey")


@query("SELECT n_name FROM nation ORDER BY n_name OFFSET 20")
def offset_rows(spark, sf_dir):
    return O.offset(table(spark, sf_dir, "nation").select("n_name").transform(O.sort, "n_name"), 20)


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey OFFSET 1000")
def offset_large(spark, sf_dir):
    """Nearly all rows of a table."""
    df = table(spark, sf_dir, "lineitem").transform(O.sort, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return O.offset(df, 1000).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100 OFFSET 40")
def slice_page(spark, sf_dir):
    return O.slice_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").transform(O.sort, "c_acctbal", "c_custkey"), 40, 100)


@query("SELECT event_id FROM events ORDER BY value DESC, event_id DESC LIMIT 300")
def tail_of_sorted(spark, sf_dir):
    """The last rows of a frame that happens to be sorted, without keys."""
    return O.tail(table(spark, sf_dir, "events").select("event_id", "value").transform(O.sort, "value", "event_id"), 300).select("event_id")


# cleaning


@query("SELECT event_id, event_type, LAST_VALUE(NULLIF(value, v0) IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id) AS v FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v0 FROM events)")
def fill_forward(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return O.fill_forward(df, "v", "event_id", by="event_type")


@query("SELECT event_id, FIRST_VALUE(CASE WHEN event_id % 5 = 1 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM events")
def fill_backward_all_rows(spark, sf_dir):
    """Without groups: in range partitions, not in one task."""
    return O.fill_backward(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 1, F.col("value")).alias("v")), "v", "event_id")


@query("SELECT event_id, LAST_VALUE(CASE WHEN event_id % 11 = 5 THEN value END IGNORE NULLS) OVER (ORDER BY event_id) AS v FROM events")
def fill_forward_all_rows(spark, sf_dir):
    return O.fill_forward(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 5, F.col("value")).alias("v")), "v", "event_id")


@query("SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'missing') AS s, COALESCE(NULLIF(o_custkey, 1), -1) AS k FROM orders")
def fill_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.nullif("o_custkey", F.lit(1)).alias("k"))
    return df.transform(O.fill_null, "s", "missing").transform(O.fill_nulls, {"k": -1})


@query("SELECT o_orderkey, o_orderstatus AS s, o_custkey AS k FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 2 <> 0")
def drop_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey")).alias("k"))
    return O.drop_null(df)


@query("SELECT COUNT(*) FILTER (o_orderstatus = 'F') AS s, COUNT(*) FILTER (o_custkey % 2 = 0) AS k FROM orders")
def count_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey")).alias("k"))
    return O.count_nulls(df)


@query("SELECT c_custkey, CAST(TRUNC(c_acctbal) AS INTEGER) AS c_acctbal FROM customer")
def cast_column(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").transform(O.cast, "c_acctbal", "int32")


@query("SELECT p_partkey, REPLACE(p_name, ' ', '_') AS p_name, p_brand FROM part")
def column_string_ops(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"), "p_brand")
    return df.transform(O.trim_column, "p_name").transform(O.replace_column, "p_name", " ", "_")


@query(
    """SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['1', 'b'] WHEN 1 THEN ['plain'] WHEN 2 THEN CAST([] AS VARCHAR[]) ELSE [NULL] END) AS item FROM events"""
)
def explode_json(spark, sf_dir):
    """Array text, other text, an empty array, null."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, '[1, "b"]').when(k == 1, "plain").when(k == 2, "[]")
    return table(spark, sf_dir, "events").select("event_id", text.alias("item")).transform(O.explode_json, "item")


@query("SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), o_orderpriority) AS s, COALESCE(NULLIF(o_custkey, 1), o_orderkey * 2) AS k FROM orders")
def fill_null_expressions(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.nullif("o_custkey", F.lit(1)).alias("k"), "o_orderpriority")
    return O.fill_nulls(df, {"s": F.col("o_orderpriority"), "k": F.col("o_orderkey") * 2}).drop("o_orderpriority")


@query("SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s, CASE WHEN o_custkey % 2 <> 0 THEN o_custkey END AS k FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 2 <> 0")
def drop_null_all(spark, sf_dir):
    """Only rows with nulls in all of the named columns go."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey")).alias("k"))
    return O.drop_null(df, ["s", "k"], how="all")


@query("SELECT COUNT(*) FILTER (o_orderstatus = 'F') > 0 AS some, COUNT(*) FILTER (o_orderkey IS NULL) > 0 AS none FROM orders")
def any_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return S.from_records(spark, [{"some": O.has_any_null(df), "none": O.has_any_null(df, ["o_orderkey"])}], {"some": "boolean", "none": "boolean"})


@query("SELECT o_orderkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR) || ':7'), 1, 8) < '19999999'")
def sample_by_key(spark, sf_dir):
    """A tenth of the keys, the same on every run."""
    return O.sample(table(spark, sf_dir, "orders").select("o_orderkey"), 0.1, seed=7, key="o_orderkey")


@query(None)
def sample_bernoulli(spark, sf_dir):
    return O.sample(table(spark, sf_dir, "orders"), 0.1, seed=7).select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation")
def shuffle_rows(spark, sf_dir):
    return O.shuffle(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), seed=3)


# sources, histogram, inspection, pipelines, streaming


@query("SELECT CAST(range * 0.5 - 2 AS DOUBLE) AS value FROM range(20)")
def range_source(spark, sf_dir):
    return S.range_frame(spark, -2, 8, 0.5)


@query("SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE, TRUE), (2, NULL, NULL, FALSE)) t(id, name, score, ok)")
def records_source(spark, sf_dir):
    rows = [{"id": 1, "name": "a", "score": 1.5, "ok": True}, {"id": 2, "ok": False}]
    return S.from_records(spark, rows, {"id": "int32", "name": "string", "score": "float64", "ok": "boolean"})


@query("""SELECT * FROM (VALUES (1, 'x, "y"', 2.5::DOUBLE, TRUE), (NULL, 'z', NULL, FALSE), (3, NULL, 7.0, NULL)) t(id, name, score, ok)""")
def csv_source(spark, sf_dir):
    text = 'id,name,score,ok\n 1 ,"x, ""y""",2.5,true\nbad, z ,,no\n3,,7\n'
    return S.from_csv_string(spark, text, {"id": "int32", "name": "string", "score": "float64", "ok": "boolean"})


@query("SELECT l_orderkey, l_shipdate > TIMESTAMP '1998-01-01' AS late FROM lineitem WHERE l_quantity >= 49")
def parquet_source(spark, sf_dir):
    df = S.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_shipdate"], F.col("l_quantity") >= 49)
    return df.select("l_orderkey", (F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp")).alias("late"))


@query(
    """WITH b AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders),
      c AS (SELECT CAST(LEAST(FLOOR((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, COUNT(*) AS n FROM orders, b GROUP BY 1)
      SELECT CAST(range AS INTEGER) AS bin, ROUND(lo + range * ((hi - lo) / 10), 4) AS low, ROUND(lo + (range + 1) * ((hi - lo) / 10), 4) AS high, COALESCE(n, 0) AS "count" FROM range(10) CROSS JOIN b LEFT JOIN c ON bin = range"""
)
def histogram_10(spark, sf_dir):
    return O.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 10).withColumns({"low": r("low"), "high": r("high")})


@query("SELECT MIN(LENGTH(p_name)) AS min, MAX(LENGTH(p_name)) AS max, ROUND(AVG(LENGTH(p_name)), 4) AS mean FROM part")
def text_length_stats(spark, sf_dir):
    out = O.length_stats(table(spark, sf_dir, "part"), "p_name")
    return out.select(F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), r("mean").alias("mean"))


@query("SELECT SUBSTR(p_type, 1, 5) AS prefix, COUNT(*) AS \"count\" FROM part GROUP BY 1")
def text_prefix_groups(spark, sf_dir):
    return O.group_by_prefix(table(spark, sf_dir, "part"), "p_type", 5)


@query("SELECT p_name, COUNT(*) AS \"count\" FROM part GROUP BY 1 HAVING COUNT(*) > 1")
def text_duplicates(spark, sf_dir):
    return O.find_duplicates(table(spark, sf_dir, "part"), "p_name")


@query("SELECT event_type, ROUND(SUM(value * 2), 2) AS total, COUNT(*) AS n FROM events WHERE value > 10 GROUP BY event_type")
def pipeline_builder(spark, sf_dir):
    from .builder import from_schema

    df = table(spark, sf_dir, "events")
    steps = from_schema(df.schema).filter(F.col("value") > 10).select("event_type", "value").add_column("v2", F.col("value") * 2).group_by("event_type", {"total": r(E.sum_("v2"), 2), "n": E.count()})
    return df.transform(steps.build(spark))


@query("SELECT event_id, value * 2 + 1 AS value FROM events")
def map_arrow_batches(spark, sf_dir):
    import pyarrow.compute as pc

    def double(b):
        return b.set_column(1, "value", pc.add(pc.multiply(b.column(1), 2), 1.0))

    return O.map_batches(table(spark, sf_dir, "events").select("event_id", "value"), double, "event_id long, value double")


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed(df, "ts", ["event_type"], {"n": E.count(), "total": r(E.sum_("value"), 2)}, "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


@query(
    """SELECT p_partkey, UPPER(p_name) AS p_name, SUBSTR(LOWER(p_type), 3, 4) AS p_type, CASE WHEN LENGTH(p_brand) < 12 THEN RPAD(p_brand, 12, '.') ELSE p_brand END AS p_brand FROM part
    WHERE p_type LIKE 'S%' AND LENGTH(p_name) BETWEEN 5 AND 40 AND STRLEN(p_name) >= 6 AND p_brand LIKE '%2'"""
)
def text_operators(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand").transform(O.filter_by_prefix, "p_type", "S").transform(O.filter_by_suffix, "p_brand", "2")
    df = df.transform(O.filter_by_char_length, "p_name", 5, 40).transform(O.filter_by_byte_length, "p_name", 6)
    df = df.transform(O.upper_column, "p_name").transform(O.lower_column, "p_type").transform(O.substring_column, "p_type", 2, 6)
    return df.transform(O.pad_column, "p_brand", 12, ".", "right")


@query("SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_name < b.n_name THEN -1 WHEN a.n_name = b.n_name THEN 0 ELSE 1 END AS c, CAST(STRLEN(SUBSTR(a.n_name, 1, 3)) AS INTEGER) AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def text_compare(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pairs = O.join(n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey")
    return pairs.select("a", "b", O.compare("a", "b").alias("c"), O.offset_of_code_point("a", 3).alias("o"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'x', TRUE), (2, 'y', NULL), (NULL, 'z', FALSE)) t(a, b, c)")
def columns_source(spark, sf_dir):
    """Types come from the values."""
    return S.from_columns(spark, {"a": [1, 2, None], "b": ["x", "y", "z"], "c": [True, None, False]})


@query("SELECT CAST(NULL AS INTEGER) AS id, CAST(NULL AS VARCHAR) AS name WHERE FALSE")
def empty_source(spark, sf_dir):
    return S.empty(spark, {"id": "int32", "name": "string"})


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 100000")
def csv_file_round_trip(spark, sf_dir):
    """Written as CSV, read with a schema and a filter."""
    from ..storage import shared_path

    path = shared_path(spark)
    S.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return S.read_csv(spark, path, {"o_orderkey": "int64", "o_totalprice": "float64", "o_orderpriority": "string"}, filter=F.col("o_totalprice") > 100000)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def cached_source(spark, sf_dir):
    from ..storage import shared_path

    cache = shared_path(spark)
    read = lambda: table(spark, sf_dir, "nation")
    S.cached_read(spark, f"{sf_dir}/nation.parquet", read, cache)
    return S.cached_read(spark, f"{sf_dir}/nation.parquet", read, cache)


@query("SELECT MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, ROUND(AVG(o_totalprice), 4) AS mean FROM orders")
def scalar_actions(spark, sf_dir):
    """Three values of one pass."""
    values = O.scalars(table(spark, sf_dir, "orders"), {"low": E.min_("o_totalprice"), "high": E.max_("o_totalprice"), "mean": r(E.avg("o_totalprice"))})
    return S.from_records(spark, [values], {"low": "float64", "high": "float64", "mean": "float64"})


@query("SELECT MIN(c_acctbal) AS low, MAX(c_acctbal) AS high, ROUND(AVG(c_acctbal), 4) AS mean, COUNT(*) AS n FROM customer")
def scalar_shortcuts(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    values = {"low": O.scalar_min(df, "c_acctbal"), "high": O.scalar_max(df, "c_acctbal"), "mean": round(O.scalar_mean(df, "c_acctbal"), 4), "n": O.count(df)}
    return S.from_records(spark, [values], {"low": "float64", "high": "float64", "mean": "float64", "n": "int64"})


@query("SELECT MEDIAN(l_extendedprice) AS median FROM lineitem")
def median_of_all(spark, sf_dir):
    """Exact, with no task that sees all rows."""
    return O.median(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("SELECT NULLIF(user_id % 4, 0) AS u, event_type, MEDIAN(CASE WHEN event_type <> 'error' THEN value END) AS median FROM events GROUP BY 1, 2")
def median_by_groups(spark, sf_dir):
    """Null keys are a group, and a group without values has a null median."""
    df = table(spark, sf_dir, "events").select(F.nullif(F.col("user_id") % 4, F.lit(0)).alias("u"), "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return O.median(df, "v", ["u", "event_type"])


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT({c}) AS \"count\", COUNT(*) - COUNT({c}) AS nulls, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std, MIN({c})::DOUBLE AS min, MAX({c})::DOUBLE AS max FROM (SELECT l_quantity, l_linenumber, NULLIF(l_discount, 0) AS d FROM lineitem)" for c in ("l_quantity", "l_linenumber", "d"))
)
def describe_table(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("d"), "l_returnflag")
    return O.describe(df).withColumns({"mean": r("mean"), "std": r("std")})


@query("SELECT event_id, ts - INTERVAL (EXTRACT(microsecond FROM ts) % 1000000) MICROSECOND AS back, CAST(NULL AS TIMESTAMP) AS bad FROM events")
def timestamp_parse(spark, sf_dir):
    """Text in a pattern becomes a timestamp, other text null."""
    df = table(spark, sf_dir, "events").select("event_id", E.format_date(F.col("ts").cast("timestamp"), "DD/MM/YYYY HH:mm:ss").alias("t"))
    return df.select("event_id", E.to_timestamp("t", "DD/MM/YYYY HH:mm:ss").cast("timestamp_ntz").alias("back"), E.to_timestamp(F.concat("t", F.lit("?")), "DD/MM/YYYY HH:mm:ss").cast("timestamp_ntz").alias("bad"))


@query("SELECT n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation WHERE n_nationkey >= 7 AND n_regionkey > 0")
def csv_options(spark, sf_dir):
    """Several files without a header, a delimiter and quotes of their own, skipped rows in file order, a projection and a filter."""
    from ..storage import shared_path

    path = shared_path(spark)
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(";'")).alias("n_name"), "n_regionkey").repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey")
    df.write.options(sep=";", quote="'", escape="'", header="false").csv(path)
    schema = {"n_nationkey": "int32", "n_name": "string", "n_regionkey": "int32"}
    out = S.read_csv(spark, path, schema, delimiter=";", quote="'", header=False, skip_rows=7, projection=[1, 2], filter=F.col("n_regionkey") > 0)
    return out.withColumn("n_name", F.expr("rtrim(\"';\", n_name)"))


@query("SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS first FROM nation GROUP BY n_regionkey")
def parquet_sink(spark, sf_dir):
    """Written by partitions and as a bucketed table, whose groups need no shuffle."""
    import uuid

    from ..storage import shared_path

    path, name = shared_path(spark), f"brindle_{uuid.uuid4().hex}"
    S.write_parquet(table(spark, sf_dir, "nation"), path, partition_by=["n_regionkey"])
    S.write_bucketed(S.read_parquet(spark, path), name, ["n_regionkey"], 4)
    return O.group_by(spark.table(name), "n_regionkey", {"n": E.count(), "first": E.min_("n_name")})


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def exports(spark, sf_dir):
    """Records, columns and batches of a table of fixed size on the driver, and back."""
    df, schema = table(spark, sf_dir, "region").select("r_regionkey", "r_name"), {"r_regionkey": "int32", "r_name": "string"}
    parts = [O.to_records(df), [dict(zip(schema, v)) for v in zip(*(O.to_columns(df)[c] for c in schema))], [dict(zip(schema, v)) for b in O.stream_batches(df, 2) for v in zip(*b.values())]]
    return S.from_records(spark, [row for part in parts for row in part], schema)


@query("SELECT * FROM (VALUES ('region', TRUE, FALSE, 'r_regionkey,r_name', 5::BIGINT), ('nation', FALSE, FALSE, 'n_nationkey,n_name,n_regionkey', 25::BIGINT)) t(name, same, empty, columns, n)")
def inspection(spark, sf_dir):
    """Names, types, emptiness and row counts, and whether two tables may be appended."""
    from ..errors import SchemaError

    def same(a, b):
        try:
            O.validate_same_columns(a, b)
        except SchemaError:
            return False
        return True

    region, out = table(spark, sf_dir, "region"), []
    for name in ("region", "nation"):
        df = table(spark, sf_dir, name)
        assert list(O.dtypes(df)) == O.column_names(df) and "Scan parquet" in O.explain(df)
        out.append({"name": name, "same": same(region, df), "empty": O.is_empty(df), "columns": ",".join(O.column_names(df)), "n": O.count(df)})
    return S.from_records(spark, out, {"name": "string", "same": "boolean", "empty": "boolean", "columns": "string", "n": "int64"})


@query("SELECT * FROM (VALUES ('(a + 1)', 'int', FALSE, FALSE), ('(a > 1)', 'boolean', TRUE, FALSE), ('sum(a)', 'bigint', FALSE, TRUE)) t(expression, type, predicate, aggregate)")
def expression_introspection(spark, sf_dir):
    from ..types import make_schema
    from . import introspect as I

    schema, out = make_schema({"a": "int32"}), []
    for e in (F.col("a") + 1, F.col("a") > 1, F.sum("a")):
        I.validate(spark, e, schema)
        out.append({"expression": I.format_expression(e, spark, schema), "type": I.infer_type(spark, e, schema).simpleString(), "predicate": I.is_predicate(spark, e, schema), "aggregate": I.is_aggregate(spark, e, schema)})
    return S.from_records(spark, out, {"expression": "string", "type": "string", "predicate": "boolean", "aggregate": "boolean"})


@query(
    """SELECT 'bar' AS kind, o_orderstatus AS x, COUNT(*)::DOUBLE AS y FROM orders GROUP BY o_orderstatus UNION ALL
    SELECT 'line', CAST(EXTRACT(year FROM o_orderdate) AS VARCHAR), COUNT(*)::DOUBLE FROM orders GROUP BY 2 UNION ALL
    SELECT 'scatter', CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR), ROUND(MAX(c_acctbal), 2) FROM customer GROUP BY c_nationkey"""
)
def chart_points(spark, sf_dir):
    """The values of a bar, a line and a scatter chart as their Vega-Lite specifications hold them; each is drawn as SVG too."""
    from ..plot import plot

    orders = table(spark, sf_dir, "orders")
    bars = O.group_by(orders, "o_orderstatus", {"n": E.count()})
    years = O.group_by(orders.withColumn("y", F.year("o_orderdate").cast("string")), "y", {"n": E.count()}).transform(O.sort, "y")
    top = O.group_by(table(spark, sf_dir, "customer"), "c_nationkey", {"most": r(E.max_("c_acctbal"), 2)})
    out = []
    for chart in (plot(bars).bar("o_orderstatus", "n"), plot(years).line("y", "n"), plot(top).scatter("c_nationkey", "most")):
        assert chart.to_svg().startswith("<svg") and chart.to_json()["kind"] == chart.kind
        out += [{"kind": chart.kind, "x": str(v["x"]), "y": float(v["y"])} for v in chart.to_vega_lite()["data"]["values"]]
    return S.from_records(spark, out, {"kind": "string", "x": "string", "y": "float64"})


@query(
    """SELECT 'tick' AS kind, range * 20.0 AS value, range * 60.0 AS place FROM range(6) UNION ALL SELECT 'band', range, 50.0 + 100 * range FROM range(3)"""
)
def chart_scales(spark, sf_dir):
    """Ticks on a linear scale, bands on an ordinal one."""
    from ..plot import scales

    place, (band, _) = scales.linear_scale((0, 100), (0, 300)), scales.ordinal_scale(["a", "b", "c"], (0, 300))
    out = [{"kind": "tick", "value": float(t), "place": place(t)} for t in scales.nice_ticks(0, 100)] + [{"kind": "band", "value": float(i), "place": band(c)} for i, c in enumerate("abc")]
    return S.from_records(spark, out, {"kind": "string", "value": "float64", "place": "float64"})


@query(
    """SELECT user_id, CAST(MIN(ts) AS VARCHAR) AS first, COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def event_sessions(spark, sf_dir):
    """Runs of events of a user with no gap of half an hour."""
    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sessions(df, "ts", ["user_id"], {"first": F.min("ts"), "n": E.count()}, "30 minutes")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").cast("string").alias("first"), "n")


@query("SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY event_type")
def event_stream(spark, sf_dir):
    """The table read as a stream, all that is there in one run, into a table that is then read."""
    import uuid

    from ..storage import shared_path

    name = f"stream_{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = stream_table(spark, f"{sf_dir}/events*.parquet", schema)
    out = O.group_by(stream, "event_type", {"n": E.count(), "total": r(E.sum_("value"), 2)})
    q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
def pipeline_page(spark, sf_dir):
    """A pipeline with a limit after an offset."""
    from .builder import from_schema

    df = table(spark, sf_dir, "orders")
    return from_schema(df.schema).select("o_orderkey", "o_totalprice").sort(O.desc("o_totalprice"), "o_orderkey").limit(20, 30).build(spark)(df)


@query("SELECT CAST(SUM(n_nationkey) AS BIGINT) AS total, COUNT(*) AS n FROM nation")
def row_callbacks(spark, sf_dir):
    """reduce and for_each on the driver, over a table of fixed size."""
    df, seen = table(spark, sf_dir, "nation"), []
    O.for_each(df, lambda row: seen.append(row["n_nationkey"]))
    total = O.reduce(df, lambda acc, row: acc + row["n_nationkey"], 0)
    return S.from_records(spark, [{"total": total, "n": len(seen)}], {"total": "int64", "n": "int64"})


@query("SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 500000 AS over FROM orders")
def running_totals(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.sum("o_totalprice").over(w) > 500000).alias("over"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
