"""The driver's tables seen as a code graph, as frames and as the same thing in SQL.

Parts are symbols and brands their files; consecutive lines of an order call each other; suppliers
are tests that cover parts; orders are commits, customers their authors, and lines what they change.
All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import coverage_pct
from codeloom.plans.dealing import dealt
from codeloom.store import Graph

PROJECT = "shop"
#: Lines of orders, or the steps between them, that a task sorts and groups on average; under 1 KB each.
ROWS_IN_A_TASK = 250_000
NO_LIST = "CAST([] AS VARCHAR[])"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(column: str):
    return F.col(column).cast("string")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    fifth = F.col("p_partkey") % 5
    kind = F.when(fifth.isin(0, 1), "method").when(fifth.isin(2, 3), "function").otherwise("class")
    return part.select(
        F.lit(PROJECT).alias("project"),
        text("p_partkey").alias("qualified_name"),
        F.col("p_name").alias("name"),
        kind.alias("kind"),
        F.col("p_brand").alias("file"),
        (F.col("p_size") * 10).cast("int").alias("start_line"),
        (F.col("p_size") * 10 + 14).cast("int").alias("end_line"),
        F.concat_ws("\n", "p_name", F.lit(""), "p_type", "p_brand").alias("source"),
        (F.col("p_partkey") % 10 == 2).alias("is_test"),
        F.lit(True).alias("contained"),
        (F.col("p_size") % 2 == 0).alias("runtime_observed"),
        (F.col("p_size") * 2).cast("double").alias("coverage_pct"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of an order: u, v, status, test."""
    line = read(spark, sf_dir, "lineitem")
    line = dealt(line, line.count(), ROWS_IN_A_TASK, "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = line.select(F.col("l_partkey").alias("u"), F.lead("l_partkey").over(w).alias("v"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("test"))
    return rows.where("v is not null")


def by_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps with those of a call in one task."""
    return dealt(steps(spark, sf_dir), read(spark, sf_dir, "lineitem").count(), ROWS_IN_A_TASK, "u", "v")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_call(spark, sf_dir).groupBy("u", "v").agg(F.bool_or(F.col("status") == "O").alias("static"), F.bool_or(F.col("status") == "F").alias("runtime"), F.count("*").alias("observed_count"))
    return found.select(F.lit(PROJECT).alias("project"), text("u").alias("caller"), text("v").alias("callee"), "static", "runtime", "observed_count")


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("int").alias("lines_covered"))
    total = F.lit(15)
    return found.select(F.lit(PROJECT).alias("project"), text("l_suppkey").alias("test"), text("l_partkey").alias("symbol"), "lines_covered", total.alias("lines_total"), coverage_pct(F.col("lines_covered"), total).alias("coverage_pct"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.lit(PROJECT).alias("project"), F.col("p_brand").alias("path"), F.col("p_brand").alias("name")).distinct()


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = steps(spark, sf_dir).groupBy("u", "v").agg(F.count("*").alias("n"))
    rows = rows.join(file.select(F.col("p_partkey").alias("u"), F.col("p_brand").alias("src")), "u").join(file.select(F.col("p_partkey").alias("v"), F.col("p_brand").alias("target")), "v")
    rows = rows.where("src <> target").groupBy("src", "target").agg(F.sum("n").cast("int").alias("line"))
    return rows.select(F.lit(PROJECT).alias("project"), "src", "target", F.lit("file").alias("target_kind"), F.concat(F.lit("import "), "target").alias("raw"), "line")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.lit(PROJECT).alias("project"), text("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("message"), F.col("o_orderdate").cast("timestamp").alias("ts"), text("o_custkey").alias("author_email"))


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(text("c_custkey").alias("email"), F.col("c_name").alias("name"))


def symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").cast("int").alias("lines_overlapped"))
    return rows.select(F.lit(PROJECT).alias("project"), text("l_partkey").alias("qualified_name"), text("l_orderkey").alias("sha"), "lines_overlapped")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.lit(PROJECT).alias("project"), text("vec_id").alias("qualified_name"), "embedding", F.lit("table").alias("model"))


PARTS = {"symbols": symbols, "calls": calls, "covers": covers, "files": files, "imports": imports, "commits": commits, "authors": authors, "symbol_changes": symbol_changes, "embeddings": embeddings}


def graph_of(spark: SparkSession, sf_dir: str, *tables: str) -> Graph:
    """The graph with these tables (all of them if none is named)."""
    return Graph.of(spark, **{t: PARTS[t](spark, sf_dir) for t in tables or PARTS})


#: The same projection as common table expressions.
SQL = {
    "symbols": """symbols AS (
  SELECT CAST(p_partkey AS VARCHAR) AS qualified_name, p_name AS name,
    CASE WHEN p_partkey % 5 IN (0, 1) THEN 'method' WHEN p_partkey % 5 IN (2, 3) THEN 'function' ELSE 'class' END AS kind,
    p_brand AS file, CAST(p_size * 10 AS INTEGER) AS start_line, CAST(p_size * 10 + 14 AS INTEGER) AS end_line,
    p_name || chr(10) || chr(10) || p_type || chr(10) || p_brand AS source,
    p_partkey % 10 = 2 AS is_test, p_size % 2 = 0 AS runtime_observed, CAST(p_size * 2 AS DOUBLE) AS coverage_pct
  FROM part)""",
    "steps": """steps AS (
  SELECT * FROM (
    SELECT l_partkey AS u, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS v,
      l_linestatus AS status, l_suppkey AS test
    FROM lineitem) AS s
  WHERE v IS NOT NULL)""",
    "calls": """calls AS (
  SELECT CAST(u AS VARCHAR) AS caller, CAST(v AS VARCHAR) AS callee, bool_or(status = 'O') AS static, bool_or(status = 'F') AS runtime, count(*) AS observed_count
  FROM steps GROUP BY u, v)""",
    "covers": """covers AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS test, CAST(l_partkey AS VARCHAR) AS symbol, CAST(count(*) AS INTEGER) AS lines_covered, CAST(15 AS INTEGER) AS lines_total,
    CAST(round_even(CAST(100.0 * count(*) / 15 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS coverage_pct
  FROM lineitem GROUP BY l_suppkey, l_partkey)""",
    "files": "files AS (SELECT DISTINCT p_brand AS path FROM part)",
    "imports": """imports AS (
  SELECT a.p_brand AS src, b.p_brand AS target, 'file' AS target_kind, 'import ' || b.p_brand AS raw, CAST(count(*) AS INTEGER) AS line
  FROM steps s JOIN part a ON a.p_partkey = s.u JOIN part b ON b.p_partkey = s.v
  WHERE a.p_brand <> b.p_brand GROUP BY a.p_brand, b.p_brand)""",
    "commits": "commits AS (SELECT CAST(o_orderkey AS VARCHAR) AS sha, o_orderpriority AS message, o_orderdate AS ts, CAST(o_custkey AS VARCHAR) AS author_email FROM orders)",
    "authors": "authors AS (SELECT CAST(c_custkey AS VARCHAR) AS email, c_name AS name FROM customer)",
    "symbol_changes": """symbol_changes AS (
  SELECT CAST(l_partkey AS VARCHAR) AS qualified_name, CAST(l_orderkey AS VARCHAR) AS sha, CAST(sum(l_quantity) AS INTEGER) AS lines_overlapped
  FROM lineitem GROUP BY l_partkey, l_orderkey)""",
    "vectors": "vectors AS (SELECT CAST(vec_id AS VARCHAR) AS qualified_name, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
}
NEEDS = {"calls": ("steps",), "imports": ("steps",)}


def with_sql(*tables: str, recursive: bool = False, more: str = "") -> str:
    """``WITH`` and the expressions of these tables, and of what they need."""
    order: list[str] = []
    for t in tables:
        order += [x for x in (*NEEDS.get(t, ()), t) if x not in order]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([SQL[t] for t in order] + ([more] if more else [])) + "\n"
