"""One query for each operator over the projected graph, with its SQL.

Lists are joined to strings, so that both engines compare them alike.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.checks import config as cc
from codeloom.checks import run as checks
from codeloom.functions.columns import snippet
from codeloom.operators import architecture, attribution, embed, freeform, history, impact, ingest, navigation, resolve, semantic, upserts
from codeloom.plans import ingested  # noqa: F401  (registers its queries)
from codeloom.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from codeloom.plans.projection import PROJECT, by_call, calls, graph_of, read, steps, symbols, text, with_sql
from codeloom.sources.diff import diff_lines
from codeloom.sources.files import extract
from codeloom.streaming import watch

REF = "qualified_name, name, kind, file, start_line, end_line"
CALLABLE = "kind IN ('function', 'method')"
PLAIN = "(kind = 'method' OR (kind = 'function' AND NOT is_test))"
PAIR = "s.qualified_name, s.name, s.kind, s.file, s.start_line, s.end_line"


# navigation


@query(with_sql("symbols") + f"SELECT {REF} FROM symbols WHERE contains(lower(name), 'an') ORDER BY qualified_name LIMIT 50")
def find_symbol(spark, sf_dir):
    return navigation.find_symbol(graph_of(spark, sf_dir, "symbols"), PROJECT, "AN")


@query(with_sql("symbols") + f"SELECT {REF} FROM symbols WHERE name = (SELECT name FROM symbols WHERE qualified_name = '7') ORDER BY qualified_name LIMIT 50")
def find_symbol_exact(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "symbols")
    name = graph["symbols"].where("qualified_name = '7'").first()["name"]
    return navigation.find_symbol(graph, PROJECT, name, exact=True)


@query(with_sql("symbols") + f"SELECT {REF}, '' AS decorators, source, runtime_observed, coverage_pct FROM symbols WHERE qualified_name = '7'")
def get_source(spark, sf_dir):
    return navigation.get_source(graph_of(spark, sf_dir, "symbols"), PROJECT, "7").withColumn("decorators", F.array_join("decorators", ","))


def _neighbour_sql(at: str, other: str, condition: str = "true") -> str:
    return with_sql("symbols", "calls") + f"SELECT {PAIR}, c.static, c.runtime, c.observed_count FROM calls c JOIN symbols s ON s.qualified_name = c.{other} WHERE c.{at} = '7' AND {condition} ORDER BY s.qualified_name LIMIT 50"


def _neighbours(spark, sf_dir, find, provenance="any"):
    return find(graph_of(spark, sf_dir, "symbols", "calls"), PROJECT, "7", provenance).drop("call_site_lines")


@query(_neighbour_sql("callee", "caller"))
def find_callers(spark, sf_dir):
    return _neighbours(spark, sf_dir, navigation.find_callers)


@query(_neighbour_sql("callee", "caller", "c.static"))
def find_callers_static(spark, sf_dir):
    return _neighbours(spark, sf_dir, navigation.find_callers, "static")


@query(_neighbour_sql("callee", "caller", "c.runtime"))
def find_callers_runtime(spark, sf_dir):
    return _neighbours(spark, sf_dir, navigation.find_callers, "runtime")


@query(_neighbour_sql("caller", "callee"))
def find_callees(spark, sf_dir):
    return _neighbours(spark, sf_dir, navigation.find_callees)


@query(_neighbour_sql("caller", "callee", "c.static"))
def find_callees_static(spark, sf_dir):
    return _neighbours(spark, sf_dir, navigation.find_callees, "static")


@query(_neighbour_sql("caller", "callee", "c.runtime"))
def find_callees_runtime(spark, sf_dir):
    return _neighbours(spark, sf_dir, navigation.find_callees, "runtime")


def _ends(*extra: str) -> str:
    columns = [f"{e[0]}.{c} AS {e}_{c}" for e in ("caller", "target") for c in REF.split(", ")]
    return ", ".join([c.replace(" AS target_", " AS callee_") for c in columns] + list(extra))


def _one_sided_sql(condition: str, *extra: str, file: str | None = None) -> str:
    own = f" AND c.file = '{file}'" if file else ""
    return with_sql("symbols", "calls") + f"SELECT {_ends(*extra)} FROM calls e JOIN symbols c ON c.qualified_name = e.caller JOIN symbols t ON t.qualified_name = e.callee WHERE {condition}{own} ORDER BY c.qualified_name, t.qualified_name LIMIT 100"


@query(_one_sided_sql("e.runtime AND NOT e.static", "e.observed_count"))
def runtime_only_calls(spark, sf_dir):
    return navigation.runtime_only_calls(graph_of(spark, sf_dir, "symbols", "calls"), PROJECT)


@query(_one_sided_sql("e.runtime AND NOT e.static", "e.observed_count", file="Brand#11"))
def runtime_only_calls_file(spark, sf_dir):
    return navigation.runtime_only_calls(graph_of(spark, sf_dir, "symbols", "calls"), PROJECT, "Brand#11")


@query(_one_sided_sql("e.static AND NOT e.runtime"))
def dead_static_calls(spark, sf_dir):
    return navigation.dead_static_calls(graph_of(spark, sf_dir, "symbols", "calls"), PROJECT)


@query(with_sql("symbols", "covers") + f"SELECT {PAIR}, '' AS test_outcome, c.lines_covered, c.lines_total, c.coverage_pct FROM covers c JOIN symbols s ON s.qualified_name = c.test AND s.is_test WHERE c.symbol = '7' ORDER BY s.qualified_name LIMIT 50")
def tests_for(spark, sf_dir):
    return navigation.tests_for(graph_of(spark, sf_dir, "symbols", "covers"), PROJECT, "7")


@query(with_sql("symbols") + f"SELECT {REF} FROM symbols WHERE {PLAIN} AND NOT runtime_observed ORDER BY qualified_name LIMIT 100")
def untested_symbols(spark, sf_dir):
    return navigation.untested_symbols(graph_of(spark, sf_dir, "symbols"), PROJECT)


@query(with_sql("imports") + "SELECT target AS other, target_kind, raw, line FROM imports WHERE src = 'Brand#11' ORDER BY other, line LIMIT 100")
def imports_out(spark, sf_dir):
    return navigation.imports(graph_of(spark, sf_dir, "imports"), PROJECT, "Brand#11")


@query(with_sql("imports") + "SELECT src AS other, 'file' AS target_kind, raw, line FROM imports WHERE target = 'Brand#11' ORDER BY other, line LIMIT 100")
def imports_in(spark, sf_dir):
    return navigation.imports(graph_of(spark, sf_dir, "imports"), PROJECT, "Brand#11", "in")


@query(
    with_sql("symbols", "files", "calls")
    + """SELECT f.files, s.classes, s.functions, s.methods, s.tests, c.calls, c.runtime_only, c.static_only, c.both FROM
  (SELECT count(*) AS files FROM files) f,
  (SELECT count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'method') AS methods, count(*) FILTER (is_test) AS tests FROM symbols) s,
  (SELECT count(*) AS calls, count(*) FILTER (runtime AND NOT static) AS runtime_only, count(*) FILTER (static AND NOT runtime) AS static_only, count(*) FILTER (static AND runtime) AS both FROM calls) c"""
)
def graph_status(spark, sf_dir):
    return navigation.graph_status(graph_of(spark, sf_dir, "symbols", "files", "calls"), PROJECT)


@query(with_sql("symbols") + "SELECT label, count(*) AS n FROM (SELECT kind AS label FROM symbols UNION ALL SELECT 'test' FROM symbols WHERE is_test) l GROUP BY label")
def label_histogram(spark, sf_dir):
    return navigation.label_histogram(graph_of(spark, sf_dir, "symbols"), PROJECT)


# change impact

DIFF = """diff --git a/Brand#11 b/Brand#11
--- a/Brand#11
+++ b/Brand#11
@@ -249,2 +249,3 @@
 kept
+added
 kept
@@ -400 +401,2 @@
-gone
+one
+two
diff --git a/Brand#23 b/Brand#23
--- a/Brand#23
+++ b/Brand#23
@@ -99,0 +100,1 @@
+line
--- a/old
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
"""
TOUCHED = "touched(path, line) AS (VALUES ('Brand#11', 250), ('Brand#11', 401), ('Brand#11', 402), ('Brand#23', 100))"
CHANGED = f"changed AS (SELECT * FROM symbols s WHERE {CALLABLE} AND EXISTS (SELECT 1 FROM touched t WHERE t.path = s.file AND t.line BETWEEN s.start_line AND s.end_line))"
STEP = "(CASE WHEN static THEN 'S' ELSE '-' END || CASE WHEN runtime THEN 'R' ELSE '-' END)"
WAYS = f"""one AS (SELECT g.qualified_name AS via, c.caller AS node, {STEP} AS f FROM changed g JOIN calls c ON c.callee = g.qualified_name),
ways AS (
  SELECT DISTINCT via, node, 1 AS depth, f AS edges FROM one
  UNION ALL
  SELECT DISTINCT o.via, c.caller, 2, {STEP} || '>' || o.f FROM one o JOIN calls c ON c.callee = o.node AND NOT (c.caller = o.node AND c.callee = o.via))"""


@query(f"WITH {TOUCHED} SELECT path, CAST(line AS INTEGER) AS line FROM touched")
def change_impact_lines(spark, sf_dir):
    return diff_lines(spark, DIFF)


def _changed(spark, graph):
    return impact.changed_symbols(graph, PROJECT, diff_lines(spark, DIFF))


@query(with_sql("symbols", more=f"{TOUCHED},\n{CHANGED}") + f"SELECT {REF}, runtime_observed, coverage_pct FROM changed")
def changed_symbols(spark, sf_dir):
    return _changed(spark, graph_of(spark, sf_dir, "symbols"))


@query(with_sql("symbols", "calls", more=f"{TOUCHED},\n{CHANGED},\n{WAYS}") + f"SELECT {PAIR}, w.via, w.depth, w.edges FROM ways w JOIN symbols s ON s.qualified_name = w.node")
def impacted_symbols(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "symbols", "calls")
    ways = impact.impacted_symbols(graph, PROJECT, _changed(spark, graph), max_depth=2).select(*REF.split(", "), F.explode("reached_via").alias("w"))
    step = F.transform("w.edges", lambda e: F.concat(F.when(e["static"], "S").otherwise("-"), F.when(e["runtime"], "R").otherwise("-")))
    return ways.select(*REF.split(", "), "w.via", "w.depth", F.array_join(step, ">").alias("edges"))


@query(
    with_sql("symbols", "calls", "covers", more=f"{TOUCHED},\n{CHANGED},\naffected AS (SELECT qualified_name FROM changed UNION SELECT c.caller FROM calls c JOIN changed g ON g.qualified_name = c.callee JOIN symbols s ON s.qualified_name = c.caller)")
    + f"SELECT {PAIR}, '' AS test_outcome, t.covers_symbols, t.avg_coverage_pct FROM symbols s JOIN (SELECT c.test, string_agg(DISTINCT c.symbol, ',' ORDER BY c.symbol) AS covers_symbols, round(avg(c.coverage_pct), 6) AS avg_coverage_pct FROM covers c JOIN affected a ON a.qualified_name = c.symbol GROUP BY c.test) t ON t.test = s.qualified_name WHERE s.is_test"
)
def tests_to_run(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "symbols", "calls", "covers")
    changed = _changed(spark, graph)
    affected = changed.select("qualified_name").unionByName(impact.impacted_symbols(graph, PROJECT, changed, max_depth=1).select("qualified_name"))
    return impact.tests_to_run(graph, PROJECT, affected).withColumn("covers_symbols", F.array_join("covers_symbols", ",")).withColumn("avg_coverage_pct", F.round("avg_coverage_pct", 6))


# history

NOW = "(SELECT max(o_orderdate) FROM orders)"


def _now(spark, sf_dir) -> datetime:
    return read(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("t")).first()["t"]


def _plain_time(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes])


HISTORY = ("symbols", "commits", "authors", "symbol_changes")


@query(with_sql(*HISTORY) + f"SELECT h.sha, CAST(NULL AS VARCHAR) AS short_sha, c.message, c.ts AS timestamp, c.author_email, a.name AS author_name, h.lines_overlapped FROM symbol_changes h JOIN commits c ON c.sha = h.sha JOIN symbols s ON s.qualified_name = h.qualified_name AND s.{CALLABLE} LEFT JOIN authors a ON a.email = c.author_email WHERE h.qualified_name = '7' ORDER BY c.ts DESC, h.sha LIMIT 20")
def symbol_history(spark, sf_dir):
    return _plain_time(history.symbol_history(graph_of(spark, sf_dir, *HISTORY), PROJECT, "7"))


RECENT = f"""SELECT qualified_name, kind, file, max(ts) AS last_changed, count(DISTINCT sha) AS commit_count, max(sha) FILTER (WHERE ts = newest) AS latest_sha
FROM (SELECT s.qualified_name, s.kind, s.file, c.ts, c.sha, max(c.ts) OVER (PARTITION BY s.qualified_name) AS newest FROM symbol_changes h JOIN commits c ON c.sha = h.sha JOIN symbols s ON s.qualified_name = h.qualified_name WHERE s.{CALLABLE}) x
GROUP BY qualified_name, kind, file ORDER BY last_changed DESC, qualified_name LIMIT 50"""


@query(with_sql("symbols", "commits", "symbol_changes") + RECENT)
def recent_changes(spark, sf_dir):
    return _plain_time(history.recent_changes(graph_of(spark, sf_dir, *HISTORY), PROJECT))


def _churn_sql(days: int) -> str:
    return with_sql(*HISTORY) + f"""SELECT s.qualified_name, s.kind, s.file, count(DISTINCT c.sha) AS commit_count, count(DISTINCT a.email) AS unique_authors, min(c.ts) AS first_changed, max(c.ts) AS last_changed
FROM symbol_changes h JOIN commits c ON c.sha = h.sha JOIN symbols s ON s.qualified_name = h.qualified_name AND s.{CALLABLE} LEFT JOIN authors a ON a.email = c.author_email
WHERE c.ts >= {NOW} - INTERVAL {days} DAY GROUP BY s.qualified_name, s.kind, s.file"""


@query(_churn_sql(365) + " ORDER BY commit_count DESC, last_changed DESC, qualified_name LIMIT 20")
def top_churn(spark, sf_dir):
    return _plain_time(history.top_churn(graph_of(spark, sf_dir, *HISTORY), PROJECT, 365, now=_now(spark, sf_dir)))


# architecture


def _cycles_sql(edges: str, *tables: str) -> str:
    more = f"""edges AS ({edges}),
reach AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v),
mutual AS (SELECT a.u, a.v FROM reach a JOIN reach b ON b.u = a.v AND b.v = a.u),
named AS (SELECT u AS node, min(v) AS component FROM mutual GROUP BY u)"""
    return with_sql(*tables, recursive=True, more=more) + "SELECT CAST(count(*) AS INTEGER) AS size, string_agg(node, ',' ORDER BY node) AS nodes FROM named GROUP BY component HAVING count(*) >= 2 ORDER BY size DESC, min(node) LIMIT 20"


def _cycles(df: DataFrame) -> DataFrame:
    return df.withColumn("nodes", F.array_join("nodes", ","))


def _call_cycles_sql() -> str:
    """The component of the node with most ways through it by reach from there and back, the others by a closure of what is left."""
    more = f"""edges AS (SELECT DISTINCT c.caller AS u, c.callee AS v FROM calls c JOIN symbols s ON s.qualified_name = c.caller AND s.{CALLABLE}),
turning AS (SELECT a.u AS p FROM (SELECT u, count(*) AS n FROM edges GROUP BY u) a JOIN (SELECT v, count(*) AS n FROM edges GROUP BY v) b ON b.v = a.u ORDER BY a.n * b.n DESC, a.u LIMIT 1),
after AS (SELECT e.v AS node FROM edges e JOIN turning ON e.u = p UNION SELECT e.v FROM after a JOIN edges e ON e.u = a.node),
before AS (SELECT e.u AS node FROM edges e JOIN turning ON e.v = p UNION SELECT e.u FROM before b JOIN edges e ON e.v = b.node),
large AS (SELECT node FROM after INTERSECT SELECT node FROM before),
rest AS (SELECT u, v FROM edges WHERE u NOT IN (SELECT node FROM large) AND v NOT IN (SELECT node FROM large)),
reach AS (SELECT u, v FROM rest UNION SELECT r.u, e.v FROM reach r JOIN rest e ON e.u = r.v),
named AS (
  SELECT a.u AS node, min(a.v) AS component FROM reach a JOIN reach b ON b.u = a.v AND b.v = a.u GROUP BY a.u
  UNION ALL SELECT node, (SELECT min(node) FROM large) FROM large)"""
    return with_sql("symbols", "calls", recursive=True, more=more) + "SELECT CAST(count(*) AS INTEGER) AS size, string_agg(node, ',' ORDER BY node) AS nodes FROM named GROUP BY component HAVING count(*) >= 2 ORDER BY size DESC, min(node) LIMIT 20"


@query(_call_cycles_sql())
def find_cycles_call(spark, sf_dir):
    return _cycles(architecture.find_cycles(graph_of(spark, sf_dir, "symbols", "calls"), PROJECT))


@query(_cycles_sql("SELECT src AS u, target AS v FROM imports", "imports"))
def find_cycles_module(spark, sf_dir):
    return _cycles(architecture.find_cycles(graph_of(spark, sf_dir, "files", "imports"), PROJECT, "module"))


LAYERS = [{"name": "web", "patterns": ["Brand#1*"]}, {"name": "domain", "patterns": ["Brand#2*", "Brand#3"]}, {"name": "infra", "patterns": ["Brand#[45]*"]}]
LAYERED = """layered AS (
  SELECT path, CASE WHEN path LIKE 'Brand#1%' THEN 0 WHEN path LIKE 'Brand#2%' OR path = 'Brand#3' THEN 1 WHEN path LIKE 'Brand#4%' OR path LIKE 'Brand#5%' THEN 2 END AS rank FROM files),
edges AS (
  SELECT src AS from_file, target AS to_file, 'imports' AS edge_kind FROM imports
  UNION ALL
  SELECT DISTINCT a.file, b.file, 'calls' FROM calls c JOIN symbols a ON a.qualified_name = c.caller JOIN symbols b ON b.qualified_name = c.callee WHERE a.file <> b.file),
checked AS (SELECT e.*, a.rank AS ra, b.rank AS rb FROM edges e JOIN layered a ON a.path = e.from_file AND a.rank IS NOT NULL JOIN layered b ON b.path = e.to_file AND b.rank IS NOT NULL)"""
ARCHITECTURE = ("symbols", "files", "calls", "imports")
NAMED = "CASE {0} WHEN 0 THEN 'web' WHEN 1 THEN 'domain' ELSE 'infra' END"


@query(with_sql(*ARCHITECTURE, more=LAYERED) + f"SELECT from_file, to_file, {NAMED.format('ra')} AS from_layer, {NAMED.format('rb')} AS to_layer, edge_kind FROM checked WHERE ra > rb ORDER BY from_layer, from_file, to_file, edge_kind LIMIT 200")
def layering_violations(spark, sf_dir):
    return architecture.layering_violations(graph_of(spark, sf_dir, *ARCHITECTURE), PROJECT, LAYERS, limit=200)


@query(with_sql(*ARCHITECTURE, more=LAYERED) + "SELECT count(*) FILTER (ra > rb) AS violations, count(*) AS edges_checked, (SELECT count(*) FROM layered WHERE rank IS NULL) AS files_unlayered FROM checked")
def layering_summary(spark, sf_dir):
    return architecture.layering_summary(graph_of(spark, sf_dir, *ARCHITECTURE), PROJECT, LAYERS)


HUBS = f"""SELECT s.qualified_name, s.kind, s.file, i.in_callers, coalesce(o.out_callees, 0) AS out_callees FROM symbols s
JOIN (SELECT callee, count(DISTINCT caller) AS in_callers FROM calls GROUP BY callee) i ON i.callee = s.qualified_name
LEFT JOIN (SELECT caller, count(DISTINCT callee) AS out_callees FROM calls GROUP BY caller) o ON o.caller = s.qualified_name
WHERE {PLAIN} AND i.in_callers >= 10"""


@query(with_sql("symbols", "calls") + HUBS + " ORDER BY in_callers DESC, s.qualified_name LIMIT 20")
def hubs(spark, sf_dir):
    return architecture.hubs(graph_of(spark, sf_dir, "symbols", "calls"), PROJECT)


# vectors


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").where("vec_id = 1").first()["embedding"]]


def _nearest(condition: str, limit: int) -> str:
    return f"SELECT {PAIR}, round(list_cosine_similarity(v.e, q.e), 4) AS score FROM vectors v JOIN symbols s ON s.qualified_name = v.qualified_name, (SELECT e FROM vectors WHERE qualified_name = '1') q WHERE {condition} ORDER BY list_cosine_similarity(v.e, q.e) DESC, s.qualified_name LIMIT {limit}"


def _scored(df: DataFrame) -> DataFrame:
    return df.drop("source").withColumn("score", F.round("score", 4))


@query(with_sql("symbols", "vectors") + _nearest(f"s.{CALLABLE}", 10))
def semantic_search(spark, sf_dir):
    return _scored(semantic.semantic_search(graph_of(spark, sf_dir, "symbols", "embeddings"), PROJECT, _query_vector(spark, sf_dir)))


@query(with_sql("symbols", "vectors") + _nearest("s.kind = 'method'", 10))
def semantic_search_kind(spark, sf_dir):
    return _scored(semantic.semantic_search(graph_of(spark, sf_dir, "symbols", "embeddings"), PROJECT, _query_vector(spark, sf_dir), kind="method"))


def _first(relation: str, at: str, other: str) -> str:
    label = "CASE WHEN c.static AND c.runtime THEN 'both' WHEN c.static THEN 'static' WHEN c.runtime THEN 'runtime' ELSE 'unknown' END"
    return f"SELECT c.{at} AS seed, '{relation}' AS relation, c.{other} AS neighbour, {label} AS provenance, row_number() OVER (PARTITION BY c.{at} ORDER BY c.{other}) AS k FROM calls c JOIN seeds s ON s.qualified_name = c.{at}"


@query(
    with_sql("symbols", "vectors", "calls", "covers", more=f"seeds AS ({_nearest(f's.{CALLABLE}', 10)})")
    + f"SELECT seed, relation, neighbour, provenance FROM ({_first('callers', 'callee', 'caller')} UNION ALL {_first('callees', 'caller', 'callee')} UNION ALL SELECT c.symbol, 'tests', c.test, CAST(NULL AS VARCHAR), row_number() OVER (PARTITION BY c.symbol ORDER BY c.test) FROM covers c JOIN seeds s ON s.qualified_name = c.symbol JOIN symbols t ON t.qualified_name = c.test AND t.is_test) x WHERE k <= 10"
)
def semantic_neighborhood(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "symbols", "embeddings", "calls", "covers")
    seeds = semantic.semantic_search(graph, PROJECT, _query_vector(spark, sf_dir), 10).select("qualified_name")
    return semantic.neighbourhood(graph, PROJECT, seeds)


# resolution and attribution


@query(
    with_sql("steps")
    + """, parts AS (SELECT p_partkey, p_brand || '::' || p_name AS qn, p_brand AS file, p_name AS simple FROM part),
raw AS (SELECT DISTINCT a.qn AS caller, a.file, b.simple FROM steps s JOIN parts a ON a.p_partkey = s.u JOIN parts b ON b.p_partkey = s.v)
SELECT DISTINCT r.caller, coalesce((SELECT min(p.qn) FROM parts p WHERE p.simple = r.simple AND p.file = r.file), (SELECT min(p.qn) FROM parts p WHERE p.simple = r.simple)) AS callee FROM raw r"""
)
def resolve_calls(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("::", "p_brand", "p_name").alias("qn"), "p_name")
    raw = steps(spark, sf_dir).join(part.select(F.col("p_partkey").alias("u"), F.col("qn").alias("qualified_name")), "u").join(part.select(F.col("p_partkey").alias("v"), F.concat(F.lit("module.self."), "p_name").alias("callee")), "v")
    return resolve.resolve_calls(raw, part.select(F.col("qn").alias("qualified_name")).distinct())


@query(
    with_sql("imports")
    + """SELECT src || '.py' AS src, target || '.py' AS target, 'file' AS target_kind, raw, line FROM imports
UNION ALL SELECT p_brand || '.py', CASE WHEN p_size % 2 = 0 THEN 'os.path' ELSE '.' || p_name END, CASE WHEN p_size % 2 = 0 THEN 'stdlib' ELSE 'thirdparty' END, p_type, p_size FROM part"""
)
def resolve_imports(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "imports", "files")
    own = graph["imports"].select(F.concat("src", F.lit(".py")).alias("path"), F.col("target").alias("module"), "raw", "line")
    module = F.when(F.col("p_size") % 2 == 0, "os.path").otherwise(F.concat(F.lit("."), "p_name"))
    other = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".py")).alias("path"), module.alias("module"), F.col("p_type").alias("raw"), F.col("p_size").alias("line"))
    return resolve.resolve_python_imports(own.unionByName(other), graph["files"].select(F.concat("path", F.lit(".py")).alias("path")))


LINE = "CAST(l.l_linenumber * 40 + l.l_quantity AS INTEGER)"


@query(
    with_sql("symbols")
    + f""", hit AS (SELECT DISTINCT CAST(l.l_suppkey AS VARCHAR) AS test, p.p_brand AS file, {LINE} AS line FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)
SELECT h.test, s.qualified_name AS symbol, CAST(count(*) AS INTEGER) AS lines_covered, CAST(15 AS INTEGER) AS lines_total, CAST(round_even(CAST(100.0 * count(*) / 15 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS coverage_pct
FROM hit h JOIN symbols s ON s.file = h.file AND h.line BETWEEN s.start_line AND s.end_line AND s.{CALLABLE} GROUP BY h.test, s.qualified_name"""
)
def coverage_map(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"))
    lines = read(spark, sf_dir, "lineitem").join(part, "l_partkey").select(text("l_suppkey").alias("test"), "file", (F.col("l_linenumber") * 40 + F.col("l_quantity")).cast("int").alias("line"))
    return attribution.map_coverage(lines, symbols(spark, sf_dir))


@query(
    with_sql("symbols")
    + f""", hunk AS (SELECT CAST(l_orderkey AS VARCHAR) AS sha, p_brand AS file, CAST(l_linenumber * 40 AS INTEGER) AS a, CAST(l_linenumber * 40 + l_quantity AS INTEGER) AS b FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT s.qualified_name, h.sha, CAST(sum(least(h.b, s.end_line) - greatest(h.a, s.start_line) + 1) AS INTEGER) AS lines_overlapped
FROM hunk h JOIN symbols s ON s.file = h.file AND s.{CALLABLE} AND h.a <= s.end_line AND s.start_line <= h.b GROUP BY s.qualified_name, h.sha"""
)
def hunk_attribution(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"))
    start = (F.col("l_linenumber") * 40).cast("int")
    hunks = read(spark, sf_dir, "lineitem").join(part, "l_partkey").select(text("l_orderkey").alias("sha"), "file", start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end"))
    return attribution.attribute_hunks(hunks, symbols(spark, sf_dir))


@query(with_sql("steps") + "SELECT CAST(u AS VARCHAR) AS caller, CAST(v AS VARCHAR) AS callee, CAST(sum(n) AS BIGINT) AS observed_count FROM (SELECT u, v, test, count(*) AS n FROM steps GROUP BY u, v, test) t GROUP BY u, v")
def runtime_merge(spark, sf_dir):
    # grouped by u and v as they are, the rows stay where they were dealt
    by_test = by_call(spark, sf_dir).groupBy("u", "v", "test").agg(F.count("*").alias("observed_count"))
    merged = ingest.merge_runs(by_test.withColumnsRenamed({"u": "caller", "v": "callee"}))
    return merged.select(text("caller").alias("caller"), text("callee").alias("callee"), "observed_count")


# incremental

STORED = "stored AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents)"
DISK = "disk AS (SELECT CASE WHEN source = 'src1' THEN 'moved/' || doc_id ELSE source || '/' || doc_id END AS path, sha256(CASE WHEN lang = 'de' THEN text || 'x' ELSE text END) AS h FROM documents)"
CHANGE = "changes AS (SELECT coalesce(s.path, d.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted' WHEN s.h = d.h THEN 'unchanged' ELSE 'changed' END AS change FROM stored s FULL OUTER JOIN disk d ON d.path = s.path)"


def _sides(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", text("doc_id"))
    disk = docs.select(F.when(F.col("source") == "src1", F.concat(F.lit("moved/"), text("doc_id"))).otherwise(path).alias("path"), F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return docs.select(path.alias("path"), F.sha2("text", 256).alias("content_hash")), disk


@query(f"WITH {STORED},\n{DISK},\n{CHANGE}\nSELECT path, change FROM changes")
def detect_changes(spark, sf_dir):
    return ingest.detect_changes(*_sides(spark, sf_dir))


@query(f"WITH {STORED},\n{DISK},\n{CHANGE}\nSELECT count(*) FILTER (change <> 'unchanged') AS drifted_files FROM changes")
def staleness(spark, sf_dir):
    return ingest.drifted(*_sides(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS qualified_name, sha256(text) AS source_hash, NOT (n_chars % 2 = 1 AND lang = 'en') AS due FROM documents WHERE length(text) > 0")
def embed_candidates(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    stored = docs.select(text("doc_id").alias("qualified_name"), F.when(F.col("n_chars") % 2 == 1, F.sha2("text", 256)).otherwise("old").alias("source_hash"), F.when(F.col("lang") == "en", "m1").otherwise("m0").alias("model"))
    return embed.embed_candidates(docs.select(text("doc_id").alias("qualified_name"), F.col("text").alias("source")), stored, "m1").drop("source")


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: length(trim(x)) > 0)[1:3], chr(10)) AS snippet FROM documents")
def snippets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


# writes

FROM_SOURCE = "new AS (SELECT caller, callee, bool_or(static) AS static FROM (SELECT callee AS caller, caller AS callee, static FROM calls) r GROUP BY caller, callee)"


@query(
    with_sql("calls", more=FROM_SOURCE)
    + "SELECT coalesce(n.caller, o.caller) AS caller, coalesce(n.callee, o.callee) AS callee, CASE WHEN n.caller IS NOT NULL THEN n.static ELSE o.static END AS static, coalesce(o.runtime, false) AS runtime, coalesce(o.observed_count, 0) AS observed_count FROM calls o FULL OUTER JOIN new n ON n.caller = o.caller AND n.callee = o.callee"
)
def upsert_calls(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "symbols", "calls")
    back = calls(spark, sf_dir).select("project", F.col("callee").alias("caller"), F.col("caller").alias("callee"), "static")
    return upserts.write_calls(graph, back)["calls"].drop("project", "call_site_lines")


@query(with_sql("symbols", "calls") + "SELECT caller, callee, static, runtime, observed_count FROM calls WHERE caller NOT IN (SELECT qualified_name FROM symbols WHERE file = 'Brand#11') AND callee NOT IN (SELECT qualified_name FROM symbols WHERE file = 'Brand#11')")
def delete_cascade(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "symbols", "calls", "files", "imports")
    gone = graph["files"].where("path = 'Brand#11'")
    return upserts.delete_files(graph, gone)["calls"].drop("project", "call_site_lines")


@query(with_sql("symbols", "calls") + "SELECT c.caller, c.callee, CASE WHEN s.file = 'Brand#11' THEN false ELSE c.static END AS static, c.runtime, c.observed_count FROM calls c JOIN symbols s ON s.qualified_name = c.caller WHERE s.file <> 'Brand#11' OR c.runtime")
def reset_static(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "symbols", "calls", "files")
    return upserts.reset_static(graph, graph["files"].where("path = 'Brand#11'"))["calls"].drop("project", "call_site_lines")


# change feed

EVENT = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END"
SESSIONS = f"""marked AS (SELECT user_id, ts, {EVENT} AS kind, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 48 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)"""


def _events(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return read(spark, sf_dir, "events").select("user_id", text("user_id").alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def _batches(spark, sf_dir):
    return watch.debounced(_events(spark, sf_dir), "48 hours", ("user_id",))


@query(f"WITH {SESSIONS}\nSELECT user_id, min(ts) AS started, max(ts) + INTERVAL 48 HOUR AS closed, count(*) AS events FROM numbered GROUP BY user_id, session")
def debounce_batches(spark, sf_dir):
    return _plain_time(_batches(spark, sf_dir).select("user_id", F.col("session.start").alias("started"), F.col("session.end").alias("closed"), F.size("events").cast("long").alias("events")))


@query(
    f"""WITH {SESSIONS},
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts) AS k, count(*) OVER (PARTITION BY user_id, session) AS n, min(ts) OVER (PARTITION BY user_id, session) AS started FROM numbered),
ends AS (SELECT user_id, session, min(started) AS started, max(kind) FILTER (k = n) AS last_kind, coalesce(max(k) FILTER (kind = 'deleted' AND k < n), 0) AS deleted_before, coalesce(max(k) FILTER (kind = 'created'), 0) AS created_at FROM placed GROUP BY user_id, session)
SELECT user_id, started, CAST(user_id AS VARCHAR) AS path, CASE WHEN last_kind = 'deleted' THEN 'deleted' ELSE 'modified' END AS outcome FROM ends
WHERE NOT (last_kind = 'deleted' AND created_at > deleted_before)"""
)
def coalesce_events(spark, sf_dir):
    out = watch.coalesced(_batches(spark, sf_dir), ("user_id",))
    return _plain_time(out.select("user_id", F.col("session.start").alias("started"), "path", "outcome"))


# guard and free form

STATEMENTS = (
    "SELECT 1", "drop table symbols", "SELECT * FROM calls WHERE asset = 1", "select 'set' as word", "insert into calls select * from calls", "SELECT created, callee FROM calls limit 5",
    "merge into t using s on true", "SELECT x FROM t -- delete", "with a as (select 1) select * from a LIMIT 10;", "SELECT reset_at FROM t", "Truncate Table t", "SELECT limit FROM t",
)


def _literal(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + ")" for row in rows)


@query(
    f"""SELECT q AS statement, nullif(upper(regexp_extract(q, '(?i)\\b({'|'.join(freeform.FORBIDDEN)})\\b', 1)), '') AS forbidden, regexp_matches(q, '(?i)\\blimit\\s+[0-9]+\\s*;?\\s*$') AS has_limit
FROM (VALUES {_literal((s,) for s in STATEMENTS)}) AS t(q)"""
)
def guard_scan(spark, sf_dir):
    rows = spark.createDataFrame([(s,) for s in STATEMENTS], "statement string")
    return rows.select("statement", freeform.forbidden_column(F.col("statement")).alias("forbidden"), F.col("statement").rlike(r"(?i)\blimit\s+\d+\s*;?\s*$").alias("has_limit"))


@query(with_sql("symbols") + "SELECT qualified_name, file, true AS truncated FROM symbols WHERE kind = 'class' ORDER BY qualified_name LIMIT 25")
def run_sql_truncated(spark, sf_dir):
    found = freeform.run_sql(graph_of(spark, sf_dir, "symbols"), PROJECT, "SELECT qualified_name, file FROM symbols WHERE project = :project AND kind = :kind ORDER BY qualified_name", {"kind": "class"}, row_limit=25)
    return spark.createDataFrame([(r["qualified_name"], r["file"], found.truncated) for r in found.rows], "qualified_name string, file string, truncated boolean")


# checks


def _result(spark, r: checks.Result) -> DataFrame:
    return spark.createDataFrame([(r.check, r.status, r.actual, r.threshold)], "check string, status string, actual long, threshold long")


def _check_sql(name: str, threshold: int, count: str, prelude: str) -> str:
    return prelude + f"SELECT '{name}' AS \"check\", CASE WHEN n <= {threshold} THEN 'passed' ELSE 'failed' END AS status, n AS actual, CAST({threshold} AS BIGINT) AS threshold FROM (SELECT count(*) AS n FROM ({count}) f) c"


@query(_check_sql("cycles", 0, "SELECT component FROM named GROUP BY component HAVING count(*) >= 2", _cycles_sql("SELECT src AS u, target AS v FROM imports", "imports").rsplit("SELECT CAST(count", 1)[0]))
def check_cycles(spark, sf_dir):
    return _result(spark, checks.check_cycles(graph_of(spark, sf_dir, "files", "imports"), PROJECT, cc.Cycles(True)))


@query(_check_sql("layering", 500, "SELECT * FROM checked WHERE ra > rb", with_sql(*ARCHITECTURE, more=LAYERED)))
def check_layering(spark, sf_dir):
    return _result(spark, checks.check_layering(graph_of(spark, sf_dir, *ARCHITECTURE), PROJECT, cc.Layering(True, max_violations=500, layers=tuple(LAYERS))))


def _churn_check() -> str:
    prelude, _, rest = _churn_sql(365).partition("SELECT s.qualified_name, s.kind")
    return _check_sql("churn", 0, "SELECT s.qualified_name, s.kind" + rest + " HAVING count(DISTINCT c.sha) > 5 AND s.file NOT LIKE 'Brand#2%'", prelude)


@query(_churn_check())
def check_churn(spark, sf_dir):
    now = _now(spark, sf_dir)
    return _result(spark, checks.check_churn(graph_of(spark, sf_dir, *HISTORY), PROJECT, cc.Churn(True, 365, 5, ("Brand#2*",)), now))


@query(_check_sql("hubs", 40, HUBS.replace(">= 10", ">= 25"), with_sql("symbols", "calls")))
def check_hubs(spark, sf_dir):
    return _result(spark, checks.check_hubs(graph_of(spark, sf_dir, "symbols", "calls"), PROJECT, cc.Hubs(True, min_fanin=25, max_hubs=40)))


# extraction

SOURCES = {
    "calc.py": "import os\nfrom . import util\n\nclass Calc:\n    def add(self, a, b):\n        return helper(a) + b\n\n\n@mark.slow\ndef helper(x):\n    return Calc().add(x, 1)\n",
    "src/calc.ts": 'import { x } from "./util";\nexport class Calc {\n  add(a: number): number {\n    return x(a);\n  }\n}\nexport const run = () => new Calc().add(1);\n',
}
DEFINED = (
    ("calc.py", "calc.py::Calc", "class", 4, 6), ("calc.py", "calc.py::Calc.add", "method", 5, 6), ("calc.py", "calc.py::helper", "function", 10, 11),
    ("src/calc.ts", "src/calc.ts::Calc", "class", 2, 6), ("src/calc.ts", "src/calc.ts::Calc.add", "method", 3, 5), ("src/calc.ts", "src/calc.ts::run", "function", 7, 7),
)


@query(f"SELECT path, qualified_name, kind, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM (VALUES {_literal(DEFINED)}) AS t(path, qualified_name, kind, a, b)")
def source_definitions(spark, sf_dir):
    rows = [(p, "python" if p.endswith(".py") else "typescript", bytearray(t.encode())) for p, t in SOURCES.items()]
    found = extract(spark.createDataFrame(rows, "path string, language string, content binary"))
    return found.where("record = 'definition'").select("path", "qualified_name", "kind", "start_line", "end_line")

