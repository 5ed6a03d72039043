"""Queries over a graph that is built, updated, run and given a history, with their SQL.

The sources are made of all rows of ``documents``, a module each: English and German ones are Python files,
the others TypeScript.  Module k calls the function of module k / 2 and imports it; a few do not parse.
Between two states of the sources, files of ``src1`` go, those of ``src3`` come and those of ``src2`` change.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import impact, ingest
from codeloom.plans.projection import read, text
from codeloom.plans.registry import query
from codeloom.plans.scratch import shared_folder
from codeloom.store import Graph, GraphStore

NAME = "modules"
GONE, CHANGED, NEW = "src1", "src2", "src3"


# the sources, as frames


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, source, ext, broken, h (of the text), path and the same of module j = k / 2."""
    docs = read(spark, sf_dir, "documents")
    ext = F.when(F.col("lang").isin("en", "de"), "py").otherwise("ts")
    own = docs.select(F.col("doc_id").alias("k"), F.coalesce("source", F.lit("none")).alias("source"), ext.alias("ext"), (F.col("doc_id") % 97 == 13).alias("broken"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    other = own.select(F.col("k").alias("j"), F.col("source").alias("psource"))
    joined = own.withColumn("j", F.floor(F.col("k") / 2).cast("long")).join(other, "j", "left")
    return joined.withColumn("psource", F.coalesce("psource", F.lit("none"))).withColumn("path", F.concat("source", F.lit("/m"), "k", F.lit("."), "ext"))


def sources(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """path, language, content and content_hash of all files of a state."""
    rows = modules(spark, sf_dir).where(F.col("source") != (GONE if later else NEW))
    extended = (F.col("source") == CHANGED) & F.lit(later)
    k, j = text("k"), text("j")
    py = F.concat(
        F.lit("import os\nimport "), "psource", F.lit(".m"), j, F.lit("\n\nclass C"), k, F.lit(":\n    def m"), k, F.lit("(self):\n        return f"), j, F.lit("()\n\ndef f"), k, F.lit("():\n    return f"), j, F.lit("()\n\n"),
        F.when(extended, F.concat(F.lit("def g"), k, F.lit("():\n    return f"), k, F.lit("()\n"))).otherwise(F.concat(F.lit("def test_f"), k, F.lit("():\n    assert f"), k, F.lit("()\n"))),
        F.lit("# "), "h", F.lit("\n"),
    )
    ts = F.concat(
        F.lit("import { f"), j, F.lit(' } from "../'), "psource", F.lit("/m"), j, F.lit('";\nimport fs from "fs";\n\nexport function f'), k, F.lit("() {\n  return f"), j, F.lit("();\n}\n"),
        F.when(extended, F.concat(F.lit("export function g"), k, F.lit("() {\n  return f"), k, F.lit("();\n}\n"))).otherwise(""),
        F.lit("// "), "h", F.lit("\n"),
    )
    content = F.when(F.col("broken"), F.when(F.col("ext") == "py", "def (\n").otherwise("function ( {\n")).when(F.col("ext") == "py", py).otherwise(ts)
    rows = rows.select("path", F.when(F.col("ext") == "py", "python").otherwise("typescript").alias("language"), content.cast("binary").alias("content"))
    return rows.withColumn("content_hash", F.sha2("content", 256))


def _stored(spark: SparkSession, graph: Graph) -> Graph:
    """Written and read back, which cuts the lineage; keys are checked on the way."""
    return GraphStore(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}").commit(graph)


#: Graphs that this session has stored, so that the queries over one need not each make it anew.
_made: dict[tuple, object] = {}


def _once(make: Callable) -> Callable:
    @functools.wraps(make)
    def wrapped(spark: SparkSession, sf_dir: str):
        name = (spark.sparkContext.applicationId, make.__name__, sf_dir)
        if name not in _made:
            _made[name] = make(spark, sf_dir)
        return _made[name]

    return wrapped


@_once
def built(spark: SparkSession, sf_dir: str) -> Graph:
    return _stored(spark, ingest.build(Graph.of(spark), NAME, sources(spark, sf_dir, False), "/src"))


def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python modules of the first state that parse, with the names that runs have seen."""
    rows = modules(spark, sf_dir).where(F.col("source") != NEW).where("not broken and ext = 'py'")
    name = lambda dotted: F.concat("path", F.lit(f"::{dotted}"), text("k"))
    return rows.select("k", "path", name("f").alias("f"), name("test_f").alias("t"), F.concat("path", F.lit("::C"), "k", F.lit(".m"), "k").alias("m"))


@_once
def run(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph after two traced runs: f calls its class's method, tests call f and cover both."""
    rows = _sound(spark, sf_dir)
    once = rows.select(F.col("f").alias("caller"), F.col("m").alias("callee"), (F.col("k") % 3 + 1).alias("observed_count"))
    again = rows.select(F.col("f").alias("caller"), F.col("m").alias("callee"), F.lit(2).cast("long").alias("observed_count"))
    tested = rows.select(F.col("t").alias("caller"), F.col("f").alias("callee"), F.lit(1).cast("long").alias("observed_count"))
    tests = rows.select(F.col("t").alias("qualified_name"), F.when(F.col("k") % 5 == 0, "failed").otherwise("passed").alias("outcome"), (F.col("k") / 4).alias("duration"))
    lines = rows.select(F.col("t").alias("test"), F.col("path").alias("file"), F.explode(F.array(F.lit(6), F.lit(8), F.lit(9))).alias("line"))
    return _stored(spark, ingest.augment(built(spark, sf_dir), NAME, once.unionByName(again).unionByName(tested), tests, lines))


@_once
def updated(spark: SparkSession, sf_dir: str) -> tuple[Graph, ingest.UpdateSummary]:
    graph, summary = ingest.update(run(spark, sf_dir), NAME, sources(spark, sf_dir, True))
    return _stored(spark, graph), summary


@_once
def with_history(spark: SparkSession, sf_dir: str) -> Graph:
    """Forty commits, the newest first, each of which changes the functions of its modules."""
    rows = modules(spark, sf_dir).where(F.col("source") != NEW)
    place = (F.col("k") % 40).cast("int")
    hunk = F.when(F.col("ext") == "py", F.struct(F.lit(8).alias("start"), F.lit(9).alias("end"))).otherwise(F.struct(F.lit(4).alias("start"), F.lit(5).alias("end")))
    file = F.struct("path", (F.col("k") % 9).cast("int").alias("additions"), (F.col("k") % 4).cast("int").alias("deletions"), F.array(hunk).alias("hunks"))
    commits = rows.groupBy(place.alias("place")).agg(F.collect_list(file).alias("files"))
    at = F.concat(F.lit("2024-03-01T00:00:"), F.lpad((F.lit(59) - F.col("place")).cast("string"), 2, "0"), F.lit("+00:00"))
    author = F.concat(F.lit("a"), (F.col("place") % 7).cast("string"))
    sha = F.concat(F.lit("c"), "place")
    commits = commits.select("place", sha.alias("sha"), sha.alias("short_sha"), at.alias("timestamp"), F.concat(author, F.lit("@x")).alias("author_email"), author.alias("author_name"), F.lit("change").alias("message"), "files")
    return _stored(spark, ingest.add_history(built(spark, sf_dir), NAME, commits))


# the same in SQL


def _state(name: str, absent: str, extended: str) -> str:
    """Definitions, calls and imports of a state, of files that parse."""
    callee = f"JOIN {name}_code p ON p.k = c.j AND p.ext = c.ext AND NOT p.broken"
    return f"""{name}_code AS (SELECT * FROM code WHERE source <> '{absent}'),
{name}_sound AS (SELECT *, source = '{extended}' AS extended FROM {name}_code WHERE NOT broken),
{name}_defs AS (
  SELECT path || '::C' || k AS qualified_name, 'C' || k AS name, 'class' AS kind, path AS file, 4 AS a, 6 AS b, NULL AS parent_class, source FROM {name}_sound WHERE ext = 'py'
  UNION ALL SELECT path || '::C' || k || '.m' || k, 'm' || k, 'method', path, 5, 6, path || '::C' || k, source FROM {name}_sound WHERE ext = 'py'
  UNION ALL SELECT path || '::f' || k, 'f' || k, 'function', path, CASE ext WHEN 'py' THEN 8 ELSE 4 END, CASE ext WHEN 'py' THEN 9 ELSE 6 END, NULL, source FROM {name}_sound
  UNION ALL SELECT path || '::test_f' || k, 'test_f' || k, 'function', path, 11, 12, NULL, source FROM {name}_sound WHERE ext = 'py' AND NOT extended
  UNION ALL SELECT path || '::g' || k, 'g' || k, 'function', path, CASE ext WHEN 'py' THEN 11 ELSE 7 END, CASE ext WHEN 'py' THEN 12 ELSE 9 END, NULL, source FROM {name}_sound WHERE extended),
{name}_calls AS (
  SELECT c.path || '::f' || c.k AS caller, p.path || '::f' || p.k AS callee, c.source FROM {name}_sound c {callee}
  UNION ALL SELECT c.path || '::C' || c.k || '.m' || c.k, p.path || '::f' || p.k, c.source FROM {name}_sound c {callee} WHERE c.ext = 'py'
  UNION ALL SELECT path || CASE WHEN extended THEN '::g' ELSE '::test_f' END || k, path || '::f' || k, source FROM {name}_sound WHERE ext = 'py' OR extended),
{name}_imports AS (
  SELECT path AS src, CASE ext WHEN 'py' THEN 'os' ELSE 'fs' END AS target, CASE ext WHEN 'py' THEN 'stdlib' ELSE 'thirdparty' END AS target_kind, CASE ext WHEN 'py' THEN 1 ELSE 2 END AS line, source FROM {name}_sound
  UNION ALL SELECT c.path, coalesce(p.path, CASE c.ext WHEN 'py' THEN c.psource || '.m' || c.j ELSE '../' || c.psource || '/m' || c.j END), CASE WHEN p.k IS NULL THEN 'thirdparty' ELSE 'file' END, CASE c.ext WHEN 'py' THEN 2 ELSE 1 END, c.source
  FROM {name}_sound c LEFT JOIN {name}_code p ON p.k = c.j AND p.ext = c.ext)"""


CODE = """own AS (SELECT doc_id AS k, doc_id // 2 AS j, coalesce(source, 'none') AS source, CASE WHEN lang IN ('en', 'de') THEN 'py' ELSE 'ts' END AS ext, doc_id % 97 = 13 AS broken, sha256(coalesce(text, '')) AS h FROM documents),
code AS (SELECT o.*, coalesce(p.source, 'none') AS psource, o.source || '/m' || o.k || '.' || o.ext AS path FROM own o LEFT JOIN own p ON p.k = o.j)"""
ONE = f"WITH RECURSIVE {CODE},\n{_state('one', NEW, '')}"
#: What an update leaves of the first state: unchanged files keep what they have, unless its other end is gone.
TWO = f"""{ONE},
{_state('two', GONE, CHANGED)},
after_calls AS (
  SELECT caller, callee FROM one_calls WHERE source NOT IN ('{GONE}', '{CHANGED}') AND callee IN (SELECT qualified_name FROM two_defs)
  UNION SELECT caller, callee FROM two_calls WHERE source IN ('{CHANGED}', '{NEW}')),
after_imports AS (
  SELECT * FROM one_imports WHERE source NOT IN ('{GONE}', '{CHANGED}') AND NOT (target_kind = 'file' AND starts_with(target, '{GONE}/'))
  UNION ALL SELECT * FROM two_imports WHERE source IN ('{CHANGED}', '{NEW}'))"""
RUN = """ran AS (
  SELECT path || '::f' || k AS caller, path || '::C' || k || '.m' || k AS callee, CAST(3 + k % 3 AS BIGINT) AS n, source FROM one_sound WHERE ext = 'py'
  UNION ALL SELECT path || '::test_f' || k, path || '::f' || k, 1, source FROM one_sound WHERE ext = 'py'),
covered AS (
  SELECT path || '::test_f' || k AS test, path || '::f' || k AS symbol, CAST(2 AS INTEGER) AS lines_covered, CAST(2 AS INTEGER) AS lines_total, CAST(100 AS DOUBLE) AS coverage_pct, source, k FROM one_sound WHERE ext = 'py'
  UNION ALL SELECT path || '::test_f' || k, path || '::C' || k || '.m' || k, 1, 2, 50, source, k FROM one_sound WHERE ext = 'py')"""
CONTENT = """CASE WHEN broken THEN CASE ext WHEN 'py' THEN 'def (' || chr(10) ELSE 'function ( {' || chr(10) END
 WHEN ext = 'py' THEN replace('import os~import ' || psource || '.m' || j || '~~class C' || k || ':~    def m' || k || '(self):~        return f' || j || '()~~def f' || k || '():~    return f' || j || '()~~'
   || CASE WHEN {0} THEN 'def g' || k || '():~    return f' || k || '()~' ELSE 'def test_f' || k || '():~    assert f' || k || '()~' END || '# ' || h || '~', '~', chr(10))
 ELSE replace('import { f' || j || ' } from "../' || psource || '/m' || j || '";~import fs from "fs";~~export function f' || k || '() {~  return f' || j || '();~}~'
   || CASE WHEN {0} THEN 'export function g' || k || '() {~  return f' || k || '();~}~' ELSE '' END || '// ' || h || '~', '~', chr(10)) END"""


def _files(state: str, extended: str) -> str:
    content = CONTENT.replace("{0}", extended)
    return f"SELECT path, 'm' || k || '.' || ext AS name, CASE ext WHEN 'py' THEN 'python' ELSE 'typescript' END AS language, broken AS parse_error, sha256({content}) AS content_hash FROM {state}_code"


SPANS = "CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line"


# build


@query(f"{ONE}\n{_files('one', 'false')}")
def build_files(spark, sf_dir):
    return built(spark, sf_dir)["files"].drop("project")


@query(f"{ONE}\nSELECT qualified_name, name, kind, file, {SPANS}, parent_class, starts_with(name, 'test_') AS is_test FROM one_defs")
def build_definitions(spark, sf_dir):
    return built(spark, sf_dir)["symbols"].select("qualified_name", "name", "kind", "file", "start_line", "end_line", "parent_class", "is_test")


@query(f"{ONE}\nSELECT DISTINCT caller, callee, true AS static, false AS runtime FROM one_calls")
def build_calls(spark, sf_dir):
    return built(spark, sf_dir)["calls"].select("caller", "callee", "static", "runtime")


def _imports(state: str, ending: str) -> str:
    return f"SELECT src, target, target_kind, CAST(line AS INTEGER) AS line FROM {state}_imports WHERE ends_with(src, '.{ending}')"


@query(f"{ONE}\n{_imports('one', 'py')}")
def build_imports_python(spark, sf_dir):
    return built(spark, sf_dir)["imports"].select("src", "target", "target_kind", "line").where("endswith(src, '.py')")


@query(f"{ONE}\n{_imports('one', 'ts')}")
def build_imports_typescript(spark, sf_dir):
    return built(spark, sf_dir)["imports"].select("src", "target", "target_kind", "line").where("endswith(src, '.ts')")


# runs


@query(f"{ONE},\n{RUN}\nSELECT coalesce(s.caller, r.caller) AS caller, coalesce(s.callee, r.callee) AS callee, s.caller IS NOT NULL AS static, r.caller IS NOT NULL AS runtime, coalesce(r.n, 0) AS observed_count FROM (SELECT DISTINCT caller, callee FROM one_calls) s FULL OUTER JOIN ran r ON r.caller = s.caller AND r.callee = s.callee")
def augment_calls(spark, sf_dir):
    return run(spark, sf_dir)["calls"].drop("project", "call_site_lines")


@query(f"{ONE},\n{RUN}\nSELECT test, symbol, lines_covered, lines_total, coverage_pct FROM covered")
def augment_covers(spark, sf_dir):
    return run(spark, sf_dir)["covers"].drop("project")


@query(
    f"{ONE},\n{RUN}\n"
    + """SELECT d.qualified_name, c.symbol IS NOT NULL AS runtime_observed, c.coverage_pct, CASE WHEN t.k % 5 = 0 THEN 'failed' WHEN t.k IS NOT NULL THEN 'passed' END AS test_outcome, CAST(t.k / 4 AS DOUBLE) AS test_duration,
  CASE WHEN c.symbol IS NOT NULL OR t.k IS NOT NULL THEN false END AS runtime_stale
FROM one_defs d LEFT JOIN covered c ON c.symbol = d.qualified_name LEFT JOIN (SELECT DISTINCT test, k FROM covered) t ON t.test = d.qualified_name"""
)
def augment_symbols(spark, sf_dir):
    return run(spark, sf_dir)["symbols"].select("qualified_name", F.coalesce("runtime_observed", F.lit(False)).alias("runtime_observed"), "coverage_pct", "test_outcome", "test_duration", "runtime_stale")


# updates


@query(f"{TWO}\n{_files('two', f"source = '{CHANGED}'")}")
def update_files(spark, sf_dir):
    return updated(spark, sf_dir)[0]["files"].drop("project")


@query(
    f"{TWO},\n{RUN}\nSELECT d.qualified_name, d.kind, {SPANS}, d.source = '{CHANGED}' AND c.symbol IS NOT NULL AS stale FROM two_defs d LEFT JOIN covered c ON c.symbol = d.qualified_name"
)
def update_symbols(spark, sf_dir):
    return updated(spark, sf_dir)[0]["symbols"].select("qualified_name", "kind", "start_line", "end_line", F.coalesce("runtime_stale", F.lit(False)).alias("stale"))


@query(
    f"{TWO},\n{RUN},\nleft_of_runs AS (SELECT * FROM ran WHERE caller IN (SELECT qualified_name FROM two_defs) AND callee IN (SELECT qualified_name FROM two_defs))\n"
    + "SELECT coalesce(s.caller, r.caller) AS caller, coalesce(s.callee, r.callee) AS callee, s.caller IS NOT NULL AS static, r.caller IS NOT NULL AS runtime, coalesce(r.n, 0) AS observed_count FROM after_calls s FULL OUTER JOIN left_of_runs r ON r.caller = s.caller AND r.callee = s.callee"
)
def update_calls(spark, sf_dir):
    return updated(spark, sf_dir)[0]["calls"].drop("project", "call_site_lines")


@query(f"{TWO}\nSELECT src, target, target_kind, CAST(line AS INTEGER) AS line FROM after_imports")
def update_imports(spark, sf_dir):
    return updated(spark, sf_dir)[0]["imports"].select("src", "target", "target_kind", "line")


@query(
    f"""WITH {CODE}
SELECT count(*) FILTER (source = '{NEW}') AS added, count(*) FILTER (source = '{CHANGED}' AND NOT broken) AS changed, count(*) FILTER (source = '{GONE}') AS deleted,
  count(*) FILTER (source NOT IN ('{GONE}', '{CHANGED}', '{NEW}') OR source = '{CHANGED}' AND broken) AS unchanged, count(*) FILTER (source = '{NEW}' AND broken) AS parse_errors FROM code"""
)
def update_summary(spark, sf_dir):
    s = updated(spark, sf_dir)[1]
    return spark.createDataFrame([(s.added, s.changed, s.deleted, s.unchanged, s.parse_errors)], "added long, changed long, deleted long, unchanged long, parse_errors long")


# history


@query(f"{ONE}\nSELECT path || '::f' || k AS qualified_name, 'c' || k % 40 AS sha, CAST(2 AS INTEGER) AS lines_overlapped FROM one_sound")
def history_symbols(spark, sf_dir):
    return with_history(spark, sf_dir)["symbol_changes"].drop("project")


@query(f"{ONE}\nSELECT path, 'c' || k % 40 AS sha, CAST(k % 9 AS INTEGER) AS additions, CAST(k % 4 AS INTEGER) AS deletions FROM one_code")
def history_files(spark, sf_dir):
    return with_history(spark, sf_dir)["file_changes"].drop("project")


@query(f"{ONE}\nSELECT DISTINCT 'c' || k % 40 AS sha, 'a' || k % 40 % 7 || '@x' AS author_email, 'a' || k % 40 % 7 AS author, p.cursor FROM one_code, (SELECT 'c' || min(k % 40) AS cursor FROM one_code) p")
def history_commits(spark, sf_dir):
    graph = with_history(spark, sf_dir)
    authors = graph["authors"].select(F.col("email").alias("author_email"), F.col("name").alias("author"))
    cursor = graph["projects"].select(F.col("last_history_sha").alias("cursor"))
    return graph["commits"].select("sha", "author_email").join(authors, "author_email").crossJoin(F.broadcast(cursor))  # one project, one row


# change impact at its default depth


DEEP = f"""{ONE}, {{more}}
edges AS (SELECT DISTINCT caller, callee FROM one_calls),
ways AS (
  SELECT e.callee AS via, e.caller AS node, 1 AS depth, [e.caller || chr(0) || e.callee] AS used FROM edges e JOIN one_defs d ON d.qualified_name = e.callee AND d.name = 'f1'
  UNION ALL SELECT w.via, e.caller, w.depth + 1, list_append(w.used, e.caller || chr(0) || e.callee) FROM ways w JOIN edges e ON e.callee = w.node WHERE w.depth < 5 AND NOT list_contains(w.used, e.caller || chr(0) || e.callee))"""


def _of_f1(graph: Graph) -> DataFrame:
    return graph.symbols(NAME).where("name = 'f1'")


@query(f"{DEEP.replace('{more}', '')}\nSELECT DISTINCT node AS qualified_name, via, CAST(depth AS INTEGER) AS depth FROM ways")
def impact_at_full_depth(spark, sf_dir):
    graph = built(spark, sf_dir)
    ways = impact.impacted_symbols(graph, NAME, _of_f1(graph)).select("qualified_name", F.explode("reached_via").alias("w"))
    return ways.select("qualified_name", "w.via", "w.depth")


@query(
    f"{DEEP.replace('{more}', RUN + ',')},\naffected AS (SELECT node FROM ways UNION SELECT qualified_name FROM one_defs WHERE name = 'f1')\n"
    + "SELECT c.test AS qualified_name, string_agg(c.symbol, ',' ORDER BY c.symbol) AS covers_symbols, avg(c.coverage_pct) AS avg_coverage_pct FROM covered c JOIN affected a ON a.node = c.symbol GROUP BY c.test"
)
def tests_at_full_depth(spark, sf_dir):
    graph = run(spark, sf_dir)
    changed = _of_f1(graph).select("qualified_name")
    affected = changed.unionByName(impact.impacted_symbols(graph, NAME, changed, provenance="static").select("qualified_name"))
    return impact.tests_to_run(graph, NAME, affected).select("qualified_name", F.array_join("covers_symbols", ",").alias("covers_symbols"), "avg_coverage_pct")
