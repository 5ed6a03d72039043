"""Raw imports and calls to edges, by joins on names."""

from __future__ import annotations

import posixpath
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import file_of, module_column, simple_name
from codeloom.sources.files import TS_ENDINGS

STDLIB = sorted(sys.stdlib_module_names)


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (caller, callee) of raw calls (qualified_name of the caller, callee as written).

    A callee is found by its last dotted segment, in the caller's own file before any other, and of
    several the least name; calls of unknown names vanish.
    """
    names = symbols.select(F.col("qualified_name").alias("target"), simple_name(F.col("qualified_name")).alias("simple"), file_of(F.col("qualified_name")).alias("target_file"))
    # one candidate for each name, and one for each name and file; merged, as they grow with the symbols
    anywhere = names.groupBy("simple").agg(F.min("target").alias("anywhere")).hint("merge")
    nearby = names.groupBy("simple", "target_file").agg(F.min("target").alias("nearby")).hint("merge")
    raw = calls.select(F.col("qualified_name").alias("caller"), F.element_at(F.split("callee", r"\."), -1).alias("simple")).where("caller is not null").distinct()
    raw = raw.withColumn("target_file", file_of(F.col("caller")))
    found = raw.join(anywhere, "simple").join(nearby, ["simple", "target_file"], "left")
    return found.select("caller", F.coalesce("nearby", "anywhere").alias("callee")).distinct()


def resolve_python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, target, target_kind, raw, line): a project file where the module is one, else stdlib or thirdparty."""
    modules = files.select(module_column(F.col("path")).alias("module"), F.col("path").alias("found")).groupBy("module").agg(F.min("found").alias("found")).hint("merge")
    top = F.substring_index("module", ".", 1)
    kind = F.when(F.col("found").isNotNull(), "file").when(top.isin(STDLIB), "stdlib").otherwise("thirdparty")
    joined = imports.join(modules, "module", "left")
    return joined.select(F.col("path").alias("src"), F.coalesce("found", "module").alias("target"), kind.alias("target_kind"), "raw", "line")


@dataclass(frozen=True)
class TsPaths:
    """``baseUrl`` and ``paths`` of a tsconfig.json."""

    base: str | None = None
    paths: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str | None) -> TsPaths:
        import json

        try:
            options = json.loads(text or "{}").get("compilerOptions") or {}
        except (ValueError, AttributeError):
            return cls()
        paths = options.get("paths")
        return cls(options.get("baseUrl"), paths if isinstance(paths, dict) else {})

    def expand(self, spec: str) -> str | None:
        """What an alias stands for: exact ones first, then the first ``prefix/*``; only first targets count."""
        if spec in self.paths:
            return self._at_base(self.paths[spec][0])
        for pattern, targets in self.paths.items():
            head, star = pattern[:-1], pattern.endswith("/*")
            if star and spec.startswith(head):
                target = targets[0]
                return self._at_base(target[:-1] + spec[len(head) :] if target.endswith("/*") else target)
        return None

    def _at_base(self, target: str) -> str:
        return posixpath.normpath(posixpath.join(self.base or ".", target))


def candidate_path(src: str, spec: str, config: TsPaths) -> str | None:
    """The project path that a specifier means, without ending; None for a package."""
    if spec.startswith(("./", "../")):
        return posixpath.normpath(posixpath.join(posixpath.dirname(src), spec))
    return config.expand(spec)


def resolve_ts_imports(imports: DataFrame, files: DataFrame, config: TsPaths) -> DataFrame:
    """As for Python: the literal path, then each ending, then each index file; else thirdparty."""
    base = F.udf(lambda src, spec: candidate_path(src, spec, config), "string")
    rows = imports.select("path", "module", "raw", "line").withColumn("base", base("path", "module"))
    tails = ["", *TS_ENDINGS, *(f"/index{e}" for e in TS_ENDINGS)]
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat("base", F.lit(tail)).alias("try")) for k, tail in enumerate(tails)])
    wanted = rows.select("base").where("base is not null").distinct().select("base", F.explode(tries).alias("t")).select("base", "t.rank", F.col("t.try").alias("try"))
    known = files.select(F.col("path").alias("try")).hint("merge")
    best = wanted.join(known, "try").groupBy("base").agg(F.min_by("try", "rank").alias("found")).hint("merge")
    joined = rows.join(best, "base", "left")
    kind = F.when(F.col("found").isNotNull(), "file").otherwise("thirdparty")
    return joined.select(F.col("path").alias("src"), F.coalesce("found", "module").alias("target"), kind.alias("target_kind"), "raw", "line")
