"""The graph as DataFrames, and its versioned Parquet folder.

A version is written whole into a folder of its own and then named by a pointer file, so a version
that is being read is never overwritten and a failed write leaves no trace.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schema import KEYS, TABLES, conform, empty


@dataclass(frozen=True)
class Graph:
    """All tables of the graph; every operator takes one and returns frames or another one."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Graph:
        return cls(spark, {t: conform(tables[t], t) if t in tables else empty(spark, t) for t in TABLES})

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def within(self, table: str, project: str) -> DataFrame:
        """The rows of one project."""
        return self.tables[table].where(F.col("project") == project)

    def symbols(self, project: str) -> DataFrame:
        """Symbols that the project's files define."""
        return self.within("symbols", project).where("contained")

    def with_tables(self, **tables: DataFrame) -> Graph:
        return replace(self, tables=self.tables | {t: conform(df, t) for t, df in tables.items()})

    def register(self) -> None:
        """Named views for free-form queries."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)


class KeyViolation(ValueError):
    """A table with a key that is null or not unique."""


def duplicate_keys(graph: Graph, table: str) -> DataFrame:
    """Keys that occur more than once or have a null in them; empty if the table is sound."""
    keys = list(KEYS[table])
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull()
    return graph[table].groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | absent)


class GraphStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The current version; 0 if nothing has been written."""
        fs, path = self._fs("CURRENT")
        if not fs.exists(path):
            return 0
        return int(self.spark.read.text(f"{self.path}/CURRENT").first()["value"])

    def load(self) -> Graph:
        n = self.version()
        if not n:
            return Graph.of(self.spark)
        return Graph(self.spark, {t: self.spark.read.schema(ddl).parquet(f"{self.path}/v{n}/{t}") for t, ddl in TABLES.items()})

    def commit(self, graph: Graph) -> Graph:
        """Writes a new version, makes it the current one and reads it back (which cuts the lineage).

        A version in which a key occurs twice, or is null, does not become the current one.
        """
        n = self.version() + 1
        for t, ddl in TABLES.items():
            graph[t].write.mode("overwrite").parquet(f"{self.path}/v{n}/{t}")
            written = Graph(self.spark, {t: self.spark.read.schema(ddl).parquet(f"{self.path}/v{n}/{t}")})
            wrong = duplicate_keys(written, t).limit(3).collect()
            if wrong:
                fs, path = self._fs(f"v{n}")
                fs.delete(path, True)
                raise KeyViolation(f"{t}: {', '.join(KEYS[t])} must be there and unique, but {[tuple(r) for r in wrong]}")
        fs, path = self._fs("CURRENT")
        out = fs.create(path, True)
        out.write(bytearray(str(n).encode()))
        out.close()
        return self.load()

    def clean(self) -> bool:
        fs, path = self._fs("")
        return bool(fs.delete(path, True))
