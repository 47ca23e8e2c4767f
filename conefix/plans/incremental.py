"""An analysis that lives across edits: answers are kept, and an edit drops only what depends on it.

The session keeps three tables in the shared folder: the facts of each source file, the
methods' bodies, and what has been solved. An edit parses the changed files, compares the
digests of bodies, and drops the contexts of changed methods together with all contexts
that asked for them, directly or not. Everything else is reused by the next query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conefix.operators import graph
from conefix.plans.analysis import bodies_of, cells_of, demanded
from conefix.session import Scratch
from conefix.sources import java

SOURCES = "program string, path string, text string"


class Analysis:
    """``reuse`` off and ``by_demand`` off give the batch mode: every answer from scratch, for all methods."""

    def __init__(self, spark: SparkSession, sources: DataFrame, reuse: bool = True, domain: str = "interval"):
        self.spark, self.scratch, self.reuse = spark, Scratch(spark, "session"), reuse
        self.version, self.domain = 0, domain
        self.facts = self._save(self._parsed(sources), "facts")
        self.bodies = self._save(self._bodies(), "bodies")
        self.solved: DataFrame | None = None
        self.dropped = 0

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.save(df, f"{name}-{self.version}")

    @staticmethod
    def _parsed(sources: DataFrame) -> DataFrame:
        keyed = sources.select(F.concat_ws("\0", "program", "path").alias("path"), "text")
        split = F.split("path", "\0")
        return java.parse_sources(keyed).select(split[0].alias("program"), split[1].alias("path"), "kind", "data")

    def _table(self, kind: str) -> DataFrame:
        return self.facts.where(F.col("kind") == kind).select("program", F.from_json("data", java.SCHEMAS[kind]).alias("d")).select("program", "d.*")

    def _bodies(self) -> DataFrame:
        return bodies_of(self._table("edge"), self._table("method"), hierarchy=self._table("parent"))

    def keep(self, path: str) -> None:
        """Write the current facts to a folder that outlives the driver."""
        self.facts.write.mode("overwrite").parquet(path)

    def restore(self, path: str) -> None:
        """Go on from facts that ``keep`` has written; answers are computed again."""
        self.take(self.spark.read.schema(self.facts.schema).parquet(path))

    def take(self, facts: DataFrame) -> None:
        self.version += 1
        self.facts = self._save(facts, "facts")
        self.bodies, self.solved = self._save(self._bodies(), "bodies"), None

    def methods(self) -> DataFrame:
        return self._table("method")

    def query(self, demand: DataFrame | None = None) -> DataFrame:
        """Cells for ``demand(program, fn, entry)``; without one, for all methods under the unconstrained entry."""
        if demand is None:
            demand = self.methods().select("program", "fn", F.lit("{}").alias("entry"))
        self.version += 1
        self.solved = demanded(self.bodies, demand, self.scratch, self.solved if self.reuse else None, f"solved-{self.version}", self.domain)
        return cells_of(self.solved)

    def edit(self, changes: DataFrame) -> int:
        """Apply ``changes(program, path, text)``, a null text deletes the file; the number of contexts that were dropped."""
        self.version += 1
        keys = changes.select("program", "path").distinct()
        fresh = self._parsed(changes.where("text IS NOT NULL"))
        self.facts = self._save(self.facts.join(keys, ["program", "path"], "left_anti").unionByName(fresh), "facts")
        before, self.bodies = self.bodies, self._save(self._bodies(), "bodies")
        old, new = before.select("program", "fn", F.col("digest").alias("a")), self.bodies.select("program", "fn", F.col("digest").alias("b"))
        changed = old.join(new, ["program", "fn"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("program", "fn")
        if self.solved is None or not self.reuse:
            self.solved = None
            return 0
        node = lambda c: F.concat_ws("|", "program", c)
        asks = self.solved.where("kind = 'ask'").select(node(F.substring_index("asked", "|", 1)).alias("src"), node("ctx").alias("dst"))
        contexts = self.solved.select("program", "fn", "ctx").distinct()
        # A context that was asked of a method without a body has no rows; its callers' bodies changed with it.
        seeds = contexts.join(changed, ["program", "fn"], "left_semi").select(F.lit(0).alias("origin"), node("ctx").alias("node"))
        dirty = graph.reach(asks, seeds).select("node")
        kept = self._save(self.solved.withColumn("node", node("ctx")).join(dirty, "node", "left_anti").drop("node"), "kept")
        self.dropped = contexts.count() - kept.select("program", "ctx").distinct().count()
        self.solved = kept
        return self.dropped
