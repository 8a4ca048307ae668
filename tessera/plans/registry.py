"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL where there is one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT sha256(coalesce(text, '')) AS digest, count(*) AS members, min(doc_id) AS canonical, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity groups of more than one member, with the canonical one."""
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return groups.agg(F.count("*").alias("members"), F.min("doc_id").alias("canonical"), F.sum("n_chars").alias("chars")).where("members > 1")


import tessera.plans.audit  # noqa: E402, F401  registers its queries
import tessera.plans.books  # noqa: E402, F401  registers its queries
import tessera.plans.catalog  # noqa: E402, F401  registers its queries
import tessera.plans.checks  # noqa: E402, F401  registers its queries
import tessera.plans.folders  # noqa: E402, F401  registers its queries
import tessera.plans.imports  # noqa: E402, F401  registers its queries
import tessera.plans.shelves  # noqa: E402, F401  registers its queries
import tessera.plans.states  # noqa: E402, F401  registers its queries
