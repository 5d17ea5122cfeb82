"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COUNTS = ("rank", "chars", "n_lines")


def query(sql: str | None = None, name: str | None = None):
    """Registers f(read) under its name; read(table) gives a table of the data set."""

    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            # counts and ranks are long, as in the SQL
            return out.withColumns({c: F.col(c).cast("long") for c in COUNTS if dict(out.dtypes).get(c) == "int"})

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


from . import corpus_queries, report_queries, retrieval_queries, table_queries  # noqa: E402, F401
