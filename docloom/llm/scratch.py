"""Written tables (see docloom.scratch) and small tables that are part of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.scratch import Scratch, shared_dir

__all__ = ["Scratch", "literal_table", "shared_dir"]


def literal_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table of whole numbers, booleans and nulls that is part of the plan; names: as in "a b c"."""
    show = lambda x: "CAST(NULL AS BIGINT)" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}L"
    columns = names.split()
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"0L AS {c}" for c in columns)).limit(0)
    body = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
