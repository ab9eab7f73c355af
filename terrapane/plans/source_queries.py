"""Queries on what files say of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapane.plans.queries import query
from terrapane.sources import headers

#: Tables with a numeric key first.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}
_NAMES = "(SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns WHERE table_name = '{t}')"


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, {_NAMES.format(t=t)} AS columns, CAST(min({k}) AS DOUBLE) AS low, CAST(max({k}) AS DOUBLE) AS high FROM {t}" for t, k in KEYS.items()))
def footer_tables(spark, sf_dir):
    """Rows, columns and the bounds of the first column of the tables under a folder, from the footers of their files."""
    rows = headers.file_headers(spark, sf_dir).where("kind = 'parquet'")
    name = F.regexp_extract(F.substring("file", len(sf_dir.rstrip("/")) + 2, 1_000), r"^([^/.]+)", 1)
    names = F.array_join(F.transform("columns", lambda c: c["name"]), ",")
    key = F.element_at("bounds", F.element_at("columns", 1)["name"])
    rows = rows.select(name.alias("name"), "rows", names.alias("columns"), key["low"].alias("low"), key["high"].alias("high")).where(F.col("name").isin(*KEYS))
    return rows.groupBy("name", "columns").agg(F.sum("rows").alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high"))
