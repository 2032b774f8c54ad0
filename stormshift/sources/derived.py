"""Storms, domain, watersheds and numbers of draws derived from the star-schema tables by fixed arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, COLS, CELL = 24, 32, 4000.0
DOMAIN = ((0, 0), (128000, 0), (128000, 70000), (102000, 96000), (0, 96000))
WATERSHEDS = {
    "bend": ((48000, 36000), (72000, 36000), (72000, 52000), (60000, 52000), (60000, 64000), (48000, 64000)),
    "field": ((20000, 20000), (44000, 20000), (44000, 40000), (20000, 40000)),
}

#: A storm for each supplier, so that storms grow with the tables; one gridded record per line number, whose cells may come in several rows.
_CELLS = f"""
SELECT storm_path, concat('/SHG/PRECIPITATION/', CAST(l_linenumber AS STRING)) AS record, row, col,
  l_quantity / (1e0 + ((col - cc) * (col - cc) + (row - cr) * (row - cr)) / 2.5e1) AS value, {{x}} AS ll_x, {{y}} AS ll_y, CAST({CELL!r} AS DOUBLE) AS cell_size
FROM (SELECT l_suppkey AS st, concat('storm_', CAST(l_suppkey AS STRING)) AS storm_path, l_linenumber, l_quantity,
  CAST(l_orderkey % {ROWS} AS INT) AS row, CAST(l_partkey % {COLS} AS INT) AS col,
  6 + (5 * l_suppkey) % 20 AS cc, 5 + (7 * l_suppkey) % 14 AS cr FROM lineitem)
"""
GRID_CELLS = _CELLS.format(x="CAST(0 AS DOUBLE)", y="CAST(0 AS DOUBLE)")
#: The same storms on six grids whose corners differ from the domain's, some by parts of a cell.
SHIFTED_CELLS = _CELLS.format(x="CAST(4e3 * (st % 3) - 7.3e3 AS DOUBLE)", y="CAST(1.1e3 * (st % 2) - 5e3 AS DOUBLE)")


def grid_cells(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    """storm_path, record, row, col, value, ll_x, ll_y, cell_size."""
    text = SHIFTED_CELLS if shifted else GRID_CELLS
    return spark.sql(text.replace("FROM lineitem", "FROM {lines}"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def draws(spark: SparkSession, sf_dir: str) -> int:
    """Events of a realization: as many as customers, so that draws grow with the tables."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").count()


DRAWS_SQL = "(SELECT count(*) FROM customer)"


def _values(layers: dict[str, tuple]) -> str:
    rows = [f"('{name}', 0, 0, {i}, {x}e0, {y}e0)" for name, ring in layers.items() for i, (x, y) in enumerate((*ring, ring[0]))]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(layer, part, ring, seq, x, y)"


DOMAIN_SQL, WATERSHEDS_SQL = _values({"domain": DOMAIN}), _values(WATERSHEDS)


def domain_vertices(spark: SparkSession) -> DataFrame:
    """layer, part, ring, seq, x, y; rings are closed."""
    return spark.sql(DOMAIN_SQL)


def watershed_vertices(spark: SparkSession) -> DataFrame:
    return spark.sql(WATERSHEDS_SQL)
