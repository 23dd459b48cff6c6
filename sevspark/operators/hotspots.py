"""Geographic hot-spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions import geo
from . import aggregate, rank


def cell_rates(
    points: DataFrame, lat: str, lon: str, label: str, cells_per_degree: int = 200,
    lat_bounds=presets.LAT_BOUNDS, lon_bounds=presets.LON_BOUNDS_HOTSPOTS,
) -> DataFrame:
    """Count and mean label per grid cell inside the box."""
    inside = points.filter(geo.in_box(F.col(lat), F.col(lon), lat_bounds, lon_bounds))
    cells = inside.select(
        geo.grid_cell(F.col(lat), cells_per_degree).alias("lat_r"),
        geo.grid_cell(F.col(lon), cells_per_degree).alias("lon_r"),
        label,
    )
    return aggregate.rate_per_group(cells, ["lat_r", "lon_r"], label)


def top_cells(cells: DataFrame, n: int = 10) -> DataFrame:
    """Cells with the highest rate, as a percentage; ties by cell position."""
    order = [F.col("rate").desc(), F.col("lat_r"), F.col("lon_r")]
    return rank.top_groups(cells, order, n).withColumn("pct", F.bround(F.col("rate") * 100, 1))


def hotspots(
    points: DataFrame, lat: str, lon: str, label: str, cells_per_degree: int = 200,
    min_rate: float = 0.5, min_count: int = 3, n: int = 10,
) -> DataFrame:
    """Top cells above both limits and how many cells there are in all."""
    kept = aggregate.having(cell_rates(points, lat, lon, label, cells_per_degree), min_rate, min_count)
    total = kept.agg(F.count(F.lit(1))).scalar()
    return top_cells(kept, n).select("lat_r", "lon_r", "n", "pct", total.alias("n_cells"))
