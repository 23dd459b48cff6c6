"""Running sums, previous values and row numbers over a global order, without a one-task window.

Rows are range-partitioned by ``(series, order)`` into equal blocks, whatever the skew of a series,
and written to the shared checkpoint folder with their block number, so every later step reads the
same blocks even after an executor is lost. Windows run inside a block; what crosses a block border
is one row per block (its last row, its last series' sum), a size bounded by the number of blocks.

Copies of one row share all order columns and would fill one block however many there are. Unless the
caller knows the order to be unique, rows are therefore written once with a row number as the last
order column; the ranges are then cut through the middle of a group of copies too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import blocks_of, cut

BLOCK = "_block"
COPY = "_copy"


class Ordered:
    """A table in a fixed total order: by ``series`` first, then by ``order`` inside each series."""

    def __init__(
        self, df: DataFrame, series: Sequence[str], order: Sequence[str], *, unique: bool = False,
        blocks: int | None = None,
    ):
        self.series, self.order = list(series), list(order)
        if not unique:
            # written before it decides where rows go: a repeated task must not renumber them
            df = cut(df.withColumn(COPY, F.monotonically_increasing_id()))
            self.order.append(COPY)
        n = blocks or blocks_of(df.sparkSession)
        keys = [F.col(c) for c in (*self.series, *self.order)]
        self.df = cut(df.repartitionByRange(n, *keys).withColumn(BLOCK, F.spark_partition_id()))

    def _with(self, df: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.series, out.order, out.df = self.series, self.order, df
        return out

    @property
    def _window(self):
        return Window.partitionBy(BLOCK).orderBy(*self.series, *self.order)

    @property
    def _position(self) -> Column:
        return F.struct(*self.series, *self.order)

    def _series_of(self, row: Column) -> Column:
        same = F.lit(True)
        for c in self.series:
            same = same & row[c].eqNullSafe(F.col(c))
        return same

    def with_columns(self, columns: Mapping[str, Column]) -> Ordered:
        return self._with(self.df.withColumns(dict(columns)))

    def previous(self, columns: Mapping[str, str]) -> Ordered:
        """Add ``{new: old}``: the value of ``old`` in the previous row of the same series."""
        packed = F.struct(*self.series, *dict.fromkeys(columns.values()))
        # one row per block: its last row, handed to the next non-empty block
        last = self.df.groupBy(BLOCK).agg(F.max_by(packed, self._position).alias("_carry"))
        handed = last.select(
            F.lead(BLOCK).over(Window.orderBy(BLOCK)).alias(BLOCK), "_carry"
        ).filter(F.col(BLOCK).isNotNull())
        inside = self.df.withColumn("_prev", F.lag(packed).over(self._window))
        both = inside.join(F.broadcast(handed), BLOCK, "left")
        row = F.coalesce(F.col("_prev"), F.col("_carry"))
        values = {new: F.when(self._series_of(row), row[old]) for new, old in columns.items()}
        return self._with(both.withColumns(values).drop("_prev", "_carry"))

    def running_sum(self, columns: Mapping[str, Column | str]) -> Ordered:
        """Add ``{new: value}``: the sum of ``value`` over the series up to and including the row."""
        named = {new: (F.col(v) if isinstance(v, str) else v) for new, v in columns.items()}
        valued = self.df.withColumns({f"_v_{n}": v for n, v in named.items()})
        w = Window.partitionBy(BLOCK, *self.series).orderBy(*self.order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        inside = valued.withColumns({n: F.sum(f"_v_{n}").over(w) for n in named})

        # per block: the sum of its last series; the series is contiguous, so earlier blocks that end
        # in the same series are exactly the ones holding the rest of it
        sums = [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in named]
        per_series = valued.groupBy(BLOCK, *self.series).agg(*sums)
        carried = F.struct(*self.series, *[f"_s_{n}" for n in named])
        key = F.struct(*self.series) if self.series else F.lit(1)
        last = per_series.groupBy(BLOCK).agg(F.max_by(carried, key).alias("_c")).select(BLOCK, "_c.*")
        up_to = Window.partitionBy(*self.series).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
        handed = last.select(
            F.lead(BLOCK).over(Window.orderBy(BLOCK)).alias(BLOCK),
            F.struct(*self.series, *[F.sum(f"_s_{n}").over(up_to).alias(f"_o_{n}") for n in named]).alias("_off"),
        ).filter(F.col(BLOCK).isNotNull())
        both = inside.join(F.broadcast(handed), BLOCK, "left")
        off = F.col("_off")
        own = F.coalesce(off.isNotNull() & self._series_of(off), F.lit(False))
        total = {n: F.col(n) + F.when(own, F.coalesce(off[f"_o_{n}"], F.lit(0))).otherwise(F.lit(0)) for n in named}
        return self._with(both.withColumns(total).drop("_off", *[f"_v_{n}" for n in named]))

    def rows(self) -> DataFrame:
        return self.df.drop(BLOCK, COPY)


def row_index(df: DataFrame, order: Sequence[str], name: str = "idx", unique: bool = False) -> DataFrame:
    """Add a dense 1-based row number over the whole table."""
    return Ordered(df, [], order, unique=unique).running_sum({name: F.lit(1).cast("bigint")}).rows()


def prefix_sum(df: DataFrame, order: Sequence[str], columns: Mapping[str, Column | str], series: Sequence[str] = ()):
    """Cumulative sums over a global order, or over each series' own order."""
    return Ordered(df, series, order).running_sum(columns).rows()


def islands(df: DataFrame, series: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Number the runs of equal ``state`` in each series (column ``island``)."""
    o = Ordered(df, series, order).previous({"_before": state})
    changed = (~F.col("_before").eqNullSafe(F.col(state))).cast("bigint")
    return o.running_sum({"island": changed}).rows().drop("_before")
