"""Global places of rows in a total order, without bringing them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.shared import materialise


def global_positions(df: DataFrame, groups: Sequence[str], pos: str, counted: bool = False) -> DataFrame:
    """With ``position`` from 0: the row's place among those of its first group column, in order of the others and ``pos``.

    ``counted`` says that ``pos`` counts each group's rows from 0 already, as exploding a list does;
    otherwise they are numbered in its order.
    The rows are written once and never sorted as a whole: only the groups' sizes are range
    partitioned, and totals by partition give each group's first place. Rows of one group, such as
    the entries of one answer, are numbered together; of equal ``pos`` either may come first.
    """
    within, written = groups[0], materialise(df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = written.groupBy(*groups).agg(F.count("*").alias("_rows"))
    ranged = materialise(sizes.repartitionByRange(parts, *groups).withColumn("_part", F.spark_partition_id()))

    def before(rows: str, *by: str) -> Column:
        window = Window.partitionBy(*by[:-1]).orderBy(*(groups if by[-1] == "groups" else by[-1:])).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(rows).over(window), F.lit(0))

    totals = ranged.groupBy(within, "_part").agg(F.sum("_rows").alias("_rows"))
    firsts = totals.select(within, "_part", before("_rows", within, "_part").alias("_first"))
    inside = ranged.withColumn("_start", before("_rows", within, "_part", "groups"))
    starts = inside.join(firsts, [within, "_part"]).select(*groups, (F.col("_first") + F.col("_start")).alias("_before"))
    place = F.col(pos) if counted else F.row_number().over(Window.partitionBy(*groups).orderBy(pos)) - 1
    numbered = written.withColumn("_inside", place)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in groups]
    placed = numbered.alias("a").join(starts.alias("b"), same)
    return placed.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("b._before") + F.col("a._inside")).alias("position"))
