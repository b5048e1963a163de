"""Dense, deterministic row numbers without a global window.

``with_row_number`` range-sorts the table, counts rows per (sort partition,
release) -- a table of about #partitions + #releases rows -- turns the
counts into offsets, and adds offset + position inside the partition.  The
sorted table is checkpointed to the cluster's checkpoint folder before
counting, so the positions cannot move between the two passes and a lost
executor recomputes from the checkpoint, not from the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Offsets tables up to this many rows are broadcast; larger ones are joined.
OFFSETS_BROADCAST_ROWS = 1_000_000

#: Column in which readers keep a row's place in its source; never audited.
ORDER_COLUMN = "__order"

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | position


def file_order_key(df: DataFrame) -> list[Column]:
    """Sort key reproducing the order rows have in their source files: the key
    a reader of this package has put into ``ORDER_COLUMN``, or that of a plain
    scan.  It does not depend on how files are packed into tasks."""
    if ORDER_COLUMN in df.columns:
        return [F.col(ORDER_COLUMN)]
    try:
        is_scan = bool(df.inputFiles()) and (
            "Relation" in df._jdf.queryExecution().analyzed().getClass().getSimpleName()
            or df._jdf.queryExecution().analyzed().children().size() == 0)
    except Exception:
        is_scan = False
    if is_scan:
        return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                F.monotonically_increasing_id()]
    # not a plain file scan (a view, a join, a local frame): partition order
    return [F.monotonically_increasing_id()]


def scan_order() -> Column:
    """A row's place in its source, to be taken right at a file scan: file,
    block, and position among the block's rows."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"))


def with_row_number(df: DataFrame, order_by: list[Column], *, group: str | None = None,
                    name: str = "_row", checkpoint: bool = False,
                    max_groups: int = 1, partitions: int = 0) -> DataFrame:
    """Add ``name``: 0-based dense position in ``order_by`` order, restarting
    for every value of ``group`` (when given).

    The sorted table is persisted (or, with ``checkpoint``, written to the
    checkpoint folder) so the counting pass and the numbering pass read the
    same partitions.  Positions stay stable even if a block is recomputed:
    the range bounds are fixed once the sort's shuffle exists, and the keys
    (with the file-order tiebreaker) are unique.  A caller that writes the
    result frees the persisted copy with ``release_copy``.  ``partitions`` is a least
    number of sort partitions, for tables that the session's number would make large.
    """
    spark = df.sparkSession
    keys = ([F.col(group)] if group else []) + list(order_by)
    sort_cols = [f"__rn_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(c) for k, c in zip(keys, sort_cols)])
    sort_partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if partitions > sort_partitions:
        sort_partitions = partitions
        ordered = keyed.repartitionByRange(partitions, *sort_cols).sortWithinPartitions(*sort_cols)
    else:
        ordered = keyed.orderBy(*sort_cols)
    ordered = ordered.drop(*sort_cols)
    ordered = ordered.withColumn("__rn_mid", F.monotonically_increasing_id())
    if checkpoint:
        ensure_checkpoint_dir(spark)
        ordered = ordered.checkpoint(eager=True)
    else:
        ordered = ordered.persist()

    pid = F.shiftright(F.col("__rn_mid"), _LOCAL_BITS)
    local = F.col("__rn_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    gcols = [group] if group else []
    counts = (ordered.select(pid.alias("__rn_pid"), local.alias("__rn_local"), *gcols)
              .groupBy("__rn_pid", *gcols)
              .agg(F.count(F.lit(1)).alias("__rn_n"), F.min("__rn_local").alias("__rn_first")))
    w = Window.partitionBy(*gcols).orderBy("__rn_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__rn_pid", *gcols, "__rn_first",
        F.coalesce(F.sum("__rn_n").over(w), F.lit(0)).alias("__rn_off"))
    # the offsets table has at most (#sort partitions + #groups) rows
    bound = sort_partitions + (max_groups if group else 1)
    if bound <= OFFSETS_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    numbered = (ordered.withColumn("__rn_pid", pid).withColumn("__rn_local", local)
                .join(offsets, ["__rn_pid", *gcols])
                .withColumn(name, F.col("__rn_off") + F.col("__rn_local") - F.col("__rn_first"))
                .drop("__rn_pid", "__rn_local", "__rn_first", "__rn_off", "__rn_mid"))
    if not checkpoint:
        numbered.__dict__["sorted_copy"] = ordered
    return numbered


def release_copy(numbered: DataFrame) -> None:
    """Frees the sorted copy behind a frame of ``with_row_number`` once what was
    made from it is written."""
    copy = numbered.__dict__.pop("sorted_copy", None)
    if copy is not None:
        copy.unpersist()
