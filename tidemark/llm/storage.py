"""Where the operators put what several of their steps read, and when they may broadcast.

Executors can be lost and share no local disk, so lineage is cut only with tables written
below ``spark.checkpoint.dir``; see ``tidemark.sources.tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_dir, stored

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "shared_dir", "small", "stored"]

#: A side is broadcast only after a count has shown it to have no more rows, and about no more bytes, than this.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if it is stored already and small in rows and in bytes.

    A row takes about 24 bytes and 8 for each column in memory; what strings and arrays take besides is
    reckoned as thrice their files. Beyond the bounds the join shuffles, and adaptive execution splits
    its skewed partitions.
    """
    rows = df.count()
    if rows > BROADCAST_ROWS:
        return df
    files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if rows * (24 + 8 * len(df.columns)) + 3 * files <= BROADCAST_BYTES else df
