"""Groups whose members are compared with each other, cut so that no task gets a large one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import durable

#: Limits of the number of members that are compared in one go. Between them it follows the rows of a task.
BLOCK_LEAST, BLOCK_MOST = 256, 8192

#: Columns that tell the pairs of blocks of a group apart.
PAIR = ("one", "two")


def paired_blocks(rows: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """Add ``one`` and ``two``: groups over the block size are cut into blocks by a hash of ``member``, and a
    row goes to every pair of blocks with its own, so that any two of a group still meet.

    ``rows`` is read twice, so it should be stored. A pair of blocks has two blocks' rows at most.
    """
    spark = rows.sparkSession
    sizes = durable(rows.groupBy(*group).agg(F.count("*").alias("n")).filter(f"n > {BLOCK_LEAST}"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = min(max(rows.count() // (2 * tasks), BLOCK_LEAST), BLOCK_MOST)
    large = sizes.select(*group, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(member), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = rows.join(large, list(group), "left").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    pairs = (F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    return dealt.select("*", other.alias("other")).select(*rows.columns, *pairs)
