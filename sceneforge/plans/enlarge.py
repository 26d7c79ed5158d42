"""Amplifying a stored table into a larger stored one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from sceneforge.operators import amplify as amp
from sceneforge.sources.tables import read_table


def enlarge_table(
    spark: SparkSession,
    seed_path: str,
    out_path: str,
    key: Sequence[str],
    target_bytes: int = amp.TARGET_BYTES,
    copies: int | None = None,
    ids: Sequence[str] = (),
) -> int:
    """Write enough jittered copies of the seed to reach the target size; returns the number of copies.

    All copies come from one distributed write in the format the path names.
    """
    seed = read_table(spark, seed_path)
    wanted = copies or amp.replicas_for(amp.stored_bytes(spark, seed_path), target_bytes)
    large = amp.amplify(seed, wanted, key, ids)
    if out_path.endswith(".parquet"):
        large.write.mode("overwrite").parquet(out_path)
    else:
        large.write.mode("overwrite").option("header", True).csv(out_path)
    return wanted
