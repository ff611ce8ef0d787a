"""Session helpers: building a session, the checkpoint folder, bounded broadcasts.

Nothing here starts a server: the Spark UI stays off.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is broadcast without further thought. Code tables
# (parties, genders, chambers, offices) are far below; persons and vocabularies grow
# with the corpus and are checked with `bounded_broadcast`.
BROADCAST_ROW_LIMIT = 200_000


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "rostra",
                  extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024 ** 2) -> dict[str, str]:
    """Settings for a large cluster run, sized from the input volume and the cores.

    Shuffles start with enough partitions for ~partition_bytes each (at least 3 per core)
    and AQE coalesces small ones and splits skewed ones at run time; scans split parquet
    into ~partition_bytes pieces (documents rows are wide text)."""
    shuffle = max(3 * total_cores, input_bytes // partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 ** 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 ** 2),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names a shared folder and is used as is. Only when it is
    unset (tests, local runs) a private scratch folder is created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):  # each executor would write to its own disk
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="rostra-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table below the shared checkpoint folder and read back: cuts the
    lineage, survives lost executors, and is computed once."""
    path = scratch_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SIZE_CHECKS: dict[tuple, bool] = {}


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast `df` only when it provably has at most `max_rows` rows.

    The check reads at most ``max_rows + 1`` rows (``limit`` stops the scan early); its
    outcome is remembered per session, plan and input files (files are not rewritten in place
    while a session runs; new ones are counted). Above the bound the frame is returned unchanged and Spark plans a
    shuffled join.
    """
    key = (id(df.sparkSession), df.semanticHash(), max_rows, tuple(sorted(df.inputFiles())))
    small = _SIZE_CHECKS.get(key)
    if small is None:
        small = df.limit(max_rows + 1).count() <= max_rows
        _SIZE_CHECKS[key] = small
    return F.broadcast(df) if small else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan by `key` when it yields fewer partitions than the cluster
    has cores (a single large row group reads as one partition). Scans that already
    split are left alone, so wide text is not shuffled at scale."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n_parts = df.rdd.getNumPartitions()
    except Exception:  # Spark Connect has no RDD view; the server plans the scan
        return df
    if n_parts < cores:
        return df.repartition(max(cores * 2, 2), key)
    return df


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a single-row aggregate (a total, a count) to every row as
    scalar subqueries (computed once, no join)."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])
