"""Session helpers for local runs and tests, and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quarry", extra: dict | None = None) -> SparkSession:
    """A local session configured like the cluster jobs expect (AQE on, Arrow on, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared checkpoint location.

    The location comes from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only when
    neither is set and the master is ``local`` - a test session - a private temporary folder is
    created and registered; on a cluster a machine-local folder would lose data, so it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-ckpt-")
        sc.setCheckpointDir(base)
    path = base.rstrip("/")
    for part in parts:
        path = f"{path}/{part}"
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (for tables written by a job)."""
    return shared_dir(spark, "quarry", f"{name}-{uuid.uuid4().hex[:12]}")


def materialise(df, name: str):
    """Write ``df`` once to the shared folder and read it back (a fixed input for what follows)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def ensure_dir(path: str) -> None:
    if "://" not in path or path.startswith("file:"):
        os.makedirs(local_path(path), exist_ok=True)


_SPLITS: dict[tuple[str, str], int] = {}


def spread(df, source_key: str | None = None):
    """Round-robin ``df`` over the cluster's cores when it has fewer input partitions than cores.

    Small inputs stored as one Parquet row group scan as a single task; CPU-heavy per-row text
    work (folding, chunking, parsing, hashing) would then use one core. On a cluster reading
    large inputs there are already more splits than cores and this is a no-op (no shuffle).
    ``source_key`` (e.g. the path read) memoises the split count within the application.
    """
    sc = df.sparkSession.sparkContext
    cores = sc.defaultParallelism
    key = (sc.applicationId, source_key) if source_key else None
    splits = _SPLITS.get(key) if key else None
    if splits is None:
        splits = df.rdd.getNumPartitions()
        if key:
            _SPLITS[key] = splits
    if splits < cores:
        return df.repartition(cores)
    return df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable by the Python workers (UDFs are pickled by reference).

    Zips the package once per Spark application and registers it with ``addPyFile`` - the same
    thing ``--py-files`` does at submit time. The zip goes under the shared folder when that is a
    local path, else to a driver-side file that Spark serves to the executors.
    """
    import hashlib
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    files = sorted(p for p in pkg.rglob("*.py") if "__pycache__" not in p.parts)
    digest = hashlib.sha1()
    for p in files:
        digest.update(str(p.relative_to(pkg.parent)).encode())
        digest.update(p.read_bytes())
    base = shared_dir(spark, "quarry", "pkg")
    if "://" in base and not base.startswith("file:"):
        base = tempfile.mkdtemp(prefix="quarry-pkg-")
    ensure_dir(base)
    target = Path(local_path(base)) / f"quarry-{digest.hexdigest()[:12]}.zip"
    if not target.exists():
        tmp = target.with_suffix(f".{uuid.uuid4().hex[:6]}.tmp")
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as zf:
            for p in files:
                zf.write(p, str(p.relative_to(pkg.parent)))
        os.replace(tmp, target)
    sc.addPyFile(str(target))
    _SHIPPED.add(app)
