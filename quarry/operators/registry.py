"""Project registry as a table (``name`` is the key).

All maintenance is set-based: an upsert is a full outer join of the current table and the
incoming records, a stamp is a left join with the index summary, a removal is an anti join. The
result is a new version of the table (Parquet has no in-place MERGE); ``save_registry`` writes it to a
folder of its own and then points readers at it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULT_SETTINGS, Settings
from quarry.functions.text import index_name

REGISTRY_SCHEMA = ("name string, project_path string, index_name string, created_at timestamp, "
                   "updated_at timestamp, last_indexed_at timestamp, "
                   "last_indexed_chunk_count bigint")
REGISTRY_COLUMNS = ["name", "project_path", "index_name", "created_at", "updated_at",
                    "last_indexed_at", "last_indexed_chunk_count"]


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def _absent(error: AnalysisException) -> bool:
    return (error.getCondition() or "").split(".")[0] == "PATH_NOT_FOUND"


POINTER = "CURRENT"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the registry's pointer names; None before the first save."""
    place, fs = _file_system(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry's current version; a path that does not exist yields an empty registry (a first run).

    A version keeps its folder, so a table that was loaded stays as it is whatever is saved later. Every
    other failure (permissions, a flaky store, damaged files) is raised: an empty registry would be
    saved over the real one.
    """
    version = current_version(spark, path)
    if version is not None:
        return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{path.rstrip('/')}/{version}")
    place, fs = _file_system(spark, path)
    if not fs.exists(place) or any(f.getPath().getName().startswith("version-") for f in fs.listStatus(place)):
        return empty_registry(spark)  # nothing saved, or a first save that did not end
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)  # a plain Parquet table


def load_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """Import registries kept as JSON state files: ``{"projects": {name: record}}``.

    ``path`` is a file, a folder or a pattern. Each file is parsed for itself and each field for itself:
    a file that does not parse, or whose ``projects`` is not an object, yields nothing; a field that is
    missing or not of its type is NULL; a missing ``name`` falls back to the map key and a missing count
    to 0. Timestamps are ISO-8601 strings (with offset).
    """
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if not _absent(error):
            raise
        return empty_registry(spark)
    projects = F.try_variant_get(F.try_parse_json("value"), "$.projects", "map<string, variant>")
    rows = raw.select(F.explode(projects).alias("key", "p"))

    def field(c: str, kind: str = "string"):
        return F.try_variant_get("p", f"$.{c}", kind)

    times = [F.try_to_timestamp(field(c)).alias(c) for c in ("created_at", "updated_at", "last_indexed_at")]
    return rows.select(
        F.coalesce(field("name"), F.col("key")).alias("name"), field("project_path").alias("project_path"),
        field("index_name").alias("index_name"), *times,
        F.coalesce(field("last_indexed_chunk_count", "bigint"), F.lit(0)).cast("long").alias("last_indexed_chunk_count"))


def save_registry(registry: DataFrame, path: str) -> str:
    """Save a new version next to the older ones and point the registry at it; returns its name.

    The pointer is a small file that is replaced by an atomic rename after the version is whole. A save
    that is killed at any point leaves the version before it in force, and a registry may be saved over
    the path that it was loaded from.
    """
    spark = registry.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    registry.select(*REGISTRY_COLUMNS).write.parquet(f"{path.rstrip('/')}/{version}")
    _point(spark, path, version)
    return version


def _point(spark: SparkSession, path: str, version: str) -> None:
    target, _ = _file_system(spark, f"{path.rstrip('/')}/{POINTER}")
    fresh, fs = _file_system(spark, f"{path.rstrip('/')}/.{version}.pointer")
    stream = fs.create(fresh, True)
    try:
        stream.write(version.encode())
    finally:
        stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), options)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the current and the newest ``keep`` other versions; returns how many went.

    Unfinished versions count as others. Tables loaded from a deleted version can no longer be read.
    """
    place, fs = _file_system(spark, path)
    current = current_version(spark, path)
    if current is None:
        return 0
    others = [f for f in fs.listStatus(place)
              if f.getPath().getName().startswith("version-") and f.getPath().getName() != current]
    others.sort(key=lambda f: -f.getModificationTime())
    return sum(bool(fs.delete(f.getPath(), True)) for f in others[keep:])


def _ts(now) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def upsert_projects(current: DataFrame, incoming: DataFrame, now=None,
                    settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Register or refresh ``incoming(name, project_path[, seq])``.

    Existing records keep ``created_at``, ``last_indexed_at`` and the chunk count; path, index name
    and ``updated_at`` are refreshed. When a name arrives more than once the row with the highest
    ``seq`` (arrival order) wins; without ``seq`` the greatest path wins. Blank names are rejected (left out and reported by
    ``invalid_names``).
    """
    ts = _ts(now)
    inc = incoming.where(F.length(F.trim("name")) > 0)
    if "seq" in inc.columns:
        # max_by aggregates partially on the map side: a name arriving very often stays cheap.
        inc = inc.groupBy("name").agg(F.max_by("project_path", "seq").alias("new_path"))
    else:
        # No arrival order: take a reproducible choice (a retried task must pick the same row).
        inc = inc.groupBy("name").agg(F.max("project_path").alias("new_path"))
    cur = current.select(*REGISTRY_COLUMNS)
    joined = cur.join(inc, "name", "full_outer")
    is_new = F.col("new_path").isNotNull()
    return joined.select(
        "name",
        F.when(is_new, F.col("new_path")).otherwise(F.col("project_path")).alias("project_path"),
        F.when(is_new, index_name("name", settings.index_prefix))
        .otherwise(F.col("index_name")).alias("index_name"),
        F.coalesce("created_at", ts).alias("created_at"),
        F.when(is_new, ts).otherwise(F.col("updated_at")).alias("updated_at"),
        F.col("last_indexed_at"),
        F.coalesce("last_indexed_chunk_count", F.lit(0)).cast("long")
        .alias("last_indexed_chunk_count"),
    )


def invalid_names(incoming: DataFrame) -> DataFrame:
    return incoming.where(F.length(F.trim(F.coalesce("name", F.lit("")))) == 0) \
        .withColumn("error", F.lit("empty project name"))


def stamp_indexed(current: DataFrame, summary: DataFrame, now=None) -> DataFrame:
    """Record an indexing run: ``summary(project, chunks_indexed)``; unknown projects are ignored."""
    ts = _ts(now)
    s = summary.select(F.col("project").alias("name"), F.col("chunks_indexed").alias("_n"))
    joined = current.join(s, "name", "left")
    hit = F.col("_n").isNotNull()
    return joined.select(
        "name", "project_path", "index_name", "created_at",
        F.when(hit, ts).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, ts).otherwise(F.col("last_indexed_at")).alias("last_indexed_at"),
        F.when(hit, F.col("_n")).otherwise(F.col("last_indexed_chunk_count")).cast("long")
        .alias("last_indexed_chunk_count"),
    )


def remove_projects(current: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry without ``removals(name)``, outcome per requested name).

    The outcome has ``ok`` (was registered) and ``chunks_deleted`` (the last recorded count, as
    reported when chunks are dropped with the record).
    """
    names = removals.select("name").distinct()
    remaining = current.join(names, "name", "left_anti")
    outcome = names.join(current.select("name", "last_indexed_chunk_count", F.lit(True).alias("_known")),
                         "name", "left") \
        .select("name", F.coalesce("_known", F.lit(False)).alias("ok"),
                F.coalesce("last_indexed_chunk_count", F.lit(0)).cast("long")
                .alias("chunks_deleted"))
    return remaining, outcome


# Registries up to this many records are broadcast to the requests they are joined with.
REGISTRY_BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, max_rows: int = REGISTRY_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after checking the row count (requests may hit one project heavily;
    a broadcast join has no reducer to overload)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def lookup(requests: DataFrame, registry: DataFrame, project_col: str = "project") -> DataFrame:
    """Attach the registry record to each request; ``status`` is ``ok`` or ``not_registered``."""
    reg = broadcast_if_small(
        registry.select(F.col("name").alias(project_col), "index_name", "project_path",
                        F.lit(True).alias("_known")))
    return requests.join(reg, project_col, "left").withColumn(
        "status", F.when(F.col("_known"), F.lit("ok")).otherwise(F.lit("not_registered"))).drop("_known")


def list_projects(registry: DataFrame) -> DataFrame:
    """Compact listing ordered by lower-case name (count absent -> 0)."""
    return registry.select(
        "name", "project_path", "last_indexed_at",
        F.coalesce("last_indexed_chunk_count", F.lit(0)).cast("long")
        .alias("last_indexed_chunk_count"),
    ).orderBy(F.lower("name"), "name")


def register_discovered(registry: DataFrame, discovered: DataFrame, now=None,
                        settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Bulk registration: project discovery feeds the upsert (``discovered(name, project_path)``)."""
    return upsert_projects(registry, discovered.select("name", "project_path"), now, settings)


def registry_counts(registry: DataFrame) -> DataFrame:
    """One row: projects, projects that were indexed, and their recorded chunks."""
    return registry.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count("last_indexed_at").alias("indexed_projects"),
        F.coalesce(F.sum("last_indexed_chunk_count"), F.lit(0)).cast("long").alias("chunks"))


def compact_registered(registry: DataFrame) -> DataFrame:
    """The short form of a registration: name, path and index name."""
    return registry.select("name", "project_path", "index_name")


def compact_indexed(summary: DataFrame, registry: DataFrame) -> DataFrame:
    """The short form of an index run per project, with its index name."""
    names = registry.select(F.col("name").alias("project"), "index_name")
    return summary.join(broadcast_if_small(names), "project", "left").select(
        "project", "index_name", "files_indexed", "chunks_indexed", "status",
        *[c for c in ("error",) if c in summary.columns])


def remove_with_chunks(current: DataFrame, removals: DataFrame, index_path: str) -> tuple[DataFrame, DataFrame]:
    """Remove registrations together with their chunks in the index table.

    Returns (remaining registry, outcome per requested name) where ``chunks_deleted`` counts the rows
    that were really dropped from the table.
    """
    from quarry.operators.index import drop_projects

    remaining, outcome = remove_projects(current, removals)
    known = outcome.where("ok").select("name")
    dropped = drop_projects(current.sparkSession, index_path, known)
    counted = dropped.select(F.col("project").alias("name"), F.col("chunks_deleted").alias("_n"))
    outcome = outcome.join(counted, "name", "left").select(
        "name", "ok", F.coalesce("_n", F.lit(0)).cast("long").alias("chunks_deleted"))
    return remaining, outcome
