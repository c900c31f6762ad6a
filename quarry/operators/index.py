"""The index table: one Parquet dataset partitioned by ``project``.

Refreshing a project rewrites only its partition (dynamic partition overwrite), so other projects
stay readable throughout and the job commit makes the switch atomic per partition. Reads prune to
the requested projects. ``project`` is always a STRING, whatever the names look like (``007`` and ``7`` are
two projects).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import chunk_key
from quarry.session import materialise

INDEX_COLUMNS = ["project", "file_path", "chunk_index", "chunk_key", "language", "content",
                 "path_tokens", "symbol_name", "symbol_type", "start_line", "end_line",
                 "embedding"]


def to_index_rows(chunks_with_vectors: DataFrame, *more: str) -> DataFrame:
    df = chunks_with_vectors.withColumn("chunk_key", chunk_key("file_path", "chunk_index"))
    return df.select(*INDEX_COLUMNS, *more)


# Upper bound of rows per written file (a chunk row with a 512-float vector is a few KB).
INDEX_ROWS_PER_FILE = 200_000


#: Row groups and pages small enough to skip most of a file; Bloom filters on the key that is looked up.
INDEX_FILE_OPTIONS = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10),
                      "parquet.page.row.count.limit": "100",
                      "parquet.bloom.filter.enabled#chunk_key": "true",
                      "parquet.bloom.filter.expected.ndv#chunk_key": "20000"}

#: Most keys that are looked up one by one; for more, a scan of the projects reads hardly more.
FETCH_KEYS = 2000


def refresh_projects(index_rows: DataFrame, path: str,
                     rows_per_file: int = INDEX_ROWS_PER_FILE) -> None:
    """Full refresh of every project present in ``index_rows``; other projects are untouched.

    Rows are rebalanced by project: small projects share a task (so a project is a few files, not
    one per input task) and AQE splits a project that is too large for one. Files are capped at
    ``rows_per_file`` rows, and dynamic partition overwrite swaps exactly the projects present in
    the input. Files are sorted by ``chunk_key`` in small pages with a Bloom filter per row group, so
    ``fetch_keys`` reads little more than the rows it wants.
    """
    rows = to_index_rows(index_rows) if "chunk_key" not in index_rows.columns else index_rows
    rows = rows.withColumn("project", F.col("project").cast("string"))
    (rows.hint("rebalance", "project").sortWithinPartitions("project", "chunk_key").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").options(**INDEX_FILE_OPTIONS)
     .option("maxRecordsPerFile", rows_per_file)
     .partitionBy("project")
     .parquet(path))


def partition_path(spark: SparkSession, path: str, project: str) -> str:
    """The folder of one project, with the name escaped the way partition writers do."""
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"{path.rstrip('/')}/{utils.getPartitionPathString('project', project)}"


def drop_projects(spark: SparkSession, path: str, projects: DataFrame) -> DataFrame:
    """Remove the partitions of ``projects(name)``; returns ``(project, chunks_deleted)``.

    Dynamic overwrite cannot delete a partition, so the listed partitions are removed with the
    Hadoop file system API (one call per project, streamed to the driver, no data read beyond the
    counts). A folder that is still there afterwards is an error, never a reported success.
    """
    current = read_index(spark, path)
    gone = materialise(current.join(projects.select(F.col("name").alias("project")).distinct(), "project",
                                    "left_semi")
                       .groupBy("project").agg(F.count(F.lit(1)).alias("chunks_deleted")), "dropped")
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in gone.select("project").toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(partition_path(spark, path, row["project"]))
        fs = p.getFileSystem(hconf)
        if not fs.delete(p, True) or fs.exists(p):
            raise OSError(f"partition of project {row['project']!r} was not deleted: {p.toString()}")
    spark.catalog.refreshByPath(path)
    return gone


def with_defaults(entries: DataFrame) -> DataFrame:
    """Complete stored entries: texts default to empty, numbers to 0, the language to ``text``, and empty
    symbols are NULL. Columns that a table lacks stay absent; filters on ``project`` still prune."""
    rules = {
        "file_path": lambda c: F.coalesce(c, F.lit("")),
        "content": lambda c: F.coalesce(c, F.lit("")),
        "path_tokens": lambda c: F.coalesce(c, F.lit("")),
        "language": lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("text")),
        "symbol_name": lambda c: F.nullif(c, F.lit("")),
        "symbol_type": lambda c: F.nullif(c, F.lit("")),
        "chunk_index": lambda c: F.coalesce(c, F.lit(0)),
        "start_line": lambda c: F.coalesce(c, F.lit(0)),
        "end_line": lambda c: F.coalesce(c, F.lit(0)),
    }
    return entries.withColumns({n: rule(F.col(n)) for n, rule in rules.items() if n in entries.columns})


def read_index(spark: SparkSession, path: str, projects: list[str] | None = None) -> DataFrame:
    """The index table; partition names are never read as numbers or dates.

    Entries are completed by ``with_defaults``.
    """
    found = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    schema = T.StructType([f for f in found if f.name != "project"] + [T.StructField("project", T.StringType())])
    df = with_defaults(spark.read.schema(schema).parquet(path))
    if projects is not None:
        df = df.where(F.col("project").isin(projects))
    return df


def fetch_keys(index: DataFrame, keys: DataFrame, columns: list[str], most: int = FETCH_KEYS) -> DataFrame | None:
    """The index rows of ``keys(project, chunk_key)``, or None when there are more than ``most`` keys.

    The keys become a Parquet filter: folders go by project, row groups by Bloom filter and key range,
    pages by the column index. The rows, at most ``most``, are written once.
    """
    wanted = keys.select("project", "chunk_key").distinct().limit(most + 1).collect()
    if len(wanted) > most:
        return None
    found = index.where(F.col("project").isin(sorted({r.project for r in wanted}))
                        & _any_of("chunk_key", sorted({r.chunk_key for r in wanted})))
    return materialise(found.select(*columns), "fetched")


def _any_of(column: str, values: list[str], listed: int = 10):
    """``column`` is one of ``values``, as a balanced tree of short lists.

    The Parquet reader tests the values of a list of up to ten one by one, of a longer one only their range.
    """
    if len(values) <= listed:
        return F.col(column).isin(values)
    half = len(values) // 2
    return _any_of(column, values[:half], listed) | _any_of(column, values[half:], listed)


def index_summary(chunks: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Per project: files and chunks indexed; with a registry, projects without chunks appear with
    status ``no_chunks``."""
    per_project = chunks.groupBy("project").agg(
        F.countDistinct("file_path").alias("files_indexed"),
        F.count(F.lit(1)).alias("chunks_indexed"))
    if registry is None:
        return per_project.withColumn("status", F.lit("ok"))
    names = registry.select(F.col("name").alias("project"))
    return (names.join(per_project, "project", "left")
            .select("project",
                    F.coalesce("files_indexed", F.lit(0)).alias("files_indexed"),
                    F.coalesce("chunks_indexed", F.lit(0)).alias("chunks_indexed"),
                    F.when(F.col("chunks_indexed") > 0, F.lit("ok"))
                    .otherwise(F.lit("no_chunks")).alias("status")))


def index_projects(files: DataFrame, path: str, embed, registry: DataFrame | None = None,
                   now=None, settings=None, decoded: bool = False, signatures: str | None = None, lsh=None):
    """Index projects end to end: chunks -> search text -> vectors -> refresh -> summary -> stamp.

    ``files(project, file_path, content)`` holds every file of the projects to (re)index (bytes,
    or text with ``decoded=True``); ``embed`` maps a text Column to a vector Column (e.g.
    ``lambda c: hashed_embedding(c)``) or to ``struct<vector, error>`` (``model_column(..., errors=True)``).
    Only projects present in ``files`` are rewritten.
    With a ``registry``, files of unregistered projects are left out, registered projects
    without chunks are reported as ``no_chunks``, and the stamped registry is returned. The summary
    counts the rows of this run only: a project whose files now give no chunks is ``no_chunks``, keeps
    its old rows and is not stamped. So is a project with a text that could not be embedded: it is
    ``failed`` with the first error in its files, and the other projects are indexed.

    With ``signatures`` (a path) and ``lsh`` (``LshParams``) the stored approximate index of the same
    projects is renewed with their rows.

    Returns ``(summary, registry_after)``; ``registry_after`` is None without a registry.
    """
    from quarry.config import DEFAULT_SETTINGS
    from quarry.operators import registry as rg
    from quarry.operators.structure import build_chunks, structured_chunks, with_search_text

    settings = settings or DEFAULT_SETTINGS
    if registry is not None:
        names = rg.broadcast_if_small(registry.select(F.col("name").alias("project")))
        files = files.join(names, "project", "left_semi")
    chunks = (with_search_text(structured_chunks(files, settings)) if decoded
              else build_chunks(files, settings))
    embedded = chunks.withColumn("embedding", embed(F.col("search_text")))
    error = F.lit(None).cast("string")
    if isinstance(embedded.schema["embedding"].dataType, T.StructType):
        embedded = embedded.withColumn("_error", F.col("embedding.error")).withColumn("embedding", F.col("embedding.vector"))
        error = F.col("_error")
    # computed once: the table is written from these rows and the summary counts them
    every = materialise(to_index_rows(embedded.withColumn("_error", error), "_error"), "index_rows")
    failed = materialise(every.where("_error is not null").groupBy("project").agg(
        F.min_by("_error", F.struct("file_path", "chunk_index")).alias("error")), "failed")
    rows = every.drop("_error").join(rg.broadcast_if_small(failed), "project", "left_anti")
    refresh_projects(rows, path)
    if signatures is not None:
        from quarry.operators.lsh_index import write_signatures

        write_signatures(rows, signatures, lsh, id_cols=["file_path", "chunk_index"], group_col="project")
    summary = index_summary(rows, registry)
    if registry is None:
        empty = files.select("project").distinct().join(summary, "project", "left_anti")
        summary = summary.unionByName(empty.select(
            "project", F.lit(0).cast("long").alias("files_indexed"),
            F.lit(0).cast("long").alias("chunks_indexed"), F.lit("no_chunks").alias("status")))
    summary = summary.join(rg.broadcast_if_small(failed), "project", "left").withColumn(
        "status", F.when(F.col("error").isNotNull(), F.lit("failed")).otherwise(F.col("status")))
    if registry is None:
        return summary, None
    stamped = rg.stamp_indexed(registry, summary.where(F.col("chunks_indexed") > 0), now=now)
    return summary, stamped


def index_totals(summary: DataFrame) -> DataFrame:
    """One row over an index run: projects, those with chunks, those that failed, files and chunks."""
    return summary.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(F.col("status") == "ok").alias("projects_indexed"),
        F.count_if(F.col("status") == "failed").alias("projects_failed"),
        F.coalesce(F.sum("files_indexed"), F.lit(0)).cast("long").alias("files_indexed"),
        F.coalesce(F.sum("chunks_indexed"), F.lit(0)).cast("long").alias("chunks_indexed"))


# "Insert" replaces a project's chunks (same operator); there is deliberately no append.
insert_chunks = refresh_projects
