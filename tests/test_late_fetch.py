"""Late fetch: candidates come out of the sorted index files without a second scan."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators.search import search


def bytes_read(spark):
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(stats.get(i).getBytesRead() for i in range(stats.size()))


@pytest.fixture(scope="module", autouse=True)
def counted_reads(spark):
    """Vectored reads of local files pass by the file system's byte counter."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.hadoop.vectored.io.enabled", "false")
    yield
    conf.set("parquet.hadoop.vectored.io.enabled", "true")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """An index of 60,000 chunks of two projects, 60 MB of text, in its production layout."""
    path = str(tmp_path_factory.mktemp("late") / "index")
    n = F.col("id")
    rows = spark.range(60_000).select(
        F.when(n % 3 == 0, "small").otherwise("large").alias("project"), F.format_string("src/%s.py", F.md5(n.cast("string"))).alias("file_path"),
        F.lit(0).alias("chunk_index"), F.lit("py").alias("language"),
        F.concat(*[F.md5(F.concat(n.cast("string"), F.lit(str(i)))) for i in range(30)]).alias("content"),
        F.lit("src py").alias("path_tokens"), F.lit(None).cast("string").alias("symbol_name"),
        F.lit(None).cast("string").alias("symbol_type"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"),
        F.array(*[(F.pmod(F.xxhash64(n, F.lit(i)), F.lit(1000)) / 1000.0 - 0.5).cast("float") for i in range(8)]).alias("embedding"))
    ix.refresh_projects(rows, path)
    return path


def keys(spark, ids):
    n = F.col("id")
    return spark.createDataFrame([(i,) for i in ids], "id long").select(
        F.when(n % 3 == 0, "small").otherwise("large").alias("project"),
        F.concat(F.lit("src/"), F.md5(n.cast("string")), F.lit(".py#0")).alias("chunk_key"))


def test_files_are_sorted_by_key(spark, stored):
    import glob

    import pyarrow.parquet as pq

    for path in glob.glob(f"{stored}/project=*/*.parquet"):
        column = pq.read_table(path, columns=["chunk_key"]).column(0).to_pylist()
        assert column == sorted(column)


@pytest.mark.parametrize("count", [3, 50, 100])
def test_fetch_reads_a_fraction_of_the_bytes(spark, stored, count):
    index = ix.read_index(spark, stored)
    columns = ["project", "file_path", "content", "start_line"]
    before = bytes_read(spark)
    index.select(*columns).write.format("noop").mode("overwrite").save()
    whole = bytes_read(spark) - before
    wanted = keys(spark, range(0, 60_000, 60_000 // count))
    before = bytes_read(spark)
    got = ix.fetch_keys(index, wanted, columns)
    part = bytes_read(spark) - before
    assert got.count() == wanted.count()
    assert {r.file_path + "#0" for r in got.collect()} == {r.chunk_key for r in wanted.collect()}
    assert part < whole * (0.05 if count == 3 else 0.2 if count == 50 else 0.4), (part, whole)


def test_many_keys_are_refused(spark, stored):
    index = ix.read_index(spark, stored)
    assert ix.fetch_keys(index, keys(spark, range(20)), ["content"], most=19) is None
    assert ix.fetch_keys(index, keys(spark, range(20)), ["content"], most=20).count() == 20
    assert ix.fetch_keys(index, keys(spark, range(ix.FETCH_KEYS)), ["file_path"]).count() == ix.FETCH_KEYS
    assert ix.fetch_keys(index, keys(spark, []), ["content"]).count() == 0


def test_search_of_a_stored_index_equals_that_of_its_rows(spark, stored):
    index = ix.read_index(spark, stored).where("file_path < 'src/08'")
    queries = index.orderBy("file_path").limit(12).select(
        F.monotonically_increasing_id().alias("query_id"), "project", F.lit("src").alias("query"), "embedding")
    late, _ = search(index, queries)
    plain, _ = search(index.drop("chunk_key"), queries)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(late) == rows(plain) and late.count() == 60
