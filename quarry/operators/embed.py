"""Embedding a text column into fixed-dimension vectors.

Backends:

* ``attach_vectors`` - ready vectors from a table, joined on a key (never by position), with the
  rows lacking a vector reported by an anti join;
* ``hashed_embedding`` - deterministic hashed bag of words: tokens -> bucket from the first 32 bits
  of their MD5 -> counts -> L2 normalised. Bucket ids are computed in the JVM; the per-row count
  vector is filled by numpy over whole Arrow batches;
* ``model_embedding`` / ``model_column`` - any user function ``list[str] -> 2-D array`` run as an iterator
  Arrow UDF: the model is loaded once per task and fed batches of a fixed size; failures can stay with
  their rows.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import col_
from quarry.session import materialise

TOKEN_PATTERN = "[a-z0-9]+"


def bucket_ids(text, dim: int) -> Column:
    """ARRAY<INT> of the hash bucket of every token of the lower-cased text."""
    toks = F.regexp_extract_all(F.lower(col_(text)), F.lit(TOKEN_PATTERN), 0)
    return F.transform(toks, lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


def _count_vectors(dim: int, normalize: bool, precision: str = "float"):
    out_type = np.float32 if precision == "float" else np.float64
    spark_type = T.FloatType() if precision == "float" else T.DoubleType()

    @F.pandas_udf(T.ArrayType(spark_type))
    def vectors(ids: pd.Series) -> pd.Series:
        lengths = ids.map(len).to_numpy()
        out = np.zeros((len(ids), dim), dtype=np.float64)
        if lengths.sum():
            rows = np.repeat(np.arange(len(ids)), lengths)
            flat = np.concatenate([np.asarray(v, dtype=np.int64) for v in ids if len(v)])
            np.add.at(out, (rows, flat), 1.0)
        if normalize:
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
        return pd.Series(list(out.astype(out_type)))

    return vectors


def hashed_embedding(text, dim: int = 512, normalize: bool = True,
                     precision: str = "float") -> Column:
    """Dense hashed bag-of-words vector (FLOAT by default, DOUBLE with ``precision='double'``)."""
    return _count_vectors(dim, normalize, precision)(bucket_ids(text, dim))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, on) -> tuple[DataFrame, DataFrame]:
    """(chunks with ``embedding``, chunks that have no vector)."""
    on = [on] if isinstance(on, str) else list(on)
    # one join for both results, written once: each side is read and shuffled once
    paired = materialise(chunks.join(vectors.withColumn("_found", F.lit(True)), on, "left"), "paired")
    missing = paired.where("_found is null").select(*chunks.columns)
    return paired.where("_found").drop("_found"), missing


#: Texts given to a model at once.
MODEL_BATCH = 64


def _vectors(model: Callable, texts: list[str], dim: int | None) -> np.ndarray:
    """The model's vectors, checked: one row per text, of the dimension that was asked for."""
    found = np.asarray(model(texts), dtype=np.float32)
    if found.ndim != 2 or found.shape[0] != len(texts):
        raise ValueError(f"model gave shape {found.shape} for {len(texts)} texts")
    if dim is not None and found.shape[1] != dim:
        raise ValueError(f"model gave {found.shape[1]} dimensions instead of {dim}")
    return found


def _embed_batch(model: Callable, texts: list[str], dim: int | None) -> tuple[list, list]:
    """(vectors, errors): where the model fails for a batch, each text is tried alone."""
    try:
        return list(_vectors(model, texts, dim)), [None] * len(texts)
    except Exception as failure:  # whatever a user's model raises is data here
        if len(texts) == 1:
            return [None], [f"{type(failure).__name__}: {failure}"]
    parts = [_embed_batch(model, [t], dim) for t in texts]
    return [v for p, _ in parts for v in p], [e for _, p in parts for e in p]


def model_column(model_factory: Callable[[], Callable], batch_size: int = MODEL_BATCH, dim: int | None = None,
                 errors: bool = False) -> Callable[[Column], Column]:
    """User model backend: a function from a text Column to a vector Column.

    ``model_factory()`` runs once per task and returns a callable from a list of texts to an (n, dim)
    array. It gets texts in their order, ``batch_size`` at a time whatever the Arrow batches are; NULL
    texts have NULL vectors and never reach it. A wrong number or dimension of vectors is an error.

    With ``errors`` the column is ``struct<vector, error>``: a text that the model fails for has no vector
    but a message, and the other texts of its batch keep theirs.
    """
    kind = T.ArrayType(T.FloatType())
    if errors:
        kind = T.StructType([T.StructField("vector", kind), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for texts in batches:
            given = np.flatnonzero(texts.notna().to_numpy())
            out, why = np.full(len(texts), None, object), np.full(len(texts), None, object)
            for lo in range(0, len(given), batch_size):
                at = given[lo:lo + batch_size]
                part = texts.iloc[at].tolist()
                found, failed = _embed_batch(model, part, dim) if errors else (_vectors(model, part, dim), [None] * len(at))
                for i, vector, error in zip(at, found, failed):
                    out[i], why[i] = vector, error
            yield pd.DataFrame({"vector": out, "error": why}) if errors else pd.Series(out)

    return embed


def model_embedding(df: DataFrame, text_col: str, model_factory: Callable[[], Callable], out_col: str = "embedding",
                    batch_size: int = MODEL_BATCH, dim: int | None = None) -> DataFrame:
    """``df`` with the vectors of a user model for ``text_col`` (see ``model_column``)."""
    from quarry.session import ship_package

    ship_package(df.sparkSession)
    return df.withColumn(out_col, model_column(model_factory, batch_size, dim)(F.col(text_col)))


def embed_unique_texts(df: DataFrame, text_col: str, embed, out_col: str = "embedding",
                       max_broadcast_bytes: int = 256 * 1024 * 1024, dim_hint: int = 512) -> DataFrame:
    """Embed each distinct text once and join the vectors back (the query-embedding cache, as a
    set operation).

    Texts are keyed by their white-space-compacted form; one representative per key (the least
    raw text, so the choice is reproducible) is embedded. The key table is built with a partial
    aggregate, so a text repeated millions of times costs one row per task before the shuffle;
    vectors are broadcast back when ``keys x dim_hint x 8`` bytes fit ``max_broadcast_bytes``,
    else joined by key.
    """
    from quarry.functions.text import query_cache_key

    keyed = df.withColumn("_qkey", query_cache_key(text_col))
    reps = keyed.groupBy("_qkey").agg(F.min(text_col).alias("_rep"))
    vectors = reps.select("_qkey", embed(F.col("_rep")).alias(out_col))
    n_keys = reps.count()
    if n_keys * dim_hint * 8 <= max_broadcast_bytes:
        vectors = F.broadcast(vectors)
    return keyed.join(vectors, "_qkey", "left").drop("_qkey")


def read_cache(spark, path: str, dim_type=None) -> DataFrame:
    """(key, vector) of the embedding cache under ``path``, one row per key; empty before the first run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], T.StructType([
            T.StructField("key", T.StringType()), T.StructField("vector", dim_type or T.ArrayType(T.FloatType()))]))
    # two runs at once may both have added a key: either vector will do, the least one is reproducible
    return spark.read.parquet(path).groupBy("key").agg(F.min("vector").alias("vector"))


def embed_cached(df: DataFrame, text_col: str, embed, path: str, out_col: str = "embedding",
                 max_broadcast_bytes: int = 256 * 1024 * 1024) -> tuple[DataFrame, int]:
    """``df`` with vectors from a cache that lasts across runs, and the number of texts embedded now.

    Texts are keyed by their white-space-compacted form. Distinct keys are found with a partial aggregate;
    an anti join with the cache leaves the misses, which alone are embedded (the least raw text of each
    key) and appended to the cache in one committed write: a run that fails adds nothing or whole rows.
    The cache must hold vectors of one model only: give each model a path of its own. Texts whose
    embedding is NULL are not kept. The vectors that this table asks for go back by broadcast while their
    real size allows, else by a join on the key.
    """
    from quarry.functions.text import query_cache_key
    from quarry.session import ship_package

    spark = df.sparkSession
    ship_package(spark)
    keyed = df.withColumn("_key", query_cache_key(text_col))
    asked = materialise(keyed.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.min(text_col).alias("_text")), "asked")
    vector = embed(F.col("_text"))
    kind = asked.select(vector.alias("vector")).schema["vector"].dataType
    misses = asked.join(read_cache(spark, path, kind).select("key"), "key", "left_anti")
    # filtered after it is written: a filter on the vector would have the model run twice
    fresh = materialise(misses.select("key", vector.alias("vector")), "fresh").where("vector is not null")
    added = fresh.count()
    if added:
        fresh.write.mode("append").parquet(path)
    wanted = materialise(read_cache(spark, path, kind).join(asked.select("key"), "key", "left_semi"), "vectors")
    size = wanted.agg(F.coalesce(F.sum(F.size("vector") * 8 + F.octet_length("key")), F.lit(0)).alias("n")).first().n
    wanted = wanted.select(F.col("key").alias("_key"), F.col("vector").alias(out_col))
    return keyed.join(F.broadcast(wanted) if size <= max_broadcast_bytes else wanted, "_key", "left").drop("_key"), added
