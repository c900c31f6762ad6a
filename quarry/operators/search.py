"""Search a table of queries against the index in one distributed plan.

Per query: candidate budget ``min(max(limit * multiplier, limit), 100)``, nearest neighbours inside
the query's project (exact by default, LSH with ``Settings(retrieval="lsh")``), semantic score from
the distance, lexical bonus, re-rank
(score desc, then distance, then chunk key), threshold with fallback, per-query limit. Every
per-query group after retrieval holds at most 100 candidates, so the windows here are bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT_SETTINGS, Settings
from quarry.functions import text as tx
from quarry.operators.index import fetch_keys
from quarry.session import materialise
from quarry.operators.knn import knn_exact_counted
from quarry.operators.lexical import with_lexical_bonus, with_query_terms

INDEX_KEY = ["project", "file_path", "chunk_index"]
RESULT_COLUMNS = ["query_id", "rank", "project", "file_path", "chunk_index", "language",
                  "symbol_name", "symbol_type", "start_line", "end_line", "content", "distance",
                  "semantic_score", "lexical_score", "score"]


def semantic_score(distance, metric: str = "cosine") -> Column:
    d = tx.col_(distance)
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - d))
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(d, F.lit(0.0)))


def candidate_budget(limit, multiplier: int, most: int = DEFAULT_SETTINGS.max_candidates) -> Column:
    """Candidates to fetch for a limit: ``multiplier`` times as many, at most ``most``."""
    lim = tx.col_(limit)
    return F.least(F.greatest(lim * F.lit(multiplier), lim), F.lit(most))


def prepare_queries(queries: DataFrame, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Effective limit / min score, candidate budget, terms; rejects ``limit <= 0``."""
    cols = set(queries.columns)
    limit = F.col("limit") if "limit" in cols else F.lit(None)
    min_score = F.col("min_score") if "min_score" in cols else F.lit(None)
    eff_limit = F.coalesce(limit.cast("int"), F.lit(settings.default_query_limit))
    eff_limit = F.when(eff_limit > 0, eff_limit).otherwise(
        F.raise_error(F.lit("query limit must be positive")).cast("int"))
    out = queries.withColumns({
        "eff_limit": eff_limit,
        "eff_min_score": F.coalesce(min_score.cast("double"), F.lit(settings.query_min_score)),
    }).withColumn("k", candidate_budget("eff_limit", settings.query_candidate_multiplier,
                                      settings.max_candidates))
    return with_query_terms(out, "query")


def retrieve_counted(index: DataFrame, queries: DataFrame, settings: Settings = DEFAULT_SETTINGS,
                     signatures=None) -> tuple[DataFrame, int]:
    """Top-k candidates per query (k from the ``k`` column) inside the query's project, and the
    number of queries."""
    if settings.retrieval == "lsh":
        return _retrieve_lsh(index, queries, settings, signatures)
    return knn_exact_counted(index, queries, "k", id_cols=["file_path", "chunk_index"],
                             group_col="project", metric=settings.distance_metric,
                             settings=settings)


def _retrieve_lsh(index: DataFrame, queries: DataFrame, settings: Settings,
                  signatures=None) -> tuple[DataFrame, int]:
    """Approximate candidates by stored signatures; without any, the index is signed for this search."""
    from quarry.operators import lsh_index as li

    ids = ["file_path", "chunk_index"]
    if signatures is None:
        params = li.LshParams(li.vector_dimension(index), settings.lsh_bands, settings.lsh_bits)
        rows = li.signature_rows(index, params, id_cols=ids, group_col="project")
        signatures = li.Signatures(materialise(rows, "signatures"), params)
    return li.knn_stored(index, signatures, queries, "k", id_cols=ids, group_col="project",
                         metric=settings.distance_metric, flips=settings.lsh_flips, settings=settings)


CANDIDATE_ROW_BYTES = 256  # key columns of one candidate row, generous


# Beyond this many broadcast blocks of candidate keys, one shuffle join replaces repeated scans.
MAX_METADATA_BLOCKS = 8


def attach_metadata(index: DataFrame, hits: DataFrame, n_queries: int,
                    settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Join candidate keys to their index rows without shuffling the index.

    Candidates number at most ``queries x 100``. While that bound times the key size stays under
    ``knn_broadcast_max_bytes`` the candidate keys are broadcast and the index is only scanned
    (pruned to the queried projects). Larger candidate sets are split by a hash of the query id
    into blocks that each fit, one broadcast join (and pruned scan) per block; only beyond
    ``MAX_METADATA_BLOCKS`` blocks does a single shuffle join take over. ``n_queries`` is counted
    on the (small) query table, never on ``hits``, which would re-run the retrieval.

    An index with stored keys (``chunk_key``) is not scanned again for a few candidates: their rows are
    looked up through the files' indexes (``fetch_keys``).
    """
    columns = [*INDEX_KEY, "language", "content", "path_tokens", "symbol_name", "symbol_type", "start_line", "end_line"]
    meta = index.select(*columns)
    keys = hits.select("query_id", *INDEX_KEY, "distance")
    if "chunk_key" in index.columns:
        keys = materialise(keys, "candidates")  # read three times: the keys, their number, the join
        near = fetch_keys(index, keys.withColumn("chunk_key", tx.chunk_key("file_path", "chunk_index")), columns)
        if near is not None:
            meta = near  # a key of one project may be an unwanted key of another: the join decides
    bound = n_queries * settings.max_candidates * CANDIDATE_ROW_BYTES
    blocks = max(1, math.ceil(bound / settings.knn_broadcast_max_bytes))
    if blocks == 1:
        return meta.join(F.broadcast(keys), INDEX_KEY)
    if blocks > MAX_METADATA_BLOCKS:
        return meta.join(keys, INDEX_KEY)
    parts = [meta.join(F.broadcast(keys.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)),
                       INDEX_KEY)
             for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rank_candidates(cands: DataFrame, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Scores, rank, threshold decision per query (all candidates kept, flagged)."""
    scored = cands.withColumn("semantic_score", semantic_score("distance", settings.distance_metric))
    scored = with_lexical_bonus(scored)
    scored = scored.withColumn("score", F.col("semantic_score") + F.col("lexical_score"))
    by_query = Window.partitionBy("query_id")
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.col("distance").asc(), F.col("file_path"), F.col("chunk_index"))
    fb = F.least(F.lit(settings.query_fallback_min_score), F.col("eff_min_score"))
    return (scored
            .withColumn("rank", F.row_number().over(order))
            .withColumn("best_score", F.max("score").over(by_query))
            .withColumn("passes", F.col("best_score") >= F.col("eff_min_score"))
            .withColumn("threshold", F.when(F.col("passes"), F.col("eff_min_score")).otherwise(fb)))


def search(index: DataFrame, queries: DataFrame, settings: Settings = DEFAULT_SETTINGS,
           registry: DataFrame | None = None, embed=None, signatures=None) -> tuple[DataFrame, DataFrame]:
    """Answer every row of ``queries``.

    ``index``: ``project, file_path, chunk_index, language, content, path_tokens, symbol_name,
    symbol_type, start_line, end_line, embedding``.
    ``queries``: ``query_id, project, query, embedding`` and optional ``limit``, ``min_score``.
    ``registry`` (optional): table with a ``name`` column; queries for other projects get status
    ``not_registered`` and no results.

    ``embed`` (a function from a text Column to a vector Column) embeds queries that come without
    an ``embedding`` column; equal texts (up to white space) are embedded once.

    ``signatures`` (see ``lsh_index``): the stored table that ``Settings(retrieval="lsh")`` looks
    candidates up in; without it the index is signed for this one search.

    The search runs once, when this function is called; both returned tables read its written result.
    Repeated query ids are an error.

    Returns ``(results, summary)``.
    """
    if "embedding" not in queries.columns:
        if embed is None:
            raise ValueError("queries need an embedding column or an embed function")
        from quarry.operators.embed import embed_unique_texts

        queries = embed_unique_texts(queries, "query", embed,
                                     max_broadcast_bytes=settings.knn_broadcast_max_bytes,
                                     dim_hint=settings.embedding_dimensions)
    # evaluated once: the kernel, the candidate join and the summary all read this table
    prepared = materialise(prepare_queries(queries, settings), "queries")
    twice = prepared.groupBy("query_id").count().where("count > 1").select("query_id").limit(3).collect()
    if twice:
        raise ValueError(f"query_id must be unique; repeated: {[r.query_id for r in twice]}")
    if registry is not None:
        from quarry.operators.registry import broadcast_if_small

        known = broadcast_if_small(registry.select(F.col("name").alias("project")).distinct()
                                   .withColumn("registered", F.lit(True)))
        prepared = prepared.join(known, "project", "left") \
            .withColumn("registered", F.coalesce("registered", F.lit(False)))
    else:
        prepared = prepared.withColumn("registered", F.lit(True))
    active = prepared.where("registered")
    hits, n_queries = retrieve_counted(index, active, settings, signatures)
    qinfo = active.select("query_id", "project", "eff_limit", "eff_min_score", "terms",
                          "folded_query")
    cands = attach_metadata(index, hits.join(qinfo.select("query_id", "project"), "query_id"),
                            n_queries, settings).join(qinfo.drop("project"), "query_id")
    ranked = rank_candidates(cands, settings)
    # Rows at or above the threshold are a prefix of the score order, so the rank stands.
    results = ranked.where((F.col("score") >= F.col("threshold"))
                           & (F.col("rank") <= F.col("eff_limit")))
    results = results.withColumn("used_fallback", ~F.col("passes")) \
        .withColumn("applied_min_score", F.col("threshold"))
    # one run of the search: results and summary read what it wrote
    results = materialise(results.select(*RESULT_COLUMNS, "used_fallback", "applied_min_score"), "results")
    per_query = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.max("used_fallback").alias("used_fallback"),
        F.max("applied_min_score").alias("applied_min_score"))
    summary = (prepared.select("query_id", "project", "registered", "eff_min_score")
               .join(per_query, "query_id", "left")
               .select(
                   "query_id",
                   F.when(F.col("registered"), F.lit("ok")).otherwise(F.lit("not_registered"))
                   .alias("status"),
                   F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                   F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"),
                   F.coalesce("applied_min_score", F.col("eff_min_score")).alias("applied_min_score"),
               ))
    return results.select(*RESULT_COLUMNS), summary


def compact_results(results: DataFrame, settings: Settings = DEFAULT_SETTINGS,
                    queries: DataFrame | None = None) -> DataFrame:
    """Presentation form: scores rounded to 4 places, snippet instead of content, empty optional
    fields as NULL; with ``queries(query_id, query)`` also the text that was asked."""
    def opt_str(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    def opt_int(c: str) -> Column:
        return F.when(F.col(c) != 0, F.col(c))

    asked = []
    if queries is not None:
        results = results.join(queries.select("query_id", "query"), "query_id")
        asked = ["query"]
    return results.select(
        "query_id", *asked, "project", "rank", "file_path",
        F.round("score", 4).alias("score"),
        tx.snippet("content", settings.snippet_chars).alias("snippet"),
        opt_str("symbol_name").alias("symbol_name"),
        opt_str("symbol_type").alias("symbol_type"),
        opt_str("language").alias("language"),
        opt_int("start_line").alias("start_line"),
        opt_int("end_line").alias("end_line"),
        F.round("semantic_score", 4).alias("semantic_score"),
        F.round("lexical_score", 4).alias("lexical_score"),
    )
