"""Query terms, synonym expansion and the lexical bonus.

All of it is per-row column logic: terms are computed once per query row (not per candidate),
the synonym dictionary is a literal array, and hit counts are ``size(filter(terms, ...))`` over
the candidate's folded fields - no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import (CONTENT_HIT_CAP, CONTENT_HIT_WEIGHT, PATH_HIT_CAP, PATH_HIT_WEIGHT,
                           PHRASE_BONUS, QUERY_PREFIX_LEN, QUERY_TOKEN_PATTERN, STOP_WORDS,
                           SYMBOL_HIT_CAP, SYMBOL_HIT_WEIGHT, TERM_SYNONYMS)
from quarry.functions.text import col_, fold, strip


def synonym_table() -> Column:
    """The dictionary as ARRAY<STRUCT<key, vals ARRAY<STRING>>> (values in a fixed order)."""
    return F.array(*[
        F.struct(F.lit(key).alias("key"), F.array(*[F.lit(v) for v in sorted(vals)]).alias("vals"))
        for key, vals in TERM_SYNONYMS.items()
    ])


def query_tokens(folded) -> Column:
    """Distinct tokens of a folded query, stop words removed."""
    toks = F.array_distinct(F.regexp_extract_all(col_(folded), F.lit(QUERY_TOKEN_PATTERN), 0))
    return F.array_except(toks, F.array(*[F.lit(w) for w in STOP_WORDS]))


def synonym_terms(tokens) -> Column:
    """Keys and values of every group fired by a token (key substring of it, or it a value)."""
    fired = F.transform(col_(tokens), lambda t: F.flatten(F.transform(
        F.filter(synonym_table(), lambda s: F.contains(t, s["key"]) | F.array_contains(s["vals"], t)),
        lambda s: F.array_append(s["vals"], s["key"]))))
    return F.array_distinct(F.flatten(fired))


def query_terms_from_tokens(tokens) -> Column:
    tokens = col_(tokens)
    prefixes = F.transform(F.filter(tokens, lambda t: F.length(t) >= QUERY_PREFIX_LEN),
                           lambda t: F.substring(t, 1, QUERY_PREFIX_LEN))
    return F.array_distinct(F.concat(tokens, prefixes, synonym_terms(tokens)))


def query_terms(query) -> Column:
    """The term set of a raw query text."""
    return query_terms_from_tokens(query_tokens(fold(query)))


def with_query_terms(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Adds ``terms`` and ``folded_query`` (folded, stripped) once per query row."""
    folded = fold(query_col)
    return (queries.withColumn("_folded", folded)
            .withColumn("terms", query_terms_from_tokens(query_tokens("_folded")))
            .withColumn("folded_query", strip("_folded")).drop("_folded"))


def _hits(terms: Column, pred) -> Column:
    return F.size(F.filter(terms, pred))


def bonus_columns(terms, folded_query, fp, sym, ptok, hay) -> dict:
    """Hit counts, phrase flag and the capped bonus for one candidate row.

    ``fp``, ``sym``, ``ptok`` and ``hay`` must be plain columns already holding the folded file
    path, symbol name, path tokens and haystack (they are referenced inside lambdas).
    """
    terms, fp, sym, ptok, hay = (col_(c) for c in (terms, fp, sym, ptok, hay))
    path_hits = _hits(terms, lambda t: F.contains(fp, t) | F.contains(ptok, t))
    symbol_hits = _hits(terms, lambda t: F.contains(sym, t))
    content_hits = _hits(terms, lambda t: F.contains(hay, t))
    nq = col_(folded_query)
    phrase = (F.length(nq) > 0) & F.contains(hay, nq)
    bonus = (F.least(path_hits * F.lit(PATH_HIT_WEIGHT), F.lit(PATH_HIT_CAP))
             + F.least(symbol_hits * F.lit(SYMBOL_HIT_WEIGHT), F.lit(SYMBOL_HIT_CAP))
             + F.least(content_hits * F.lit(CONTENT_HIT_WEIGHT), F.lit(CONTENT_HIT_CAP))
             + F.when(phrase, F.lit(PHRASE_BONUS)).otherwise(F.lit(0.0)))
    bonus = F.when(F.size(terms) > 0, bonus).otherwise(F.lit(0.0))
    return {"path_hits": path_hits, "symbol_hits": symbol_hits, "content_hits": content_hits,
            "phrase": phrase, "lexical_score": bonus}


def with_lexical_bonus(cands: DataFrame, *, terms="terms", folded_query="folded_query",
                       file_path="file_path", symbol_name="symbol_name",
                       path_tokens="path_tokens", content="content",
                       detail: bool = False) -> DataFrame:
    """Adds ``lexical_score`` (and the hit counts when ``detail``) to candidate rows."""
    staged = cands.withColumns({
        "_fp": fold(F.coalesce(col_(file_path), F.lit(""))),
        "_sym": fold(F.coalesce(col_(symbol_name), F.lit(""))),
        "_ptok": fold(F.coalesce(col_(path_tokens), F.lit(""))),
        "_body": fold(F.coalesce(col_(content), F.lit(""))),
    }).withColumn("_hay", F.concat_ws("\n", "_fp", "_sym", "_ptok", "_body"))
    cols = bonus_columns(terms, folded_query, "_fp", "_sym", "_ptok", "_hay")
    keep = cols if detail else {"lexical_score": cols["lexical_score"]}
    return staged.withColumns(keep).drop("_fp", "_sym", "_ptok", "_body", "_hay")
