"""Driver queries of the dealt operators, over whole tables with production parameters.

``ORACLES`` holds DuckDB SQL where SQL can express the operator in reasonable time; the others are
tested against brute force, round trips or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_turns, probe, read_back
from .common import table
from .decontaminate import contamination
from .html_text import extract_text
from .jaccard_join import jaccard_classes
from .language_mix import language_id
from .license_scan import scan
from .line_dedup import dedup_lines
from .oracles import ORACLES  # noqa: F401
from .packing import pack
from .permutation_index import nearest
from .quality import score_quality
from .ranked_search import ranked_search
from .spelling import drop_letter, spelling_variants
from .toxicity import toxicity


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by inner product for every 20th vector (permutation index)."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page (tag-path ratios)."""
    return extract_text(table(spark, sf_dir, "pages"))


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the co-trained classifier."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of every document (Wu-Manber)."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document (Levenshtein automata and context windows)."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated (exact or fuzzy) lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingle Jaccard join of all documents (chosen paths): class and links per document."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document (mixture inference)."""
    return language_id(table(spark, sf_dir, "documents"))


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents")).drop("sequence_length")


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(probe(spark))))


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item (bit-sliced Bloom signatures)."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document (positional rare-token index)."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "matches")


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents (trie-node pairs)."""
    return spelling_variants(table(spark, sf_dir, "documents"), drop_letter)


QUERIES = {
    "op1_permutation_index_ann": q_op1,
    "op2_tag_path_ratio_extraction": q_op2,
    "op3_cotraining_quality": q_op3,
    "op4_wu_manber_decontamination": q_op4,
    "op5_levenshtein_toxicity": q_op5,
    "op6_fuzzy_line_dedup": q_op6,
    "op7_chosen_path_jaccard_join": q_op7,
    "op8_mixture_language_id": q_op8,
    "op9_dp_packing": q_op9,
    "op10_chat_grammar_round_trip": q_op10,
    "op11_bloom_ranked_search": q_op11,
    "op12_rare_token_license_scan": q_op12,
    "op13_trie_pair_spelling_variants": q_op13,
}
