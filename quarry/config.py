"""Settings and fixed vocabularies.

Operators never read the environment: they take a ``Settings`` value (defaults below) so a job is
fully described by its arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------------------------
# Fixed values. These must stay equal to the behaviour being reproduced (file selection, chunk
# cut points, query tokenisation and synonym expansion); they are data, not tuning knobs.
# ---------------------------------------------------------------------------------------------

# File extensions that are indexed (compared lower-cased, with the dot).
SUPPORTED_EXTENSIONS = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".go", ".rs", ".rb", ".php", ".cs",
    ".cpp", ".c", ".h", ".hpp", ".m", ".mm", ".swift", ".scala", ".lua", ".sh", ".zsh", ".bash",
    ".sql", ".html", ".css", ".scss", ".json", ".yaml", ".yml", ".toml", ".md", ".txt", ".xml",
)

# Directory names that are never entered (any path component equal to one of them is skipped).
IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", ".venv", "venv", "__pycache__",
    "dist", "build", ".next", ".turbo", ".cache", "coverage", ".pytest_cache",
)

# Preferred cut points inside a chunk window (the last one found wins).
CHUNK_SPLIT_HINTS = (
    "\nclass ", "\ndef ", "\nasync def ", "\nfunction ", "\nexport ", "\nconst ", "\nlet ",
    "\nvar ", "\n\n",
)

# Query words that never become search terms.
STOP_WORDS = (
    "a", "as", "o", "os", "de", "da", "das", "do", "dos", "e", "em", "na", "nas", "no", "nos",
    "para", "por", "com", "sem", "como", "eu", "me", "se", "the", "an", "and", "or", "to", "of",
    "in", "on", "for", "where", "what", "how", "does", "work",
)

# Synonym groups: a token fires a group when the key is a substring of it or it is one of the
# values; a fired group adds its key and all its values to the query terms.
TERM_SYNONYMS = {
    "auth": (
        "auth", "authenticate", "authentication", "authorization", "login", "token", "credential",
        "credentials", "session", "identity", "oauth", "jwt", "signin", "signup", "user",
    ),
    "autent": (
        "autenticacao", "autenticar", "autenticado", "autenticada", "auth", "authenticate",
        "authentication", "authorization", "login", "token", "credencial", "credenciais",
        "sessao", "usuario",
    ),
    "login": (
        "login", "signin", "auth", "authenticate", "authentication", "session", "token", "user",
    ),
    "token": ("token", "jwt", "bearer", "auth", "authentication", "credential", "secret"),
    "senha": ("senha", "password", "secret", "credential", "credentials", "auth"),
    "usuario": ("usuario", "user", "account", "identity", "member", "auth"),
    "permiss": (
        "permission", "permissions", "role", "roles", "access", "authorization", "policy",
    ),
}

# Scoring constants of the lexical bonus: (weight per hit, cap) for path, symbol and content
# hits, and the bonus for the whole folded query appearing in the haystack.
PATH_HIT_WEIGHT, PATH_HIT_CAP = 0.08, 0.24
SYMBOL_HIT_WEIGHT, SYMBOL_HIT_CAP = 0.12, 0.36
CONTENT_HIT_WEIGHT, CONTENT_HIT_CAP = 0.025, 0.25
PHRASE_BONUS = 0.2

# Query tokens: folded text, runs of at least three of these characters.
QUERY_TOKEN_PATTERN = "[a-z0-9_]{3,}"
# Length of the prefix term added for long tokens.
QUERY_PREFIX_LEN = 5

# A hint must sit strictly after this offset inside the window to be used as a cut.
MIN_SPLIT_OFFSET = 200


@dataclass(frozen=True)
class Settings:
    """Operator parameters with their defaults."""

    chunk_max_chars: int = 1600
    chunk_overlap: int = 200
    default_query_limit: int = 5
    query_min_score: float = 0.10
    query_fallback_min_score: float = 0.03
    query_candidate_multiplier: int = 2
    # Most candidates fetched per query; a limit above it returns at most this many results.
    max_candidates: int = 100
    embedding_dimensions: int = 512
    embedding_normalize: bool = True
    distance_metric: str = "cosine"
    index_prefix: str = "quarry"
    snippet_chars: int = 400
    preview_chars: int = 2000
    # Upper bound for the query block shipped to every task by the exact kNN operator.
    knn_broadcast_max_bytes: int = 256 * 1024 * 1024
    # Above this many index partitions the partial top-k rows are merged in two levels.
    knn_reduce_fanout: int = 512
    # Candidate retrieval for search: "exact" (broadcast query blocks) or "lsh" (bucket join).
    retrieval: str = "exact"
    lsh_bands: int = 8
    lsh_bits: int = 8
    # Neighbouring buckets a query also probes in each band (behind its least certain bits).
    lsh_flips: int = 0

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULT_SETTINGS = Settings()
