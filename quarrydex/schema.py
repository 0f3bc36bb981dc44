"""Table schemas, enumerations and settings of the code-knowledge store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


_SPECS = {
    "projects": "id string, name string",
    "project_repos": "id string, project_id string, repo_id string",
    "repos": "id string, name string, root_path string, remote_url string, default_branch string, description string, last_scanned bigint",
    "packages": "id string, name string, repo_id string, language string, virtual_path string, physical_path string, description string",
    "files": "id string, repo_id string, package_id string, path string, file_hash string, last_updated bigint",
    "nodes": (
        "id string, repo_id string, file_id string, package_id string, parent_node_id string, name string, body string, header string, kind string, "
        "subtype string, docstring string, comment string, custom_value string, start_line int, end_line int, start_byte int, end_byte int, "
        "embedding_code_vec array<float>, embedding_model string, search_boost float, visibility string, fts_needle string"
    ),
    "import_edges": (
        "id string, repo_id string, from_package_id string, from_file_id string, to_package_physical_path string, to_package_virtual_path string, "
        "to_package_id string, alias string, dot boolean, external boolean, raw string"
    ),
    "embedding_cache": "id bigint, model string, hash binary, vector array<float>, last_accessed_at timestamp",
    "schema_versions": "name string, applied_at timestamp",
}
#: Columns that identify a row of each table.
KEYS = {"project_repos": ["project_id", "repo_id"], "embedding_cache": ["model", "hash"], "schema_versions": ["name"]}


def schema(table: str) -> T.StructType:
    """The Spark schema of a store table (needs an active session)."""
    return _table(_SPECS[table])


def tables() -> list[str]:
    return list(_SPECS)


LANGUAGES = ("python", "c", "cpp", "go", "typescript", "javascript", "java", "markdown", "text", "terraform")
NODE_KINDS = ("function", "method", "class", "interface", "enum", "namespace", "property", "const", "variable", "literal", "block", "comment", "custom")
VISIBILITIES = ("public", "private", "protected", "package", "internal")
MODIFIERS = ("static", "async", "abstract", "final", "override", "generic")
EDGE_TYPES = ("imports", "exports")
SUMMARY_MODES = ("skip", "definition", "documentation", "source")
TOKENIZERS = ("code", "word", "noop")
FILE_STATES = ("skipped", "bare_file", "parsed_file", "error")
IGNORED_DIRS = tuple("__pycache__ .git .hg .idea .mypy_cache .pytest_cache .svn .vscode".split())


def invalid_rows(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose enumeration column holds an unknown value (nulls are allowed)."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


@dataclass
class SearchSettings:
    rrf_k: int = 60
    vector_weight: float = 0.5
    text_weight: float = 0.5
    similarity_threshold: float = 0.4
    bm25_threshold: float | None = None
    repo_boost: float = 1.2
    sliced_ranks: bool = False
    kind_boosts: dict[str, float] = field(
        default_factory=lambda: {"function": 2.0, "method": 2.0, "class": 1.5, "const": 1.3, "variable": 1.3, "property": 1.3, "literal": 0.9}
    )
    field_boosts: dict[str, float] = field(default_factory=lambda: dict(zip(("name", "file_path", "body", "docstring"), (3, 2, 1, 1))))


@dataclass
class Settings:
    search: SearchSettings = field(default_factory=SearchSettings)
    tokenizer: str = "code"
    chunk_max_tokens: int = 512
    chunk_min_tokens: int = 64
    list_limit: int = 50
    refresh_enabled: bool = True
    refresh_cooldown_s: int = 300
    refresh_debounce_s: int = 1
    project_paths: bool = False
    ignored_dirs: tuple[str, ...] = IGNORED_DIRS
    parser_extensions: dict[str, str] = field(default_factory=dict)
    language_extensions: dict[str, list[str]] = field(default_factory=dict)
    parse_unknown_text: bool = False
    embedder: str = "hashing"
    embedding_dim: int = 1024
    embedding_cache: str = "store"
    embed_batch: int = 128
    embed_wait_s: float = 0.05
    cache_max_rows: int = 1_000_000
    cache_trim_batch: int = 10_000
    disabled_tools: tuple[str, ...] = ()
