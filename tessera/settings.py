"""Engine settings: defaults, validation, layered loading from TOML and the environment, TOML output."""

from __future__ import annotations

import hashlib
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

CATEGORIES = ("docs", "config", "data", "tests", "code")
MIN_CHUNK_CHARS, MAX_CHUNK_CHARS = 60, 20_000
NEVER_INDEXED = ("pem",)
SECRETS = ("embed_api_key",)
ENV_PREFIX = "TESSERA_"


@dataclass(frozen=True)
class Settings:
    """All knobs, flat; values are checked when made. The defaults are fixed values."""

    ranker: str = "rrf"
    rrf_constant: int = 60
    prose_min_words: int = 4
    adaptive_alpha: bool = True
    alpha_symbol: float = 0.3
    alpha_prose: float = 0.5
    saturation_decay: float = 0.5
    rerank: bool = True
    file_coherence: float = 0.2
    stem_boost: float = 1.0
    definition_boost: float = 3.0
    candidate_depth: int = 30
    distill_docs: bool = False
    content: tuple[str, ...] = ()
    content_excluded: tuple[str, ...] = ("data",)
    index_excluded: tuple[str, ...] = ("data",)
    doc_languages: tuple[str, ...] = ("markdown", "markdown_inline", "html", "rst", "asciidoc", "latex")
    config_languages: tuple[str, ...] = (
        "toml", "yaml", "json", "ini", "xml", "dockerfile", "make", "cmake", "hcl", "terraform", "properties", "editorconfig",
        "gitignore", "gitattributes", "gomod", "gosum", "requirements", "pymanifest",
    )
    data_languages: tuple[str, ...] = ("csv", "tsv", "psv")
    test_markers: tuple[str, ...] = ("test", "spec")
    embed_backend: str = "hashing"
    embed_dims: int = 64
    embed_endpoint: str = ""
    embed_api_key: str = ""
    embed_query_prefix: str = ""
    embed_doc_prefix: str = ""
    coverage: str = "hybrid"
    window_chars: int = 750
    lexical_mode: str = "full"
    lexical_cap_chars: int = 2_000
    lexical_enrich: bool = False
    split_identifiers: str = "off"
    max_chunk_lines: int = 200
    gitignore: bool = True
    hard_exclude: tuple[str, ...] = (".git", ".tessera", ".venv", "venv", "node_modules", "__pycache__", ".build", "dist", "target", ".pytest_cache", ".mypy_cache")
    max_file_bytes: int = 1_000_000
    refresh_mode: str = "auto"
    rescan_after_seconds: int = 5
    data_dir: str = ""

    def __post_init__(self) -> None:
        choices = {
            "ranker": ("rrf", "none"),
            "embed_backend": ("hashing", "http", "none"),
            "coverage": ("definition", "hybrid"),
            "lexical_mode": ("full", "capped"),
            "split_identifiers": ("off", "inline", "append"),
            "refresh_mode": ("auto", "manual"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {', '.join(allowed)}")
        for name in ("content", "content_excluded", "index_excluded"):
            if unknown := set(getattr(self, name)) - {*CATEGORIES, "all"}:
                raise ValueError(f"{name}: unknown categories {sorted(unknown)}")
        if self.candidate_depth < 1 or self.window_chars < 1 or not 0 <= self.saturation_decay <= 1:
            raise ValueError("candidate_depth and window_chars are at least 1, saturation_decay is from 0 to 1")
        if self.embed_backend == "http" and not self.embed_endpoint.startswith(("http://", "https://")):
            raise ValueError("embed_backend http needs an embed_endpoint")

    def fingerprint(self, *names: str) -> str:
        """A digest of the named settings; an index built under another one is stale."""
        return hashlib.blake2b(repr([(n, getattr(self, n)) for n in names]).encode(), digest_size=8).hexdigest()

    def identity(self) -> dict[str, str]:
        return {
            "vectors": self.fingerprint("embed_backend", "embed_dims", "embed_doc_prefix", "embed_endpoint"),
            "categories": self.fingerprint("doc_languages", "config_languages", "data_languages", "test_markers", "index_excluded"),
            "chunking": self.fingerprint("coverage", "window_chars", "lexical_mode", "lexical_cap_chars", "lexical_enrich", "split_identifiers", "max_chunk_lines", "distill_docs"),
        }


def normalise_content(content: str | tuple[str, ...] | list[str] | None, settings: Settings) -> tuple[str, ...]:
    """The explicit categories of a filter: none means all but the excluded, "all" adds every category but data."""
    named = (content,) if isinstance(content, str) else tuple(content or settings.content)
    if unknown := set(named) - {*CATEGORIES, "all"}:
        raise ValueError(f"unknown content {sorted(unknown)}; known: {', '.join(CATEGORIES)}")
    if not named:
        return tuple(c for c in CATEGORIES if c not in settings.content_excluded)
    wanted = set(named) - {"all"} | ({*CATEGORIES} - {"data"} if "all" in named else set())
    return tuple(c for c in CATEGORIES if c in wanted)


def require_indexed(content: str | tuple[str, ...] | list[str] | None, settings: Settings) -> None:
    """Raises LookupError if a category is asked for by name that no index holds."""
    named = {content} if isinstance(content, str) else set(content or ())
    if refused := sorted(named & set(settings.index_excluded)):
        raise LookupError(f"not indexed: {', '.join(refused)}; change index_excluded and rebuild")


def flattened(table: Mapping) -> dict:
    out: dict = {}
    for key, value in table.items():
        out.update(flattened(value) if isinstance(value, Mapping) else {key: value})
    return out


def _typed(name: str, value: object) -> object:
    default = getattr(Settings(), name)
    if isinstance(value, str) and not isinstance(default, str):
        if isinstance(default, bool):
            if value.lower() not in ("1", "0", "true", "false", "yes", "no"):
                raise ValueError(f"{name}: {value!r} is no boolean")
            return value.lower() in ("1", "true", "yes")
        if isinstance(default, tuple):
            return tuple(x.strip() for x in value.split(",") if x.strip())
        return type(default)(value)
    return tuple(value) if isinstance(default, tuple) else value


def load(user: Path | None = None, repo: Path | None = None, env: Mapping[str, str] | None = None, **overrides: object) -> Settings:
    """User file, then repository file, environment and overrides, the later over the earlier.

    Unknown keys raise; a secret in the repository's file is refused.
    """
    known = {f.name for f in fields(Settings)}
    values: dict[str, object] = {}
    for path in (user, repo):
        if path is None or not path.exists():
            continue
        got = flattened(tomllib.loads(path.read_text()))
        if unknown := set(got) - known:
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        if path is repo and (secret := set(got) & set(SECRETS)):
            raise ValueError(f"{path}: {sorted(secret)} must not stand in a repository")
        values |= got
    source = os.environ if env is None else env
    values |= {n: source[ENV_PREFIX + n.upper()] for n in known if ENV_PREFIX + n.upper() in source}
    if unknown := set(overrides) - known:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    values |= overrides
    return replace(Settings(), **{k: _typed(k, v) for k, v in values.items()})


def as_toml(settings: Settings, active: bool = True) -> str:
    """All settings but secrets as TOML, commented out unless active."""
    shown = lambda v: str(v).lower() if isinstance(v, bool) else repr(list(v)).replace("'", '"') if isinstance(v, tuple) else f'"{v}"' if isinstance(v, str) else repr(v)
    lines = [f"{f.name} = {shown(getattr(settings, f.name))}" for f in fields(settings) if f.name not in SECRETS]
    return "\n".join(lines if active else [f"# {line}" for line in lines]) + "\n"
