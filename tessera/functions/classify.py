"""What a file is, from its path, language and bytes: language, category, test, generated, penalty."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import NEVER_INDEXED, Settings
from .text import file_name

#: Languages by suffix and by whole file name.
SUFFIXES = {
    "bash": "sh bash", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs", "elixir": "ex exs", "go": "go", "haskell": "hs", "java": "java",
    "javascript": "js mjs cjs jsx", "kotlin": "kt kts", "lua": "lua", "markdown": "md markdown", "php": "php", "python": "py pyi", "ruby": "rb",
    "rust": "rs", "scala": "scala", "swift": "swift", "typescript": "ts tsx", "zig": "zig", "html": "html htm", "rst": "rst", "asciidoc": "adoc",
    "latex": "tex", "toml": "toml", "yaml": "yaml yml", "json": "json", "ini": "ini cfg", "xml": "xml", "cmake": "cmake", "hcl": "hcl",
    "terraform": "tf", "properties": "properties", "csv": "csv", "tsv": "tsv", "psv": "psv", "sql": "sql", "dart": "dart", "pem": "pem", "css": "css",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "make", "cmakelists.txt": "cmake", ".editorconfig": "editorconfig", ".gitignore": "gitignore", ".gitattributes": "gitattributes", "go.mod": "gomod", "go.sum": "gosum", "requirements.txt": "requirements", "manifest.in": "pymanifest"}
#: Path penalties.
TEST_FILES = (
    r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb|[^/]*\.test\.[jt]sx?"
    r"|[^/]*\.spec\.[jt]sx?|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift|[^/]*Tests?\.cs|test_[^/]*\.cpp|[^/]*_test\.cpp"
    r"|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala|[^/]*Suite\.scala|[^/]*Test\.scala|[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua"
    r"|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.\w+)$"
)
TEST_DIRS = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIRS = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLE_DIRS = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
TYPE_FILES = r"\.d\.ts$"
REEXPORT_NAMES = ("__init__.py", "package-info.java")
STRONG, MODERATE, MILD = 0.3, 0.5, 0.7
PROBE_FLOOR, PROBE_BYTES, MAX_MEDIAN_LINE = 16_384, 65_536, 1_000


def language(path: Column) -> Column:
    """The language of a file by its name, or null."""
    by_suffix = F.create_map(*map(F.lit, chain.from_iterable((s, lang) for lang, all_ in SUFFIXES.items() for s in all_.split())))
    by_name = F.create_map(*map(F.lit, chain.from_iterable(NAMES.items())))
    name = F.lower(file_name(path))
    suffix = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    return F.coalesce(F.try_element_at(by_name, name), F.try_element_at(by_suffix, suffix))


def is_indexable(path: Column) -> Column:
    return F.coalesce(language(path).isNotNull() & ~language(path).isin(*NEVER_INDEXED), F.lit(False))


def test_patterns(markers: tuple[str, ...]) -> tuple[str, str]:
    """A pattern for any case (segments and delimited parts) and one that minds it (camelCase suffixes)."""
    one_of = "|".join(map(re.escape, markers))
    loose = (
        rf"(?i)(?:^|/)__?(?:{one_of})s?__?(?:/|$)|(?:^|/)(?:{one_of})(?:s|ing)?(?:/|$)"
        rf"|(?:^|/|[_.\-])(?:{one_of})s?[_.\-]|[_.\-](?:{one_of})s?\.[A-Za-z0-9]+$"
    )
    return loose, rf"[a-z0-9](?:{'|'.join(m.title() for m in markers)})s?\.[A-Za-z0-9]+$"


def is_test(path: Column, markers: tuple[str, ...]) -> Column:
    if not markers:
        return F.lit(False)
    loose, camel = test_patterns(markers)
    return path.rlike(loose) | path.rlike(camel)


def classify(lang: Column, path: Column, settings: Settings) -> Column:
    """docs, config and data by language, then tests by path, else code."""
    low = F.lower(F.coalesce(lang, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name, languages in (("docs", settings.doc_languages), ("config", settings.config_languages), ("data", settings.data_languages)):
        if languages:
            out = out.when(low.isin(*(x.lower() for x in languages)), name)
    return out.when(is_test(path, settings.test_markers), "tests").otherwise("code")


def is_generated(content: Column, size: Column) -> Column:
    """Whether the upper median of the lengths of whole lines in the first bytes is too long to be typed.

    content is text or binary; lengths are bytes.
    """
    probe = F.substring(content.cast("binary"), 1, PROBE_BYTES)
    lines = F.split(F.decode(probe, "ISO-8859-1"), "\n", -1)  # one character a byte
    lengths = F.array_sort(F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda x: F.length(x)))
    whole = F.size(lengths)
    median = F.get(lengths, F.floor(whole / 2).cast("int"))
    return (size >= PROBE_FLOOR) & ((whole < 3) | (median > MAX_MEDIAN_LINE))


def path_penalty(path: Column) -> Column:
    """The product of what tests, re-exports, compatibility, example and type-definition paths cost."""
    norm = F.translate(path, "\\", "/")
    cost = lambda test, factor: F.when(test, F.lit(factor)).otherwise(F.lit(1.0))
    return (
        cost(norm.rlike(TEST_FILES) | norm.rlike(TEST_DIRS), STRONG)
        * cost(file_name(path).isin(*REEXPORT_NAMES), MODERATE)
        * cost(norm.rlike(COMPAT_DIRS), STRONG)
        * cost(norm.rlike(EXAMPLE_DIRS), STRONG)
        * cost(norm.rlike(TYPE_FILES), MILD)
    )
