"""Symbols from source text: Python by its syntax tree, Markdown by headings, other languages by patterns.

The pattern extractor is a stand-in for grammars: it sees definitions that open a line and calls by name.
"""

from __future__ import annotations

import ast
import hashlib
import pkgutil
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, lang string, content_type string, name string, tag string, kind string, start_line int, end_line int, signature string, enclosing string"
MAX_SIGNATURE = 500
#: Kinds of definitions and references by language.
CAPABILITIES = {
    "bash": ("function variable", "call"), "c": ("class function type", "call member"), "cpp": ("class function method type", "call member type"),
    "csharp": ("class interface method module", "class interface send call member type"), "elixir": ("module function", "call module"),
    "go": ("function method type interface class module variable constant", "call type module member"), "haskell": ("function interface type", "call"),
    "java": ("class interface method", "class interface method member type"), "javascript": ("class function method", "call class member type"),
    "kotlin": ("class function object", "call type member"), "lua": ("function method", "call method member type"), "markdown": ("section", ""),
    "php": ("class function", "call class member type"), "python": ("constant class function", "call type member"), "ruby": ("class method module", "call"),
    "rust": ("class function interface macro method module", "call implementation member type"), "scala": ("class constant function interface type", "call member type"),
    "swift": ("class function interface method property", "call member type"), "typescript": ("class enum function interface method module type", "call class type member"),
    "zig": ("constant function", "call member type"),
}
#: Definitions that open a line, by language: keywords of each kind.
OPENERS = {
    "go": {"function": r"func(?:\s+\([^)]*\))?", "type": "type"}, "rust": {"function": r"(?:pub\s+)?(?:async\s+)?fn", "class": r"(?:pub\s+)?(?:struct|enum)", "interface": r"(?:pub\s+)?trait", "module": r"(?:pub\s+)?mod"},
    "javascript": {"function": r"(?:export\s+)?(?:async\s+)?function\*?", "class": r"(?:export\s+)?class"}, "typescript": {"function": r"(?:export\s+)?(?:async\s+)?function\*?", "class": r"(?:export\s+)?(?:abstract\s+)?class", "interface": r"(?:export\s+)?interface", "enum": r"(?:export\s+)?enum", "type": r"(?:export\s+)?type"},
    "ruby": {"method": r"def(?:\s+self\.)?", "class": "class", "module": "module"}, "php": {"function": r"(?:(?:public|private|protected|static)\s+)*function", "class": r"(?:abstract\s+|final\s+)?class"},
    "swift": {"function": r"(?:(?:public|private|internal|static|override)\s+)*func", "class": r"(?:(?:public|final|open)\s+)*(?:class|struct|enum)", "interface": r"(?:public\s+)?protocol"},
    "kotlin": {"function": r"(?:(?:private|public|internal|suspend|override)\s+)*fun", "class": r"(?:(?:data|sealed|open|abstract)\s+)*class", "object": "object"},
    "scala": {"function": "def", "class": r"(?:case\s+)?class", "interface": "trait"}, "lua": {"function": r"(?:local\s+)?function"}, "elixir": {"module": "defmodule", "function": r"defp?"},
    "java": {"class": r"(?:(?:public|private|protected|abstract|final|static)\s+)*class", "interface": r"(?:public\s+)?interface"}, "csharp": {"class": r"(?:(?:public|private|internal|abstract|sealed|static)\s+)*class", "interface": r"(?:public\s+)?interface", "module": "namespace"},
    "c": {"class": "struct|enum|union"}, "cpp": {"class": r"class|struct|enum(?:\s+class)?"}, "zig": {"function": r"(?:pub\s+)?fn", "constant": r"(?:pub\s+)?const"}, "haskell": {"type": r"data|newtype|type", "interface": "class"}, "bash": {"function": "function"},
}
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(|\.([A-Za-z_]\w*)")
#: What the parser raises on a text that is no Python, or that is nested too deep for it.
UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)
_NO_CALLS = frozenset("if for while switch return catch function func fn def sizeof and or not in match when unless elif".split())


def row(name: str, tag: str, kind: str, start: int, end: int, signature: str | None = None, enclosing: str | None = None) -> dict:
    return {"name": name, "tag": tag, "kind": kind, "start_line": start, "end_line": end, "signature": (signature or "")[:MAX_SIGNATURE].strip() or None, "enclosing": enclosing}


def from_python(source: str) -> list[dict]:
    """Definitions (module constants, classes, functions) and references (calls, upper-case owners of members, annotations)."""
    try:
        tree = ast.parse(source)
    except UNPARSED:
        return from_patterns(source, "python")
    lines, out = re.split("\r\n?|\n", source), []  # as the parser counts them

    def header(node: ast.AST) -> str:
        return " ".join("\n".join(lines[node.lineno - 1 : max(node.body[0].lineno - 1, node.lineno)]).split()).rstrip(":")

    def annotated(node: ast.AST) -> Iterator[ast.Name]:
        for part in ast.walk(node):
            if isinstance(part, ast.Name):
                yield part
            elif isinstance(part, ast.Constant) and isinstance(part.value, str):
                try:
                    for inner in ast.walk(ast.parse(part.value, mode="eval")):
                        if isinstance(inner, ast.Name):
                            inner.lineno = part.lineno
                            yield inner
                except UNPARSED:
                    continue

    def under(node: ast.AST, owner: str | None, top: bool) -> list[tuple[ast.AST, str | None, bool]]:
        return [(child, owner, top) for child in ast.iter_child_nodes(node)][::-1]

    def visit(node: ast.AST) -> None:
        held = under(node, None, True)  # a list in place of calls: a tree may be deeper than the stack
        while held:
            child, owner, top = held.pop()
            inner = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                out.append(row(child.name, "def", kind, child.lineno, child.end_lineno, header(child)))
                inner = child.name
                if kind == "function":
                    for note in [child.returns, *(a.annotation for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs, child.args.vararg, child.args.kwarg] if a)]:
                        out.extend(row(n.id, "ref", "type", n.lineno, n.lineno, None, inner) for n in (annotated(note) if note else ()))
            elif top and isinstance(child, ast.Assign):
                out.extend(row(t.id, "def", "constant", child.lineno, child.end_lineno, lines[child.lineno - 1]) for t in child.targets if isinstance(t, ast.Name))
            elif isinstance(child, ast.AnnAssign):
                out.extend(row(n.id, "ref", "type", n.lineno, n.lineno, None, owner) for n in annotated(child.annotation))
            if isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    out.append(row(f.id, "ref", "call", f.lineno, f.lineno, None, owner))
                elif isinstance(f, ast.Attribute):
                    out.append(row(f.attr, "ref", "call", f.end_lineno, f.end_lineno, None, owner))
            elif isinstance(child, ast.Attribute) and isinstance(child.value, ast.Name) and child.value.id[:1].isupper():
                out.append(row(child.value.id, "ref", "member", child.lineno, child.lineno, None, owner))
            held += under(child, inner, False)

    visit(tree)
    return out


def from_markdown(source: str) -> list[dict]:
    """ATX headings outside code fences; a section ends where the next heading starts."""
    lines, heads, fenced = source.split("\n"), [], False
    for n, line in enumerate(lines, 1):
        if re.match(r"\s{0,3}(```|~~~)", line):
            fenced = not fenced
        elif not fenced and (m := re.match(r"\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", line)) and m[1]:
            heads.append((m[1], n, line))
    ends = [n - 1 for _, n, _ in heads[1:]] + [len(lines)] * bool(heads)
    return [row(name, "def", "section", n, end, line) for (name, n, line), end in zip(heads, ends, strict=True)]


def from_patterns(source: str, lang: str) -> list[dict]:
    """Definitions by their opening keywords, ending before the next at no deeper indent; calls and members by name."""
    openers = OPENERS.get(lang, {"function": "def", "class": "class"} if lang == "python" else {})
    patterns = [(kind, re.compile(rf"^(\s*)(?:{words})\s+([A-Za-z_][\w]*)")) for kind, words in openers.items()]
    lines, opened = source.split("\n"), []
    for n, line in enumerate(lines, 1):
        for kind, pattern in patterns:
            if m := pattern.match(line):
                opened.append((m[2], kind, n, len(m[1]), line))
                break
    out = []
    for k, (name, kind, n, indent, line) in enumerate(opened):
        end = next((m - 1 for _, _, m, deep, _ in opened[k + 1 :] if deep <= indent), len(lines))
        out.append(row(name, "def", kind, n, end, re.split(r"[{:]\s*$", line)[0]))
    spans = sorted(((r["start_line"], r["end_line"], r["name"]) for r in out), key=lambda s: s[1] - s[0])
    named = {(r["start_line"], r["name"]) for r in out}
    if CAPABILITIES.get(lang, ("", ""))[1]:
        for n, line in enumerate(lines, 1):
            for m in _CALL.finditer(line):
                name = m[1] or m[2]
                if name not in _NO_CALLS and (n, name) not in named:
                    owner = next((s[2] for s in spans if s[0] <= n <= s[1]), None)
                    out.append(row(name, "ref", "call" if m[1] else "member", n, n, None, owner))
    return out


def symbols_of(source: str, lang: str) -> list[dict]:
    """Symbols of one text; none for a language without an extractor."""
    if lang == "python":
        return from_python(source)
    if lang == "markdown":
        return from_markdown(source)
    return from_patterns(source, lang) if lang in OPENERS else []


def extract(corpus: DataFrame) -> DataFrame:
    """Rows (path, lang, content_type, text) to symbols, in batches of Arrow; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, lang, content, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = set()
                for r in symbols_of(text or "", lang or ""):
                    mark = (r["name"], r["tag"], r["start_line"], r["kind"]) if r["tag"] == "def" else None
                    if mark is None or mark not in seen:
                        seen.add(mark)
                        out.append({"path": path, "lang": lang, "content_type": content, **r})
            text_, int_ = pa.string(), pa.int32()
            kinds = {"path": text_, "lang": text_, "content_type": text_, "name": text_, "tag": text_, "kind": text_, "start_line": int_, "end_line": int_, "signature": text_, "enclosing": text_}
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(kinds.items())))

    return corpus.select("path", "lang", "content_type", "text").mapInArrow(run, SCHEMA)


def revision() -> str:
    """A digest of this module; symbols of another revision are stale."""
    return hashlib.blake2b(pkgutil.get_data(__package__, "extract.py"), digest_size=8).hexdigest()


def capability_table(spark) -> DataFrame:
    """(lang, definitions, reference_kinds, calls) of every language with an extractor."""
    rows = [(lang, bool(d), r.split(), bool({"call", "send", "method"} & set(r.split()))) for lang, (d, r) in CAPABILITIES.items()]
    return spark.createDataFrame(rows, "lang string, definitions boolean, reference_kinds array<string>, calls boolean")
