"""Command line: index, search, defs, refs, symbols, status, config, init, clear. JSON by default, --text for people.

Exit codes: 0 done (also without results), 1 failure, 2 a question that cannot be answered.
"""

from __future__ import annotations

import argparse
import difflib
import json
import shutil
import sys
from pathlib import Path

from .index import Index, home, location
from .settings import as_toml, load


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-r", "--repo", default=".")
    common.add_argument("--config", type=Path)
    common.add_argument("--text", action="store_true")
    filters = argparse.ArgumentParser(add_help=False)
    for name in ("content", "include", "exclude"):
        filters.add_argument(f"--{name}", action="append")
    filters.add_argument("-l", "--lang", action="append")
    commands = out.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", parents=[common, filters])
    search.add_argument("query", nargs="+")
    search.add_argument("-k", type=int, default=10)
    search.add_argument("--code", choices=("full", "signature", "none"), default="full")
    for name in ("defs", "refs"):
        command = commands.add_parser(name, parents=[common])
        command.add_argument("name")
        command.add_argument("-l", "--lang", action="append")
    symbols = commands.add_parser("symbols", parents=[common, filters])
    symbols.add_argument("pattern", nargs="?")
    symbols.add_argument("--tag", choices=("def", "ref"))
    symbols.add_argument("--count-by", choices=("name", "lang", "file", "tag", "content"))
    symbols.add_argument("--limit", type=int)
    commands.add_parser("index", parents=[common]).add_argument("--force", action="store_true")
    commands.add_parser("status", parents=[common])
    commands.add_parser("config", parents=[common]).add_argument("--commented", action="store_true")
    commands.add_parser("init", parents=[common]).add_argument("--force", action="store_true")
    clear = commands.add_parser("clear", parents=[common])
    clear.add_argument("--all", action="store_true")
    clear.add_argument("--dry-run", action="store_true")
    return out


def bytes_of(folder: Path) -> int:
    """Bytes of all files under a folder."""
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def check_languages(index: Index, asked: list[str] | None) -> None:
    """Raises LookupError for a language that the index does not hold, with the nearest one that it does; called where nothing was found."""
    held = {r["value"] for r in index.languages().collect()} if asked else set()
    if unknown := [x for x in asked or () if x not in held] if held else []:
        near = difflib.get_close_matches(unknown[0], sorted(held), 1, 0.6)
        raise LookupError(f"no indexed file is of language {unknown[0]!r}; " + (f"is {near[0]!r} meant?" if near else f"the index holds {', '.join(sorted(held))}"))


def initialise(target: Path, settings, force: bool) -> dict:
    """Writes the settings in force as a file of the repository; every value is pinned by it."""
    if target.exists() and not force:
        raise FileExistsError(f"{target} exists; --force overwrites it")
    target.write_text("# The settings in force when this was written. A key that stays here no longer follows the defaults.\n\n" + as_toml(settings))
    return {"wrote": str(target)}


def cleared(targets: list[Path], dry_run: bool) -> dict:
    """Removes indexes, or says what would go; a folder that is still there afterwards is an error."""
    out = []
    for folder in (t for t in targets if t.is_dir()):
        size = f"{bytes_of(folder) / 1e6:.1f} MB"
        if not dry_run:
            shutil.rmtree(folder, ignore_errors=True)
            if folder.exists():
                raise OSError(f"{folder} could not be removed")
        out.append(f"{'would remove' if dry_run else 'removed'} {folder.name}  {size}")
    return {"cleared": out or ["nothing to clear"]}


def answer(args: argparse.Namespace, index: Index) -> dict:
    """The payload of a command."""
    rows = lambda df: [{k: v for k, v in r.asDict(True).items() if v is not None} for r in df.collect()]
    if args.command == "index":
        report = index.refresh(args.force)
        return {"added": report.added, "changed": report.changed, "deleted": report.deleted, "seconds": round(report.elapsed_s, 3)}
    if args.command == "status":
        on_disk = round(bytes_of(Path(index.data)) / 1e6, 1)
        shown = ", ".join(f"{r['value']} {r['n']}" for r in rows(index.languages(8)))
        return {"root": str(Path(index.root).resolve()), "index": index.data, **{r["what"]: r["n"] for r in rows(index.status())}, "size_mb": on_disk, "languages": shown}
    if args.command in ("defs", "refs"):
        found = rows((index.definitions if args.command == "defs" else index.references)(args.name, args.lang))
        if not found:
            check_languages(index, args.lang)
        by = {c: sum(r["content_type"] == c for r in found) for c in {r["content_type"] for r in found}}
        return {"name": args.name, "count": len(found), "by_content_type": dict(sorted(by.items(), key=lambda x: (-x[1], x[0]))), "symbols": found}
    filters = {"lang": args.lang, "content": args.content, "include": args.include, "exclude": args.exclude}
    if args.command == "symbols" and args.count_by:
        counts, totals = index.symbol_counts(args.count_by, args.pattern, tag=args.tag, limit=args.limit, **filters)
        got, total = rows(counts), totals.first()
        if not got:
            check_languages(index, args.lang)
        return {"count_by": args.count_by, "groups": total["groups"], "total": total["total"], "shown": len(got), "counts": got}
    if args.command == "symbols":
        found = rows(index.symbols(args.pattern, tag=args.tag, limit=args.limit, **filters))
        if not found:
            check_languages(index, args.lang)
        return {"count": len(found), "symbols": found}
    query = " ".join(args.query)
    hits = rows(index.search(query, args.k, **filters))
    if not hits:
        check_languages(index, args.lang)
    for hit in hits:
        hit["score"] = round(hit["score"], 4)
        hit["tiers"] = {k: round(v, 4) for k, v in hit.get("tiers", {}).items()}
        text = hit.pop("text")
        if args.code == "full":
            hit["code"] = text
        if args.code != "signature":
            hit.pop("signature", None)
    return {"query": query, "count": len(hits), "results": hits}


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        own = Path(args.repo) / "tessera.toml"
        settings = load(home() / "tessera.toml", args.config or own)
        if args.command == "config":
            print(as_toml(settings, not args.commented), end="")
            return 0
        if args.command == "init":
            payload = initialise(own, settings, args.force)
        elif args.command == "clear":
            every = sorted((home() / "index").iterdir()) if args.all and (home() / "index").is_dir() else []
            payload = cleared(every if args.all else [location(args.repo, settings)], args.dry_run)
        else:
            if spark is None:
                from .session import local_session

                spark = local_session()
            payload = answer(args, Index.open(spark, args.repo, settings))
    except (LookupError, ValueError) as problem:
        print(problem, file=sys.stderr)
        return 2
    except Exception as problem:  # noqa: BLE001
        print(problem, file=sys.stderr)
        return 1
    if args.text:
        for key, value in payload.items():
            print(f"{key}: {value}" if not isinstance(value, list) else "\n".join(json.dumps(v, default=str) for v in value))
    else:
        print(json.dumps(payload, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
