"""Command line: ``python -m lectern.cli --root DIR {import,index,search,exact,list,link,adopt} ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Row, SparkSession

from lectern.library import Library


def size_text(n: int) -> str:
    return f"{n / 1024 / 1024:.2f} MB"


def book_label(book_id: str | None, title: str | None) -> str:
    return " / ".join(x for x in (book_id, title) if x)


def import_report(rows: list[Row]) -> str:
    return "\n\n".join(
        f"{book_label(r['book_id'], r['title'])}\n  author: {r['author'] or '-'}\n  sections: {r['section_count']}\n  characters: {r['total_chars']} ({size_text((r['total_chars'] or 0) * 3)} at most)\n"
        f"  chunks: {r['chunk_count']} ({(r['initial_chunk_count'] or 0) - (r['chunk_count'] or 0)} merged), {r['min_chunk_chars']} to {r['max_chunk_chars']} characters, {r['average_chunk_chars']} on average\n  index: {r['index_status']}"
        for r in rows
    )


def index_report(rows: list[Row]) -> str:
    return "\n".join(f"{r['book_id']}: {r['term_count']} terms, {r['posting_count']} postings" for r in rows) or "nothing indexed"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--root", required=True)
    p.add_argument("--json", action="store_true")
    s = p.add_subparsers(dest="command", required=True)
    a = s.add_parser("import")
    a.add_argument("path")
    for name in ("--title", "--author", "--book-id"):
        a.add_argument(name)
    for name in ("--max-chars", "--min-chars"):
        a.add_argument(name, type=int)
    a.add_argument("--build-index", action="store_true")
    for command in ("index", "search", "exact"):
        a = s.add_parser(command)
        if command != "index":
            a.add_argument("query")
            a.add_argument("--limit", type=int, default=10)
            a.add_argument("--max-preview", type=int, default=220)
        a.add_argument("--book-id")
        a.add_argument("--all", action="store_true")
    s.add_parser("list")
    a = s.add_parser("link")
    for name in ("--title", "--author", "--external-id", "--book-id"):
        a.add_argument(name)
    a.add_argument("--confirm", action="store_true")
    a.add_argument("--pending", action="store_true")
    s.add_parser("adopt").add_argument("folder")
    return p


def run(lib: Library, a: argparse.Namespace) -> str:
    if a.command == "import":
        rows = lib.import_books(a.path, title=a.title, author=a.author, book_id=a.book_id, max_chars=a.max_chars, min_chars=a.min_chars, build_index=a.build_index).collect()
        text = import_report(rows)
    elif a.command == "index":
        rows = lib.build_index(a.book_id, every=a.all).collect()
        text = index_report(rows)
    elif a.command in ("search", "exact"):
        hits = (lib.search if a.command == "search" else lib.search_exact)(a.query, a.book_id, every=a.all, limit=a.limit, max_preview=a.max_preview)
        rows, text = (hits.collect(), "") if a.json else ([], lib.report(hits))
    elif a.command == "list":
        rows = lib.list_books().collect()
        text = "\n".join(f"{book_label(r['book_id'], r['title'])} [{r['index_status']}] {r['reading_status'] or ''}".rstrip() for r in rows)
    elif a.command == "adopt":
        rows = [Row(table=t, rows=n) for t, n in lib.adopt(a.folder).items()]
        text = "\n".join(f"{r['table']}: {r['rows']}" for r in rows)
    elif a.pending:
        rows = lib.pending_links().collect()
        text = "\n".join(f"{r['ext_title']}: " + ", ".join(f"{c['book_id']} ({c['score']})" for c in r["candidates"]) for r in rows)
    else:
        r = lib.link_external(a.title, ext_id=a.external_id, author=a.author, book_id=a.book_id, confirm=a.confirm)
        return json.dumps({"action": r.action} | r.values, ensure_ascii=False, default=str)
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, default=str) if a.json else text


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    print(run(Library(SparkSession.builder.appName("lectern").getOrCreate(), a.root), a))


if __name__ == "__main__":
    main()
