import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.library import Library
from lectern.sources.decode import decode
from lectern.sources.epub import read_epub, skipped
from lectern.sources.html import to_text

SAMPLE = "第一章：雾\n\n清晨的城里有一层很薄的雾。人们穿过街口时，像从一页纸走到另一页纸。\n\n第二章：书房\n\n她把书摊开，决定只读一小段。这样故事不会一下子淹没她。\n"


def epub(spine='<itemref idref="c1"/><itemref idref="nav"/><itemref idref="gone"/><itemref idref="c2"/>') -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/p.opf",
            f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Fog</dc:title><dc:creator>Ann</dc:creator></metadata><manifest><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="c2" href="sub/c2.xhtml" media-type="application/xhtml+xml"/></manifest><spine>{spine}</spine></package>',
        )
        z.writestr("OEBPS/c1.xhtml", "<html><head><title>x</title></head><body><h1>One &amp; <i>only</i></h1><p>First.</p></body></html>")
        z.writestr("OEBPS/nav.xhtml", "<html><body>nav</body></html>")
        z.writestr("OEBPS/sub/c2.xhtml", "<html><body><p>Second.</p><ul><li>a</li></ul></body></html>")
    return buf.getvalue()


def test_decode():
    assert decode("雾".encode("gb18030")) == "雾" and decode(b"\xff\xfe\xfe\x96") == "雾" and decode(b"\xef\xbb\xbfx") == "x"
    assert decode(("ÑÊÎÖÐ" * 4).encode()) == "ÑÊÎÖÐ" * 4  # accented capitals are no sign of a wrong charset
    assert decode(None) == "" and decode(b"") == ""


def test_html():
    assert to_text("<p>a  b</p><script>x</script><h2>H</h2><img src=x>t<br>u&nbsp;v") == "a b\n\nH\n\nt\nu\xa0v"
    assert to_text(None) == ""


def test_epub():
    e = read_epub(epub())
    assert (e["title"], e["author"]) == ("Fog", "Ann") and e["sections"][0] == ("One & only", "One & only\n\nFirst.") and e["sections"][1][0] == "c2"
    with pytest.raises(ValueError):
        read_epub(epub(""))
    assert skipped({"id": "x", "href": "cover-1.xhtml"}) and skipped({"id": "封面", "href": "a.xhtml"}) and skipped({"media-type": "image/png"}) and not skipped({"id": "discovery", "href": "discovery.xhtml"})


def test_workflow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sample-book.txt").write_text(SAMPLE, encoding="utf-8")
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.list_books().count() == 0
    rows = lib.import_books(str(tmp_path / "in"), title="示例书", author="A", book_id="sample-book", max_chars=1000, min_chars=200).collect()
    assert len(rows) == 1 and rows[0]["chunk_count"] == 1 and rows[0]["total_chars"] == 77 and rows[0]["index_status"] == "not_built"
    linked = lib.link_external("示例书", book_id="sample-book", confirm=True)
    assert linked.action == "linked" and linked.values["score"] == 1.0 and lib.link_external("示例书").action == "reused"
    assert lib.build_index("sample-book").first()["term_count"] == 2
    assert [(r["term"], r["count"]) for r in lib.table("postings").orderBy("term").collect()] == [("一页", 2), ("页纸", 2)]
    assert lib.list_books().first()["index_status"] == "built"
    book, chunks, warnings = lib.manifest("sample-book", include_preview=True)
    assert chunks.count() == 1 and not warnings and "text" not in chunks.columns
    assert [(r["chunk_id"], r["score"]) for r in lib.search("雾", "sample-book").collect()] == [("ch000", 5)]
    hit = lib.search_exact("清晨的城里有一层很薄的雾", "sample-book").first()
    assert hit["score"] == 105 and hit["exact"]
    assert lib.find_highlight("清晨的城里有一层很薄的雾", title="示例书").values["chunk_id"] == "ch000"
    assert lib.get_chunk("sample-book", path="chunks/ch000.md").first()["book_title"] == "示例书"
    now = datetime(2025, 1, 1)
    lib.update_note("sample-book", quick_recovery={"lastChunkId": "ch000", "extra": ["a", "b"]}, current_understanding=" fog ", append_section="摘录与想法", append_heading="h1", append_content="c1", now=now)
    lib.update_note("sample-book", append_section="摘录与想法", append_heading="h2", append_content="c2", now=now)
    note = {r["heading"]: r["content"] for r in lib.read_note("sample-book", ("摘录与想法", "当前理解", "阅读恢复区")).collect()}
    assert note["摘录与想法"] == "### h1\n\nc1\n\n### h2\n\nc2" and note["当前理解"] == "fog" and "- lastChunkId: ch000\n" in note["阅读恢复区"] and note["阅读恢复区"].endswith("- extra: a, b")
    assert lib.read_full_note("sample-book", 10).first()["truncated"]
    with pytest.raises(ValueError):
        lib.resume()
    lib.update_progress("sample-book", last_chunk_id="ch000", current_themes=[" x ", ""])
    lib.update_progress("sample-book", next_chunk_id="ch000", status="reading")
    p = lib.progress("sample-book").first()
    assert (p["last_chunk_id"], p["next_chunk_id"], p["status"], p["current_themes"], p["note_path"]) == ("ch000", "ch000", "reading", ["x"], "notes/sample-book.md")
    assert lib.progress().first()["book_id"] == "sample-book"
    assert lib.resume()["chunk"].first()["chunk_id"] == "ch000"
    assert "ch000" in lib.report(lib.search("雾", "sample-book"))
    again = lib.import_books(str(tmp_path / "in"), book_id="sample-book", max_chars=1000)
    assert again.first()["index_status"] == "not_built" and lib.table("postings").count() == 0 and lib.unindexed().count() == 1


def test_many_kinds_and_guards(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.epub").write_bytes(epub())
    (d / "broken.epub").write_bytes(b"no zip")
    (d / "b.md").write_text("---\ntitle: Rain\nauthor: Bo\n---\n# Chapter 1\n\ntext", encoding="utf-8")
    (d / "empty.txt").write_text("")
    (d / "x.pdf").write_text("x")
    lib = Library(spark, str(tmp_path / "lib"))
    got = {r["book_id"]: (r["title"], r["author"], r["source_type"]) for r in lib.import_books(str(d), build_index=True).collect()}
    assert got == {"fog": ("Fog", "Ann", "epub"), "rain": ("Rain", "Bo", "md")}
    assert lib.link_external("Fog Tales").action == "pending" and lib.pending_links().count() == 1
    for bad in (lambda: lib.search("q"), lambda: lib.search("q", "a/b"), lambda: lib.get_chunk("fog"), lambda: lib.manifest("none"), lambda: lib.link_external(), lambda: lib.update_note("fog", append_section="x", append_content="y"), lambda: Library(spark, None), lambda: lib.import_books(str(d), title="two")):
        with pytest.raises(ValueError):
            bad()
    assert lib.table("chunks").where(F.col("text").contains("nav")).count() == 0


def test_import_follows_all_ids_not_a_limited_list(spark, tmp_path, monkeypatch):
    d = tmp_path / "in"
    d.mkdir()
    for k in range(3):
        (d / f"b{k}.txt").write_text(f"lamp{k} lamp{k}", encoding="utf-8")
    lib = Library(spark, str(tmp_path / "lib"))
    frame = type(spark.range(1))
    whole = frame.limit
    monkeypatch.setattr(frame, "limit", lambda df, n: whole(df, min(n, 1)))  # a small stand-in for 10,000
    assert lib.import_books(str(d), build_index=True).where("index_status = 'built'").count() == 3
    assert lib.table("postings").select("book_id").distinct().count() == lib.table("chunk_index").count() == 3
    assert lib.import_books(str(d)).where("index_status = 'not_built'").count() == 3
    assert lib.table("postings").count() == 0 and lib.table("chunk_index").count() == 0


def test_import_touches_no_other_book_of_the_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(SAMPLE, encoding="utf-8")
    lib = Library(spark, str(tmp_path / "lib"))
    lib.import_books(str(tmp_path / "in"), book_id="a", max_chars=1000, build_index=True)
    assert [r["book_id"] for r in lib.import_books(str(tmp_path / "in"), book_id="b", max_chars=1000).collect()] == ["b"]
    assert {r["book_id"] for r in lib.table("postings").collect()} == {"a"}


def test_streaming(spark, tmp_path):
    from lectern.streaming.ingest import ingest_folder, progress_windows

    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text(SAMPLE, encoding="utf-8")
    for _ in range(2):
        ingest_folder(spark, str(d), str(tmp_path / "out"), str(tmp_path / "cp"), max_chars=1000).awaitTermination()
        (d / "b.txt").write_text("Chapter 1\nfog fog", encoding="utf-8")
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 2
    src = tmp_path / "u"
    rows = [(1, "b", datetime(2025, 1, 1, 5), datetime(2025, 1, 2)), (1, "b", datetime(2025, 1, 1, 5), datetime(2025, 1, 3)), (2, "b", datetime(2025, 1, 1, 9), datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "update_id bigint, book_id string, last_read_at timestamp, received_at timestamp")
    df.write.parquet(str(src))
    q = progress_windows(spark.readStream.schema(df.schema).parquet(str(src))).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["updates"] for r in spark.table("days").collect()] == [2]


def test_adopt_folder_and_command_line(spark, tmp_path, capsys):
    import json

    from lectern import cli
    from lectern.sources.folder import warnings

    d = tmp_path / "old"
    (d / "books" / "fog" / "chunks").mkdir(parents=True)
    (d / "books" / "bad").mkdir()
    (d / "books" / "bad" / "manifest.json").write_text("{")
    (d / "notes").mkdir()
    chunk = {"id": "ch000", "title": "One", "sectionTitle": "One", "order": 0, "path": "chunks\\ch000.md", "charCount": 7, "keywords": ["fog", 1], "prevId": None, "nextId": None}
    (d / "books" / "fog" / "manifest.json").write_text(json.dumps({"bookId": "fog", "title": "Fog", "importedAt": "2025-01-01T00:00:00.000Z", "chunkCount": 1, "chunkStats": {"averageChars": 7}, "index": {"status": "built"}, "chunks": [chunk]}))
    (d / "books" / "fog" / "chunks" / "ch000.md").write_text("# One\n\nfog fog\n")
    (d / "books" / "fog" / "search-index.json").write_text(json.dumps({"bookId": "fog", "terms": {"fog": [["ch000", 2], {"chunkId": "ch001", "count": 1}, ["ch002", 0], None]}}))
    (d / "progress.json").write_text(json.dumps({"books": {"fog": {"lastChunkId": "ch000", "lastReadAt": "no time", "currentThemes": [" a ", ""]}}, "recentBooks": [{"localBookId": "fog"}, "x"]}))
    (d / "book-map.json").write_text(json.dumps({"links": [{"wereadBookId": "w1", "wereadTitle": "Fog", "localBookId": "fog", "score": 0.9, "status": "linked", "matchedBy": ["normalizedTitle"]}], "pending": [{"wereadTitle": "Fo", "candidates": [{"localBookId": "fog", "score": 0.75, "matchedBy": []}]}]}))
    (d / "notes" / "fog.md").write_text("# Fog\n\n## 当前理解\n\nx\n")
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.adopt(str(d)) == {"books": 1, "chunks": 1, "postings": 2, "progress": 1, "notes": 1, "links": 1, "pending": 1}
    assert lib.get_chunk("fog", "ch000").first()["text"] == "fog fog" and lib.table("books").first()["imported_at"] == datetime(2025, 1, 1)
    assert lib.table("progress").first()["recency_seq"] == 2 and lib.table("progress").first()["current_themes"] == ["a"]
    assert lib.find_highlight("fog fog", ext_id="w1").values["chunk_id"] == "ch000" and lib.find_highlight("x", title="Fo").action == "pending"
    assert warnings(spark, str(d)).count() == 1
    assert lib.find_book(title="Fog").first()["book_id"] == "fog"
    for args, part in ((["search", "fog", "--all"], "fog / Fog"), (["exact", "--book-id", "fog", "fog fog"], "score 105"), (["list"], "[built]"), (["index", "--all"], "1 terms"), (["link", "--pending"], "fog (0.75)"), (["link", "--title", "Fog"], "linked"), (["--json", "search", "fog", "--all"], '"score"')):
        root = ["--root", str(tmp_path / "lib")]
        assert part in cli.run(lib, cli.parser().parse_args([*root, *args])), args


def test_fields_flags_and_reports(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "fog.txt").write_text("Chapter 1\n\n" + "fog fog lamp lamp. " * 30, encoding="utf-8")
    (d / "void.txt").write_text("x", encoding="utf-8")
    lib = Library(spark, str(tmp_path / "lib"))
    lib.import_books(str(d))
    assert {(r["book_id"], r["problem"]) for r in lib.problems().collect()} == {("fog", "not indexed"), ("void", "not indexed")}
    built = lib.build_index(every=True, max_chunk_ratio=1.0)
    rows = {r["book_id"]: r for r in built.collect()}
    assert rows["fog"]["term_count"] == 2 and rows["fog"]["bytes"] > 10 and rows["fog"]["warning"] is None and rows["void"]["warning"] == "no term is kept"
    assert lib.build_summary(built) == {"succeeded": 1, "failed": 1, "warnings": 1} and lib.problems().count() == 0
    assert '"max_chunk_ratio": 1.0' in lib.table("books").first()["index_options"]
    assert "text_preview" not in lib.search("fog", every=True).columns
    assert len(lib.search("fog", every=True, include_text=True).first()["text_preview"]) > 400 and lib.search_exact("fog fog", every=True, include_text=True).first()["text_preview"].startswith("fog fog")
    book, _, warnings = lib.manifest("fog", include_raw=True)
    assert '"chunk_id": "ch000"' in book.first()["raw"] and not warnings
    lib.update_progress("fog", last_chunk_id="ch000", last_path="chunks/ch000.md", last_section_title="Chapter 1", title="Fog")
    lib.update_progress("fog", next_path="chunks/ch001.md", author="Ann")
    p = lib.progress("fog").first()
    assert (p["last_path"], p["next_path"], p["last_section_title"], p["title"], p["author"]) == ("chunks/ch000.md", "chunks/ch001.md", "Chapter 1", "Fog", "Ann")
    assert "reading_status" not in lib.list_books(include_progress=False).columns and "index_status" not in lib.list_books(include_index_status=False).columns
    assert lib.list_books(include_stats=True).first()["chunk_count"] == 1
    hit = lib.find_highlight("fog fog lamp", book_id="fog", include_chunk=True, max_preview=80)
    assert hit.values["chunk"]["text"].startswith("fog") and len(hit.values["hits"][0]["preview"]) <= 84
    for bad in (lambda: lib.update_progress("fog", note_path="../../x"), lambda: lib.get_chunk("fog", path="../../../x"), lambda: lib.import_books(str(tmp_path / "none")), lambda: lib.import_books(__file__)):
        with pytest.raises(ValueError):
            bad()
    versions = [p for p in (tmp_path / "lib" / "progress").iterdir() if p.is_dir()]
    assert len(versions) == 2 and not [p for p in (tmp_path / "lib" / "progress").iterdir() if p.name.startswith("NEXT")]


def test_many_records_are_linked_in_one_plan(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name in ("fog", "rain tales"):
        (d / f"{name}.txt").write_text("x y z")
    lib = Library(spark, str(tmp_path / "lib"))
    lib.import_books(str(d))
    ext = spark.createDataFrame([("1", "Fog", None), ("2", "Rain", None), ("3", "Snow", None), (None, None, None), ("1", "Fog", None)], "ext_id string, title string, author string")
    got = {r["ext_id"]: (r["action"], r["book_id"]) for r in lib.link_many(ext).collect()}
    assert got["1"] == ("linked", "fog") and got["2"][0] == "pending" and got["3"][0] == "no-match"
    assert lib.table("links").first()["matched_by"] == ["normalizedTitle", "localBookId"] and lib.pending_links().count() == 1
    assert {r["ext_id"]: r["action"] for r in lib.link_many(ext).collect()}["1"] == "reused"


def test_state_stream_keeps_only_what_decides(spark, tmp_path):
    from lectern.operators import state
    from lectern.streaming.ingest import progress_state

    schema = "update_id bigint, book_id string, last_chunk_id string, next_chunk_id string, status string, current_themes array<string>, note_path string, last_read_at timestamp_ntz, received_at timestamp_ntz"
    t = datetime(2025, 1, 1)
    rows = [(n, "b", f"ch{n}", None if n else "chx", "" if n % 2 else "reading", ["a"] if n == 1 else None, None, t.replace(day=1 + n % 9), t) for n in range(30)] + [(99, "c", None, None, None, None, None, None, None), (100, None, "x", None, None, None, None, t, t)]
    src = tmp_path / "src"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(src))
        progress_state(spark, str(src), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = {tuple(map(str, r)) for r in state.latest_progress(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(map(str, r)) for r in spark.read.parquet(str(tmp_path / "out" / "state" / "version=2")).collect()} == want
    assert spark.read.parquet(str(tmp_path / "out" / "deciding" / "version=2")).count() <= 12


def test_a_file_that_cannot_be_read_is_an_error(spark, tmp_path):
    from lectern.sources.folder import read_folder

    (tmp_path / "books" / "e").mkdir(parents=True)
    (tmp_path / "books" / "e" / "manifest.json").write_text('{"bookId": "e", "title": "E"}')
    found = read_folder(spark, str(tmp_path))
    assert found["books"].first()["book_id"] == "e" and found["chunks"].count() == 0 and found["progress"].count() == 0


def test_a_change_writes_only_its_bucket(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    for k in range(4):
        lib.update_progress(f"book{k}", status="reading")
    before = lib._parts("progress")
    lib.update_progress("book0", status="done")
    after = lib._parts("progress")
    assert len(before) == len(after) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert {r["book_id"]: r["status"] for r in lib.table("progress").collect()} == {"book0": "done", "book1": "reading", "book2": "reading", "book3": "reading"}
    lib._remove("progress", spark.createDataFrame([("book1",)], "book_id string"))
    assert lib.table("progress").count() == 3 and lib.progress("book1").isEmpty() and lib.progress("none").isEmpty()
