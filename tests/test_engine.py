import io
import logging
import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom import config as settings
from corpusloom.config import Config
from corpusloom.functions import generation as G
from corpusloom.log import close_log, open_log
from corpusloom.operators import catalog, complete, knn, numbering, store
from corpusloom.operators.store import Index, delete_chunks
from corpusloom.plans.ask import answers, ask, cited, hits_for
from corpusloom.plans.ingest import ingest
from corpusloom.sources import extract
from corpusloom.sources.files import list_files
from corpusloom.streaming.landing import ingest_rows, ingest_stream


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_sanitising_bytes():
    rows = [(b"Plain", "Plain"), ("Café & München & 📚".encode(), "Café & München & 📚"), (b"a\x80b", "a b"), (b"\xc0\x80", "  "), (b"\xed\xa0\x80", "   "),
            (b"\xf4\x90\x80\x80", "    "), (b"\x01\x02\t\n\r\x7f", "  \t\n\r\x7f"), (b"\xe2\x82", "  ")]
    for raw, want in rows:
        assert extract.sanitize(raw) == want and len(extract.sanitize(raw).encode()) == len(raw)
    draw = random.Random(2)
    for _ in range(500):
        raw = bytes(draw.choice([65, 0x80, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x93, 0x9A, 0xED, 0xA0]) for _ in range(12))
        assert len(extract.sanitize(raw).encode()) == len(raw)


def test_formats():
    docx = zipped(word__document_dot_xml="<w:p><w:t>One &amp; a</w:t><w:tab/><w:t xml:space='x'>b</w:t></w:p><w:p><w:t>Two</w:t></w:p>")
    assert extract.extract("a.docx", docx)[0].splitlines()[0].startswith("One & a")
    odt = zipped(content_dot_xml="<text:p>One <text:span>in</text:span></text:p><text:p>Two</text:p>")
    assert extract.odt_text(odt) == "One in\nTwo\n"
    assert extract.odt_text(odt, exact=True) == "One <text:span>in</text:span>Two"
    epub = zipped(b_dot_xhtml="<p>B</p>", a_dot_html="<p>A</p>", c_dot_css="x")
    assert extract.extract("x.epub", epub)[0] == "B\n\n\nA\n"
    body = b"BT (Hello \\( there) Tj ((nested) x) Tj ET"
    pdf = b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >>\nstream\n" + zlib.compress(body) + b"\nendstream\nstream\n(plain)\nendstream"
    assert extract.pdf_streams_text(pdf) == b"Hello \\( there (nested) x plain "
    assert extract.extract("x.html", b"<p>a</p>\0gone") == ("a\n", None)
    assert extract.extract("x.rtf", b"{\\rtf1 hi}") == ("{\\rtf1 hi}", None)
    assert extract.extract("x.dat", b"a\0b") == (None, "binary")
    assert extract.extract("x.zip", b"text") == (None, "ignored extension")
    assert extract.extract("x.pdf", b"version https://git-lfs.github.com/spec/v1")[0] is None
    assert extract.extract("x.txt", b" \n\t") == (None, "blank")
    assert extract.extract("x.docx", b"no zip")[0] is None
    assert extract.extract("x.pdf", b"no pdf")[0] is None


def test_collecting_files(spark, tmp_path):
    collect = lambda path: sorted(r["path"] for r in list_files(spark, path).collect())
    for name in ("_a.md", ".b.md", "B.PDF", "node_modules/c.md", "__pycache__/d.md", "sub/e.txt", "noext", "f.py"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    assert [os.path.relpath(p, tmp_path) for p in collect(str(tmp_path))] == ["B.PDF", "_a.md", "sub/e.txt"]
    assert collect(f'"{tmp_path}/f.py"') == []
    with pytest.raises(FileNotFoundError):
        collect(str(tmp_path / "gone"))


def test_settings(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    assert settings.load() == Config()
    c = Config(index_path="x/y", embed_dimension=8, similarity_threshold=0.7, chunk_size_words=9, chunk_overlap_words=0)
    settings.save(c, str(tmp_path / "deep" / "f.toml"))
    assert settings.load(str(tmp_path / "deep" / "f.toml")) == c
    bad = tmp_path / "corpusloom.toml"
    bad.write_text("[embedder]\nchunk_size_words = 0\nchunk_overlap_words = -1\ndimension = 'x'\n[system]\nlog_path = 'l'\n")
    assert settings.load() == Config(log_path="l")
    bad.write_text("[")
    with pytest.raises(settings.ConfigError):
        settings.load()
    with pytest.raises(OSError):
        settings.load("gone.toml")


def test_log_levels(tmp_path):
    log = open_log(str(tmp_path / "x.log"))
    for level in (logging.DEBUG, logging.INFO, logging.WARNING, logging.ERROR):
        log.log(level, "line")
    close_log(log)
    assert [x.split("[")[2].split("]")[0] for x in (tmp_path / "x.log").read_text().splitlines()] == ["INFO", "WARNING", "ERROR"]


@pytest.fixture
def library(tmp_path):
    texts = {"a.txt": "Apples grow on trees in the orchard.", "b.txt": "Bananas are yellow and grow in bunches.", "c.md": "The moon orbits the earth.", "d.txt": ""}
    for name, text in texts.items():
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    return tmp_path


def test_ingest_twice_change_duplicate_and_ask(spark, library):
    c = Config(index_path=f"file://{library}/kb", similarity_threshold=0.3, confidence_threshold=0.1)
    one = ingest(spark, str(library / "in"), c)
    assert (one.docs, one.chunks, one.skipped, one.failed) == (3, 3, 0, 1)
    two = ingest(spark, str(library / "in"), c)
    assert (two.docs, two.chunks, two.skipped, two.failed) == (0, 0, 3, 1)
    (library / "in" / "e.txt").write_text((library / "in" / "a.txt").read_text())
    (library / "in" / "c.md").write_text("The sun is a star. " * 200)
    three = ingest(spark, str(library / "in"), c)
    assert (three.docs, three.skipped, three.failed) == (1, 3, 1) and three.chunks == 5
    index = Index(spark, c.index_path)
    listed = {r["path"].rsplit("/", 1)[1]: (r["id"], r["chunk_count"]) for r in catalog.list_documents(index.documents(), index.chunks()).collect()}
    assert listed == {"a.txt": (1, 1), "b.txt": (2, 1), "c.md": (3, 5), "e.txt": (4, 0)}
    assert index.chunks().select("id").distinct().count() == index.chunks().count() == 7
    assert catalog.resolve(index.documents(), "C.MD") == 3 and catalog.resolve(index.documents(), "12") == 12 and catalog.resolve(index.documents(), "zz") is None
    assert [r["chunk_idx"] for r in catalog.document_chunks(index.chunks(), 3, 2).collect()] == [0, 1]

    found = {r["question_id"]: r for r in ask(spark, ["Where do apples grow", "qqq zzz xxx"], c).collect()}
    assert "Apples" in found[0]["text"], found
    assert not found[0]["is_refusal"] and 0 < found[0]["confidence"] <= 1
    assert found[1]["is_refusal"] and found[1]["reason"].startswith("Stage 1 Refusal") and found[1]["text"] == G.NO_KNOWLEDGE
    shown = cited(hits_for(spark, ["Where do apples grow"], c), 0.3).orderBy("ref").collect()
    assert shown[0]["path"].endswith("a.txt") and shown[0]["similarity"].endswith("%")


def test_reset_and_dimensions(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/kb", 4).open()
    docs = spark.sql("SELECT 1L AS id, 'docs/fresh.txt' AS path, 'h' AS content_hash, current_timestamp() AS created_at")
    chunks = spark.sql("SELECT 1L AS id, 1L AS doc_id, 0 AS chunk_idx, 'Fresh chunk content' AS content, array(0.5f, 0.5f, 0.5f, 0.5f) AS embedding")
    index.publish(docs, chunks)
    assert catalog.list_documents(index.documents(), index.chunks(), "fresh").count() == 1
    assert catalog.list_documents(index.documents(), index.chunks(), "nonexistent").count() == 0
    assert catalog.document_chunks(index.chunks(), 1).first()["word_count"] == 3
    with pytest.raises(Exception, match="dimension"):
        index.publish(docs, chunks.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert tuple(catalog.stats(index.documents(), index.chunks()).first()) == (1, 1)  # the failed version never went live
    assert delete_chunks(index.chunks(), index.documents().withColumnRenamed("id", "doc_id")).count() == 0
    with pytest.raises(PermissionError):
        index.reset()
    index.reset(force=True, dimension=8)
    assert tuple(catalog.stats(index.documents(), index.chunks()).first()) == (0, 0)
    with pytest.raises(ValueError, match="dimensions"):
        Index(spark, index.path, 4).open()


def test_refusals_need_no_generator(spark):
    class Never:
        def generate(self, prompt):
            raise AssertionError

    schema = "question_id long, question string, rank int, path string, content string, similarity double"
    hits = spark.createDataFrame([(0, "q", None, None, None, None), (1, "q", 1, "p", "c", 0.42)], schema)
    found = {r["question_id"]: r for r in answers(hits, Never).collect()}
    assert found[0]["confidence"] == 0.0 and found[1]["confidence"] == pytest.approx(0.42)
    assert found[1]["reason"] == "Stage 1 Refusal: Best similarity 0.420 < threshold 0.650"


def test_landing_zone(spark, tmp_path):
    c = Config(index_path=f"file://{tmp_path}/kb", embed_dimension=16)
    rows = spark.createDataFrame([("p1", "one text"), ("p2", "one text"), ("p3", "  "), ("p4", None)], "path string, text string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        ingest_stream(stream, c, f"{tmp_path}/check").awaitTermination()
    index = Index(spark, c.index_path, 16)
    assert tuple(catalog.stats(index.documents(), index.chunks()).first()) == (2, 1)
    assert ingest_rows(index, rows, c).docs == 0


def test_completion_and_history(tmp_path):
    assert "/quit" not in complete.commands("/") and complete.commands("/q") == ["/quit"] and len(complete.commands("")) == 12
    for name in ("b.txt", "a.txt", ".hid"):
        (tmp_path / name).write_text("x")
    (tmp_path / "zdir").mkdir()
    assert [p.removeprefix(str(tmp_path)) for p, _ in complete.paths(f"{tmp_path}/")] == ["/zdir/", "/a.txt ", "/b.txt "]
    assert complete.paths(f"{tmp_path}/.h")[0][1] is False and complete.paths("/none/x") == []
    history = complete.History(str(tmp_path / "h" / "lines"))
    for line in ("/help", "/stats", "/stats", "What?", ""):
        history.add(line)
    assert complete.History(str(tmp_path / "h" / "lines")).lines == ["/help", "/stats", "What?"]


def test_lookups(spark):
    docs = spark.createDataFrame([(3, "b", "h"), (2, "a", "h"), (4, "c", None), (5, "d", "")], "id long, path string, content_hash string")
    assert catalog.find_by_path(docs, "b") == 3 and catalog.find_by_path(docs, "z") is None
    assert catalog.find_by_hash(docs, "h") == 2 and catalog.find_by_hash(docs, "q") is None
    assert [catalog.hash_of(docs, p) for p in "bcdz"] == ["h", None, None, None]


def test_command_line(spark, library, capsys, monkeypatch):
    from corpusloom import cli

    monkeypatch.setenv("XDG_CONFIG_HOME", str(library / "cfg"))
    c = Config(index_path=f"file://{library}/kb2", similarity_threshold=0.3, confidence_threshold=0.1)
    lines = ["/help", "/nope", f"/ingest '{library}/in'", "/stats", "/docs A.TXT", "/chunks b.txt", "/reset", "Where do apples grow", "/exit", "/docs"]
    cli._chat(spark, c, lines)
    out = capsys.readouterr()
    assert "3 documents, 3 chunks stored" in out.out and "documents: 3" in out.out and "a.txt" in out.out and "Bananas are" in out.out
    assert "Apples grow on trees" in out.out and "unknown command /nope" in out.err and "force" in out.err
    assert (library / "cfg" / "corpusloom" / "history").exists()


def test_writes_follow_the_change(spark, library):
    """Unchanged files publish nothing and leave the caller's cache alone; a changed one writes its own chunks only."""
    mine = spark.range(7).cache()
    assert mine.count() == 7
    c = Config(index_path=f"file://{library}/kb")
    ingest(spark, str(library / "in"), c)
    index = Index(spark, c.index_path)
    before = index.version
    folders = set(p.name for p in (library / "kb").iterdir())
    ingest(spark, str(library / "in"), c)
    assert index.version == before and set(p.name for p in (library / "kb").iterdir()) == folders
    assert mine.storageLevel.useMemory
    mine.unpersist()
    (library / "in" / "c.md").write_text("The moon is not a star. " * 10)
    other = {tuple(r) for r in index.chunks().filter("doc_id <> 3").select("id", "doc_id", "content").collect()}
    ingest(spark, str(library / "in"), c)
    fresh = set(p.name for p in (library / "kb").iterdir()) - folders
    assert index.version == before + 1 and sorted(f.split("-")[0] for f in fresh) == ["chunks", "documents", "gone"]
    written = spark.read.parquet(*[f"file://{library}/kb/{f}" for f in fresh if f.startswith("chunks")])
    assert {r["doc_id"] for r in written.collect()} == {3}
    assert {tuple(r) for r in index.chunks().filter("doc_id <> 3").select("id", "doc_id", "content").collect()} == other
    assert index.chunks().filter("doc_id = 3").count() == written.count()


def test_second_writer_gives_up_and_segments_are_compacted(spark, tmp_path, monkeypatch):
    index = Index(spark, f"file://{tmp_path}/kb", 2).open()
    docs = spark.sql("SELECT 1L AS id, 'a' AS path, 'h' AS content_hash, current_timestamp() AS created_at")
    chunk = lambda i: spark.sql(f"SELECT {i}L AS id, 1L AS doc_id, 0 AS chunk_idx, 'text {i}' AS content, array(0.6f, 0.8f) AS embedding")
    monkeypatch.setattr(store, "TIER", 3)
    for i in range(1, 5):
        index.append(docs, chunk(i), docs.select(F.col("id").alias("doc_id")))
        assert [r["content"] for r in index.chunks().collect()] == [f"text {i}"] and len(index._live()["chunks"]) <= 3
    live = index._live()
    index.append(docs, chunk(9), docs.select(F.col("id").alias("doc_id")))
    with pytest.raises(RuntimeError, match="another writer"):
        index._commit(live["version"], live)


def test_null_and_odd_queries(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    asked = lambda rows: spark.createDataFrame(rows, "query_id long, embedding array<float>")
    found = knn.search(asked([(1, None), (2, [1.0, 0.1]), (3, [0.0, 0.0])]), corpus, 1).collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(2, 1)]
    assert knn.search(asked([(1, None)]), corpus).count() == 0
    with pytest.raises(ValueError, match="different widths"):
        knn.search(asked([(1, [1.0]), (2, [1.0, 0.0])]), corpus)


def test_numbered_by_strings(spark):
    keys = [f"k{i * 7919 % 500:04}" for i in range(500)] + [None, None]
    found = numbering.numbered(spark.createDataFrame([(k,) for k in keys], "k string"), "k", ranges=7).collect()
    assert [r["k"] for r in sorted(found, key=lambda r: r["rn"])] == sorted(keys, key=lambda k: (k is not None, k or ""))
