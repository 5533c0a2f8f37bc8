import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import pytest

from corpusloom.config import Config
from corpusloom.functions.hashing import BLOCK, Fnv1a64, fnv1a64
from corpusloom.operators.store import Index
from corpusloom.plans.ingest import ingest
from corpusloom.sources import extract, files

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("size", [0, 1, 2, 255, 4097, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7])
def test_stream_hash_equals_the_plain_one(size):
    data = random.Random(size).randbytes(size)
    assert Fnv1a64().update(data).state == fnv1a64(data)
    pieces, at = Fnv1a64(), 0
    for step in (1, 0, 100, BLOCK, size):
        pieces.update(data[at : at + step])
        at += step
    assert pieces.hexdigest() == f"{fnv1a64(data):016x}"
    assert Fnv1a64(pieces.state).update(b"more").state == fnv1a64(data + b"more")


def test_zeros_and_ones():
    for data in (b"\0" * 5000, b"\xff" * 5000, b"\x00\xff" * 2500):
        assert Fnv1a64().update(data).state == fnv1a64(data)


def test_large_files_hash_in_little_memory(tmp_path):
    """Memory grows by less than 100 MB over a sparse file of 256 MB."""
    with open(tmp_path / "big.txt", "wb") as f:
        f.truncate(256 << 20)
    code = (
        "import resource, sys; from corpusloom.sources.extract import file_hash\n"
        "peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10\n"
        "file_hash(sys.argv[2]); before = peak(); print(file_hash(sys.argv[1]), peak() - before)"
    )
    (tmp_path / "small.txt").write_bytes(b"x" * 3_000_000)
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "big.txt"), str(tmp_path / "small.txt")], capture_output=True, check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}).stdout.split()
    # A zero byte multiplies the state by the prime.
    assert out[0].decode() == f"{14695981039346656037 * pow(1099511628211, 256 << 20, 1 << 64) % (1 << 64):016x}" and int(out[1]) < 100


def test_many_files_in_nested_folders(spark, tmp_path):
    n = 10_000
    for i in range(n):
        folder = tmp_path / "in" / f"a{i % 7}" / f"b{i % 31}" / ("c" if i % 2 else "_d")
        if i < 500:
            folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{'_' if i % 5 == 0 else ''}f{i}.{'TXT' if i % 3 else 'md'}").write_text(f"text {i}")
    (tmp_path / "in" / "a0" / "skip.py").write_text("x")
    found = files.list_files(spark, f"file://{tmp_path}/in")
    rows = found.collect()
    assert len(rows) == n and all(r["path"].startswith(f"file://{tmp_path}/in/a") for r in rows) and sum(r["size"] for r in rows) == sum(len(f"text {i}") for i in range(n))
    hashed = {r["path"].rsplit("f", 1)[1].split(".")[0]: r["content_hash"] for r in extract.hash_files(found).collect()}
    assert len(hashed) == n and all(hashed[str(i)] == f"{fnv1a64(f'text {i}'.encode()):016x}" for i in range(0, n, 97))


def test_single_files_missing_paths_and_links(spark, tmp_path):
    (tmp_path / "one.md").write_text("x")
    (tmp_path / "one.py").write_text("x")
    listed = lambda p: [r["path"] for r in files.list_files(spark, p).orderBy("path").collect()]
    assert listed(f"{tmp_path}/one.md") == [f"{tmp_path}/one.md"] and listed(f"file://{tmp_path}/one.py") == []
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"file://{tmp_path}/gone")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "z.txt").write_text("z")
    os.symlink(tmp_path / "deep" / "er", tmp_path / "aside")  # one folder by two ways: the shorter one counts
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.txt")
    assert listed(str(tmp_path)) == [f"{tmp_path}/aside/z.txt", f"{tmp_path}/one.md"]


def test_ingest_through_a_file_system_of_spark(spark, tmp_path):
    """viewfs is known to Spark's JVM only."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "apples grow"), ("sub/b.html", "<p>bananas</p>"), (".hidden.txt", "no"), ("c.py", "no"), ("d.txt", " ")):
        (tmp_path / "in" / name).write_text(text)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.loomtest.link./in", f"file://{tmp_path}/in")
    c = Config(index_path=f"file://{tmp_path}/kb", embed_dimension=8)
    one = ingest(spark, "viewfs://loomtest/in", c)
    assert (one.docs, one.chunks, one.failed) == (2, 2, 1)
    index = Index(spark, c.index_path, 8)
    assert {r["path"] for r in index.documents().collect()} == {"viewfs://loomtest/in/a.txt", "viewfs://loomtest/in/sub/b.html"}
    assert {r["content"] for r in index.chunks().collect()} == {"apples grow", "bananas"}
    two = ingest(spark, "viewfs://loomtest/in", c)
    assert (two.docs, two.skipped, two.failed) == (0, 2, 1)


def test_what_inflates_too_far_fails(monkeypatch):
    monkeypatch.setattr(extract, "INFLATED", 1000)
    body = zlib.compress(b"(" + b"a" * 5000 + b")")
    pdf = b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream"
    text, error = extract.extract("x.pdf", pdf)
    assert text is None and "inflates beyond 1000 bytes" in error


@pytest.mark.parametrize("name, ext, data, want", [("pdftotext", "pdf", b"%PDF-1.4 x", "told by the helper"), ("antiword", "doc", b"anything", "told by the helper")])
def test_helpers_on_the_path(tmp_path, monkeypatch, name, ext, data, want):
    """A program's output is the text; one that fails or says nothing is passed over."""
    program = tmp_path / name
    program.write_text('#!/bin/sh\nfor f in "$@"; do [ -s "$f" ] && echo "told by the helper"; done; exit 0\n')
    program.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert extract.extract(f"x.{ext}", data) == (want + "\n", None)
    program.write_text("#!/bin/sh\nexit 3\n")
    stream = b"%PDF-1.4\nstream\n(plain)\nendstream" if ext == "pdf" else data
    assert extract.extract(f"x.{ext}", stream) == (("plain ", None) if ext == "pdf" else (None, "blank"))
    monkeypatch.setenv("PATH", "/nowhere")
    assert extract.extract(f"x.{ext}", stream) == (("plain ", None) if ext == "pdf" else (None, "no text found"))
