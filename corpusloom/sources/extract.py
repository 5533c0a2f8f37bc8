"""Text of files. Formats are told by extension; what isn't one of them is plain text unless it looks binary."""

from __future__ import annotations

import codecs
import io
import re
import shutil
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.functions.hashing import Fnv1a64
from corpusloom.functions.paths import IGNORED, extension
from corpusloom.functions.text import BLOCK, ENTITIES
from corpusloom.operators.tables import partitions
from corpusloom.schemas import EXTRACTED
from corpusloom.sources.files import open_stream

# Marks of files.
LFS_MARK = b"version https://git-lfs"
PDF_MARK = b"%PDF-"
BINARY_HEAD = 1024

#: Bytes that a stream or member of a file may inflate to; beyond, the file fails.
INFLATED = 256 << 20
#: Bytes of a file that are read at once to hash it, and characters of text that a task hands on at once.
HASHED = 1 << 20
HANDED_ON = 16 << 20

_BLANK = " \t\n\x0b\f\r"
_CONTROLS = bytes(32 if b < 32 and b not in b"\t\n\r" else b for b in range(256))
codecs.register_error("corpusloom.space", lambda e: (" " * (e.end - e.start), e.end))


def sanitize(data: bytes) -> str:
    """Every byte that isn't part of valid UTF-8 and every control but tab and line ends becomes a space."""
    return data.translate(_CONTROLS).decode("utf-8", "corpusloom.space")


def is_binary(data: bytes) -> bool:
    return b"\0" in data[:BINARY_HEAD]


def is_lfs_pointer(data: bytes) -> bool:
    return data.startswith(LFS_MARK)


_HTML = re.compile(
    r"<script.*?(?:</script>|\Z)|<style.*?(?:</style>|\Z)|<!--(?:-?>|.*?(?:-->|\Z))|<[^>]*(?:>|\Z)|&(?:nbsp|amp|lt|gt|quot|apos|#39);", re.I | re.S
)
_BLOCK = re.compile(BLOCK, re.I)


def html_text(html: str) -> str:
    """As functions.text.html_text()."""
    out, at, last = [], 0, ""

    def put(part: str) -> None:
        nonlocal last
        if part:
            out.append(part)
            last = part[-1]

    for m in _HTML.finditer(html):
        put(html[at : m.start()])
        at, token = m.end(), m.group()
        if token.startswith("&"):
            put(ENTITIES.get(token, token))
        elif _BLOCK.match(token) and last not in ("", "\n"):
            put("\n")
    put(html[at:])
    return "".join(out)


def xml_text(xml: str, opening: str, closing: str, breaking: str = "", strip: bool = False) -> str:
    """What stands between tags that start with `opening` and the next `closing`, with five entities decoded; `breaking`
    breaks the line unless it is broken. strip: tags inside go."""
    entities = re.compile("&(?:amp|lt|gt|quot|apos);")
    out: list[str] = []

    def newline() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    tokens = re.compile("|".join(re.escape(t) for t in (breaking, opening) if t))
    at = 0
    while m := tokens.search(xml, at):
        if breaking and m.group() == breaking:
            newline()
            at = m.end()
            continue
        body = xml.find(">", m.start()) + 1
        if not body:
            break
        end = xml.find(closing, body)
        stop = end if end >= 0 else (xml.find("<", body) if "<" in xml[body:] else len(xml))
        text = xml[body:stop]
        if strip:
            text = re.sub("<[^>]*>", "", text)
        if text := entities.sub(lambda e: ENTITIES[e.group()], text):
            out.append(text)
        at = stop if end < 0 else end + len(closing)
        if strip and end >= 0:
            newline()
    return "".join(out)


def _member(data: bytes, name: str) -> str | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _inflated(z, name).decode("utf-8", "replace") if name in z.namelist() else None


def _inflated(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > INFLATED:
        raise ValueError(f"{name} inflates beyond {INFLATED} bytes")
    return z.read(name)


def docx_text(data: bytes) -> str | None:
    xml = _member(data, "word/document.xml")
    return None if xml is None else xml_text(xml, "<w:t", "</w:t>", "</w:p>")


def odt_text(data: bytes, exact: bool = False) -> str | None:
    """Paragraphs on lines of their own and without inner tags. exact: as one run of text with inner tags kept."""
    xml = _member(data, "content.xml")
    return None if xml is None else xml_text(xml, "<text:p", "</text:p>", strip=not exact)


def epub_text(data: bytes) -> str | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = [_inflated(z, n).decode("utf-8", "replace") for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
    return "\n\n".join(map(html_text, pages)) or None


def _strings(content: bytes) -> Iterator[bytes]:
    """Literal strings in balanced parentheses, escapes left as they are."""
    depth = start = at = 0
    while at < len(content):
        c = content[at]
        if depth and c == 0x5C:
            at += 1
        elif c == 0x28:
            depth += 1
            start = at + 1 if depth == 1 else start
        elif c == 0x29 and depth:
            depth -= 1
            if not depth and at > start:
                yield content[start:at]
        at += 1
    if depth and start < len(content):
        yield content[start:]


def pdf_streams_text(data: bytes) -> bytes | None:
    """Strings of all content streams, inflated where their dictionary says so, each followed by a space."""
    out = []
    for m in re.finditer(rb"stream[\r\n]*(.*?)endstream", data, re.S):
        content = m.group(1)
        if b"/FlateDecode" in data[max(0, m.start() - 256) : m.start()] and len(content) > 2:
            inflate = zlib.decompressobj()
            try:
                content = inflate.decompress(content, INFLATED)
            except zlib.error:
                pass
            else:
                if inflate.unconsumed_tail and not inflate.eof:
                    raise ValueError(f"a stream inflates beyond {INFLATED} bytes")
        out += [s + b" " for s in _strings(content)]
    return b"".join(out) or None


def _helper(command: list[str], data: bytes, suffix: str) -> tuple[int, bytes] | None:
    """(exit code, output) of a program on the data as a file, or None where it isn't installed."""
    if not shutil.which(command[0]):
        return None
    with tempfile.NamedTemporaryFile(suffix=suffix) as f:  # read at once by the same worker
        f.write(data)
        f.flush()
        done = subprocess.run([x if x != "{}" else f.name for x in command], capture_output=True, check=False)
    return done.returncode, done.stdout


def pdf_text(data: bytes) -> bytes | None:
    if not data.startswith(PDF_MARK):
        return None
    ran = _helper(["pdftotext", "-q", "-nopgbrk", "{}", "-"], data, ".pdf")
    if ran and ran[0] == 0 and ran[1]:
        return ran[1]
    return pdf_streams_text(data)


def doc_text(data: bytes) -> bytes | None:
    ran = _helper(["antiword", "-t", "{}"], data, ".doc")
    return ran[1] if ran else None


_FORMATS: dict[str, Callable[[bytes], str | bytes | None]] = {
    "pdf": pdf_text,
    "docx": docx_text,
    "odt": odt_text,
    "epub": epub_text,
    "html": lambda d: html_text(d.split(b"\0")[0].decode("utf-8", "surrogateescape")),
    "htm": lambda d: html_text(d.split(b"\0")[0].decode("utf-8", "surrogateescape")),
    "doc": doc_text,
}


def extract(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, None), or (None, why there is none)."""
    ext = extension(path)
    if is_lfs_pointer(data):
        return None, "pointer to a stored file"
    if ext in IGNORED:
        return None, "ignored extension"
    try:
        if ext in _FORMATS:
            raw = _FORMATS[ext](data)
        elif is_binary(data):
            return None, "binary"
        else:
            raw = data.split(b"\0")[0]
    except (zipfile.BadZipFile, KeyError, OSError, ValueError) as e:
        return None, f"{type(e).__name__}: {e}"[:200]
    if raw is None:
        return None, "no text found"
    text = sanitize(raw if isinstance(raw, bytes) else raw.encode("utf-8", "surrogateescape"))
    return (text, None) if text.strip(_BLANK) else (None, "blank")


def _read(path: str) -> bytes | None:
    try:
        with open_stream(path) as f:
            return f.read()
    except OSError:
        return None


def file_hash(path: str) -> str | None:
    """The content hash of a file, read block by block; None where it can't be read."""
    state = Fnv1a64()
    try:
        with open_stream(path) as f:
            while block := f.read(HASHED):
                state.update(block)
    except OSError:
        return None
    return state.hexdigest()


def hash_files(files: DataFrame) -> DataFrame:
    """(path, content_hash) of files (path); a file that can't be read has a null hash. Files are dealt out over tasks and
    read as streams, so a task's memory doesn't depend on their sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"path": part["path"], "content_hash": [file_hash(p) for p in part["path"]]})

    return files.select("path").repartition(partitions(files.sparkSession)).mapInPandas(run, "path string, content_hash string")


def _told(rows: Iterator[tuple[str, str, bytes | None]]) -> Iterator[pd.DataFrame]:
    """What extract() makes of (path, content_hash, data), in batches of bounded size."""
    held: list[tuple] = []
    size = 0
    names = ["path", "content_hash", "text", "error"]
    for path, digest, data in rows:
        text, error = (None, "unreadable") if data is None else extract(path, data)
        held.append((path, digest, text, error))
        size += len(text or "")
        if size >= HANDED_ON:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    yield pd.DataFrame(held, columns=names)


def extract_files(files: DataFrame) -> DataFrame:
    """(path, content_hash) to (path, content_hash, text, error); a task holds one file at a time, and texts up to HANDED_ON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _told((p, h, _read(p)) for part in batches for p, h in zip(part["path"], part["content_hash"], strict=True))

    return files.select("path", "content_hash").mapInPandas(run, EXTRACTED)


def extract_contents(files: DataFrame) -> DataFrame:
    """(path, content_hash, content) to (path, content_hash, text, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _told((p, h, bytes(c)) for part in batches for p, h, c in zip(part["path"], part["content_hash"], part["content"], strict=True))

    return files.select("path", "content_hash", "content").mapInPandas(run, EXTRACTED)
