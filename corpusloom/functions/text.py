"""Text functions over columns, all JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the C locale has it; the explicit class, for \s differs between engines.
SPACE = r"[ \t\n\x0B\f\r]"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"

CHUNK_WORDS, CHUNK_OVERLAP = 250, 40
SNIPPET = 84

# Where a generated answer is cut, and the end of its thinking.
STOPS = ("<|im_end|>", "<|im_start|>", "\nQuestion:", "\nUser:", "\nHuman:", "\n---")
THINK_END = "</think>"


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_SPACE}+")), F.lit(0))


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(NOT_SPACE), F.lit(False))


def chunk_steps(size: int, overlap: int) -> tuple[int, int]:
    """(size, step): a negative overlap counts as 0, one of the size or more as one less."""
    return size, size - min(max(overlap, 0), size - 1)


def chunks(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of words as array<struct(chunk_idx, content, word_count)>; empty for blank and null texts and for
    a size below 1. The last window is the first that reaches the last word."""
    if size <= 0:
        return F.array().cast("array<struct<chunk_idx:int,content:string,word_count:int>>")
    size, step = chunk_steps(size, overlap)

    def windows(ws: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(ws) - size) / F.lit(step))).cast("int")
        starts = F.when(F.size(ws) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last))
        return F.transform(
            starts,
            lambda i: F.struct(
                i.cast("int").alias("chunk_idx"),
                F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " ").alias("content"),
                F.least(F.lit(size), F.size(ws) - i * step).cast("int").alias("word_count"),
            ),
        )

    # The words are bound to a variable: an expression named twice inside a lambda would be split anew for each window.
    return F.flatten(F.transform(F.array(words(F.coalesce(text, F.lit("")))), windows))


def sanitize_controls(text: Column) -> Column:
    """C0 controls but tab, line feed and carriage return become spaces. Valid text only; see sources.extract for bytes."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


#: Valid UTF-8, one byte a character, and then a byte that no sequence holds. Possessive, so that no step is taken back.
_BAD_BYTE = (
    r"\G((?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})*+)[\x80-\xFF]"
)


def repair_utf8(data: Column) -> Column:
    """Bytes as text, with a space for each byte that isn't part of valid UTF-8; null for null. Valid bytes, told by one check,
    are taken as they are; the others are read one byte a character, repaired by one pattern and put together again."""
    bytes_only = F.regexp_replace(F.decode(data, "ISO-8859-1"), _BAD_BYTE, "$1 ")
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.encode(bytes_only, "ISO-8859-1").cast("string"))


def sanitize_bytes(data: Column) -> Column:
    """Bytes as sources.extract.sanitize() reads them, without a Python worker."""
    return sanitize_controls(repair_utf8(data))


_TOKEN = (
    r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<!--(?:-?>|.*?(?:-->|\z))|<[^>]*(?:>|\z)"
    r"|&(?:nbsp|amp|lt|gt|quot|apos|#39);|&|[^<&]+"
)
_DROPPED = r"(?is)^(?:<script|<style|<!--)"

# What tags that break a line start with, and the entities that are decoded.
BLOCK = r"<(?:p|br|div|h[1-6]|li|tr|/p>|/div>|/li>|blockquote)"
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'"}


def html_text(html: Column) -> Column:
    """Text of a web page: scripts, styles and comments go, block tags break lines, seven entities are decoded.

    The page is cut into tokens by one pattern; a break is first a mark, and marks become line feeds where the text so far
    isn't empty and doesn't end in one already.
    """
    html = F.regexp_replace(html, "\x01", " ")
    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))

    def shown(t: Column) -> Column:
        out = F.when(t.rlike(_DROPPED), F.lit("")).when(t.rlike(f"(?is)^{BLOCK}"), F.lit("\x01")).when(t.startswith("<"), F.lit(""))
        for name, char in ENTITIES.items():
            out = out.when(t == name, F.lit(char))
        return out.otherwise(t)

    text = F.array_join(F.transform(tokens, shown), "")
    return F.regexp_replace(F.regexp_replace(text, "(^|\n)\x01+", "$1"), "\x01+", "\n")


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """One line of at most `limit` characters, with runs of white space collapsed and `...` where text is left."""
    flat = F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+", " ")
    return F.concat(F.rtrim(F.substring(flat, 1, limit)), F.when(F.length(flat) > limit, F.lit("...")).otherwise(F.lit("")))


def stop_cut(text: Column, stops: tuple[str, ...] = STOPS) -> Column:
    """The text before the first stop sequence."""
    at = F.least(*[F.nullif(F.locate(s, text), F.lit(0)) for s in stops])
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def think_strip(text: Column) -> Column:
    """What follows the first end of thinking, without white space at its start; trailing white space goes in any case."""
    at = F.locate(THINK_END, text)
    after = F.regexp_replace(F.substring(text, at + len(THINK_END), F.length(text)), f"^{SPACE}+", "")
    return F.regexp_replace(F.when(at > 0, after).otherwise(text), f"{SPACE}+$", "")


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix of two texts; of a group, that of its least and greatest text."""
    n = F.least(F.length(low), F.length(high))
    first = F.filter(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(low, i, F.lit(1)) != F.substring(high, i, F.lit(1)),
    )
    return F.when(F.size(first) > 0, F.substring(low, F.lit(1), F.element_at(first, 1) - 1)).otherwise(F.substring(low, F.lit(1), n))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, _UPPER, _LOWER)


def ilike_contains(column: Column, pattern: str) -> Column:
    """Whether the pattern occurs, the case of A-Z aside; % and _ in it are wildcards and a backslash is a character."""
    return ascii_lower(column).like("%" + pattern.translate(_ASCII_LOWER).replace("\\", "\\\\") + "%")


def find_ignoring_case(text: Column, wanted: str) -> Column:
    """The 0-based place of the first occurrence, the case of A-Z aside; null where there is none, 0 for an empty one."""
    return F.nullif(F.locate(wanted.translate(_ASCII_LOWER), ascii_lower(text)) - 1, F.lit(-1))
