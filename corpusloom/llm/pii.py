"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, schemes, digits and cues for identifiers. A local
parser per kind grows each anchor to the boundaries of an address or number and validates it. Parsers only look at the
characters around their anchor, so the cost follows the number of anchors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of reports: the base ones, then those that cues and schemes add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account", "tel", "credential", "secret")

# Anchors by what they start.
_SCHEMES = ("mailto:", "tel:", "://")
_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "routing", "Routing", "konto", "Konto", "cuenta", "Cuenta", "compte", "Compte")
_SECRETS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"0*([1-9][0-9]*|0)")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"(?: (?:no|nr|number|num|id)\b)?[.:#= ]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9A-Za-z])")
_NUMBER = re.compile(r"\+?[0-9](?:[ ().-]*[0-9]){7,14}(?![0-9])")
_ASSIGNED = re.compile(r"""["']? ?[:=] ?["']?([A-Za-z0-9_+/=.-]{16,})""")
_AUTHORITY = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")


@lru_cache(maxsize=1)
def anchors():
    """The automaton: digits and signs have their own letter, schemes and cues a kind."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for digit in "0123456789":
        made.add_word(digit, ("digit", 1))
    hidden = [(form(word), "secret") for word in _SECRETS for form in (str.lower, str.title, str.upper)]
    for word, kind in (*hidden, ("@", "at"), ("+", "plus"), *((s, s) for s in _SCHEMES), *((c, "cue") for c in _CUES)):
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits are right: the rearranged number is 1 modulo 97."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points by kind, in order and without overlaps within a kind; a null text has none."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    if not text:
        return found
    done = dict.fromkeys(found, 0)  # where the parser of a kind goes on
    for last, (kind, width) in anchors().iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= done["ip"]:
                _addresses(text, at, found["ip"], done)
            if at >= done["card"]:
                _card(text, at, found["card"], done)
            if at >= done["iban"] and at >= 2:
                _iban(text, at, found["iban"], done)
        elif kind == "at":
            _email(text, at, found["email"], done)
        elif kind == "plus":
            if at >= done["phone"] and (m := _DIALLED.match(text, at)):
                done["phone"] = m.end()
                if 8 <= len(_digits(m.group())) <= 15:
                    found["phone"].append(m.span())
        elif kind == "cue":
            if at >= done["account"] and not text[at - 1 : at].isalpha() and (m := _ACCOUNT.match(text, last + 1)):
                done["account"] = m.end(1)
                found["account"].append(m.span(1))
        elif kind == "secret":
            if at >= done["secret"] and (m := _ASSIGNED.match(text, last + 1)):
                done["secret"] = m.end(1)
                found["secret"].append(m.span(1))
        elif kind == "tel:":
            if not text[max(0, at - 1) : at].isalnum() and (m := _NUMBER.match(text, last + 1)):
                found["tel"].append(m.span())
        elif kind == "://" and (m := _AUTHORITY.match(text, last + 1)):
            found["credential"].append((last + 1, m.group().rindex("@") + last + 1))
    return found


def _email(text: str, at: int, found: list, done: dict) -> None:
    """Grows left over the local part, not past the last match, and right over a domain with a dot."""
    start, stop = at, done["email"]
    while start > stop and _LOCAL.match(text, start - 1):
        start -= 1
    if start < at and (m := _DOMAIN.match(text, at + 1)):
        found.append((start, m.end()))
        done["email"] = m.end()


def _addresses(text: str, at: int, found: list, done: dict) -> None:
    """A chain of numbers joined by dots holds an address in every four; the rest of it holds none."""
    done["ip"] = (chain := _DOTTED.match(text, at)).end()
    start, four = at, []
    for m in _PART.finditer(text, at, chain.end()):
        four.append(m)
        if len(four) == 4:
            if all(x.end(1) - x.start(1) <= 3 and int(x[1]) <= 255 for x in four):
                found.append((start, m.end()))
            start, four = m.end() + 1, []


def _card(text: str, at: int, found: list, done: dict) -> None:
    if m := _GROUPED.match(text, at):
        done["card"] = m.end()
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    else:
        done["card"] = at + 1


def _iban(text: str, at: int, found: list, done: dict) -> None:
    """Two capitals before a digit open a number whose length is the longest, up to 34, with right check digits."""
    start = at - 2
    if start < done["iban"] or not (text[start:at].isascii() and text[start:at].isupper()) or text[max(0, start - 1) : start].isalnum():
        return
    if m := _IBAN.match(text, start):
        body = m.group()
        for end in range(len(body), 14, -1):
            if body[end - 1] != " " and (end == len(body) or not body[end].isalnum()) and iban(body[:end].replace(" ", "")):
                found.append((start, start + end))
                done["iban"] = start + end
                return


def digest(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """kind:start:end of the kinds in their order, then by start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str | None) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans count as one, of the first kind."""
    spans = sorted((a, b, k) for k, all_of in find(text).items() for a, b in all_of)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join(out) + (text or "")[at:]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(t) for t in batch.column(1).to_pylist()]
        counts = [pa.array([len(x[k]) for x in found], pa.int64()) for k in BASE]
        base = pa.array([hashlib.sha256(digest(x, BASE).encode()).hexdigest() for x in found], pa.string())
        spans = pa.array([digest(x, BASE + ADDED) for x in found], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, spans], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row, in one pass without a shuffle.

    Null and empty texts have no spans; repeated rows are reported each; an empty table gives an empty table.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the text column redacted; every row and column stays, null and empty texts as they are, repeated rows too."""
    @F.pandas_udf("string")
    def clean(part: pd.Series) -> pd.Series:
        return part.map(lambda t: redact(t) if t else t)

    return docs.withColumn(text, clean(F.col(text)))
