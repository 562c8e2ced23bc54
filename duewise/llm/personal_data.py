"""Personal data with offsets, in plain and in disguised form.

Plain identifiers are found in the text as it is. For disguised ones a chain of small transducers rewrites the
text (look-alike characters, spelled digits, at/dot forms) and keeps, for each new character, the range of
original characters it stands for; identifiers of the rewritten text that no plain one covers are mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.llm.common import map_rows, schema_with, table
from duewise.llm.registry import query

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number's digits are taken whole, so a failed start need not be tried again inside the run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at) if start < at else None
        if host:
            yield start, host.end()
        # What stands before this sign cannot belong to a later match: the sign is no local character.
        free = host.end() if host else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """Kind, start, end of each plain identifier, by kind and then start; matches that fail a check are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Letters of other scripts that look like ASCII ones.
_LOOK_ALIKES = dict(zip("аеорсхуікѕјԁԛһАВЕКМНОРСТХІЈЅ", "aeopcxyiksjdqhABEKMHOPCTXIJS", strict=True)) | dict(
    zip("οανικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavikptuxABEZHIKMNOPTYX", strict=True)
)
_INVISIBLE = "­​‌‍⁠﻿"
_DASHES = "‐‑‒–−"
_OTHER = re.compile(r"[^\x00-\x7f]+")


def _ascii_of(char: str) -> str | None:
    """The ASCII character, or nothing, that ``char`` is a disguise of; None if it is no disguise."""
    if char in _LOOK_ALIKES:
        return _LOOK_ALIKES[char]
    if char in _INVISIBLE:
        return ""
    if char in _DASHES:
        return "-"
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", char)
    # Widths, styled letters, circled signs: one character that compatibility folding turns into one of ASCII.
    return folded if len(folded) == 1 and "!" <= folded <= "~" else None


# The words for digits and signs.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "dot": ".", "point": ".", "plus": "+", "dash": "-",
}
_WORD = "|".join(_SPELLED)
_RUN = re.compile(rf"(?<!\w)(?:{_WORD}|[0-9]+)(?:[ ,-]{{1,2}}(?:{_WORD}|[0-9]+)){{3,}}(?!\w)", re.I)
_PART = re.compile(rf"(?:{_WORD}|[0-9]+)", re.I)
_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_AT = re.compile(rf"\s?(?:{_OPEN}(?:at|@){_CLOSE})\s?", re.I)
_DOT = re.compile(rf"\s?(?:{_OPEN}(?:dot|\.){_CLOSE})\s?", re.I)
_ATOM = r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+"
_LABELS = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
_ANY_DOT = rf"(?:\s?{_OPEN}(?:dot|\.){_CLOSE}\s?|\s(?:dot|\.)\s)"
_ANY_AT = rf"(?:\s?{_OPEN}(?:at|@){_CLOSE}\s?|\sat\s|\s?@\s?)"
_INNER_DOT = re.compile(_ANY_DOT, re.I)
# A whole local part, and the at and the host where they follow; what it looks ahead to is free for the next match.
_ADDRESS = re.compile(
    rf"{_ATOM}(?:{_ANY_DOT}{_ATOM})*+(?:(?=(?P<at>{_ANY_AT})(?P<host>{_LABELS}(?:{_ANY_DOT}{_LABELS})*+)(?P<more>{_ANY_AT}[A-Za-z0-9]|[_%+])?))?", re.I
)
_TOP = re.compile(r"[A-Za-z]{2,}")
_SPACED = re.compile(r"\s@|@\s|\s\.\s")
_BRACKETED = re.compile(rf"{_OPEN}(?:at|@|dot|\.){_CLOSE}", re.I)

Edit = tuple[int, int, str]


def _apply(text: str, map_: list[tuple[int, int, bool]], edits: list[Edit]) -> tuple[str, list[tuple[int, int, bool]]]:
    """Rewrite ranges of ``text``; the map has, for each character, its original range and whether it was rewritten."""
    out, kept, at = [], [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        kept += map_[at:start]
        if new:
            whole = (map_[start][0], map_[end - 1][1], True)
            kept += [whole] * len(new)
        elif kept:
            # A deleted character belongs to the one before it.
            kept[-1] = (kept[-1][0], map_[end - 1][1], True)
        at = end
    return "".join([*out, text[at:]]), kept + map_[at:]


def _character_edits(text: str) -> list[Edit]:
    edits = []
    for m in _OTHER.finditer(text):
        for i in range(*m.span()):
            new = _ascii_of(text[i])
            if new is not None:
                edits.append((i, i + 1, new))
    return edits


def _digit_edits(text: str) -> list[Edit]:
    edits = []
    for m in _RUN.finditer(text):
        parts = [(p.start(), p.end(), p[0].lower()) for p in _PART.finditer(text, *m.span())]
        if sum(w in _SPELLED and _SPELLED[w].isdigit() for *_, w in parts) < 4:
            continue
        for k, (start, end, word) in enumerate(parts):
            stop = parts[k + 1][0] if k + 1 < len(parts) else end
            edits.append((start, stop, _SPELLED.get(word, word)))
    return edits


def _address_edits(text: str) -> Iterator[Edit]:
    """Signs of addresses in which each at and dot may be plain, spaced, a bare word or in brackets."""
    free = 0
    for m in _ADDRESS.finditer(text):
        # A host with another at or a sign of local parts behind it belongs to a later address.
        if m["at"] is None or m["more"] or m.start() < free:
            continue
        dots = [d.span() for d in _INNER_DOT.finditer(text, *m.span("host"))]
        bounds = [m.start("host"), *(x for d in dots for x in d), m.end("host")]
        pieces = [text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)]
        # What follows the last name that can end a host is not part of it.
        while dots and not _TOP.fullmatch(pieces[-1].rpartition(".")[2]):
            pieces.pop()
            dots.pop()
        labels = ".".join(pieces).split(".")
        while len(labels) > 1 and not _TOP.fullmatch(labels[-1]):
            labels.pop()
        # A bare at before a host in plain form is prose: shop at example.com.
        if len(labels) < 2 or (m["at"].strip().lower() == "at" and not dots):
            continue
        start = m.start()
        inner = [d.span() for d in _INNER_DOT.finditer(text, start, m.start("at"))]
        if start and text[start - 1] == "@":
            # The first piece is the end of a plain address in front.
            inner = inner[1:]
        edits = [(*m.span("at"), "@"), *((a, b, ".") for a, b in inner + dots)]
        free = m.end("host")
        yield from (e for e in edits if text[e[0] : e[1]] != e[2])


def _sign_edits(text: str) -> list[Edit]:
    edits = [(*m.span(), "@") for m in _AT.finditer(text)] + [(*m.span(), ".") for m in _DOT.finditer(text)]
    edits += _address_edits(text)
    edits.sort()
    return [e for k, e in enumerate(edits) if not k or e[0] >= edits[k - 1][1]]


def disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of disguised identifiers that meet no plain one of their kind, in offsets of ``text``."""
    map_ = None
    new = text
    for edits_of in (_character_edits, _digit_edits, _sign_edits):
        if edits_of is _character_edits and new.isascii():
            continue
        if edits_of is _sign_edits and not (_BRACKETED.search(new) or "dot" in new.lower() or _SPACED.search(new)):
            continue
        edits = edits_of(new)
        if edits:
            map_ = map_ or [(i, i + 1, False) for i in range(len(new))]
            new, map_ = _apply(new, map_, edits)
    if map_ is None:
        return []
    out = []
    for kind, start, end in identifiers(new):
        if any(changed for *_, changed in map_[start:end]):
            a, b = map_[start][0], max(x[1] for x in map_[start:end])
            if not any(k == kind and s < b and a < e for k, s, e in plain):
                out.append((kind, a, b))
    return out


SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("plain", T.BooleanType()), T.StructField("value", T.StringType()),
])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_()), ("value", pa.string())])


def spans_of(text: str) -> list[dict]:
    plain = identifiers(text)
    found = [(k, a, b, True) for k, a, b in plain] + [(k, a, b, False) for k, a, b in disguised(text, plain)]
    found.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return [{"kind": k, "start": a, "end": b, "plain": p, "value": text[a:b]} for k, a, b, p in found]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``personal``: kind, start, end (code points, end exclusive), plain or disguised, value.

    Spans are ordered by kind (email, ip, card, phone), then start. A null or empty text has none; a column of
    that name is replaced. Spans of different kinds may overlap.
    """
    kept = docs.drop("personal")
    names = kept.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = pa.array([spans_of(t) if t else [] for t in batch.column("text").to_pylist()], pa.list_(_ARROW_SPAN))
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), spans], names=[*names, "personal"])

    return map_rows(kept, run, schema_with(kept, personal=T.ArrayType(SPAN)))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, plain counts of each kind, base_sha256 of the plain spans, and all spans as one string."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    plain = F.filter("personal", lambda s: s["plain"])

    def count(kind):
        return F.size(F.filter("personal", lambda s: s["plain"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(plain).cast("binary"), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return span_digests(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))
