"""Secret scan: an Aho-Corasick keyword pass, anchored patterns only at its hits,
then validation of embedded checksums.

Base kinds (leftmost, not overlapping within a kind; failing matches are dropped):
``assign`` (keyword, sign and a value of 12 characters or more), ``access`` (key
ids of 18 or more) and ``hex`` (runs of 16 or more).  Runs of hex digits have no
keyword; one automaton pass over a whole batch picks the texts that hold one.
Added kinds, each kept only when it validates: ``github`` and ``npm`` tokens, whose
last six characters are the base-62 CRC-32 of the thirty before, and ``jwt``, whose
first two parts decode to JSON objects, the first naming an algorithm.

Spans are code points, end exclusive.  Null texts count as empty; repeated rows
give repeated results; a very long text is scanned whole; a claim set nested too
deeply to be read is none; an empty table gives no rows.  The scan reads doc_id and
text alone; redaction keeps every other column as it is, but for n_chars.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawise.llm.common import doc_texts, released, slices

#: The kinds in their order, keywords, patterns and the checksum alphabet.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "jwt": ("eyj",)}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
}
BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def checksum_62(text: str) -> str:
    """Six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE_62[digit] + out
    return out


def _decoded(part: str) -> dict | None:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # deeply nested JSON is no claim set
        return None
    return found if isinstance(found, dict) else None


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind in ("github", "npm"):
        return checksum_62(m[1]) == m[2]
    if kind == "jwt":
        return "alg" in (_decoded(m[1]) or ()) and _decoded(m[2]) is not None
    return True


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str, keywords, may_have_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, in order."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter that grows would shift what follows
        lower = text.translate(_LOWER)
    found, ends = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in keywords.iter(lower))
    for start, kind in hits:
        if start >= ends[kind] and (m := PATTERNS[kind].match(text, start)):
            ends[kind] = m.end()
            if _valid(kind, m):
                found.append((start, KINDS.index(kind), m.end()))
    if may_have_hex:
        found += [(m.start(), KINDS.index("hex"), m.end()) for m in PATTERNS["hex"].finditer(text)]
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "<secret>") -> str:
    """The text with every stretch under a span replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanned(texts: pa.Array, keywords) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    hexed = pc.match_substring_regex(texts, "[0-9a-f]{16}").to_pylist()
    for text, may in zip(texts.to_pylist(), hexed, strict=True):
        yield text, scan(text, keywords, may)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_validated."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            for piece in slices(batch):
                rows = [s for _, s in _scanned(piece.column("text"), keywords)]
                counts = [[sum(k == i for _, k, _ in s) for s in rows] for i in range(3)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "n_assign": pa.array(counts[0], pa.int64()), "n_access": pa.array(counts[1], pa.int64()), "n_hex": pa.array(counts[2], pa.int64()),
                    "base_sha256": pa.array([hashlib.sha256(_joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in rows], pa.string()),
                    "spans": pa.array([_joined(s) for s in rows], pa.string()), "n_validated": pa.array([sum(k > 2 for _, k, _ in s) for s in rows], pa.int64()),
                })

    return doc_texts(docs).mapInArrow(released(find), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_validated long")


def redact_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The same rows and columns with secrets replaced in ``text``; null texts stay null."""
    schema = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            for piece in slices(batch):
                at = piece.schema.get_field_index("text")
                texts = piece.column(at)
                clean = [None if null else redact(t, s, mark) for null, (t, s) in zip(texts.is_null().to_pylist(), _scanned(texts.fill_null(""), keywords), strict=True)]
                yield piece.set_column(at, piece.schema.field(at), pa.array(clean, texts.type))

    out = docs.mapInArrow(released(rewrite), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
