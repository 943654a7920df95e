"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Three patterns give the base spans. Beyond them, candidate strings (runs of token characters) are searched with a
window of fixed length per character class: the window's Shannon entropy is kept by incremental counts as it slides,
windows at or above the class's threshold are merged into spans, and spans that fit the allow-list are suppressed.
Windows that overlap a placeholder don't count; what stands beside it is searched all the same.

Positions are code points of the whole text, ends exclusive. Edge cases: a null text is empty; a text of any length is
scanned whole, with work in proportion to its length; texts are scanned one by one, so repeated rows get equal spans;
an empty table gives an empty result; other columns are kept by ``redacted`` and not read by ``scanned``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _text
from ._store import Scratch, lean

#: Fixed patterns and least lengths of what they must find.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
NEEDLES = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Window length, and per class its characters and least entropy in bits a character.
WINDOW = 24
CLASSES = (
    ("entropy_hex", re.compile(rb"[0-9A-Fa-f]{24,}"), 3.0),
    ("entropy_base64", re.compile(rb"[A-Za-z0-9+/_-]{24,}"), 4.0),
)
#: Strings of these forms are no secrets: one kind of character only, a repeated short unit, paths of lower-case words.
ALLOW = re.compile(rb"[A-Za-z/_=+-]+|[0-9/_=+-]+|(.{1,4})\1+.{0,3}|(?:[/_-]?[a-z]++|[/_-][0-9]++)+", re.DOTALL)
#: What makes a word a placeholder, if it isn't longer than two windows. In longer ones it may stand by chance.
PLACEHOLDER = re.compile(rb"EXAMPLE|example|XXXX|xxxx|1234567890|abcdefgh")
WORD = re.compile(rb"[A-Za-z0-9]+")
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_CLOG = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]

Span = tuple[str, int, int]


def runs_of(mask: np.ndarray, n: int) -> np.ndarray:
    """Starts of all stretches of n set places."""
    have, step = mask, 1
    while 2 * step <= n:
        have = have[:-step] & have[step:] if len(have) > step else have[:0]
        step *= 2
    rest = n - step
    if rest:
        have = have[:-rest] & have[rest:] if len(have) > rest else have[:0]
    return np.flatnonzero(have)


def entropy_spans(text: bytes, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of at least that entropy. One step changes two counts, so it costs the same at any length."""
    counts, total, out = [0] * 256, 0.0, []
    log = math.log2(window)
    for i, c in enumerate(text):
        total += _CLOG[counts[c] + 1] - _CLOG[counts[c]]
        counts[c] += 1
        if i >= window - 1:
            if log - total / window >= least:
                if out and out[-1][1] >= i - window + 1:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i - window + 1, i + 1))
            gone = text[i - window + 1]
            total += _CLOG[counts[gone] - 1] - _CLOG[counts[gone]]
            counts[gone] -= 1
    return out


def _base(text: bytes, kinds: int) -> list[Span]:
    out = []
    if kinds & 1:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if kinds & 2:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    if kinds & 4:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_MIN]
    return out


def unplaced(run: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, string) of what lies between the placeholders of a candidate string, where windows fit in."""
    at = 0
    if PLACEHOLDER.search(run):
        for word in WORD.finditer(run):
            short = len(word[0]) <= 2 * WINDOW
            for m in PLACEHOLDER.finditer(run, word.start(), word.end()):
                lo, hi = word.span() if short else m.span()
                if lo - at >= WINDOW:
                    yield at, run[at:lo]
                at = hi
    if len(run) - at >= WINDOW:
        yield at, run[at:]


def _entropy(text: bytes) -> list[Span]:
    out: list[Span] = []
    for kind, candidates, least in CLASSES:
        for m in candidates.finditer(text):
            if ALLOW.fullmatch(m[0]):
                continue
            for at, part in unplaced(m[0]):
                for lo, hi in entropy_spans(part, least):
                    found = part[lo:hi]
                    if not ALLOW.fullmatch(found) and re.search(rb"[0-9]", found) and re.search(rb"[A-Za-z]", found):
                        out.append((kind, m.start() + at + lo, m.start() + at + hi))
    return out


def spans_of(texts: pa.Array) -> Iterator[tuple[int, list[Span], list[Span]]]:
    """(row, base spans, further spans) in code points, for the rows that have any."""
    for first, buf, offs in _text.chunks(texts):
        raw = buf.tobytes()
        low = _text.lowered(buf).tobytes()
        kinds: dict[int, int] = {}

        def mark(at: np.ndarray, bit: int, offs: np.ndarray = offs, kinds: dict[int, int] = kinds) -> None:
            for row in np.unique(np.searchsorted(offs, at, side="right") - 1):
                kinds[int(row)] = kinds.get(int(row), 0) | bit

        for needle, where, bit in [*((x, low, 1) for x in NEEDLES), (b"AKIA", raw, 2)]:
            at, found = where.find(needle), []
            while at >= 0:
                found.append(at)
                at = where.find(needle, at + 1)
            if found:
                mark(np.array(found), bit)
        mark(runs_of(_HEX[buf], HEX_MIN), 4)
        mark(runs_of(_TOKEN[buf], WINDOW), 8)
        for row, bits in sorted(kinds.items()):
            text = raw[offs[row] : offs[row + 1]]
            base, more = _base(text, bits), _entropy(text) if bits & 8 else []
            if base or more:
                if not text.isascii():
                    # byte offsets to code points: all spans begin and end beside ASCII characters
                    place = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    base, more = ([(k, int(place[a]), int(place[b])) for k, a, b in x] for x in (base, more))
                yield first + row, base, more


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    Scratch(docs.sparkSession, "secrets")
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            counts, sha, spans = np.zeros((3, n), dtype=np.int64), [nothing] * n, [""] * n
            for row, base, more in spans_of(b.column("text")):
                for i, kind in enumerate(KINDS[:3]):
                    counts[i, row] = sum(s[0] == kind for s in base)
                sha[row] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[row] = joined(base + more)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def covered(text: str, spans: list[Span]) -> str:
    """The text with every secret's value replaced by the name of its kind in brackets."""
    out, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [text[at:lo], f"[{kind}]"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with secrets in text covered and n_chars, where there is one that is an integer, set anew."""
    Scratch(docs.sparkSession, "secrets")
    has_length = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            found = list(spans_of(texts))
            if found:
                new = texts.to_pylist()
                lengths = b.column("n_chars").to_pylist() if has_length else []
                for row, base, more in found:
                    new[row] = covered(new[row], base + more)
                    if has_length:
                        lengths[row] = len(new[row])
                cols = [pa.array(new, b.schema.field("text").type) if c == "text" else pa.array(lengths, b.schema.field(c).type) if c == "n_chars" else b.column(c) for c in names]
                b = pa.RecordBatch.from_arrays(cols, names=names)
            yield b

    return docs.mapInArrow(lean(run), T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
