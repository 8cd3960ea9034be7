r"""Secret scan with a recursive decoding worklist.

A document's text is the first layer. Every layer is searched for secrets; everything in it that can be unwrapped
becomes a further layer, until the worklist is empty:

* a line with URL escapes (``%41``), Unicode escapes (``\u0041``, ``\u{41}``, ``\U00000041``, ``\x41``, ``&#65;``, ``&#x41;``) or
  escaped quotes and slashes, with all of them replaced;
* a run of base64 letters (plain or URL alphabet), tried at each of its four alignments, since a path or a word may
  stand right before it; bytes without readable text and without a magic number make no layer;
* gzip, zlib, bzip2, xz and zstandard streams;
* readable text of two bytes a character.

A layer's characters are code points or, where it comes from bytes, bytes; the patterns are ASCII, so nothing is lost.
Each layer knows by which characters of the original text any stretch of it is spelled: by arithmetic (base64, two-byte
text), by the escapes before it, or the whole stream (compressed). So every find is reported in the original text.

Fixpoint and cycles: a layer is entered once for its place and content, so a stream that unpacks to itself ends the
walk. Streams that grow without end stop at ``budget`` unpacked bytes a document; how many streams were left closed
is in ``n_closed`` (no find is dropped silently; ``budget=None`` unpacks all).

Defined cases: a null text is empty; a null id keeps its row; repeated rows get a row each; an empty table gives an
empty result; other columns are ignored. A very long text is searched whole, in time linear in its length and the
length of its layers.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from logvigil.llm.common import texts

Span = tuple[int, int]
Place = Callable[[int, int], Span]

# The kinds in the order of report, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

_ESCAPE = re.compile(
    r"%[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|\\[\\\"'/]"
)
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
_WIDE = re.compile(r"(?:[\t\n\r\x20-\x7e]\x00){14,}")
_STREAMS = re.compile(r"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|(?<![A-Za-z0-9])\x78[\x01\x5e\x9c\xda]")
_STREAM_BYTES = re.compile(_STREAMS.pattern.encode("latin-1"))
_WIDER = re.compile(r"[^\x00-\xff]")
_WRAPPED = re.compile(r"[A-Za-z0-9+/]{60,76}(?:\r?\n[A-Za-z0-9+/]{1,76})+")


def _class(letters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in letters]] = True
    return table


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX, _BASE64 = _class("0123456789abcdef"), _class(_LETTERS + "+/-_")
#: Shorter runs cannot spell a whole find: the shortest one, ``token=`` and eight letters, takes 19.
_LEAST_BASE64 = 19


def _runs(codes: np.ndarray, table: np.ndarray, least: int) -> list[Span]:
    """Maximal stretches of characters of a class."""
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = table[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _codes(text: str) -> np.ndarray:
    """A byte for each character; those beyond a byte are 255, which is in no class."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(wide, 255).astype(np.uint8)


def matches(text: str, codes: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the plain patterns: leftmost and non-overlapping for each kind, too short ones left out."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *span) for span in _runs(_codes(text) if codes is None else codes, _HEX, LEAST["hex"])]
    return found


def in_order(found) -> list[tuple[str, int, int]]:
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _whole(span: Span) -> Place:
    return lambda start, end: span


def _shifted(place: Place, by: int, times: int = 1) -> Place:
    return lambda start, end: place(by + times * start, by + times * end)


def _sixty_four(place: Place, at: int) -> Place:
    """Bytes of a base64 run that begins at ``at``: byte b is spelled by two letters from 4 * (b // 3) + b % 3 on."""
    def spelled(start: int, end: int) -> Span:
        last = end - 1
        return place(at + start // 3 * 4 + start % 3, at + last // 3 * 4 + last % 3 + 2)
    return spelled


def _listed(place: Place, letters: np.ndarray) -> Place:
    """Characters ``letters`` of the layer above, one for each character of a layer."""
    return lambda start, end: place(int(letters[start]), int(letters[end - 1]) + 1)


def _replaced(place: Place, out: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> Place:
    """Escapes: character ``out[k]`` of the new layer stands for ``low[k]`` to ``high[k]`` of the line at ``base``."""
    def origin(i: int) -> Span:
        k = int(np.searchsorted(out, i, "right")) - 1
        if k < 0:
            return i, i + 1
        if out[k] == i:
            return int(low[k]), int(high[k])
        behind = int(high[k]) + i - int(out[k]) - 1
        return behind, behind + 1
    return lambda start, end: place(base + origin(start)[0], base + origin(end - 1)[1])


def _character(escape: str) -> str:
    if escape[0] == "%":
        return chr(int(escape[1:], 16))
    if escape[0] == "&":
        value = int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
    elif escape[1] in "uUx":
        value = int(escape[2:].strip("{}"), 16)
    else:
        return escape[1]
    return chr(value) if value < 0x110000 else "\ufffd"


def unescaped(line: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray] | None:
    """The line with its escapes replaced, and where they are in the new and the old line; None without any."""
    pieces, out, low, high, done, size = [], [], [], [], 0, 0
    for m in _ESCAPE.finditer(line):
        start, end = m.span()
        pieces += [line[done:start], _character(m[0])]
        size += start - done
        out.append(size)
        low.append(start)
        high.append(end)
        size, done = size + 1, end
    if not out:
        return None
    return "".join([*pieces, line[done:]]), np.array(out), np.array(low), np.array(high)


def unpacked(data: bytes, at: int, end: int, most: int | None) -> tuple[bytes, int] | None:
    """What the compressed stream from ``at`` on holds, as far as it can be read up to ``end``, and the stream's length;
    None beyond ``most`` bytes. It is read and unpacked in small pieces, so the limit is met in time."""
    magic, begin = data[at : at + 4], at
    blocks = None  # readers that take a limit for their output
    if magic[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
    elif magic[:1] == b"\x78":
        reader = zlib.decompressobj()
    elif magic[:3] == b"BZh":
        blocks = reader = bz2.BZ2Decompressor()
    elif magic[:1] == b"\xfd":
        blocks = reader = lzma.LZMADecompressor(memlimit=1 << 28)
    else:
        reader = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    out, size = [], 0
    try:
        while not reader.eof and (at < end or blocks and not blocks.needs_input):
            if blocks:
                fed, piece = blocks.needs_input, blocks.decompress(data[at : min(at + 1024, end)] if blocks.needs_input else b"", 1 << 20)
            else:
                fed, piece = True, reader.decompress(data[at : min(at + 1024, end)])
            at = min(at + 1024, end) if fed else at
            out.append(piece)
            size += len(piece)
            if most is not None and size > most:
                return None
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        pass  # a damaged stream: what was read before counts
    return b"".join(out), (at - len(reader.unused_data) if reader.eof else end) - begin


class Walk:
    """The worklist of one document."""

    def __init__(self, text: str, budget: int | None):
        self.left, self.n_closed, self.n_layers, self.depth = budget, 0, 0, 0
        self.seen: set[tuple] = set()
        self.found: set[tuple[str, int, int]] = set()
        self.todo: deque[tuple[str, Place, int]] = deque()
        self.base: list[tuple[str, int, int]] = []
        self.todo.append((text, lambda start, end: (start, end), 0))
        while self.todo:
            self._layer(*self.todo.popleft())

    def _enter(self, text: str, place: Place, depth: int) -> None:
        if text:
            key = (*place(0, len(text)), hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if key not in self.seen:
                self.seen.add(key)
                self.todo.append((text, place, depth))

    def _layer(self, text: str, place: Place, depth: int) -> None:
        codes = _codes(text)
        here = matches(text, codes)
        if depth == 0:
            self.base = here
            self.found.update(here)
        else:
            self.n_layers += 1
            self.depth = max(self.depth, depth)
            self.found.update((kind, *place(start, end)) for kind, start, end in here)
        if "%" in text or "\\" in text or "&#" in text:
            self._lines(text, place, depth)
        runs = _runs(codes, _BASE64, _LEAST_BASE64)
        for start, end in runs:
            self._base64(text[start:end], _shifted(place, start), depth)
        if any(end - start >= 60 for start, end in runs):
            for m in _WRAPPED.finditer(text):
                letters = np.array([k for k, c in enumerate(m[0]) if c not in "\r\n"]) + m.start()
                self._base64(re.sub(r"[\r\n]", "", m[0]), _listed(place, letters), depth)
        if "\x00" in text:
            for m in _WIDE.finditer(text):
                self._enter(m[0][::2], _shifted(place, m.start(), 2), depth + 1)
        if not text.isascii() or text[:1] == "x" or "BZh" in text:
            starts = [m.start() for m in _STREAMS.finditer(text)]
            if starts:
                self._streams(text, starts, place, depth)

    def _lines(self, text: str, place: Place, depth: int) -> None:
        at = 0
        for line in text.split("\n"):
            changed = unescaped(line)
            if changed:
                new, out, low, high = changed
                self._enter(new, _replaced(place, out, low, high, at), depth + 1)
            at += len(line) + 1

    def _base64(self, run: str, place: Place, depth: int) -> None:
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            size = len(run) - skip
            body = run[skip:] + "A" * (-size % 4)
            data = binascii.a2b_base64(body)[: size * 3 // 4]
            if _READABLE.search(data) or _STREAM_BYTES.search(data) or (b"\x00" in data and _WIDE.search(data.decode("latin-1"))):
                self._enter(data.decode("latin-1"), _sixty_four(place, skip), depth + 1)

    def _streams(self, text: str, starts: list[int], place: Place, depth: int) -> None:
        data = text.encode("latin-1", "replace")
        walls = [m.start() for m in _WIDER.finditer(text)] + [len(text)]  # no stream reaches beyond a character above a byte
        for at in starts:
            stream = unpacked(data, at, walls[bisect.bisect(walls, at)], self.left)
            if stream is None:
                self.n_closed += 1
            elif stream[0]:
                out, size = stream
                if self.left is not None:
                    self.left -= len(out)
                self._enter(out.decode("latin-1"), _whole(place(at, at + size)), depth + 1)


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_found", "n_layers", "depth", "n_closed"]
_TYPES = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 4


def _listing(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def scan_text(text: str, budget: int | None = 1 << 26) -> tuple:
    """One document's row, without its id."""
    walk = Walk(text, budget)
    base, everything = in_order(walk.base), in_order(walk.found)
    counts = [sum(f[0] == kind for f in base) for kind in KINDS]
    return (*counts, hashlib.sha256(_listing(base).encode()).hexdigest(), _listing(everything),
            len(everything), walk.n_layers, walk.depth, walk.n_closed)


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", budget: int | None = 1 << 26) -> DataFrame:
    """Per document the counts and digest of the plain finds, and ``spans``: these and the finds in decoded layers,
    ``kind:start:end`` in code points of the whole text. ``n_found``, ``n_layers``, ``depth`` and ``n_closed`` describe the walk.
    """
    rows = texts(docs, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(scan_text(body, budget) for body in batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, _TYPES)], names=_NAMES)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                                "n_found long, n_layers long, depth long, n_closed long")
