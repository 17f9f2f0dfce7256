"""Secret scan with a worklist of decoded layers.

Every text is searched for secrets; stretches that are URL-encoded, hold Unicode
escapes, or are base64 (of plain or compressed bytes) are unwrapped into new layers, which
are searched and unwrapped in turn until nothing new appears. Spans found in a
layer are mapped back to the characters of the original text they came from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm.storage import tidy

# The patterns of the kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the whole run, 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
URL = re.compile(r"%[0-9A-Fa-f]{2}")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# A line break inside base64: of the text, or written as an escape, with quotes, comment signs and indentation around it.
LINE_BREAK = re.compile(r"""[\x20\t"']*+(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t>#*"']*+""")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{LINE_BREAK.pattern}[A-Za-z0-9+/_-]++)+={{0,2}}")
# Stretches that may be escaped bytes, and how their signs are told apart.
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])+")
URL_SIGN = re.compile(r"%[0-9A-Fa-f]{2}|.")
ESCAPED_SIGN = re.compile(r"\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\u\{0*[0-9A-Fa-f]{1,2}\}|\\[0-3]?[0-7]{1,2}|\\[abfnrtv\\'\"/]|[\x20-\x5b\x5d-\xff]")
ESCAPED_BYTES = re.compile(f"(?:{ESCAPED_SIGN.pattern})+")
SHORT = dict(zip("abfnrtv", b"\a\b\f\n\r\t\v"))
COMPRESSED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
NAMES = re.compile(r"[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Pp][Aa][Ss][Ss][Ww]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
# Compressed layers are read in pieces of so many bytes, cut after a byte that can stand in no secret and in no encoded stretch.
PIECE = 1 << 22
BREAK = re.compile(rb"""(?s).*(?:[^A-Za-z0-9+/_=.\-"':%\\{}\s\0>#*]|\0\0)""")

#: For each character its stretch of the original text, one stretch for all, or None for the original text itself.
Map = list[tuple[int, int]] | tuple[int, int] | None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets written plainly in ``text``."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _percent(text: str, at: Map) -> Iterator[tuple[str, Map]]:
    """The text with all %XX runs decoded."""
    out: list[str] = []
    place: list[tuple[int, int]] = []
    end = 0
    for run in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", text):
        out.append(text[end:run.start()])
        place += [_origin(at, i, i + 1) for i in range(end, run.start())]
        got = bytes.fromhex(run[0].replace("%", "")).decode("utf-8", "replace")
        raw = 0
        for ch in got:
            n = len(ch.encode()) if ch != "\ufffd" else 1
            lo, hi = run.start() + 3 * min(raw, len(run[0]) // 3 - 1), min(run.end(), run.start() + 3 * (raw + n))
            place.append(_origin(at, lo, max(hi, lo + 3)))
            raw += n
        out.append(got)
        end = run.end()
    out.append(text[end:])
    place += [_origin(at, i, i + 1) for i in range(end, len(text))]
    yield "".join(out), place


def _escapes(text: str, at: Map) -> Iterator[tuple[str, Map]]:
    """The text with its Unicode escapes replaced; surrogate pairs are joined."""
    out: list[str] = []
    place: list[tuple[int, int]] = []
    end = 0
    for m in UNICODE.finditer(text):
        code = int(m[1] or m[2] or m[3], 16)
        out += text[end:m.start()]
        place += [_origin(at, i, i + 1) for i in range(end, m.start())]
        here = _origin(at, m.start(), m.end())
        if 0xDC00 <= code < 0xE000 and m.start() == end and out and 0xD800 <= ord(out[-1]) < 0xDC00:
            out[-1] = chr(0x10000 + ((ord(out[-1]) - 0xD800) << 10) + code - 0xDC00)
            place[-1] = (place[-1][0], here[1])
        else:
            out.append(chr(code) if code < 0x110000 else "\ufffd")
            place.append(here)
        end = m.end()
    out += text[end:]
    place += [_origin(at, i, i + 1) for i in range(end, len(text))]
    yield "".join(out), place


def _opened(raw: bytes):
    """A decompressor for bytes that begin with a compression header, else None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if raw[:6] == b"\xfd7zXZ\x00" else None


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes behind all members of a compressed stream, in pieces; what turns out not to be compressed comes as it is."""
    data = _take(pieces, 6)
    while data:
        machine = _opened(data)
        if machine is None:
            yield data
            yield from pieces
            return
        while not machine.eof:
            try:
                got = machine.decompress(data, PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                yield data
                yield from pieces
                return
            data = getattr(machine, "unconsumed_tail", b"")
            if got:
                yield got
            if not machine.eof and not data and (not got or getattr(machine, "needs_input", True)):
                data = next(pieces, b"")
                if not data and not got:
                    return  # cut short
        data = machine.unused_data.lstrip(b"\0")
        if len(data) < 6:
            data = (data + _take(pieces, 6)).lstrip(b"\0")


def _take(pieces: Iterator[bytes], least: int) -> bytes:
    """At least that many bytes, or all."""
    got: list[bytes] = []
    n = 0
    while n < least and (piece := next(pieces, None)) is not None:
        got.append(piece)
        n += len(piece)
    return b"".join(got)


def _blocks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes cut where no secret and no encoded stretch of any layer can go on; only a stretch without such a place grows."""
    held: list[bytes] = []
    for piece in pieces:
        m = BREAK.match(piece)
        if m is None:
            held.append(piece)
        else:
            yield b"".join([*held, piece[:m.end()]])
            held = [piece[m.end():]]
    if rest := b"".join(held):
        yield rest


def _decoded(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, first byte, bytes per character) as UTF-8 or else latin-1, and where bytes are zero as UTF-16; patterns are ASCII, so other characters of UTF-16 are one sign."""
    try:
        yield raw.decode("utf-8"), 0, 0 if not raw.isascii() else 1
    except UnicodeDecodeError:
        yield raw.decode("latin-1"), 0, 1
    if b"\0" in raw:
        for first in (0, 1):
            for order in ("<u2", ">u2"):
                wide = np.frombuffer(raw, order, (len(raw) - first) // 2, first) if len(raw) > first + 1 else np.empty(0, np.uint16)
                yield np.where(wide < 128, wide, 255).astype(np.uint8).tobytes().decode("latin-1"), first, 2


def _headers(raw: bytes) -> Iterator[int]:
    """Where a compressed stream begins behind other bytes."""
    for m in COMPRESSED.finditer(raw, 1):
        head = raw[m.start():m.start() + 4096]
        try:
            if (machine := _opened(head)) is None:
                continue
            machine.decompress(head, 64)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            continue
        yield m.start()


def _unfolded(
    raw: bytes, span: tuple[int, int], most: int | None, too_large: list[tuple[int, int]], above: frozenset[bytes] = frozenset(),
) -> Iterator[tuple[str, Map]]:
    """The layers of bytes that may be or hold compressed ones, again and again; block by block, so that a large layer need not fit into memory."""
    pieces = iter([raw])
    while True:
        first = _take(pieces, PIECE)
        name = hashlib.sha256(first).digest()
        pieces = itertools.chain([first], pieces)
        if name in above or _opened(first) is None:
            break
        above |= {name}
        pieces = _inflated(pieces)
        if most is not None:
            first = _take(pieces, most + 1)
            if len(first) > most:
                too_large.append(span)
                return
            pieces = iter([first])
    for block in _blocks(pieces):
        for text, _, _ in _decoded(block):
            yield text, span
        for place in _headers(block):
            yield from _unfolded(block[place:], span, most, too_large, above)


def _phases(body: str) -> Iterator[tuple[int, bytes]]:
    """(phase, bytes) of base64 signs from each of the first four on: a run may be glued to other signs."""
    body = body.replace("-", "+").replace("_", "/")
    for phase in range(4):
        part = body[phase:len(body) - ((len(body) - phase) % 4 == 1)]
        if part:
            yield phase, base64.b64decode(part + "=" * (-len(part) % 4))


def _base64(text: str, at: Map, most: int | None, too_large: list[tuple[int, int]]) -> Iterator[tuple[str, Map]]:
    """The layers of each stretch that is base64, of text in any encoding or of compressed bytes."""
    for m in BASE64.finditer(text):
        for _, raw in _phases(m[0].rstrip("=")):
            yield from _unfolded(raw, _origin(at, m.start(), m.end()), most, too_large)


def _wrapped(text: str, at: Map, most: int | None, too_large: list[tuple[int, int]]) -> Iterator[tuple[str, Map]]:
    """The layers of base64 that goes over line breaks; each character comes from the lines that hold its signs."""
    for m in WRAPPED.finditer(text):
        breaks = [(b.start(), b.end()) for b in LINE_BREAK.finditer(text, m.start(), m.end())]
        lines = list(zip([m.start(), *(e for _, e in breaks)], [*(b for b, _ in breaks), m.end()]))
        parts = [text[lo:hi].rstrip("=") for lo, hi in lines]
        body = "".join(parts)
        if len(body) < 16:
            continue
        line = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        for phase, raw in _phases(body):
            byte = np.arange(len(raw))
            sign = phase + 4 * (byte // 3) + byte % 3
            place = [_origin(at, lines[i][0], lines[j][1]) for i, j in zip(line[sign].tolist(), line[sign + 1].tolist())]
            for got, first, step in _decoded(raw):
                if not step:
                    got, step = raw.decode("latin-1"), 1
                yield got, place[first::step][:len(got)]
            for begin in [*([0] if _opened(raw) else []), *_headers(raw)]:
                yield from _unfolded(raw[begin:], (place[begin][0], place[-1][1]), most, too_large)


def _value(sign: str) -> int:
    """The byte that an escape or a plain sign stands for."""
    if len(sign) == 1:
        return ord(sign)
    if sign[0] == "%" or sign[1] in "xu":
        return int(sign[1:] if sign[0] == "%" else sign[2:].strip("{}"), 16)
    return int(sign[1:], 8) if sign[1] in "01234567" else SHORT.get(sign[1], ord(sign[1]))


def _escaped_bytes(
    text: str, at: Map, stretch: re.Pattern, sign: re.Pattern, mark: str, most: int | None, too_large: list[tuple[int, int]],
) -> Iterator[tuple[str, Map]]:
    """The layers of compressed bytes that are written with escapes."""
    for m in stretch.finditer(text):
        if mark not in m[0]:
            continue
        signs = [(x.start(), _value(x[0])) for x in sign.finditer(text, m.start(), m.end())]
        plain = bytes(v for _, v in signs)
        # a plus sign may stand for a space
        spaced = bytes(32 if text[i] == "+" else v for i, v in signs) if mark == "%" and "+" in m[0] else plain
        for raw in {plain, spaced}:
            for begin in [*([0] if _opened(raw) else []), *_headers(raw)]:
                yield from _unfolded(raw[begin:], _origin(at, signs[begin][0], m.end()), most, too_large)


def _origin(at: Map, lo: int, hi: int) -> tuple[int, int]:
    if at is None:
        return lo, hi
    return at if isinstance(at, tuple) else (at[lo][0], at[hi - 1][1])


def _inner(layer: str, at: Map, most: int | None, too_large: list[tuple[int, int]]) -> Iterator[tuple[str, Map]]:
    """The layers directly inside a layer."""
    if URL.search(layer):
        yield from _percent(layer, at)
        yield from _escaped_bytes(layer, at, URL_BYTES, URL_SIGN, "%", most, too_large)
    if "\\" in layer:
        if UNICODE.search(layer):
            yield from _escapes(layer, at)
        yield from _escaped_bytes(layer, at, ESCAPED_BYTES, ESCAPED_SIGN, "\\", most, too_large)
    yield from _base64(layer, at, most, too_large)
    if "\n" in layer or "\r" in layer or "\\n" in layer:
        yield from _wrapped(layer, at, most, too_large)


def scan_text(text: str, max_layer_bytes: int | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of one text, each as sorted (start, end, kind)."""
    base = base_spans(text)
    found = set(base)
    seen: set[tuple] = set()
    too_large: list[tuple[int, int]] = []
    work = [_inner(text, None, max_layer_bytes, too_large)]  # one open layer for each depth
    while work:
        layer, at = next(work[-1], (None, None))
        if layer is None:
            work.pop()
            continue
        # the same text from another place is another layer, but nothing is its own ancestor twice
        key = (at if isinstance(at, tuple) else hash(tuple(at)), hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest())
        if key in seen:
            continue
        seen.add(key)
        found |= {(*_origin(at, lo, hi), kind) for lo, hi, kind in base_spans(layer)}
        work.append(_inner(layer, at, max_layer_bytes, too_large))
    found |= {(lo, hi, "opaque") for lo, hi in too_large}
    return base, sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer_bytes: int | None = None) -> DataFrame:
    """One row per document row: ``id_col``, base and spans as arrays of (start, end, kind).

    ``base`` are the plainly written secrets, leftmost and non-overlapping within
    a kind; ``spans`` adds those found in decoded layers, mapped to the original
    text (code points, end exclusive). Compressed layers of any size are unfolded
    block by block. A caller may set ``max_layer_bytes``: then a larger compressed layer
    is not unfolded and its stretch is reported whole as kind "opaque".

    A null text is empty and has no spans, a null identifier stays null, repeated
    rows are scanned one by one, an empty table gives no rows, texts are read
    whole, other columns are ignored.
    """
    span = "array<struct<start:int,end:int,kind:string>>"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            got = [scan_text(t or "", max_layer_bytes) for t in rows["text"].to_pylist()]
            lists = [pa.array([[{"start": a, "end": b, "kind": c} for a, b, c in g[k]] for g in got], spans) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([rows["id"], *lists], ["id", "base", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(scan), f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)
