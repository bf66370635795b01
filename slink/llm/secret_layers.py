"""Secrets in texts, also below nested encodings: a worklist of decoded layers.

The text is the first layer. Each layer is scanned by the base rules and unwrapped in every way that applies: URL and
Unicode escapes in place, base64 stretches and the compressed data inside them as layers of their own. New layers
join the worklist until none is new; a layer equal to one that it was decoded from, by its digest, is a cycle and ends
there. Every character of a layer knows the stretch of the original text that it came from, so spans found in any
layer are mapped back; equal layers from other stretches are mapped each.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slink.llm import arrow

KINDS = ("assign", "access", "hex")
MOST_EXPANSION = 64 << 20  # bytes that one base64 stretch may open to; the rest is reported as unopened
LEAST_BASE64 = 16
LEAST_SECRET = 12  # characters of the shortest base span, "token=" and six more; encodings only make it longer
CHUNK = 1 << 16

Span = tuple[int, str, int]

# Letters of the name in either case, of ASCII only.
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Base64 that may be broken over lines, also where the break is written as an escape.
_BREAK = r"(?:(?:\\r)?\\n|\r?\n)[\x20\t]*"
_LINES = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_SIGNS = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAKS = re.compile(_BREAK)
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_PLAIN = re.compile(rb"[\x09-\x0d\x20-\x7e]{%d,}" % LEAST_SECRET)
_WIDE = re.compile(rb"(?:[\x09-\x0d\x20-\x7e]\x00){%d,}|(?:\x00[\x09-\x0d\x20-\x7e]){%d,}" % (LEAST_SECRET, LEAST_SECRET))


def scan(text: str) -> list[Span]:
    """Base spans: leftmost matches of each kind that do not overlap, less those that fail their check."""
    found: list[Span] = []
    folded = text.lower()
    if any(name in folded for name in _NAMES):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


@dataclass
class Layer:
    """Decoded text; character i came from characters starts[i] to ends[i] of the original. None: as they stand."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def map(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            places = np.arange(len(self.text))
            return places, places + 1
        return self.starts, self.ends


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match replaced by its decoded characters; None if nothing changes."""
    starts, ends = layer.map()
    texts, firsts, lasts, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        pieces = decode(m[0])  # (characters, first, last) relative to the match
        if pieces is None:
            continue
        texts += [layer.text[at : m.start()], *(p[0] for p in pieces)]
        firsts += [starts[at : m.start()], *(np.full(len(p[0]), starts[m.start() + p[1]]) for p in pieces)]
        lasts += [ends[at : m.start()], *(np.full(len(p[0]), ends[m.start() + p[2] - 1]) for p in pieces)]
        at = m.end()
    if not at:
        return None
    texts.append(layer.text[at:])
    firsts.append(starts[at:])
    lasts.append(ends[at:])
    return Layer("".join(texts), np.concatenate(firsts), np.concatenate(lasts))


def _url(run: str) -> list[tuple[str, int, int]]:
    """Characters of a run of %XX, each with the escapes it came from; bytes that are no UTF-8 stay as characters."""
    data = bytes.fromhex(run.replace("%", ""))
    out, at = [], 0
    while at < len(data):
        size = next((n for n in range(1, 5) if _valid(data[at : at + n])), 0)
        text = data[at : at + size].decode() if size else chr(data[at])
        out.append((text, 3 * at, 3 * (at + max(size, 1))))
        at += max(size, 1)
    return out


def _valid(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _character(code: int) -> str | None:
    return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else None


def _unicode(run: str) -> list[tuple[str, int, int]] | None:
    """Characters of a Unicode, hexadecimal or entity escape; surrogate pairs join."""
    if run.startswith("&"):
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        text = _character(code)
        return [(text, 0, len(run))] if text else None
    if run.startswith("\\u{"):
        text = _character(int(run[3:-1], 16))
        return [(text, 0, len(run))] if text else None
    width = 6 if run[1] == "u" else 4
    codes = [int(run[i + 2 : i + width], 16) for i in range(0, len(run), width)]
    out, i = [], 0
    while i < len(codes):
        size, code = 1, codes[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1] < 0xE000:
            size, code = 2, 0x10000 + ((code - 0xD800) << 10) + codes[i + 1] - 0xDC00
        text = _character(code)
        out.append((text or run[i * width : (i + 1) * width], i * width, (i + size) * width))
        i += size
    return out


def _opener(magic: bytes):
    """A decompressor, and how many bytes to give it at once."""
    if magic.startswith(b"\x28"):
        import zstandard

        # It has no bound on what it gives out at once, so it gets little.
        return zstandard.ZstdDecompressor().decompressobj(), 256
    if magic.startswith(b"BZh"):
        return bz2.BZ2Decompressor(), CHUNK
    if magic.startswith(b"\xfd"):
        return lzma.LZMADecompressor(), CHUNK
    return zlib.decompressobj(31 if magic.startswith(b"\x1f") else 15), CHUNK


def _opened(data: bytes, at: int, magic: bytes, most: int) -> tuple[bytes, int, str]:
    """What the stream at a place opens to, where it ends, and how: whole, short, broken, or large."""
    opener, size = _opener(magic)
    bounded = not magic.startswith(b"\x28")
    out, held, place, view = [], 0, at, memoryview(data)
    try:
        while not opener.eof:
            if held >= most:
                return b"", place, "large"
            piece = getattr(opener, "unconsumed_tail", b"")
            if not piece and getattr(opener, "needs_input", True):
                if place >= len(data):
                    return b"".join(out), len(data), "short"
                piece = view[place : place + size]
                place += len(piece)
            out.append(opener.decompress(piece, most - held) if bounded else opener.decompress(piece))
            held += len(out[-1])
    except Exception as error:
        # zstandard has its own class of errors, and is imported only where it is needed.
        if not isinstance(error, (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)) and "Zstd" not in type(error).__name__:
            raise
        return b"".join(out), at + len(magic), "broken"
    return b"".join(out), place - len(opener.unused_data), "whole"


def _texts(data: bytes) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Texts in bytes, with the first byte and the size of each character.

    Bytes that are text as a whole are one; of others all stretches of ASCII, in UTF-8 or UTF-16, that can hold a
    secret: its characters, and those of all its encodings, are ASCII.
    """
    whole = _text(data)
    if whole:
        sizes = np.array([len(c.encode()) for c in whole])
        return [(whole, np.r_[0, np.cumsum(sizes)[:-1]], sizes)]
    found = [(m[0].decode(), np.arange(m.start(), m.end()), np.ones(len(m[0]), int)) for m in _PLAIN.finditer(data)]
    for m in _WIDE.finditer(data):
        text = m[0].replace(b"\x00", b"").decode()
        found.append((text, np.arange(m.start(), m.end(), 2), np.full(len(text), 2)))
    return found


def _streams(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """Texts below all compressed streams in bytes, also inside one another, with the outermost stream's place.

    None stands for a stream that is not whole or opens to too much.
    """
    left = MOST_EXPANSION
    # Inner bytes, where they came from (None: the data itself), and digests of the bytes that they came from.
    worklist: list[tuple[bytes, tuple[int, int] | None, frozenset]] = [(data, None, frozenset())]
    while worklist:
        inner, origin, above = worklist.pop()
        if not _MAGIC.search(inner) or _text(inner):
            continue
        digest = hashlib.sha256(inner).digest()
        if digest in above:
            continue
        at = 0
        while m := _MAGIC.search(inner, at):
            opened, end, how = _opened(inner, m.start(), m[0], left)
            place = origin or (m.start(), end if how == "whole" else len(inner))
            # What only looks like a stream ends at once; a later one may begin right after its first bytes.
            at = end if how == "whole" else m.end()
            if how == "large":
                yield *place, None
                at = max(at, end)
                continue
            left -= len(opened)
            texts = [t for t, _, _ in _texts(opened)]
            for text in texts:
                yield *place, text
            if how != "whole" and (texts or (how == "short" and len(m[0]) > 2)):
                yield *place, None
            if opened:
                worklist.append((opened, place, above | {digest}))


def _text(data: bytes) -> str | None:
    """Text of decoded bytes, None if they look like none: not UTF-8, or with control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def _base64(plain: str) -> Iterator[tuple[int, bytes]]:
    """Readings of a stretch without padding from each of its first four characters, as it may follow other signs."""
    plain = plain.replace("-", "+").replace("_", "/")
    for skip in range(min(4, len(plain))):
        body = plain[skip:]
        body = body[: len(body) - 1] if len(body) % 4 == 1 else body
        yield skip, base64.b64decode(body + "=" * (-len(body) % 4), validate=True)


def _stretches(text: str) -> Iterator[tuple[str, np.ndarray, int, bool]]:
    """Base64 of a text: its signs, their places, where it ends, and whether it is only a line of a longer one."""
    blocks, at = [], 0
    for m in _LINES.finditer(text):
        breaks = [(b.start(), b.end()) for b in _BREAKS.finditer(text, m.start(), m.end())]
        if not breaks:
            continue
        edges = [m.start(), *(e for b in breaks for e in b), m.end()]
        lines = [_SIGNS.match(text, first, last) for first, last in zip(edges[::2], edges[1::2], strict=True)]
        places = np.concatenate([np.arange(*line.span()) for line in lines])
        blocks.append(m.span())
        yield "".join(line[0] for line in lines), places, m.end(), False
    for m in _BASE64.finditer(text):
        while at < len(blocks) and blocks[at][1] <= m.start():
            at += 1
        signs = m[0].rstrip("=")
        yield signs, np.arange(m.start(), m.start() + len(signs)), m.end(), at < len(blocks) and blocks[at][0] <= m.start()


def _unwrapped(layer: Layer) -> Iterator[Layer | None]:
    """Every layer that the given one holds; None stands for data too large to open, or not whole."""
    text = layer.text
    if "%" in text:
        yield from filter(None, [_in_place(layer, _PERCENT, _url)])
    if "\\" in text or "&#" in text:
        yield from filter(None, [_in_place(layer, _ESCAPE, _unicode)])
    starts, ends = layer.map()
    for signs, places, stop, part in _stretches(text):
        # Words and hexadecimal numbers are no base64: it mixes cases, or has digits and other signs among letters.
        if signs.isalpha() and (signs.islower() or signs.isupper() or signs.istitle()):
            continue
        for skip, data in _base64(signs):
            for found, first, sizes in _texts(data):
                last = first + sizes - 1
                a = skip + first // 3 * 4 + first % 3
                b = np.minimum(skip + last // 3 * 4 + last % 3 + 1, len(places) - 1)
                yield Layer(found, starts[places[a]], ends[places[b]])
            for first, end, found in _streams(data):
                if found is None:
                    # A line of a longer stretch is counted there.
                    if not part:
                        yield None
                    continue
                a = places[skip + first // 3 * 4 + first % 3]
                b = stop if end == len(data) else places[skip + (end - 1) // 3 * 4 + (end - 1) % 3 + 1] + 1
                yield Layer(found, np.full(len(found), starts[a:b].min()), np.full(len(found), ends[a:b].max()))


def secrets(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans with those of decoded layers, number of layers, and streams too large or not whole."""
    base = scan(text)
    every = set(base)
    root = Layer(text)
    seen = {_key(root)}
    worklist, unopened = [(root, frozenset({_digest(text)}))], 0
    while worklist:
        layer, above = worklist.pop()
        for inner in _unwrapped(layer):
            if inner is None:
                unopened += 1
                continue
            digest, key = _digest(inner.text), _key(inner)
            if digest in above or key in seen:
                continue
            seen.add(key)
            worklist.append((inner, above | {digest}))
            for start, kind, end in scan(inner.text):
                first, last = inner.origin(start, end)
                every.add((first, kind, last))
    order = sorted(every, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return base, order, len(seen), unopened


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode(errors="surrogatepass")).digest()


def _key(layer: Layer) -> bytes:
    """Digest of a layer's text and of where each of its characters came from."""
    starts, ends = layer.map()
    whole = hashlib.sha256(_digest(layer.text))
    whole.update(np.ascontiguousarray(starts, np.int64))
    whole.update(np.ascontiguousarray(ends, np.int64))
    return whole.digest()


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, counts and digest of the base spans, all spans, n_layers and n_unopened of each row of `docs`.

    Null and empty texts have no spans; texts of any length are read whole; repeated rows give the same spans; other
    columns are carried or ignored as `keep` says. n_unopened counts compressed streams that are not whole, of which
    what can be opened is searched, and those with which a stretch opens to more than MOST_EXPANSION bytes, which are not.
    """
    keep = keep or []
    slim = docs.select(*keep, F.col("text").alias("_text"))
    names = [f"n_{k}" for k in KINDS]
    shown = [F.lit(0).cast("long").alias(n) for n in names]
    shown += [F.lit("").alias("base_sha256"), F.lit("").alias("spans")]
    shown += [F.lit(0).cast("long").alias(n) for n in ("n_layers", "n_unopened")]
    schema = slim.select(*keep, *shown).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.pieces(whole, "_text"):
                found = [secrets(t) for t in arrow.strings(batch.column("_text"))]
                columns = [batch.column(k) for k in keep]
                columns += [pa.array([sum(s[1] == k for s in f[0]) for f in found], pa.int64()) for k in KINDS]
                columns += [
                    pa.array([hashlib.sha256(listed(f[0]).encode()).hexdigest() for f in found], pa.string()),
                    pa.array([listed(f[1]) for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([f[3] for f in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)
