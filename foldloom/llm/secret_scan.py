"""Secret scans over a worklist of decoded layers.

Layers of a text: its URL escapes undone, its Unicode and HTML number escapes undone, each run of 16-bit characters
read as such, and each base64 token decoded in its four alignments, also over line ends (gzip, zlib and bzip2 data that
begins with the token, or after a line end, '/', '-' or '_', is unpacked too, all members and down to what isn't
compressed). Every new layer is scanned and unwrapped itself; a layer that was met before at the same place ends there,
so cycles end and the worklist reaches its fixpoint. The worklist goes deep first and makes a layer when its turn comes:
what it holds at a time is one layer for each level of nesting, and a digest of each layer that was met. A layer knows
which stretch of the source text its characters came from, and found spans are given in code points of the source.

Defined results: null text counts as empty and has no spans; equal spans of one kind are given once; decoded
bytes are scanned as they are, whether they are UTF-8 or not. Unpacked data over ``MAX_LAYER`` bytes is scanned in overlapping stretches of bytes.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import bounded, keyed, text_chunks

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{?([0-9A-Fa-f]{4,6})\}?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
CUT = re.compile(r"[/_-]")
WIDE = re.compile(r"(?:[\t\n\r\x20-\x7e]\x00){7,}[\t\n\r\x20-\x7e]?")
MAX_LAYER = 16_000_000
OVERLAP = 100_000

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the plain patterns."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text, and where it came from: all of it from one stretch (``whole``), or its parts from what ``place`` says."""

    def __init__(self, text: str, whole: tuple[int, int] | None = None, place: Callable[[int, int], tuple[int, int]] | None = None):
        self.text, self.whole, self.place = text, whole, place

    def source(self, start: int, stop: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return self.place(start, stop) if self.place else (start, stop)

    def key(self) -> bytes:
        """A digest of the text and its place."""
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass") + b"%d %d" % self.source(0, len(self.text)), digest_size=16).digest()

    def replaced(self, cuts: list[tuple[int, int, str]]) -> Layer:
        """The layer with stretches replaced. What is kept from it is known by the cuts alone."""
        parts, begins, shift, at, size = [], [], [], 0, 0
        for a, b, new in cuts:
            parts += [self.text[at:a], new]
            size += a - at
            begins.append(size)
            size += len(new)
            shift.append(size)
            at = b
        parts.append(self.text[at:])

        def near(i: int) -> tuple[int, int]:
            """The stretch of this layer that character ``i`` of the new one stands for."""
            k = bisect_right(begins, i) - 1
            if k >= 0 and i < shift[k]:
                return cuts[k][:2]
            old = i if k < 0 else cuts[k][1] + i - shift[k]
            return old, old + 1

        def place(start: int, stop: int) -> tuple[int, int]:
            return self.source(*near(start))[0], self.source(*near(stop - 1))[1]

        return Layer("".join(parts), whole=self.whole, place=place)


def wide_layers(layer: Layer) -> Iterator[Layer]:
    """Runs of ASCII characters of 16 bits each."""
    for m in WIDE.finditer(layer.text):
        yield Layer(m[0][::2], place=lambda i, j, m=m: layer.source(m.start() + 2 * i, m.start() + 2 * j - 1))


def url_cuts(text: str) -> list[tuple[int, int, str]]:
    cuts = []
    for m in URL.finditer(text):
        raw, at = bytes.fromhex(m[0].replace("%", "")), m.start()
        while raw:
            size = next((k for k in range(1, 5) if _character(raw[:k])), 0)
            if size:
                cuts.append((at, at + 3 * size, raw[:size].decode()))
            size = size or 1
            raw, at = raw[size:], at + 3 * size
    return cuts


def _character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def escape_cuts(text: str) -> list[tuple[int, int, str]]:
    cuts = []
    for m in ESCAPE.finditer(text):
        code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            cuts.append((m.start(), m.end(), chr(code)))
    return cuts


def opened(head: bytes) -> object | None:
    """A decompressor for data that begins like this."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else None


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """What a compressed stream holds, one member after the other, in pieces of bounded size."""
    engine, held = None, b""
    for piece in pieces:
        held += piece
        while True:
            if engine is None and (engine := opened(held)) is None:
                if len(held) > 2:
                    return
                break
            try:
                part = engine.decompress(held, MAX_LAYER)
            except (zlib.error, OSError, EOFError):
                return
            if part:
                yield part
            if engine.eof:
                engine, held = None, engine.unused_data
                continue
            held = getattr(engine, "unconsumed_tail", b"")
            if not held and len(part) < MAX_LAYER:
                break


def stretches(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The stream in stretches of ``MAX_LAYER`` bytes that overlap."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) > MAX_LAYER:
            yield bytes(held[:MAX_LAYER])
            del held[: MAX_LAYER - min(OVERLAP, MAX_LAYER // 2)]
    if held:
        yield bytes(held)


def unpacked(raw: memoryview) -> Iterator[bytes]:
    """What compressed data holds, and what that holds, down to what isn't compressed (or was met before)."""
    met, head = set(), bytes(raw[:3])
    source = lambda: (bytes(raw[i : i + 65_536]) for i in range(0, len(raw), 65_536))
    while opened(head) is not None:
        inner, head, count = (lambda source=source: members(source())), b"", 0
        for part in stretches(inner()):
            head, count = head if count else part, count + 1
            yield part
        if count == 1:
            if head in met:
                return
            met.add(head)
            inner = lambda data=head: iter((data,))
        source = inner


def _readable(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def token_layers(layer: Layer, token: str, at: Callable[[int], int], stop: int, cuts: list[int], exact: bool) -> Iterator[Layer]:
    """Layers of a base64 token in each of its four alignments, and of compressed data from each of ``cuts`` on.

    ``at``: places of the token's characters. What is found stands for the token from a cut on, or (``exact``) for the
    characters that it was decoded from. Patterns are ASCII, so a character is made of each byte, whatever it is.
    """
    token = token.replace("-", "+").replace("_", "/")
    for r in range(4):
        part = token[r : len(token) - ((len(token) - r) % 4 == 1)]
        raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        mine = [c for c in cuts if c % 4 == r]

        def place(i: int, j: int, r: int = r, raw: bytes = raw, mine: list[int] = mine) -> tuple[int, int]:
            first = r + 8 * i // 6
            if exact:
                return layer.source(at(first), at(r + (8 * j - 1) // 6) + 1)
            before = mine[: bisect_right(mine, first)]
            begin = next((c for c in before if _readable(raw[(c - r) // 4 * 3 : i])), before[0] if before else r)
            return layer.source(at(begin), stop)

        if raw:
            yield Layer(raw.decode("latin-1"), place=place)
        for c in sorted({r, *mine}):
            o = (c - r) // 4 * 3
            if opened(raw[o : o + 3]) is not None:
                for inner in unpacked(memoryview(raw)[o:]):
                    yield Layer(inner.decode("latin-1"), whole=layer.source(at(c), stop))


def base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        token = m[0].rstrip("=")
        cuts = [0, *(i.end() for i in CUT.finditer(token))]
        yield from token_layers(layer, token, lambda i, m=m: m.start() + i, m.end(), cuts, False)
    for m in WRAPPED.finditer(layer.text) if "\n" in layer.text or "\r" in layer.text else ():
        lines = [(x.start(), x[0]) for x in LINE.finditer(layer.text, m.start(), m.end())]
        token = "".join(x for _, x in lines)
        if len(token) < 16:
            continue
        begins = [0, *accumulate(len(x) for _, x in lines)][:-1]

        def at(i: int, lines: list[tuple[int, str]] = lines, begins: list[int] = begins) -> int:
            k = bisect_right(begins, i) - 1
            return lines[k][0] + i - begins[k]

        cuts = sorted({*begins, *(i.end() for i in CUT.finditer(token))})
        yield from token_layers(layer, token, at, m.end(), cuts, True)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers right under one, one at a time."""
    if "%" in layer.text and (cuts := url_cuts(layer.text)):
        yield layer.replaced(cuts)
    if ("\\" in layer.text or "&#" in layer.text) and (cuts := escape_cuts(layer.text)):
        yield layer.replaced(cuts)
    if "\0" in layer.text:
        yield from wide_layers(layer)
    yield from base64_layers(layer)


def find_secrets(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all layers, by start, then kind."""
    base = set(base_spans(text))
    found, first = set(base), Layer(text)
    work, met = [unwrapped(first)], {first.key()}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif layer.text and (key := layer.key()) not in met:
            met.add(key)
            found.update((k, *layer.source(a, b)) for k, a, b in base_spans(layer.text))
            work.append(unwrapped(layer))
    return sorted(((k, a, b, (k, a, b) in base) for k, a, b in found), key=lambda x: (x[1], x[0], x[2]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` (kind, start, end, whether the plain text shows it) of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                cells = [[{"kind": KINDS[k], "start": a, "end": b, "base": plain} for k, a, b, plain in find_secrets(t)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, kind)], ["doc_id", "spans"])

    return keyed(df, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}")


def shown(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each covered stretch replaced by ``<kind>`` of its first span."""
    out, at = [], 0
    for kind, start, stop, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact_documents(df: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of ``df`` with every secret's stretch of the text replaced and the size (if there is one) renewed;
    texts without a secret stay as they are."""
    bounded(df.sparkSession)
    text, size = df.columns.index(text_col), df.columns.index(size_col) if size_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text_col):
                columns, changed = list(part.columns), False
                texts, sizes = part.column(text).to_pylist(), None if size is None else part.column(size).to_pylist()
                for i, t in enumerate(texts):
                    if t and (spans := find_secrets(t)):
                        texts[i], changed = redact(t, spans), True
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                if changed:
                    columns[text] = pa.array(texts, part.schema.field(text).type)
                    if sizes is not None:
                        columns[size] = pa.array(sizes, part.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)
