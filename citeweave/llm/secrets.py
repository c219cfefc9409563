"""Secret scans with a recursive decoding worklist.

Each text is a layer.  A layer is scanned for secrets, then every encoded part
of it is unwrapped into a child layer: percent and Unicode escapes are undone
over the whole layer, base64 runs and compressed payloads one by one.  A base64
run is decoded from each of its first four characters on, whatever else its
bytes hold.  Children
join the worklist until nothing new appears; a layer with the same content for
the same characters of the document is not entered again, which ends cycles,
while the same content elsewhere is.  Spans found in a child are mapped back to
the characters of the text that encode them.  Compressed members are sought
anywhere in decoded bytes, also in what other members expand to; members that
follow each other are one stream.  What is found in a payload stands for all of
it.

A null text counts as empty; rows are independent, so order, ties and repeats
do not matter; an empty table gives an empty result; a null doc_id stays null.
Texts are scanned whole, whatever their length.  Compressed payloads are
unpacked in windows of 8 MiB that overlap by 64 KiB, so memory stays bounded
whatever they expand to.  What goes on beyond a window (members, base64 runs,
escaped text) is a stream of its own that is read from where it begins, so
nothing is cut at a window's end but a match longer than the overlap, whose
kind is found all the same from a part of it.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import bounded_slices, texts_of
from .tables import read_table

# The patterns of the base scan, and their order for equal starts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A failing run of these two is dropped whole, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# Both begin with a plain character, which the search looks for first.
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})*")
_CODE = r"\\(?:u\{[0-9A-Fa-f]{1,6}\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})"
_ESCAPE = re.compile(f"{_CODE}(?:{_CODE})*")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
# Lines of a wrapped run are one run; only its last line may be short.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)?={0,2}")
_BREAKS = "\r\n \t"
_PLAIN_BASE64 = str.maketrans("-_", "+/", _BREAKS)
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
LONGEST_MAGIC = 6
WINDOW, OVERLAP = 8 << 20, 64 << 10
#: Bytes given to a decompressor at once; what it made of them is lost if they are damaged.
STEP = 16
#: Decompressors that can be copied get more at once, and the step is taken again in small ones if it meets damage.
LONGEST_STEP, LONGEST_OUT = 64 << 10, 1 << 20
DAMAGE = (zlib.error, OSError, lzma.LZMAError, EOFError, zstandard.ZstdError)

# Runs in bytes, for streams longer than a window; a line of SHORTEST_LINE may be followed by another.
SHORTEST_LINE = 16
_RUN = re.compile(_BASE64.pattern.removesuffix("={0,2}").encode())
_RUN_LINE = re.compile(rb"[A-Za-z0-9+/_-]*")
_RUN_BREAK = re.compile(rb"\r?(?:\n[ \t]*)?")
_PLAIN_BYTES = bytes.maketrans(b"-_", b"+/")
LONGEST_ESCAPE = 24  # a pair of the longest ones


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base scan, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Nowhere:
    """Coordinates of layers below a payload, all of which stand for the whole of it."""

    def __getitem__(self, at: int | slice):
        return () if isinstance(at, slice) else 0


NOWHERE = Nowhere()
Coordinates = np.ndarray | range | Nowhere


def _pick(places: np.ndarray | range, index: np.ndarray) -> np.ndarray:
    """The places at some indices; a range has step 1."""
    return places.start + index if isinstance(places, range) else places[index]


@dataclass
class Layer:
    """Decoded text; character i stands for characters lo(i) to hi(i) of the root.

    What is not ``plain`` text has damaged bytes or control characters, and counts as a layer only if it holds a secret.
    """

    text: str
    lo: Coordinates
    hi: Coordinates
    plain: bool = True


@dataclass
class Payload:
    """Bytes with compressed members; they stand for characters first to last of the root."""

    raw: bytes
    first: int
    last: int


def _expander(head: bytes):
    """A streaming decompressor for the magic that the bytes begin with, if any."""
    if not _MAGIC.match(head):
        return None
    if head[0] == 0x1F:
        return zlib.decompressobj(31)
    if head[0] == 0x78:
        return zlib.decompressobj(15)
    if head[0] == 0x42:
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[0] == 0xFD else zstandard.ZstdDecompressor().decompressobj()


class Stream:
    """Content of the compressed members that follow each other from a place of another stream on.

    Each call unpacks anew.  Once a call is exhausted, ``end`` is where the last whole member ends, and ``open`` tells
    whether the other stream ended within a member.
    """

    def __init__(self, source: Callable[[], Iterator[bytes]], place: int):
        self.source, self.place, self.end, self.open = source, place, place + 1, False

    def __call__(self) -> Iterator[bytes]:
        machine, feed, at, step, self.open = None, b"", self.place, STEP, True
        for piece in _from(self.source(), self.place):
            lo = 0
            while lo < len(piece):
                fresh = piece[lo : lo + step]
                feed, at, lo = feed + fresh, at + len(fresh), lo + len(fresh)
                while feed:
                    if machine is None:
                        if len(feed) < LONGEST_MAGIC:
                            break  # more to come
                        machine, step = _expander(feed), STEP
                        if machine is None:
                            self.open = False
                            return
                    try:
                        yield from _expanded(machine, feed)
                    except DAMAGE:
                        self.open = False
                        return  # a damaged payload still yields what came before the damage
                    feed = b""
                    if machine.eof:
                        feed, machine = machine.unused_data, None
                        self.end = at - len(feed)
                    elif hasattr(machine, "copy"):
                        step = min(2 * step, LONGEST_STEP)
        if machine is None:
            self.open = bool(feed)


def _from(pieces: Iterable[bytes], place: int) -> Iterator[bytes]:
    """A stream from a place on."""
    for piece in pieces:
        if place < len(piece):
            yield piece[place:] if place else piece
        place = max(0, place - len(piece))


def _expanded(machine, feed: bytes) -> Iterator[bytes]:
    """What a decompressor makes of some bytes, in bounded pieces; of damaged ones, what ``STEP`` bytes at a time give."""
    while feed:
        spare = machine.copy() if len(feed) > STEP and hasattr(machine, "copy") else None
        try:
            out = machine.decompress(feed, LONGEST_OUT) if hasattr(machine, "copy") else machine.decompress(feed)
        except DAMAGE:
            if spare:
                for lo in range(0, len(feed), STEP):
                    yield spare.decompress(feed[lo : lo + STEP])
            raise
        if out:
            yield out
        feed = getattr(machine, "unconsumed_tail", b"")


class Run:
    """Bytes of a base64 run that begins at a place of another stream, decoded from one of its first four characters on.

    Once a call is exhausted, ``end`` is where the run ends.
    """

    def __init__(self, source: Callable[[], Iterator[bytes]], place: int, skip: int):
        self.source, self.place, self.skip, self.end = source, place, skip, place

    def _lines(self) -> Iterator[bytes]:
        held, line, self.end = b"", 0, self.place
        for piece in _from(self.source(), self.place):
            held += piece
            while held:
                size = _RUN_LINE.match(held).end()
                if size:
                    yield held[:size]
                    line, held, self.end = line + size, held[size:], self.end + size
                if not held:
                    break
                gap = _RUN_BREAK.match(held) if line >= SHORTEST_LINE else None
                if gap is None:
                    return
                if gap.end() == len(held):
                    break  # more to come
                if not _RUN_LINE.match(held, gap.end()).end() > gap.end() or b"\n" not in gap[0]:
                    return
                line, held, self.end = 0, held[gap.end() :], self.end + gap.end()

    def __call__(self) -> Iterator[bytes]:
        held, skip = b"", self.skip
        for part in self._lines():
            held += part[skip:].translate(_PLAIN_BYTES)
            skip = max(0, skip - len(part))
            whole = len(held) - len(held) % 4
            if whole:
                yield base64.b64decode(held[:whole])
                held = held[whole:]
        if len(held) > 1:
            yield base64.b64decode(held + b"=" * (-len(held) % 4))


class Unescaped:
    """Another stream as text whose percent or Unicode escapes are undone.

    Bytes beyond ASCII outside escapes become question marks: they are part of no secret and of no encoded part.
    """

    def __init__(self, source: Callable[[], Iterator[bytes]], pattern: re.Pattern, decode):
        self.source, self.pattern, self.decode = source, pattern, decode

    def _undone(self, text: str) -> bytes:
        out, last = [], 0
        for m in self.pattern.finditer(text):
            raw, pieces = self.decode(m[0])
            out += [text[last : m.start()].encode("ascii", "replace"), raw or "".join(t for t, _, _ in pieces).encode()]
            last = m.end()
        return b"".join([*out, text[last:].encode("ascii", "replace")])

    def __call__(self) -> Iterator[bytes]:
        held = ""
        for piece in self.source():
            held += piece.decode("latin-1")
            # An escape, or a pair of them, may go on in the next piece.
            mark = min((at for sign in "%\\" if (at := held.find(sign, max(0, len(held) - LONGEST_ESCAPE))) >= 0), default=len(held))
            if mark:
                yield self._undone(held[:mark])
                held = held[mark:]
        yield self._undone(held)


def _windows(pieces: Iterable[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes, whether it is the last) of a stream in overlapping windows."""
    at, held = 0, bytearray()
    for piece in pieces:
        held += piece
        while len(held) > WINDOW:
            yield at, bytes(held[:WINDOW]), False
            del held[: WINDOW - OVERLAP]
            at += WINDOW - OVERLAP
    if held:
        yield at, bytes(held), True


@dataclass
class Window:
    """A window's text; ``encoded`` is the part of it whose encoded runs lie in this window."""

    text: str
    encoded: str
    whole: bool


def _parts(source: Callable[[], Iterator[bytes]], streams: set[bytes], texts: bool = True) -> Iterator[Window | Stream | Run | Unescaped]:
    """The windows of a stream, and the streams that its members, escapes and long base64 runs expand to, unless seen before.

    A member that ends in the window in which it begins is unpacked from there, and so is any chance magic, as it soon
    proves damaged.  Only what goes on beyond the window is read from the source again.  Without ``texts`` only members
    count.
    """
    whole, size, kept = hashlib.blake2b(digest_size=16), 0, bytearray()
    for piece in source():
        whole.update(piece)
        size += len(piece)
        if size <= WINDOW:
            kept += piece
        else:
            kept = bytearray()
    if not size or whole.digest() in streams:
        return
    streams.add(whole.digest())
    content, escapes, run_end, member_end, tried = bytes(kept), set(), 0, 0, -1
    for at, window, last in [(0, content, True)] if size <= WINDOW else _windows(source()):
        new = len(window) if last else len(window) - OVERLAP  # what starts later is whole or longer in the next window
        lo, hi, only = max(0, run_end - at), len(window), at == 0 and last
        if texts and not only:
            for n, (pattern, mark, _) in enumerate(ESCAPES):
                if n not in escapes and pattern.search(window.decode("latin-1")):
                    escapes.add(n)
            for m in _RUN.finditer(window, lo) if not last else ():
                if m.start() < new and _RUN_BREAK.fullmatch(window, m.end()):
                    hi = m.start()
        if texts:
            text = window.decode("utf-8", "replace")
            yield Window(text, text if only else window[lo:hi].decode("utf-8", "replace"), only)
        for m in _MAGIC.finditer(window):
            place = at + m.start()
            if place < member_end or place <= tried or m.start() >= new:
                continue
            tried = place
            member = Stream(lambda window=window: iter([window]), m.start())
            for _ in member():
                pass
            if member.open and not last:
                member = Stream(source, place)
                yield member  # read to its end before the next is asked for
                member_end = member.end
            else:
                member_end = at + member.end
                yield member
        if hi < len(window):
            for skip in range(4):
                run = Run(source, at + hi, skip)
                yield run
            run_end = run.end
    for n in sorted(escapes):
        yield Unescaped(source, ESCAPES[n][0], ESCAPES[n][2])


def _inside(raw: bytes) -> tuple[set[int], set[bytes]]:
    """Kinds of secret in all that a payload holds, and the digests of its layers that are text or hold a secret.

    Streams and layers are followed depth first, so one window a level is held.
    """
    kinds, texts, seen, streams = set(), set(), set(), set()
    # The payload's own bytes are not a layer.
    stack: list[Iterator] = [_parts(lambda: iter([raw]), streams, texts=False)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            continue
        if isinstance(child, (Stream, Run, Unescaped)):
            stack.append(_parts(child, streams))
            continue
        if isinstance(child, Payload):
            stack.append(_parts(lambda raw=child.raw: iter([raw]), streams))
            continue
        text = child.text
        digest = _digest(text.encode("utf-8", "surrogatepass"))
        if not text or digest in seen:
            continue
        seen.add(digest)
        found = {k for _, k, _ in base_spans(text)}
        kinds |= found
        # A window may begin and end within a character.
        if found or not (_CONTROL.search(text) or "\ufffd" in text[3:-3]):
            texts.add(digest)
        if isinstance(child, Layer) or child.whole:
            stack.append(_children(Layer(text, NOWHERE, NOWHERE)))
        else:
            stack.append(_base64_children(Layer(child.encoded, NOWHERE, NOWHERE)))
    return kinds, texts


def _as_text(raw: bytes) -> str | None:
    """Bytes as text, or None where they are not plausible text."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(text) else text


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> tuple[Layer | None, list[Payload]]:
    """The layer with each match replaced by its decoding, and compressed payloads among the matches."""
    out, lo, hi, last, packed = [], [], [], 0, []
    for m in pattern.finditer(layer.text):
        raw, pieces = decode(m[0])
        if _MAGIC.search(raw):
            packed.append(Payload(raw, int(layer.lo[m.start()]), int(layer.hi[m.end() - 1])))
        out.append(layer.text[last : m.start()])
        out.extend(text for text, _, _ in pieces)
        if layer.lo is not NOWHERE:
            kept = np.arange(last, m.start())
            lo += [kept, np.array([m.start() + a for text, a, _ in pieces for _ in text], np.int64)]
            hi += [kept, np.array([m.start() + b - 1 for text, _, b in pieces for _ in text], np.int64)]
        last = m.end()
    if not out:
        return None, []
    out.append(layer.text[last:])
    if layer.lo is NOWHERE:
        return Layer("".join(out), NOWHERE, NOWHERE), packed
    kept = np.arange(last, len(layer.text))
    return Layer("".join(out), _pick(layer.lo, np.concatenate([*lo, kept])), _pick(layer.hi, np.concatenate([*hi, kept]))), packed


def _decode_percent(run: str) -> tuple[bytes, list[tuple[str, int, int]]]:
    raw = unquote_to_bytes(run)
    try:
        raw.decode("utf-8")
        kind = "utf-8"
    except UnicodeDecodeError:
        kind = "latin-1"
    pieces, at = [], 0
    for ch in raw.decode(kind):
        size = len(ch.encode(kind))
        pieces.append((ch, 3 * at, 3 * (at + size)))
        at += size
    return raw, pieces


def _decode_escapes(run: str) -> tuple[bytes, list[tuple[str, int, int]]]:
    pieces: list[tuple[str, int, int]] = []
    for m in _ONE_ESCAPE.finditer(run):
        code = int(next(g for g in m.groups() if g), 16)
        if pieces and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(pieces[-1][0]) < 0xDC00:
            high, a, _ = pieces.pop()
            pieces.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), a, m.end()))
        else:
            pieces.append((chr(code) if code < 0x110000 else "\ufffd", m.start(), m.end()))
    codes = [ord(p[0]) for p in pieces]
    pieces = [("\ufffd" if 0xD800 <= ord(t) < 0xE000 else t, a, b) for t, a, b in pieces]
    return bytes(codes) if all(c < 256 for c in codes) else b"", pieces


def _base64_children(layer: Layer) -> Iterator[Layer | Payload]:
    """What each base64 run decodes to from its first four characters on, as a word before a blob may be glued to it."""
    for m in _BASE64.finditer(layer.text):
        run = m[0].rstrip("=")
        place = range(m.start(), m.end())
        if "\n" in run:
            place = m.start() + np.flatnonzero(np.frombuffer(run.encode(), np.uint8) > ord(" "))
        run, end = run.translate(_PLAIN_BASE64), m.end() - 1
        for skip in range(4):
            part = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            if packed := _MAGIC.search(raw):
                yield Payload(raw[packed.start() :], int(layer.lo[place[skip + packed.start() * 4 // 3]]), int(layer.hi[end]))
            text, plain = _as_text(raw), True
            if text is None:
                text, plain = raw.decode("latin-1"), False
                if not (base_spans(text) or any(p.search(text) for p in (_PERCENT, _ESCAPE, _BASE64))):
                    continue
            if layer.lo is NOWHERE:
                yield Layer(text, NOWHERE, NOWHERE, plain)
                continue
            sizes = np.ones(len(text), np.int64)
            if plain and len(raw) > len(text):
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                sizes += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            last = sizes.cumsum()
            after = skip + last * 4 // 3
            ends = np.where(after < len(place), _pick(place, np.minimum(after, len(place) - 1)), end)
            yield Layer(text, _pick(layer.lo, _pick(place, skip + (last - sizes) * 4 // 3)), _pick(layer.hi, ends), plain)


ESCAPES = ((_PERCENT, "%", _decode_percent), (_ESCAPE, "\\", _decode_escapes))


def _children(layer: Layer) -> Iterator[Layer | Payload]:
    for pattern, mark, decode in ESCAPES:
        if mark in layer.text:
            child, packed = _rewritten(layer, pattern, decode)
            if child:
                yield child
            yield from packed
    yield from _base64_children(layer)


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (both as (start, kind, end) of the root text) and the number of distinct layers that are text or hold a secret."""
    base, inside = base_spans(text), {}
    spans, texts, seen = set(base), {_digest(text.encode("utf-8", "surrogatepass"))}, set()
    work = [Layer(text, range(len(text)), range(1, len(text) + 1))]
    while work:
        layer = work.pop()
        for child in _children(layer):
            if isinstance(child, Payload):
                key = _digest(child.raw)
                if key not in inside:
                    inside[key] = _inside(child.raw)
                spans.update((child.first, k, child.last) for k in inside[key][0])
                texts |= inside[key][1]
                continue
            if not child.text:
                continue
            # The text and the characters it stands for decide all that is found below.
            digest = _digest(child.text.encode("utf-8", "surrogatepass"))
            state = digest + _digest(child.lo.tobytes() + child.hi.tobytes())
            if state in seen:
                continue
            seen.add(state)
            found = base_spans(child.text)
            if found or child.plain:
                texts.add(digest)
            spans.update((int(child.lo[a]), k, int(child.hi[b - 1])) for a, k, b in found)
            work.append(child)
    return base, sorted(spans), len(texts)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document the base counts and digest, all spans, and the number of layers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            found = [scan_text(t) for t in texts_of(b)]
            counts = [[sum(s[1] == k for s in base) for base, _, _ in found] for k in range(3)]
            columns = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts)]
            columns += [pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _, _ in found], pa.string()), pa.array([_joined(s) for _, s, _ in found], pa.string()), pa.array([n for _, _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact_text(text: str, mark: str = "[secret]") -> str:
    """The text with every span, base or decoded, replaced by ``mark`` (overlapping spans once)."""
    out, last, end = [], 0, -1
    start = None
    for a, _, b in scan_text(text)[1]:
        if start is not None and a < end:
            end = max(end, b)
            continue
        if start is not None:
            out += [text[last:start], mark]
            last = end
        start, end = a, b
    if start is not None:
        out += [text[last:start], mark]
        last = end
    return "".join(out) + text[last:]


def redact(docs: DataFrame) -> DataFrame:
    """Documents with secrets replaced in ``text`` and ``n_chars`` brought up to date; null texts stay null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            new = [None if t is None else redact_text(t) for t in b.column("text").to_pylist()]
            columns = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                columns["n_chars"] = pa.array([old if t is None else len(t) for t, old in zip(new, columns["n_chars"].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, in the text and in its encoded layers."""
    return secret_spans(read_table(spark, sf_dir, "documents"))
