"""Secret scans through nested encodings.

Each text is a worklist of layers. The text itself is scanned first; then percent escapes, Unicode, octal and character references and
base64 runs (compressed contents are inflated) are unwrapped in turn, each unwrapped layer is scanned again, and
the rounds go on until no decoder changes anything or a layer repeats. Runs of a layer know the
stretch of the original text they came from, so each finding is reported in the original's code points.

What is no clean text when unwrapped goes to a worklist of bytes (``contents``), whose findings all have the stretch of the
run that held them: base64 runs are decoded at each of the four offsets, since a run may begin with a name and '/', '-'
or '_', and over line ends; compressed streams are looked for in decoded base64, percent and backslash escapes alike,
and are inflated member after member, as often as they are nested. All patterns are ASCII, so bytes need no decoding.

Escapes that were escaped again and again would need as many rounds as they have levels: after ``ROUNDS`` rounds, each of them
scanned, what is left of them is undone in one pass from left to right (``peeled``), so the work stays linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import re
from collections import deque
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds, in the order of reports, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Named references to one ASCII character, as HTML has them.
REFERENCES = {name[:-1]: ord(c) for name, c in html5.items() if name.endswith(";") and len(name) <= 11 and len(c) == 1 and c < "\x80"}
ONE_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|%u[0-9A-Fa-f]{4}"
                         rf"|&(?:{'|'.join(sorted(REFERENCES))});")  # fmt: skip
# Octal escapes count where two or more stand together.
UNICODE = re.compile(ONE_UNICODE.pattern + r"|(?:\\[0-3][0-7]{2}){2,}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])")

#: A compressed layer that inflates to more bytes than this is scanned as a stream, in windows of this size (``windows``).
MAX_INFLATED = 64 << 20
#: Rounds of escapes that are undone one by one.
ROUNDS = 16

Found = tuple[str, int, int]


def scan(text: str) -> list[Found]:
    """The findings in this very text, by start, then kind."""
    found: list[Found] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


class TooLarge(Exception):
    pass


B64 = "A-Za-z0-9+/_-"
# The shortest finding has 12 bytes, 16 characters of base64.
RUN = rf"[{B64}]{{16,}}"
WRAPPED = rf"(?<![{B64}])[{B64}]{{16,}}+(?:[ \t]*+(?:\r?\n|\\r\\n|\\n)[ \t>]*+[{B64}]++)++"
BREAK = re.compile(rf"\\r\\n|\\n|[^\\{B64}]+")
BREAK_B = re.compile(BREAK.pattern.encode())
BASE64_RUNS = tuple(re.compile(p) for p in (RUN, WRAPPED))
BASE64_RUNS_B = tuple(re.compile(p.encode()) for p in (RUN, WRAPPED))
ESCAPE = re.compile(ONE_UNICODE.pattern + r"|\\[0-7]{1,3}|\\[abfnrtv\\'\"]")
ASSIGN_B, ACCESS_B, HEX_B, PERCENT_B, ESCAPE_B = (re.compile(p.pattern.encode(), p.flags & re.IGNORECASE) for p in (ASSIGN, ACCESS, HEX, PERCENT, ESCAPE))
ONE_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ENDED, ENDINGS = re.compile(rf"(?:%[0-9A-Fa-f]{{2}}|{ONE_UNICODE.pattern})$"), frozenset("0123456789abcdefABCDEF;}")
MAGIC = re.compile(r"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
MAGIC_B = re.compile(MAGIC.pattern.encode("latin-1"))
# ASCII characters of two bytes each, in either order; the shortest finding has 12.
UTF16_B = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}|(?:\0[\t\n\r\x20-\x7e]){12,}")
NAMED = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, "'": 39, '"': 34}
PIECE = 1 << 20


def opener(head: bytes):
    """A decompressor where head begins gzip, zlib, bzip2 or xz data, else None."""
    import bz2
    import lzma
    import zlib

    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 0x0F == 8 and head[0] >> 4 <= 7 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def deflate_pieces(raw: bytes) -> Iterator[bytes]:
    import zlib

    d = zlib.decompressobj(-15)
    yield d.decompress(raw, PIECE)
    while not d.eof and d.unconsumed_tail:
        yield d.decompress(d.unconsumed_tail, PIECE)


def headless(raw: bytes, depth: int) -> Iterator[tuple[int, bytes, int]]:
    """The contents of a deflate stream without a header, in windows; nothing where raw is none."""
    import zlib

    if len(raw) < 12 or raw[0] & 6 == 6 or opener(raw) is not None:
        return
    d, size = zlib.decompressobj(-15), 0
    try:
        piece = d.decompress(raw, PIECE)
        while True:
            size += len(piece)
            if d.eof or not d.unconsumed_tail:
                break
            piece = d.decompress(d.unconsumed_tail, PIECE)
    except zlib.error:
        return
    if d.eof and len(d.unused_data) < 4 and size >= 12:
        yield from windows(deflate_pieces(raw), depth)


def sliced(raw: bytes, at: int) -> Iterator[bytes]:
    size = 4096
    while at < len(raw):
        yield raw[at : at + size]
        at, size = at + size, min(2 * size, PIECE)


class Members:
    """The contents of the compressed streams that follow one another at the start of chunks, in pieces; what precedes an error or a missing end counts.

    ``done`` is the length of the whole streams, ``reach`` that of all that was read; ``left`` is what was read beyond the streams.
    """

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.done, self.reach, self.left = chunks, 0, 0, b""

    def __iter__(self) -> Iterator[bytes]:
        import lzma
        import zlib

        rest = b""
        while True:
            while len(bare := rest.lstrip(b"\0") if self.done else rest) < 10 and (more := next(self.chunks, None)) is not None:
                rest += more
            d = opener(bare)
            if d is None:
                self.left = rest
                return
            at, rest = self.done + len(rest) - len(bare), bare
            try:
                while not d.eof:
                    if not rest and not (rest := next(self.chunks, b"")):
                        self.reach = at
                        return
                    out = d.decompress(rest, PIECE)
                    yield out
                    if hasattr(d, "needs_input"):
                        while not d.eof and not d.needs_input:
                            yield d.decompress(b"", PIECE)
                    else:
                        while not d.eof and len(out) == PIECE:
                            yield (out := d.decompress(d.unconsumed_tail, PIECE))
                    at, rest = at + len(rest) - len(d.unused_data), d.unused_data
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                self.reach, self.left = at + len(rest), rest
                return
            self.done = self.reach = at


def inflated(raw: bytes) -> bytes:
    """The contents where raw is gzip, zlib, bzip2 or xz data, all members and as often as they are nested, else raw itself."""
    seen = set()
    while opener(raw) is not None and raw not in seen:
        seen.add(raw)
        out = bytearray()
        for piece in Members(sliced(raw, 0)):
            out += piece
            if len(out) > MAX_INFLATED:
                raise TooLarge
        if not out:
            return raw
        raw = bytes(out)
    return raw


# Bytes at which no match and no run is open: what no pattern has, and line ends that no wrapped base64 goes over.
_OTHER, _OWN = rb"[^A-Za-z0-9+/_\s>\\-]", rb"[A-Za-z0-9+/_-]"
BOUNDARY = re.compile(rb"[^\t\n\r\x20-\x7e]|(?:" + b"|".join(rb"(?<=%s%s{%d})" % (before, _OWN, k) for before in (_OTHER, _OWN + rb"\x20") for k in range(16)) + rb")\r?\n|(?<=" + _OTHER + rb")[\r\n]")
#: Windows cut inside a run have so many bytes in common.
OVERLAP = 1 << 20


def cut_at(window: bytes) -> int:
    """The end of the last boundary, or 0. Looks at the last stretches first."""
    size = 1 << 16
    while True:
        found = 0
        for m in BOUNDARY.finditer(window, max(0, len(window) - size), len(window) - 1):
            found = m.end()
        if found or size >= len(window):
            return found
        size *= 8


def windows(chunks: Iterator[bytes], depth: int) -> Iterator[tuple[int, bytes, int]]:
    """Depth, contents and whether a run was cut: what inflates to more than MAX_INFLATED bytes comes in windows of that size.

    Windows end where no match is open. Where there is no such place the next one overlaps by OVERLAP bytes, which
    counts as closed. A large stream that is itself compressed is inflated as a stream as well.
    """
    out, first = bytearray(), True
    for piece in chunks:
        out += piece
        if first and len(out) > MAX_INFLATED and opener(bytes(out[:10])) is not None:
            own = Members(itertools.chain([bytes(out)], chunks))
            yield from windows(iter(own), depth + 1)
            out, first = bytearray(own.left), False
        while len(out) > MAX_INFLATED:
            first = False
            window = bytes(out[:MAX_INFLATED])
            at = cut_at(window)
            yield depth, window[: at or MAX_INFLATED], int(not at)
            del out[: at or max(1, MAX_INFLATED - OVERLAP)]
    yield depth, bytes(out), 0


def streams(raw: bytes, depth: int) -> Iterator[tuple[int, int, Iterator[tuple[int, bytes, int]], Members]]:
    """Where compressed data begins in raw, and its contents."""
    at = 0 if opener(raw[:10]) is not None else -1
    while True:
        if at < 0 or at and not MAGIC_B.match(raw, at):
            m = MAGIC_B.search(raw, max(at, 0))
            if m is None:
                return
            at = m.start()
        own = Members(sliced(raw, at))
        yield at, windows(iter(own), depth), own
        at += max(1, own.done)


def escaped_byte(token: str) -> bytes:
    if token[0] == "%" and token[1] != "u":
        return bytes.fromhex(token[1:])
    if token[0] == "\\" and token[1] in NAMED:
        return bytes([NAMED[token[1]]])
    if token[0] == "\\" and token[1] in "01234567":
        return bytes([int(token[1:], 8) & 255])
    got = from_unicode(token)
    if got is None:
        return token.encode()
    code = ord(got[0][0])
    return bytes([code]) if code < 256 else chr(code).encode()


def decoded(run: bytes) -> Iterator[bytes]:
    run = run.replace(b"-", b"+").replace(b"_", b"/")
    for offset in range(4):
        own = run[offset:]
        if len(own) % 4 == 1:
            own = own[:-1]
        yield base64.b64decode(own + b"=" * (-len(own) % 4))


def kinds_in(raw: bytes) -> set[str]:
    lower = raw.lower()
    found = set()
    if any(w.encode() in lower for w in ASSIGN_WORDS) and any(len(m[2]) >= ASSIGN_LEAST for m in ASSIGN_B.finditer(raw)):
        found.add("assign")
    if b"AKIA" in raw and ACCESS_B.search(raw):
        found.add("access")
    if HEX_B.search(raw):
        found.add("hex")
    return found


Within = tuple[int, set[str], int]  # depth, kinds, and layers that stayed closed


def contents(raw: bytes, depth: int, seen: set[bytes]) -> Iterator[Within]:
    """The kinds in raw and in all that it wraps, breadth first; seen holds the digests of what has been gone through, so cycles end."""
    work = deque([(raw, depth, 0)])
    while work:
        raw, depth, rounds = work.popleft()
        mark = hashlib.blake2b(raw, digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        yield depth, kinds_in(raw), 0
        plain = [raw]
        if rounds >= ROUNDS:
            work.append((peeled_bytes(raw), depth + 1, 0))
        else:
            if PERCENT_B.search(raw):
                plain.append(ONE_PERCENT_B.sub(lambda m: bytes.fromhex(m[0][1:].decode()), raw))
                if b"+" in raw:
                    plain.append(ONE_PERCENT_B.sub(lambda m: bytes.fromhex(m[0][1:].decode()), raw.replace(b"+", b" ")))
            if (b"\\" in raw or b"&" in raw or b"%u" in raw) and ESCAPE_B.search(raw):
                plain.append(ESCAPE_B.sub(lambda m: escaped_byte(m[0].decode()), raw))
        work.extend((p, depth + 1, rounds + 1) for p in plain[1:])
        for k, own in enumerate(plain):
            for _, inner, _ in streams(own, depth + 1 + (k > 0)):
                for d, window, closed in inner:
                    if closed:
                        yield d, set(), closed
                    if len(window) <= PIECE:
                        work.append((window, d, 0))
                    else:  # a stream's windows are gone through as they come
                        yield from contents(window, d, seen)
        if b"\0" in raw:
            work.extend((m[0].replace(b"\0", b""), depth + 1, 0) for m in UTF16_B.finditer(raw))
        for pattern in BASE64_RUNS_B:
            for m in pattern.finditer(raw):
                for inner in decoded(BREAK_B.sub(b"", m[0])):
                    work.append((inner, depth + 1, 0))
                    for d, window, closed in headless(inner, depth + 2):
                        yield d, set(), closed
                        yield from contents(window, d, seen)


def unpacked(inner: Iterator[tuple[int, bytes, int]], seen: set[bytes]) -> Iterator[Within]:
    for depth, window, closed in inner:
        if closed:
            yield depth, set(), closed
        if window:
            yield from contents(window, depth, seen)


def peeled(text: str) -> tuple[str, list[int]] | None:
    """The text with all escapes undone, those too that undoing makes; and where each character of it begins. None without any."""
    out: list[str] = []
    came: list[int] = []
    changed = False
    for i, c in enumerate(text):
        out.append(c)
        came.append(i)
        while out[-1] in ENDINGS and (m := ENDED.search("".join(out[-12:]))):
            got = chr(int(m[0][1:], 16)) if m[0][0] == "%" and m[0][1] != "u" else (from_unicode(m[0]) or [("\ufffd", 0, 0)])[0][0]
            at = came[-len(m[0])]
            del out[-len(m[0]) :], came[-len(m[0]) :]
            out.append(got)
            came.append(at)
            changed = True
    return ("".join(out), came) if changed else None


def peeled_bytes(raw: bytes) -> bytes:
    got = peeled(raw.decode("latin-1"))
    return raw if got is None else got[0].encode("latin-1", "replace")


ONE_PERCENT_B = re.compile(ONE_PERCENT.pattern.encode())


def as_bytes(text: str, pattern: re.Pattern | None) -> tuple[bytes, list[int] | range]:
    """The text with its escapes as bytes, and the character that each byte comes from, with the length last. Without a pattern characters are bytes."""
    if pattern is None:
        return text.encode("latin-1", "replace"), range(len(text) + 1)
    out, at, came = bytearray(), 0, []
    for m in [*pattern.finditer(text), None]:
        for i in range(at, m.start() if m else len(text)):
            one = text[i].encode("utf-8", "surrogatepass")
            out += one
            came += [i] * len(one)
        if m:
            one = escaped_byte(m[0])
            out += one
            came += [m.start()] * len(one)
            at = m.end()
    return bytes(out), [*came, len(text)]


class Spans:
    """Where the characters of a layer come from: runs that were copied, and runs that all come from one stretch of the original."""

    def __init__(self):
        self.at: list[int] = []
        self.of: list[tuple[int, int, bool]] = []
        self.n = 0

    def add(self, n: int, a: int, b: int, copied: bool) -> None:
        if n:
            self.at.append(self.n)
            self.of.append((a, b, copied))
            self.n += n

    def take(self, other: Spans, lo: int, hi: int) -> None:
        """The characters lo..hi of another layer."""
        k = bisect.bisect_right(other.at, lo) - 1
        while lo < hi:
            end = min(hi, other.at[k + 1] if k + 1 < len(other.at) else other.n)
            a, b, copied = other.of[k]
            shift = lo - other.at[k] if copied else 0
            self.add(end - lo, a + shift, a + shift + end - lo if copied else b, copied)
            lo, k = end, k + 1

    def start(self, i: int) -> int:
        k = bisect.bisect_right(self.at, i) - 1
        a, _, copied = self.of[k]
        return a + (i - self.at[k] if copied else 0)

    def end(self, i: int) -> int:
        k = bisect.bisect_right(self.at, i) - 1
        a, b, copied = self.of[k]
        return a + i - self.at[k] + 1 if copied else b


def branches(text: str, spans: Spans, depth: int, tried: set) -> Iterator[tuple[int, list[Found], int]]:
    """What the base64 runs and the compressed bytes of a layer hold: as layers() gives it."""
    def told(within: Iterator[Within], a: int, b: int):
        for at, kinds, closed in within:
            if kinds or closed:
                yield at, [(k, spans.start(a), spans.end(b - 1)) for k in KINDS if k in kinds], closed

    for pattern in BASE64_RUNS:
        for m in pattern.finditer(text):
            key = (m[0], spans.start(m.start()))
            if key in tried:
                continue
            tried.add(key)
            for raw in decoded(BREAK.sub("", m[0]).encode() if pattern is BASE64_RUNS[1] else m[0].encode()):
                yield from told(contents(raw, depth + 1, set()), m.start(), m.end())
                yield from told(unpacked(headless(raw, depth + 2), set()), m.start(), m.end())
    ways: list[tuple[str, re.Pattern | None]] = [(text, None)]
    if occurs(PERCENT, text):
        ways += [(text, ONE_PERCENT)] + [(text.replace("+", " "), ONE_PERCENT)] * ("+" in text)
    if ("\\" in text or "&" in text or "%u" in text) and ESCAPE.search(text):
        ways.append((text, ESCAPE))
    for own, pattern in ways:
        if pattern is None:
            if not MAGIC.search(own):
                continue
        elif not MAGIC_B.search((ONE_PERCENT_B if pattern is ONE_PERCENT else ESCAPE_B).sub(lambda m: escaped_byte(m[0].decode()), own.encode("utf-8", "surrogatepass"))):
            continue
        raw, came = as_bytes(own, pattern)
        for at, inner, members in streams(raw, depth + 1):
            held, shut = {}, 0
            for d, kinds, closed in unpacked(inner, set()):
                shut += closed
                for k in kinds:
                    held[k] = min(d, held.get(k, d))
            last = max(came[at], came[min(len(raw), at + max(1, members.reach))] - 1)
            for d in sorted(set(held.values())):
                yield d, [(k, spans.start(came[at]), spans.end(last)) for k in KINDS if held.get(k) == d], 0
            if shut:
                yield depth + 1, [], shut


def readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\r\n" for c in text) else None


Piece = tuple[str, int, int]  # decoded text, and the stretch of the match that each of its characters comes from


def from_percent(token: str) -> list[Piece] | None:
    raw = bytes.fromhex(token.replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return [(raw.decode("latin-1"), 0, len(token))]
    pieces, at = [], 0
    for c in text:
        n = 3 * len(c.encode())
        pieces.append((c, at, at + n))
        at += n
    return pieces


def from_unicode(token: str) -> list[Piece] | None:
    if token.startswith("&#"):
        code = int(token[3:-1], 16) if token[2] in "xX" else int(token[2:-1])
    elif token[0] == "&":
        code = REFERENCES[token[1:-1]]
    elif token[1] in "0123":
        return [(chr(int(token[i + 1 : i + 4], 8)), i, i + 4) for i in range(0, len(token), 4)]
    elif token.count("\\u") == 2:
        high, low = int(token[2:6], 16), int(token[8:12], 16)
        code = 0x10000 + ((high - 0xD800) << 10) + (low - 0xDC00)
    else:
        code = int(token.strip("%\\uUx{}"), 16)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return None
    return [(chr(code), 0, len(token))]


def from_base64(token: str) -> list[Piece] | None:
    body = token.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if "-" in body or "_" in body else None, validate=True)
    except (binascii.Error, ValueError):
        return None
    text = readable(inflated(raw))
    return [(text, 0, len(token))] if text else None


DECODERS: tuple[tuple[re.Pattern, Callable], ...] = ((PERCENT, from_percent), (UNICODE, from_unicode), (BASE64, from_base64))


def occurs(pattern: re.Pattern, text: str) -> bool:
    """Whether there is something to undo; most texts have none of the marks, which are found faster than a pattern."""
    marks = ("%",) if pattern is PERCENT else ("\\", "&", "%u") if pattern is UNICODE else ("",)
    return any(m in text for m in marks) and pattern.search(text) is not None


def unwrapped(text: str, spans: Spans, pattern: re.Pattern, decode: Callable) -> tuple[str, Spans] | None:
    """The next layer with its map into the original, or None where nothing was decoded. Layers too large for this are left to branches."""
    if not occurs(pattern, text):
        return None
    out, to, at, changed = [], Spans(), 0, False
    for m in pattern.finditer(text):
        try:
            pieces = decode(m.group())
        except TooLarge:
            continue
        if pieces is None:
            continue
        a = m.start()
        out.append(text[at:a])
        to.take(spans, at, a)
        for piece, lo, hi in pieces:
            out.append(piece)
            to.add(len(piece), spans.start(a + lo), spans.end(a + hi - 1), False)
        at, changed = m.end(), True
    if not changed:
        return None
    out.append(text[at:])
    to.take(spans, at, len(text))
    return "".join(out), to


def all_peeled(text: str, spans: Spans) -> tuple[str, Spans] | None:
    got = peeled(text)
    if got is None:
        return None
    layer, came = got
    to, i = Spans(), 0
    while i < len(layer):
        j = i + 1
        if layer[i] == text[came[i]] and (came[j] if j < len(came) else len(text)) == came[i] + 1:
            while j < len(layer) and came[j] == came[i] + j - i and layer[j] == text[came[j]] and (came[j + 1] if j + 1 < len(came) else len(text)) == came[j] + 1:
                j += 1
            to.take(spans, came[i], came[i] + j - i)
        else:
            to.add(1, spans.start(came[i]), spans.end((came[j] if j < len(came) else len(text)) - 1), False)
        i = j
    return layer, to


def layers(text: str) -> Iterator[tuple[int, list[Found], int]]:
    """Depth, findings in the original's code points, and layers that stayed closed, for the text and all that it wraps."""
    yield 0, scan(text), 0
    spans = Spans()
    spans.add(len(text), 0, len(text), True)
    tried: set = set()
    yield from branches(text, spans, 0, tried)
    if not any(occurs(pattern, text) for pattern, _ in DECODERS):
        return
    seen, depth, rounds, moved = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}, 0, 0, True
    while moved:
        moved, rounds = False, rounds + 1
        steps = [lambda t, own, p=pattern, d=decode: unwrapped(t, own, p, d) for pattern, decode in DECODERS]
        for step in steps if rounds <= ROUNDS else [all_peeled, steps[-1]]:
            got = step(text, spans)
            if got is None or not got[0]:
                continue
            layer, to = got
            mark = hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if mark in seen:  # a cycle
                continue
            seen.add(mark)
            text, spans, moved, depth = layer, to, True, depth + 1
            yield depth, [(kind, spans.start(a), spans.end(b - 1)) for kind, a, b in scan(text)], 0
            yield from branches(text, spans, depth, tried)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.int32())])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, closed_layers = [], []
        for value in batch.column(1):
            own: dict[Found, int] = {}
            shut = 0
            for depth, found, closed in layers(value.as_py() or ""):
                shut += closed
                for f in found:
                    own.setdefault(f, depth)
            ordered = sorted(own.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
            spans.append([{"kind": k, "start": a, "end": b, "layer": depth} for (k, a, b), depth in ordered])
            closed_layers.append(shut)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN)), pa.array(closed_layers, pa.int64())], ["doc_id", "spans", "closed_layers"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, layer; end exclusive, layer 0 is the text itself), closed_layers.

    closed_layers counts the windows of very large layers that had to be cut inside a run; findings and plain runs across
    such a cut are still found, as windows overlap, but compressed bytes across it are read up to the cut only.
    A null text counts as empty. Null and repeated identifiers pass through, a row each; an empty input gives an
    empty result; other columns play no part. A finding reached in several layers is reported once, with the first.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,layer:int>>, closed_layers bigint"
    return rows.mapInArrow(_scan_batches, schema)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found stretch of text replaced by mark; overlapping stretches count as one."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(at):
                text = value.as_py()
                for a, b in reversed(_merged({(a, b) for _, found, _ in layers(text or "") for _, a, b in found})):
                    text = text[:a] + mark + text[b:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(run, docs.schema)


def _merged(stretches: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op3(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_digest("spans"), _told(F.col("spans")).alias("spans"), "closed_layers")


def base_spans(spark, sf_dir: str) -> DataFrame:
    """What op3 finds in the texts as they stand, the part of it that SQL can express."""
    from tripledger.llm.common import table

    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", *_digest("spans"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _digest(spans: str) -> list[Column]:
    base = F.filter(spans, lambda s: s["layer"] == 0)
    return [*(_n_of(base, kind) for kind in KINDS), F.sha2(_told(base), 256).alias("base_sha256")]


def _n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _found_sql(place: int, kind: str, pattern: str, kept: str) -> str:
    """SQL for the matches of one kind as a list of structs: a match begins after all pieces and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      'start': list_sum(list_transform(pieces[:i], lambda p: length(p))) + coalesce(list_sum(list_transform(m[:i - 1], lambda p: length(p))), 0),
      'place': {place}, 'kind': '{kind}', 'size': length(m[i]), 'value': length(v[i])}}), lambda f: f.{kept}) AS found
  FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {int(kind == "assign")}) AS v, string_split_regex(t, '{quoted}') AS pieces
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


BASE_SQL = f"""
WITH found AS ({" UNION ALL ".join((
    _found_sql(1, "assign", "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", "value >= 6"),
    _found_sql(2, "access", "AKIA[A-Z0-9]{16,}", "size >= 20"),
    _found_sql(3, "hex", "[0-9a-f]{24,}", "size >= 24"),
))}),
spans AS (SELECT doc_id, list_sort(flatten(list(found))) AS s FROM found GROUP BY doc_id)
SELECT doc_id, len(list_filter(s, lambda f: f.kind = 'assign')) AS n_assign, len(list_filter(s, lambda f: f.kind = 'access')) AS n_access,
  len(list_filter(s, lambda f: f.kind = 'hex')) AS n_hex,
  sha256(coalesce(array_to_string(list_transform(s, lambda f: f.kind || ':' || CAST(f.start AS BIGINT) || ':' || CAST(f.start + f.size AS BIGINT)), ','), '')) AS base_sha256
FROM spans"""
