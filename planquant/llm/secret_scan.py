"""Secret scans: a worklist of decoded layers, each rescanned, with spans mapped to the text as it was.

Base kinds, found in every whole text: assign, access, hex (see `base_spans`). The worklist starts with the text
itself and takes, from each layer, the layers below it:

* the layer with every run of URL escapes (%41), or of Unicode escapes (\\u0041, \\x41), replaced once, position by position;
* the layer in which escapes of both kinds are replaced until none is left, escapes of escapes included. A stack does so in
  one pass over the characters that an escape can have, so a chain of any depth takes time in proportion to its length;
* every base64 run (19 characters or more, as many as the shortest match has; both alphabets; runs that fill whole lines one after the
  other, quoted or indented or not, also joined) as layers of its own, one for each of the four alignments where it isn't text or
  compressed data from its start, since characters of the alphabet may stand before it: the text that its bytes are (UTF-8, or byte by byte where they are no UTF-8), or what they
  inflate to as zlib or gzip data, once or more often, where a head of such data starts a group of the run;
* bytes written in URL, \\x or \\u escapes (with plain characters between) that start with a zlib or gzip head: what they inflate to;
* a layer with NUL characters without them: UTF-16 text, of which one byte after the other was decoded.

Inflated data is scanned whole, in parts of about `STEP` bytes, cut where no match can
cross; only an unbroken run longer than that is held whole.

A layer whose digest has been seen is not opened again, so cycles end; the rest ends as each step shortens the text
or unpacks it. A match found in a lower layer becomes a span over the characters of the original text from which
its own characters come; it is added unless the base has the same span. Matches of a lower layer that touch no decoded
character are those of the layer above and are left out.

Null and empty texts have no spans; repeated rows give repeated results; texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from planquant.llm.common import Kept, arrow_map, slices

KINDS = ("assign", "access", "hex")
#: Bytes inflated at a time; no bound on what is inflated.
STEP = 1 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Every assignment has a letter pair of one of its keywords before a separator; this only tells texts that can't have one.
_ASSIGN_KEY = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
#: Characters that an escape, or an escape of an escape, can go on with.
_REGION = re.compile(r"[%\\][%\\0-9A-Fa-fxu]*")
_COMPRESSED = re.compile(rb"\x1f\x8b|\x78")
#: Up to the last character that is in no match, escape or base64 run, or a blank between words that no escape touches, or the end of
#: a line that no run goes on from.
_LAST_CUT = re.compile(r"""(?s:.*)(?:[^A-Za-z0-9+/_.=\-"'\x20:%\\\r\n\t,;>]|\x20[A-Za-z0-9]+\x20(?=[A-Za-z0-9])|(?<![A-Za-z0-9+/_-]{19})(?<![\x20\t"',;>\r])\n)""")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
#: Runs that fill line after line, quoted or indented or not, of 19 characters or more; the last of any length.
_WRAPPED = re.compile(r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}+(?:[\x20\t"',;>]*+\r?\n[\x20\t"'>]*+[A-Za-z0-9+/_-]{19,}+)*+(?:[\x20\t"',;>]*+\r?\n[\x20\t"'>]*+[A-Za-z0-9+/_-]++)?={0,2}""")
_NO_BASE64 = re.compile(r"[^A-Za-z0-9+/_-]+")
_NULS = re.compile(r"\x00+([^\x00]?)")
#: A word, number or hex run, whose bytes hold no secret and no layer: those all need other letters in any alignment (tested).
_PLAIN = re.compile(r"[0-9]*[A-Za-z]?[a-z]*|[0-9a-fA-F]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), leftmost and non-overlapping per kind; matches that fail their size are dropped."""
    out = []
    if _ASSIGN_KEY.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text, and for each piece of it where that comes from in the original."""

    __slots__ = ("pieces", "starts", "text")

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int, bool]]):
        #: (start, end, start and end in the original, whether its characters were decoded), without gaps.
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    def original(self, start: int, end: int) -> tuple[int, int, bool]:
        """The original's characters behind [start, end), and whether any was decoded."""
        from bisect import bisect_right

        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, b = self.pieces[i], self.pieces[j]
        first = a[2] if a[4] else a[2] + start - a[0]
        last = b[3] if b[4] else b[2] + end - b[0]
        return first, last, any(self.pieces[k][4] for k in range(i, j + 1))


def _inflated(parts: Iterator[bytes]) -> Iterator[bytes]:
    """What zlib or gzip data (all members) inflates to, in parts of `STEP` bytes at most; zlib.error if it is neither or broken."""
    one, first, rest = zlib.decompressobj(47), True, b""
    for part in parts:
        rest += part
        while True:
            if one.eof:
                if len(rest) < 2:
                    break
                if rest[:2] != b"\x1f\x8b":
                    return
                one, first = zlib.decompressobj(47), False
            try:
                out = one.decompress(rest, STEP)
            except zlib.error:
                if first:
                    raise
                return
            if out:
                yield out
            rest = one.unused_data if one.eof else one.unconsumed_tail
            if not (one.eof or rest or len(out) == STEP):
                break


def _opened(data: bytes, depth: int) -> Iterator[bytes]:
    """The data, inflated `depth` times, in parts."""
    parts = (data[k : k + STEP] for k in range(0, len(data), STEP))
    for _ in range(depth):
        parts = _inflated(parts)
    return parts


def _cut(parts: Iterator[bytes], encoding: str) -> Iterator[str]:
    """Parts of text, cut only where no match and no run can go on in any layer."""
    decoder, held = codecs.getincrementaldecoder(encoding)(), []
    for part in parts:
        if held and (m := _LAST_CUT.match(held[-1])):
            yield "".join(held[:-1]) + m[0]
            held = [held[-1][m.end() :]]
        held.append(decoder.decode(part))
    if text := "".join(held):
        yield text


def _texts(data: bytes) -> Iterator[str]:
    """The text that the data is, and those of all layers of zlib or gzip data inside each other, in parts.

    Each layer is read once for its digest and whether it is UTF-8, then again for the text; it is held only where it
    is no longer than `STEP` or what it came from. Layers seen before end the chain. The innermost layer counts as text
    byte by byte if it is no UTF-8."""
    depth, seen = 0, set()
    while True:
        decoder, digest, head, kept, size, text = codecs.getincrementaldecoder("utf-8")(), hashlib.sha256(), b"", [], 0, True
        try:
            for part in _opened(data, depth):
                digest.update(part)
                head = head or part[:2] if len(head) != 1 else head + part[:1]
                size += len(part)
                if text:
                    try:
                        decoder.decode(part)
                    except UnicodeDecodeError:
                        text = False
                if kept is not None:
                    kept.append(part)
                    if size > max(STEP, len(data)):
                        kept = None
        except zlib.error:
            return
        if not size or digest.digest() in seen:
            return
        seen.add(digest.digest())
        if kept is not None:
            data, depth = b"".join(kept), 0
        text = text and not decoder.getstate()[0]
        if text or not _COMPRESSED.match(head):
            yield from _cut(_opened(data, depth), "utf-8" if text else "latin-1")
        if not _COMPRESSED.match(head):
            return
        depth += 1


#: Heads of gzip and zlib data.
_HEADS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")


def _inflates(data: bytes) -> bool:
    try:
        zlib.decompressobj(47).decompress(data, 64)
    except zlib.error:
        return False
    return True


def _whole(data: bytes) -> bool:
    """Whether bytes from a run's own start are text or compressed data, so that other alignments have nothing to say."""
    if _COMPRESSED.match(data) and _inflates(data[:64]):
        return True
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _base64_texts(run: str) -> Iterator[str]:
    """What a run holds in each of its four alignments; one if it is whole from its own start. Characters before the true start decode to bytes that mean nothing and end
    with a group, so text behind them is whole; compressed data is tried wherever its head starts a group."""
    body = run.rstrip("=").translate({45: 43, 95: 47})
    for shift in range(4):
        own = body[shift:]
        own = own[:-1] if len(own) % 4 == 1 else own
        try:
            data = base64.b64decode(own + "=" * (-len(own) % 4))
        except (binascii.Error, ValueError):
            continue
        yield from _texts(data)
        if not shift and _whole(data):
            return
        for m in _HEADS.finditer(data, 1):
            if m.start() % 3 == 0 and _inflates(data[m.start() : m.start() + 64]):
                yield from _texts(data[m.start() :])


#: Where compressed bytes begin in URL escapes, and in \x or \u escapes; one byte of what they go on with.
_URL_HEAD = re.compile(r"%1[fF]%8[bB]%08|(?:%78|(?<![A-Za-z0-9])x|(?<=%[0-9A-Fa-f]{2})x)(?:%01|%5[eE]|\^|%9[cC]|%[dD][aA])")
_URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|([^\s\"<>\x80-\U0010FFFF])")
_CODE_HEAD = re.compile(r"\\(?:x|u00)1[fF]\\(?:x|u00)8[bB]\\(?:(?:x|u00)08|b)|(?:\\(?:x|u00)78|(?<![A-Za-z0-9])x)(?:\\(?:x|u00)(?:01|5[eE]|9[cC]|[dD][aA])|\^)")
_CODE_BYTE = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|([^\\\n\x80-\U0010FFFF])|\\([\\'\"abfnrtv0/])")
_SHORT = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "\\": 92, "'": 39, '"': 34, "/": 47}


def _escaped_data(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of compressed data that is written in escapes, plain characters between them."""
    for head, byte in ((_URL_HEAD, _URL_BYTE), (_CODE_HEAD, _CODE_BYTE)):
        at = 0
        while m := head.search(text, at):
            data, ends, fed, opened = bytearray(), [m.start()], 0, zlib.decompressobj(47)
            try:
                while not opened.eof and (x := byte.match(text, ends[-1])):
                    data.append(int(x[1], 16) if x[1] else ord(x[2]) if x[2] else _SHORT[x[3]])
                    ends.append(x.end())
                    if len(data) == fed + 512:
                        opened.decompress(bytes(data[fed:]))
                        fed = len(data)
                if not opened.eof:
                    opened.decompress(bytes(data[fed:]))
            except zlib.error:
                at = m.end()
                continue
            n = len(data) - len(opened.unused_data)
            yield m.start(), ends[n], bytes(data[:n])
            at = max(ends[n], m.end())


def _escaped(run: str) -> list[tuple[int, int, str]] | None:
    """(start, end, character) for each character that a run of escapes stands for; None if it stands for no text."""
    if run[0] == "%":
        data = bytes.fromhex(run.replace("%", ""))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return None
        out, at = [], 0
        for c in text:
            n = 3 * len(c.encode())
            out.append((at, at + n, c))
            at += n
        return out
    out = []
    for m in re.finditer(r"\\u([0-9A-Fa-f]{4})(?:(?<=\\u[dD][89abAB]..)\\u([dD][c-fC-F][0-9A-Fa-f]{2}))?|\\x([0-9A-Fa-f]{2})", run):
        code = int(m[3] or m[1], 16)
        if m[2]:
            code = 0x10000 + ((code - 0xD800) << 10) + int(m[2], 16) - 0xDC00
        out.append((m.start(), m.end(), "�" if 0xD800 <= code < 0xE000 else chr(code)))
    return out


def _rewritten(layer: Layer, changes: list[tuple[int, int, list[tuple[int, int, str, bool]]]]) -> Layer:
    """The layer with each [start, end) replaced by characters, each of which stands for [a, b); the others stay as they are."""
    text, pieces, n, p = [], [], 0, 0

    def keep(a: int, b: int) -> None:
        """Copies [a, b), by the pieces of the layer above; calls come in order."""
        nonlocal n, p
        while a < b:
            while layer.pieces[p][1] <= a:
                p += 1
            x = layer.pieces[p]
            c = min(b, x[1])
            pieces.append((n, n + c - a, *((x[2], x[3], True) if x[4] else (x[2] + a - x[0], x[2] + c - x[0], False))))
            text.append(layer.text[a:c])
            n, a = n + c - a, c

    at = 0
    for start, end, found in changes:
        keep(at, start)
        for a, b, c, decoded in found:
            if not decoded:
                keep(a, b)
                continue
            first, last, _ = layer.original(a, b)
            pieces.append((n, n + 1, first, last, True))
            text.append(c)
            n += 1
        at = end
    keep(at, len(layer.text))
    return Layer("".join(text), pieces)


def _unescaped(layer: Layer, pattern: re.Pattern) -> Layer | None:
    """The layer with what `pattern` finds replaced once; None if that changes nothing."""
    changes = [(m.start(), m.end(), [(m.start() + a, m.start() + b, c, True) for a, b, c in found]) for m in pattern.finditer(layer.text) if (found := _escaped(m[0]))]
    return _rewritten(layer, changes) if changes else None


_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def _reduced(region: str, data: bool = False) -> list[tuple[int, int, str, bool]] | None:
    """(start, end, character, decoded) of a region with escapes replaced until none is left; None if it has none.

    Bytes that are no UTF-8 together stay as they were written. With `data`, all that was decoded is written in URL
    escapes of one level."""
    stack: list[tuple[int, int, str | int, bool]] = []
    done = False

    def code(k: int) -> int | None:
        """The number that the last k items write in hexadecimal."""
        if len(stack) < k or any(x[2] not in _HEX_DIGITS for x in stack[-k:]):
            return None
        return int("".join(x[2] for x in stack[-k:]), 16)

    for at, c in enumerate(region):
        stack.append((at, at + 1, c, False))
        while stack[-1][2] in _HEX_DIGITS:
            if len(stack) > 2 and stack[-3][2] == "%" and (n := code(2)) is not None:
                new, size = n if n > 127 else chr(n), 3
            elif len(stack) > 3 and stack[-3][2] == "x" and stack[-4][2] == "\\" and (n := code(2)) is not None:
                new, size = chr(n), 4
            elif len(stack) > 5 and stack[-5][2] == "u" and stack[-6][2] == "\\" and (n := code(4)) is not None:
                new, size = chr(n), 6
                if 0xDC00 <= n < 0xE000 and len(stack) > 6 and isinstance(high := stack[-7][2], str) and "\ud800" <= high < "\udc00":
                    new, size = chr(0x10000 + ((ord(high) - 0xD800) << 10) + n - 0xDC00), 7
            else:
                break
            first, done = stack[-size][0], True
            del stack[-size:]
            stack.append((first, at + 1, new, True))
    if not done:
        return None
    if data:
        code = lambda c: c if isinstance(c, int) else ord(c)
        single = lambda a, b, c, decoded: [(a, b - 2, "%", True), (b - 2, b - 1, f"{code(c):02X}"[0], True), (b - 1, b, f"{code(c):02X}"[1], True)] if decoded and code(c) < 256 else [(a, b, c, decoded)]
        return [y for x in stack for y in single(*x)]
    out: list[tuple[int, int, str, bool]] = []
    k = 0
    while k < len(stack):
        a, b, c, decoded = stack[k]
        if isinstance(c, str):
            out.append((a, b, "\ufffd" if "\ud800" <= c < "\ue000" else c, decoded))
            k += 1
            continue
        end = k
        while end < len(stack) and isinstance(stack[end][2], int):
            end += 1
        run = stack[k:end]
        try:
            text = bytes(x[2] for x in run).decode()
        except UnicodeDecodeError:
            out += [(p, p + 1, region[p], False) for p in range(run[0][0], run[-1][1])]
        else:
            i = 0
            for c in text:
                n = len(c.encode())
                out.append((run[i][0], run[i + n - 1][1], c, True))
                i += n
        k = end
    return out


def _fully_unescaped(layer: Layer, data: bool = False) -> Layer | None:
    """The layer with escapes replaced until none is left; None if there are none. With `data`, all are left with one level of
    URL escapes, for bytes that may be no text; None if no byte is above 127."""
    replaced = [(m.start(), x) for m in _REGION.finditer(layer.text) if len(m[0]) > 2 and (x := _reduced(m[0], data))]
    if not replaced or data and not any(c in "89ABCDEF" and x[k - 1][2] == "%" and x[k - 1][3] for _, x in replaced for k, (_, _, c, decoded) in enumerate(x) if k and decoded):
        return None
    return _rewritten(layer, [(at + x[0][0], at + x[-1][1], [(at + a, at + b, c, d) for a, b, c, d in x]) for at, x in replaced])


def _unpacked(layer: Layer, start: int, end: int, texts: Iterator[str]):
    first, last, _ = layer.original(start, end)
    for text in texts:
        yield Layer(text, [(0, len(text), first, last, True)]), True


def _below(layer: Layer, escapes: bool):
    """Layers below, each with whether its own escapes are still to be replaced."""
    if escapes:
        if "%" in layer.text and (x := _unescaped(layer, _URL)):
            yield x, False
        if "\\" in layer.text and (x := _unescaped(layer, _UNICODE)):
            yield x, False
        if (x := _fully_unescaped(layer)) is not None:
            yield x, False
        if (x := _fully_unescaped(layer, data=True)) is not None:
            yield x, False
    if "\0" in layer.text:
        yield _rewritten(layer, [(m.start(), m.end(), [(m.start(), m.end(), m[1], True)] * len(m[1])) for m in _NULS.finditer(layer.text)]), True
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(layer.text):
            run = m[0] if pattern is _BASE64 else _NO_BASE64.sub("", m[0])
            if not _PLAIN.fullmatch(run) and (pattern is _BASE64 or "\n" in m[0]):
                yield from _unpacked(layer, m.start(), m.end(), _base64_texts(run))
    if "%" in layer.text or "\\" in layer.text:
        for start, end, data in _escaped_data(layer.text):
            yield from _unpacked(layer, start, end, _texts(data))


def decoded_spans(text: str) -> set[tuple[int, int, int]]:
    """(start, index of kind, end) in the original of what only lower layers show."""
    if not text:
        return set()
    found: set[tuple[int, int, int]] = set()
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    work = [_below(Layer(text, [(0, len(text), 0, len(text), False)]), True)]
    while work:
        if (item := next(work[-1], None)) is None:
            work.pop()
            continue
        x, escapes = item
        if not x.text:
            continue
        key = hashlib.sha256(x.text.encode("utf-8", "surrogatepass") + repr((x.pieces[0][2], x.pieces[-1][3])).encode()).digest()
        if key in seen:
            continue
        seen.add(key)
        work.append(_below(x, escapes))
        for start, kind, end in base_spans(x.text):
            first, last, decoded = x.original(start, end)
            if decoded:
                found.add((first, kind, last))
    return found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("decoded", pa.bool_())]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, decoded) of every row, by start, then kind, then end."""

    def run(batches):
        Kept.mine("secret_scan")
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    more = decoded_spans(text or "").difference(base)
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "decoded": d} for s, k, e, d in sorted([(*x, False) for x in base] + [(*x, True) for x in more])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    kind = docs.select(id_col).dtypes[0][1]
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, decoded: boolean>>")
