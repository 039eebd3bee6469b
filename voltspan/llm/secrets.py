"""Secret scanning with a recursive decoding worklist.

A text is the first layer. Each layer is scanned for secrets and for encoded parts: URL and Unicode escapes of the whole layer, base64
at each alignment and over line ends, and compressed data, of any depth and number of members, inside escapes and base64. A decoded
part becomes a layer of its own, each of whose characters knows the span of the original text that it came from, until nothing new
decodes. Bytes that aren't UTF-8 become replacement characters. Every find is thus a span of the original text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from voltspan.llm.common import struct
from voltspan.tables import table

KINDS = ("assign", "access", "hex")
MASK = "[SECRET]"
#: Inflated bytes become layers of about this size, so that a small text can't fill a worker's memory. A layer begins with the end of
#: the one before: OVERLAP bytes, or from the start of a base64 run that goes on, if that has at most CARRY bytes.
INFLATED_BYTES, OVERLAP, CARRY = 4_000_000, 1 << 16, 8_000_000
FOUND = struct(n_assign="long", n_access="long", n_hex="long", base="string", spans="string", layers="int")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
URL_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}")
TOKEN_END = re.compile(r"[\s\"'<>]|$")
UNICODE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
BREAK = re.compile(r"[^A-Za-z0-9+/_-]+")
#: The first bytes of gzip and of zlib data without a preset dictionary.
HEADER = re.compile(b"\x1f\x8b\x08|" + b"|".join(re.escape(bytes([m, f])) for m in range(8, 128, 16) for f in range(256) if (m << 8 | f) % 31 == 0 and not f & 32))
#: Compressed data are fed in steps of so many bytes.
FEED, PIECE = 1 << 16, 1 << 20
_ENCODED = np.zeros(256, bool)
_ENCODED[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n")] = True
#: A text without any of these has neither a secret nor an encoded part; RE2 tells so for a batch at a time.
WORTH = r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=])|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|[A-Za-z0-9+/_-]{16}"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets of one layer; for each kind leftmost and without overlaps."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def lossy(data: bytes) -> tuple[str, np.ndarray]:
    """The text in data, a replacement character for each byte that isn't UTF-8, and the byte position of each character, with the end."""
    text = data.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wrong = (code >= 0xD800) & (code < 0xE000)
    size = np.where(wrong, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))
    return re.sub("[\ud800-\udfff]", "\ufffd", text), np.concatenate(([0], np.cumsum(size)))


def plain(text: str) -> bool:
    """Whether a layer is nearly all printable text; others are scanned too but not counted."""
    return len(text) >= 4 and sum((c.isprintable() and c != "\ufffd") or c in "\n\r\t" for c in text) >= 0.95 * len(text)


def inflate(data: Iterable[bytes], left: list[int] | None = None) -> Iterator[bytes]:
    """What gzip or zlib data and the members that follow them hold, in pieces; ends where the data do or fail. left: what follows each member, in bytes of the part."""
    source, stream = iter(data), zlib.decompressobj(zlib.MAX_WBITS | 32)
    part = next(source, b"")
    while True:
        try:
            got = stream.decompress(part[:FEED], PIECE)
        except zlib.error:
            return
        if got:
            yield got
        part = (stream.unused_data if stream.eof else stream.unconsumed_tail) + part[FEED:]
        while len(part) < (3 if stream.eof else 1):
            if (more := next(source, None)) is None:
                break
            part += more
        if stream.eof:
            if left is not None:
                left.append(len(part))
            if not HEADER.match(part):
                return
            stream = zlib.decompressobj(zlib.MAX_WBITS | 32)
        elif not part:
            return


def streams(data: bytes) -> Iterator[tuple[int, int | None, Iterator[bytes]]]:
    """The start and the end of each compressed stream in data (no end: incomplete) and what it holds, inflated again while that is compressed itself."""
    done = 0
    for m in HEADER.finditer(data):
        if m.start() >= done and (out := unwrapped([data[m.start() :]], set())) is not None:
            left: list[int] = []
            for _ in inflate([data[m.start() :]], left):  # reads to the end of the last member
                pass
            done = len(data) - left[-1] if left else done
            yield m.start(), done if left else None, out


def unwrapped(data: Iterable[bytes], seen: set) -> Iterator[bytes] | None:
    """What compressed data hold, through all their levels; None if nothing. seen: digests of what led here, so that a cycle ends."""
    inner = inflate(data)
    if (head := next(inner, None)) is None:
        return None
    digest = hashlib.blake2b(head, digest_size=16).digest()
    if not HEADER.match(head) or digest in seen:
        return chain([head], inner)
    read, more = [], chain([head], inner)

    def tapped() -> Iterator[bytes]:
        for x in more:
            if read is not None:
                read.append(x)
            yield x

    deeper = unwrapped(tapped(), seen | {digest})
    if deeper is None:  # only looked like a header
        return chain(read, more)
    read = None
    return deeper


def unescaped(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of a text whose URL escapes are decoded, with the start and the end of each in the text."""
    at = np.array([m.start() for m in URL_ESCAPE.finditer(text)], np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wrong = (code >= 0xD800) & (code < 0xE000)
    size = np.where(wrong, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).copy()
    own, byte = np.repeat(np.arange(len(text)), size), (np.cumsum(size) - size)[at]
    data[byte] = np.frombuffer(bytes.fromhex("".join(text[i + 1 : i + 3] for i in at)), np.uint8)
    end, keep = own + 1, np.ones(len(data), bool)
    end[byte] += 2
    keep[byte + 1] = keep[byte + 2] = False
    return data[keep].tobytes(), own[keep], end[keep]


def without_unicode_escapes(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """A text whose Unicode escapes are decoded, with the start and the end of each character; two escaped halves are one character."""
    parts, start, end, at = [], [], [], 0
    for m in UNICODE_ESCAPE.finditer(text):
        parts += [text[at : m.start()], chr(int(m[1] or m[2], 16))]
        start += [np.arange(at, m.start()), [m.start()]]
        end += [np.arange(at, m.start()) + 1, [m.end()]]
        at = m.end()
    parts.append(text[at:])
    start, end = (np.concatenate([*x, np.arange(at, len(text)) + i]).astype(np.int64) for i, x in enumerate((start, end)))
    out = "".join(parts)
    high = np.array([m.start() for m in re.finditer("[\ud800-\udbff][\udc00-\udfff]", out)], np.int64)
    end[high] = end[high + 1]
    keep = np.ones(len(out), bool)
    keep[high + 1] = False
    return re.sub("[\ud800-\udfff]", "\ufffd", out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")), start[keep], end[keep]


def decoded(text: str) -> Iterator[tuple[str | Iterator[bytes], np.ndarray, np.ndarray]]:
    """The encoded parts of a layer: a text with the start and the end of each of its characters, or inflated bytes with those of their source."""
    if URL_ESCAPE.search(text):
        data, start, end = unescaped(text)
        inner, at = lossy(data)
        yield inner, start[at[:-1]], end[at[1:] - 1]
        for i, j, out in streams(data):
            yield out, start[i : i + 1], end[j - 1 : j] if j else np.array([TOKEN_END.search(text, int(start[i])).start()])
    if UNICODE_ESCAPE.search(text):
        yield without_unicode_escapes(text)
    for m in BASE64_RUN.finditer(text):
        place = np.arange(m.start(), m.end())
        for gap in BREAK.finditer(m[0]):
            place[gap.start() : gap.end()] = -1
        place, run = place[place >= 0], BREAK.sub("", m[0]).replace("-", "+").replace("_", "/")
        for shift in range(4):  # what is before the encoded part may be of its alphabet
            own = run[shift : len(run) - ((len(run) - shift) % 4 == 1)]
            data = base64.b64decode(own + "=" * (-len(own) % 4))
            inner, at = lossy(data)
            yield inner, place[shift + at[:-1] * 4 // 3], place[shift - (-at[1:] * 4 // 3) - 1] + 1
            for i, j, out in streams(data):
                inside = j is not None and j < len(data)
                yield out, place[shift + i * 4 // 3 :][:1], np.array([place[shift - (-j * 4 // 3) - 1] + 1 if inside else m.end()])


def pieces(data: Iterator[bytes]) -> Iterator[str]:
    """The whole text of inflated bytes in overlapping pieces. Long runs of blanks and those after a line end, which no secret or encoded part tells apart, are cut."""
    whole, size = bytearray(), INFLATED_BYTES
    for part in data:
        whole += part
        if len(whole) < size:
            continue
        whole = bytearray(re.sub(rb"(?<=\n)[\x20\t]+", b"", re.sub(rb"\x20{3,}", b"  ", whole)))
        if len(whole) < size:
            continue
        yield lossy(bytes(whole))[0]
        other = np.flatnonzero(~_ENCODED[np.frombuffer(whole, np.uint8)])
        run = len(whole) - (int(other[-1]) + 1 if len(other) else 0)
        whole = whole[-max(OVERLAP, run if run <= CARRY else 0) :]
        size = max(INFLATED_BYTES, 2 * len(whole))
    if whole:
        yield lossy(bytes(whole))[0]


def layers_of(text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The new layers in a layer; what a compressed part holds has the span of that part throughout."""
    for inner, first, last in decoded(text):
        for piece in [inner] if isinstance(inner, str) else pieces(inner):
            if not piece:
                continue
            if not isinstance(inner, str):
                first, last = np.broadcast_to(first[:1], len(piece)), np.broadcast_to(last[-1:], len(piece))
            yield piece, first, last


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """The secrets of the text itself, those of all layers as spans of the text (both sorted), and the number of printable layers."""
    base = sorted(scan(text))
    spans, seen, layers = set(base), set(), 1
    todo = [(layers_of(text), None, None)]
    while todo:  # depth first, so that one layer of each depth is in memory
        parts, starts, ends = todo[-1]
        if (part := next(parts, None)) is None:
            todo.pop()
            continue
        inner, first, last = part
        if starts is not None:
            first, last = starts[first], ends[last - 1]
        key = (hashlib.blake2b(inner.encode("utf-8", "replace"), digest_size=16).digest(), int(first[0]), int(last[-1]))
        if key in seen:  # the same text from the same place: going on would be a cycle
            continue
        seen.add(key)
        layers += plain(inner)
        spans.update((int(first[a]), k, int(last[b - 1])) for a, k, b in scan(inner))
        todo.append((layers_of(inner), first, last))
    return base, sorted(spans), layers


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@arrow_udf(FOUND)
def secret_spans(texts: pa.Array) -> pa.Array:
    """Counts and spans of the secrets of each whole text; a null counts as empty."""
    n = len(texts)
    counts, base, spans, layers = np.zeros((n, 3), np.int64), [""] * n, [""] * n, np.ones(n, np.int32)
    for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, WORTH), False).to_numpy(zero_copy_only=False)):
        own, every, layers[i] = find(texts[int(i)].as_py())
        for _, k, _ in own:
            counts[i, k] += 1
        base[i], spans[i] = line(own), line(every)
    columns = [*(pa.array(counts[:, k].copy()) for k in range(3)), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(layers)]
    return pa.StructArray.from_arrays(columns, [f.name for f in FOUND])


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct column `secrets` (counts, base and all spans, layers); one of that name is replaced.

    Null and empty texts have no spans; repeated rows and an empty table need nothing special.
    """
    return docs.withColumn("secrets", secret_spans(text))


def covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans, as spans apart from each other."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@arrow_udf(T.StringType())
def redacted(texts: pa.Array) -> pa.Array:
    """Each text with MASK in place of its secrets; the encoded parts that hide one are replaced too."""
    out = texts.to_pylist()
    for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, WORTH), False).to_numpy(zero_copy_only=False)):
        text, parts, at = out[i], [], 0
        for a, b in covered(find(text)[1]):
            parts += [text[at:a], MASK]
            at = b
        out[i] = "".join([*parts, text[at:]])
    return pa.array(out, pa.string())


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their secrets masked; nulls stay null, texts without a secret stay as they are."""
    return docs.withColumn(text, redacted(text))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, those in encoded parts included."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "layers")
