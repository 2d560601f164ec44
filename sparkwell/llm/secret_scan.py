"""Secret scans: a worklist of layers.  Each layer is scanned, what is encoded in it is unwrapped, and every unwrapped
part is a new layer, until none is left; a find is mapped back through the layers to code points of the document.

Layers: percent escapes, Unicode escapes (backslash u, U, x and numeric character references), base64 (both alphabets, wrapped
lines too), and gzip, zlib, bzip2, xz or zstandard data in base64 or percent escapes.  A percent sign, backslash or ampersand
that is escaped several times over is unwrapped in one step.  An escape is replaced where it stands, and of the text
around it the layer has all that one pattern could reach: up to the next character that no pattern has.  A layer that
equals one it came from (data that unpack to themselves) isn't opened again, nor is the same content at the same place.

Defined cases: a null or empty text has no finds; a null id gives a null id; repeated rows each get a row; very long texts are
scanned whole, one at a time; other columns are ignored; an empty table gives no rows.  Bytes that aren't UTF-8 text, or
that hold control characters, are no layer.  Packed data that grow beyond MOST_BYTES in one layer aren't read, and
`n_unread` counts them, so a bomb can't take a worker's memory.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from bisect import bisect_right

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwell.llm.common import slices, table, trim

#: Kinds of secrets in the order that ties follow, each with its pattern, the group that is measured and its least length.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: Each pattern again, but only where it could hold; a shorter run of hex digits can't hide a longer one.
FAST = {"assign": KINDS["assign"][0], "access": KINDS["access"][0], "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")}
ORDER = {k: i for i, k in enumerate(KINDS)}
#: A base64 run has this many characters at least (twelve bytes).
LEAST_RUN = 16
MOST_BYTES = 64 << 20

ESCAPE = re.compile(
    r"(?P<byte>%(?:25)*(?P<url>[0-9A-Fa-f]{2})|\\+(?:u005[cC])*x(?P<hex>[0-9A-Fa-f]{2}))"
    r"|\\+(?:u005[cC])*(?:u(?P<u>[0-9A-Fa-f]{4})|u\{(?P<brace>[0-9A-Fa-f]{1,6})\}|U(?P<long>[0-9A-Fa-f]{8}))"
    r"|&(?:amp;|#38;|#[xX]26;)*#(?:(?P<dec>[0-9]{1,7})|[xX](?P<ref>[0-9A-Fa-f]{1,6}));"
)
#: All characters that a pattern, an escape or a base64 run can have.
NEAR = re.compile(r"""[A-Za-z0-9+/_.=\-"':\x20%\\{}&#;\r\n]+""")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_RUN)
NEXT_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]+={0,2})")
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~-])+")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

FOUND = "array<struct<kind: string, start: int, end: int, layers: string, base: boolean>>"


def scanned(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one layer; leftmost matches of a kind that don't overlap, short ones dropped."""
    out = []
    for kind, (_, group, least) in KINDS.items():
        for m in FAST[kind].finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, *m.span()))
    return out


def unpacked(data: bytes) -> bytes | None:
    """What packed data hold; None if they aren't packed or are damaged, OverflowError beyond MOST_BYTES."""
    try:
        if data[:2] == b"\x1f\x8b" or len(data) > 1 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
            reader = zlib.decompressobj(47)
            out = reader.decompress(data, MOST_BYTES + 1)
        elif data[:3] == b"BZh":
            reader = bz2.BZ2Decompressor()
            out = reader.decompress(data, MOST_BYTES + 1)
        elif data[:6] == b"\xfd7zXZ\x00":
            reader = lzma.LZMADecompressor(memlimit=4 * MOST_BYTES)
            out = reader.decompress(data, MOST_BYTES + 1)
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor(max_window_size=MOST_BYTES).stream_reader(data) as reader:
                out = reader.read(MOST_BYTES + 1)
        else:
            return None
    except (OSError, ValueError, EOFError, MemoryError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        return None
    if len(out) > MOST_BYTES:
        raise OverflowError
    return out


def plain_text(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if not text or CONTROL.search(text) else text


def escapes(text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, what it stands for) of the escapes in a part of the text that stand for characters."""
    found, at = [(m.start(), m.end(), m) for m in ESCAPE.finditer(text, begin, end)], 0
    out = []
    while at < len(found):
        a, b, m = found[at]
        if m["byte"]:  # bytes of one character stand side by side
            for n in (1, 2, 3, 4):
                group = found[at : at + n]
                if len(group) < n or any(x[1] != y[0] for x, y in zip(group, group[1:])) or not all(x[2]["byte"] for x in group):
                    break
                try:
                    char = bytes(int(x[2]["url"] or x[2]["hex"], 16) for x in group).decode()
                except UnicodeDecodeError:
                    continue
                out.append((a, group[-1][1], char))
                at += n - 1
                break
        else:
            code = int(m["dec"]) if m["dec"] else int(m["u"] or m["brace"] or m["long"] or m["ref"], 16)
            after = found[at + 1] if at + 1 < len(found) else None
            if 0xD800 <= code < 0xDC00 and after and after[0] == b and after[2]["u"] and 0xDC00 <= (low := int(after[2]["u"], 16)) < 0xE000:
                out.append((a, after[1], chr(0x10000 + (code - 0xD800 << 10) + low - 0xDC00)))
                at += 1
            elif code < 0xD800 or 0xE000 <= code < 0x110000:
                out.append((a, b, chr(code)))
        at += 1
    return out


class Layer:
    """Content, the layer it came from, and where: place(start, end) is a span of that layer."""

    def __init__(self, content, parent=None, place=None, how=""):
        self.content, self.parent, self.place = content, parent, place
        self.path = ">".join(filter(None, (parent.path, how))) if parent else how

    def origin(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent:
            start, end = layer.place(start, end)
            layer = layer.parent
        return start, end

    def repeats(self) -> bool:
        """True where it equals a layer that it came from."""
        up = self.parent
        while up:
            if up.content == self.content:
                return True
            up = up.parent
        return False


def replaced(layer: Layer, begin: int, end: int, found: list) -> Layer:
    """A part of a layer with its escapes replaced."""
    out, starts, spans, size, at = [], [], [], 0, begin

    def add(piece, a, b):
        nonlocal size
        if piece:
            out.append(piece)
            starts.append(size)
            spans.append((a, b))
            size += len(piece)

    for a, b, char in found:
        add(layer.content[at:a], at, a)
        add(char, a, b)
        at = b
    add(layer.content[at:end], at, end)

    def place(i, j):
        p, q = bisect_right(starts, i) - 1, bisect_right(starts, j - 1) - 1
        (a, b), (c, d) = spans[p], spans[q]
        literal = [len(out[k]) == spans[k][1] - spans[k][0] for k in (p, q)]
        return a + (i - starts[p]) if literal[0] else a, c + (j - starts[q]) if literal[1] else d

    return Layer("".join(out), layer, place, "escape")


def based(text: str, m) -> list[tuple[str, list]]:
    """The runs that may be base64 at a match of RUN, wrapped lines joined: (characters, their places)."""
    where = list(range(m.start(), m.end()))
    if m.end() - m.start() in (64, 76) and text[m.end() - 1] != "=":
        end, width = m.end(), m.end() - m.start()
        while n := NEXT_LINE.match(text, end):
            size = n.end(1) - n.start(1)
            if size > width:
                break
            where.extend(range(n.start(1), n.end(1)))
            end = n.end()
            if size < width:
                break
    return [("".join(text[i] for i in where), where)] if len(where) > m.end() - m.start() else [(m[0], where)]


def from_base64(run: str) -> bytes | None:
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except ValueError:
        return None


def opened(layer: Layer) -> list[Layer]:
    """The layers that one layer holds."""
    content = layer.content
    if isinstance(content, bytes):
        if (inner := unpacked(content)) is not None:
            return [Layer(inner, layer, lambda i, j, n=len(content): (0, n), "packed")]
        if (text := plain_text(content)) is None:
            return []
        if text.isascii():
            return [Layer(text, layer, lambda i, j: (i, j))]

        def place(i, j):
            a = len(text[:i].encode())
            return a, a + len(text[i:j].encode())

        return [Layer(text, layer, place)]
    out = []
    if ("%" in content or "\\" in content or "&" in content) and ESCAPE.search(content):
        for m in NEAR.finditer(content):
            if ESCAPE.search(content, *m.span()) and (found := escapes(content, *m.span())):
                out.append(replaced(layer, *m.span(), found))
        for m in URL_BYTES.finditer(content) if "%" in content else ():
            if "%" in m[0] and (data := url_bytes(m[0]))[0] is not None:
                out.append(Layer(data[0], layer, lambda i, j, at=m.start(), w=data[1]: (at + w[i], at + w[j]), "url"))
    done = 0
    for m in RUN.finditer(content):
        if m.start() < done:
            continue
        for run, where in based(content, m):
            done = where[-1] + 1
            if add := base64_layer(layer, run, where):
                out.append(add)
                continue
            for part in re.finditer(r"[A-Za-z0-9]{%d,}={0,2}" % LEAST_RUN, run):
                if len(part[0]) < len(run) and (add := base64_layer(layer, part[0], where[part.start() : part.end()])):
                    out.append(add)
    return out


def base64_layer(layer: Layer, run: str, where: list) -> Layer | None:
    data = from_base64(run)
    if data is None or plain_text(data) is None and data[:1] not in (b"\x1f", b"\x78", b"B", b"\xfd", b"\x28"):
        return None
    return Layer(data, layer, lambda i, j: (where[i * 4 // 3], where[min(-(-j * 4 // 3), len(where)) - 1] + 1), "base64")


def url_bytes(run: str) -> tuple[bytes | None, list]:
    """Percent-encoded bytes that are packed data, with the place of each byte; escapes of characters are replaced where they stand."""
    out, where, i = bytearray(), [], 0
    while i < len(run):
        where.append(i)
        if run[i] == "%":
            out.append(int(run[i + 1 : i + 3], 16))
            i += 3
        else:
            out.append(ord(run[i]))
            i += 1
    where.append(i)
    data = bytes(out)
    return (data if data[:1] in (b"\x1f", b"\x78", b"B", b"\xfd", b"\x28") and plain_text(data) is None else None), where


def secrets(text: str | None) -> tuple[list[tuple[str, int, int, str, bool]], int, int]:
    """The finds of a document as (kind, start, end, layers, base), in order; how many layers were opened, how many not read."""
    if not text:
        return [], 0, 0
    found: dict[tuple, tuple] = {}
    seen: set = set()
    work, n_layers, n_unread = [Layer(text)], 0, 0
    while work:
        layer = work.pop()
        if isinstance(layer.content, str):
            for kind, a, b in scanned(layer.content):
                key = (kind, *layer.origin(a, b))
                if key not in found or not layer.parent:
                    found[key] = (*key, layer.path, not layer.parent)
        try:
            inner = opened(layer)
        except OverflowError:
            n_unread += 1
            continue
        for x in inner:
            mark = (x.content, x.origin(0, max(len(x.content), 1)) if x.content else None)
            if mark not in seen and x.content and not x.repeats():
                seen.add(mark)
                n_layers += 1
                work.append(x)
    return sorted(found.values(), key=lambda f: (f[1], ORDER[f[0]], f[2])), n_layers, n_unread


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, found (the secrets, base ones marked, with the layers above each), n_layers, n_unread."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(f"found {FOUND}, n_layers int, n_unread int").fields])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string()), ("base", pa.bool_())]))
        names = ("kind", "start", "end", "layers", "base")
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                got = [secrets(t) for t in part.column(1).to_pylist()]
                lists = pa.array([[dict(zip(names, f)) for f in g[0]] for g in got], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *(pa.array([g[k] for g in got], pa.int32()) for k in (1, 2))], schema.names)
        trim()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret of the text, whatever layer it is in, replaced by its kind in brackets; overlapping ones as one."""
    names, at = docs.columns, docs.columns.index(text_col)

    def mask(text):
        out, done = [], 0
        for kind, a, b, *_ in secrets(text)[0]:
            if a >= done:
                out += [text[done:a], f"[{kind}]"]
            done = max(done, b)
        return text if text is None else "".join(out) + text[done:]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, at, 4 << 20):
                cols = list(part.columns)
                cols[at] = pa.array([mask(t) for t in cols[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)
        trim()

    return docs.mapInArrow(run, docs.schema)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["base"])
    kinds = F.transform(base, lambda f: f["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"), "n_layers", "n_unread")
