"""Media columns: baseline JPEG, read without a codec library.

`parse` reads the markers of any baseline (sequential, 8-bit, Huffman) JPEG stream; `thumbnails` decodes the scan that has
its first component, alone or interleaved with others, and reconstructs the luminance at an eighth of the size from
the DC coefficients.  All restart intervals of all images of a batch are decoded in lockstep in numpy, block by block.

`encode` stores bytes losslessly in such streams: a grey image of 8 x 8 blocks, quantiser 8, whose DC coefficients are the
bytes less 128 and whose AC coefficients are zero.  Its DC thumbnail is the payload, sample for sample.  Long
payloads take several images, one after another.

Defined cases: a null or empty text is padded to one unit; long texts are read whole, in several images where
needed; a null id stays null; repeated rows each get a row; other columns are ignored; an empty table gives no rows.
Media that are null, damaged or no baseline JPEG give a row with `error` and nulls in place of payload and feature; other rows of the
batch are not touched.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import slices, table

#: Payload bytes are padded to a multiple of this; it is a row of blocks, and a restart interval.
UNIT, PAD = 576, 255
MOST_ROWS = 65535 // 8

# Code tables of our streams: DC categories 3 to 8 in at most four bits, the others in five; AC's end-of-block in one.
DC_BITS, DC_VALUES = [0, 1, 2, 3, 6] + [0] * 11, [7, 6, 8, 5, 4, 3, 2, 1, 0, 9, 10, 11]
AC_BITS, AC_VALUES = [1, 1] + [0] * 14, [0x00, 0xF0]


def code_words(bits: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(value, code, length) of a Huffman table as a DHT segment states it."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(bits: list[int], values: list[int]) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | value; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for value, code, length in code_words(bits, values):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | value
    return out


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    width, height = 8 * UNIT, 8 * rows
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, bytes([0]) + bytes([8]) * 64),
            segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            segment(0xC4, bytes([0x00, *DC_BITS, *DC_VALUES[: sum(DC_BITS)]])),
            segment(0xC4, bytes([0x10, *AC_BITS, *AC_VALUES])),
            segment(0xDD, UNIT.to_bytes(2, "big")),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: the bits of its block (category's code, extra bits, a 0 for end-of-block) and their number."""
    words = {value: (code, n) for value, code, n in code_words(DC_BITS, DC_VALUES[: sum(DC_BITS)])}
    bits, number = np.zeros(511, np.int32), np.zeros(511, np.int32)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = words[size]
        bits[diff + 255] = ((code << size) | (diff if diff >= 0 else diff + (1 << size) - 1)) << 1
        number[diff + 255] = n + size + 1
    return bits, number


BLOCK_BITS, BLOCK_LENGTH = block_codes()


def scans(payload: np.ndarray) -> list[bytes]:
    """The entropy-coded restart intervals, one for each UNIT of the payload, bytes stuffed."""
    x = payload.astype(np.int16).reshape(-1, UNIT)
    diff = np.diff(x, axis=1, prepend=np.int16(128)) + np.int16(255)
    bits, n = BLOCK_BITS[diff].ravel(), BLOCK_LENGTH[diff]
    ends = np.cumsum(n, axis=1, dtype=np.int32)
    total = ends[:, -1].astype(np.int64)
    bytes_of = (total + 7) // 8
    base = np.cumsum(bytes_of) - bytes_of
    within = ends - n
    # a block's bits, 14 at most, lie in three bytes; blocks that begin in the same byte are added up
    window = bits << (24 - n - (within & 7)).ravel()
    first = ((within >> 3) + base[:, None]).ravel()
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    byte = first[starts]
    out = np.zeros(int(bytes_of.sum()) + 3, np.int32)
    for k in range(3):
        out[byte + k] += np.add.reduceat((window >> (16 - 8 * k)) & 255, starts)
    left = -total % 8
    out[base + bytes_of - 1] |= (1 << left) - 1  # each interval's last bits are ones
    data = out.astype(np.uint8).tobytes()
    return [data[a : a + m].replace(b"\xff", b"\xff\x00") for a, m in zip(base.tolist(), bytes_of.tolist())]


def padded(payload: bytes, unit: int = UNIT, pad: int = PAD) -> bytes:
    n = max(1, -(-len(payload) // unit)) * unit
    return payload + bytes([pad]) * (n - len(payload))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT bytes) as JPEG streams, one after another."""
    units = [len(p) // UNIT for p in payloads]
    coded = scans(np.frombuffer(b"".join(payloads), np.uint8))
    out, at = [], 0
    for n in units:
        images = []
        for a in range(0, n, MOST_ROWS):
            own = coded[at + a : at + min(a + MOST_ROWS, n)]
            pieces = [header(len(own)), own[0]]
            for k, s in enumerate(own[1:]):
                pieces += [bytes([0xFF, 0xD0 + k % 8]), s]
            images.append(b"".join([*pieces, b"\xff\xd9"]))
        out.append(b"".join(images))
        at += n
    return out


class Image:
    """What the marker segments of one stream say: size, components, and of the scan with the first component its tables and restart intervals without stuffing."""

    def __init__(self):
        self.quant, self.huffman, self.restart = {}, {}, 0
        self.width = self.height = 0
        self.components, self.scan, self.intervals = [], [], []


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The image at data[at:] and where it ends; ValueError where it is damaged or not baseline."""
    try:
        return segments(data, at)
    except (IndexError, KeyError):
        raise ValueError("segment is cut short") from None


def segments(data: bytes, at: int) -> tuple[Image, int]:
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    image, at = Image(), at + 2
    huffman, restart = {}, 0
    while True:
        if data[at : at + 1] != b"\xff":
            raise ValueError("no marker where one is due")
        while data[at : at + 1] == b"\xff":
            at += 1
        if at >= len(data):
            raise ValueError("no EOI marker")
        marker, at = data[at], at + 1
        if marker == 0xD9:
            if not image.scan:
                raise ValueError("no scan of the first component")
            return image, at
        n = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + n], at + n
        if n < 2 or len(body) != n - 2:
            raise ValueError("segment is cut short")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                # the first entry, for DC, is all that a DC thumbnail takes
                image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                bits = list(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = (tuple(bits), tuple(body[17 : 17 + sum(bits)]))
                if len(body) < 17 + sum(bits):
                    raise ValueError("Huffman table is cut short")
                body = body[17 + sum(bits) :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("not 8-bit samples")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if not image.height or not image.width or not image.components or any(not h or not v for _, h, v, _ in image.components):
                raise ValueError("no size")
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError(f"not baseline: SOF marker {marker:02X}")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            known = [c[0] for c in image.components]
            if any(c not in known for c, _, _ in scan):
                raise ValueError("scan of an unknown component")
            intervals, at = entropy_coded(data, at)
            if known[0] in [c for c, _, _ in scan]:
                # tables may be stated anew for the scans of other components
                image.scan, image.intervals, image.restart, image.huffman = scan, intervals, restart, dict(huffman)


def entropy_coded(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of the scan at data[at:], and where the next marker is."""
    out, start = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            raise ValueError("scan without an end")
        if 0xD0 <= data[k + 1] <= 0xD7:
            out.append(data[start:k].replace(b"\xff\x00", b"\xff"))
            start = k + 2
        elif data[k + 1]:
            out.append(data[start:k].replace(b"\xff\x00", b"\xff"))
            return out, k
        at = k + 2


def thumbnails(images: list[Image]) -> list[np.ndarray | None]:
    """Of each image the luminance (first component) of its blocks: uint8, block rows x block columns; None if its scan is damaged."""
    tables, index = [], {}
    lanes, plans = [], []  # a lane: bytes, number of blocks, for each block of an MCU its tables and whether it is luminance

    def table_no(spec) -> int:
        if spec not in index:
            index[spec] = len(tables)
            tables.append(lookup(*map(list, spec)))
        return index[spec]

    for im in images:
        by = {c[0]: c for c in im.components}
        cid, h, v, q = im.components[0]
        h_most, v_most = max(c[1] for c in im.components), max(c[2] for c in im.components)
        needed = [(0, dc) for _, dc, _ in im.scan] + [(1, ac) for _, _, ac in im.scan]
        if q not in im.quant or any(k not in im.huffman for k in needed):
            plans.append(None)
            continue
        if alone := len(im.scan) == 1:  # blocks by rows, without the padding of MCUs
            across, down, h, v = -(-(-(-im.width * h // h_most)) // 8), -(-(-(-im.height * v // v_most)) // 8), 1, 1
        else:
            across, down = -(-im.width // (8 * h_most)), -(-im.height // (8 * v_most))
        mcu = []
        for c, dc, ac in im.scan:
            mcu += [(table_no(im.huffman[0, dc]), table_no(im.huffman[1, ac]), c == cid)] * (1 if alone else by[c][1] * by[c][2])
        per = im.restart or across * down
        if len(im.intervals) != -(-across * down // per):
            plans.append(None)
            continue
        plans.append((len(lanes), across, down, h, v, im.quant[q], len(im.intervals)))
        for k, data in enumerate(im.intervals):
            lanes.append((data, min(per, across * down - k * per) * len(mcu), tuple(mcu)))
    dc, out = decode(lanes, tables), []
    for plan in plans:
        own = None if plan is None else dc[plan[0] : plan[0] + plan[-1]]
        if own is None or any(x is None for x in own):
            out.append(None)
            continue
        _, across, down, h, v, q, _ = plan
        luma = np.clip(np.floor(np.concatenate(own) * q / 8 + 0.5) + 128, 0, 255).astype(np.uint8)
        out.append(luma.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h))
    return out


SIZES = np.arange(16)
MASK, HALF = (1 << SIZES) - 1, (1 << SIZES) >> 1


def decode(lanes: list[tuple], tables: list[np.ndarray]) -> list[np.ndarray | None]:
    """Luminance DC coefficients of each lane, lanes of like MCUs in lockstep; None for a lane that is damaged."""
    out: list[np.ndarray | None] = [None] * len(lanes)
    layouts: dict[tuple, list[int]] = {}
    for i, lane in enumerate(lanes):
        layouts.setdefault(lane[2], []).append(i)
    for mcu, members in layouts.items():
        members.sort(key=lambda i: -lanes[i][1])  # those with blocks left are always the first ones
        blocks = np.array([lanes[i][1] for i in members])
        raw = np.frombuffer(b"".join(lanes[i][0] + b"\xff" * 8 for i in members), np.uint8).astype(np.uint32)
        words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        size_of = np.array([len(lanes[i][0]) for i in members])
        pos = 8 * (np.cumsum(size_of + 8) - size_of - 8)
        limit = pos + 8 * size_of
        bad = np.zeros(len(members), bool)
        luma = sum(x[2] for x in mcu)
        diffs = np.zeros((int(blocks[0]) // len(mcu) * luma, len(members)), np.int32)
        row = 0

        def symbol(p, table):
            """What the table has for the bits at p."""
            return table[(words[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF]

        for b in range(int(blocks[0])):
            live = int(np.searchsorted(-blocks, -b)) if blocks[-1] <= b else len(members)
            dc, ac, is_luma = mcu[b % len(mcu)]
            got = symbol(pos[:live], tables[dc])
            failed = got == 0
            size, p = got & 15, pos[:live] + (got >> 8)
            if is_luma:
                bits = (words[p >> 3] >> (32 - (p & 7) - size).astype(np.uint32)) & MASK[size]
                diffs[row, :live] = np.where(bits < HALF[size], bits - MASK[size], bits)
                row += 1
            p += size
            got = symbol(p, tables[ac])
            failed |= got == 0
            p += (got >> 8) + (got & 15)
            k = 1 + np.where(got & 255 == 0xF0, 16, ((got & 255) >> 4) + 1)
            on = np.flatnonzero((got & 255 != 0) & (k < 64))
            np.minimum(p, limit[:live] + 1, out=p)
            while len(on):  # lanes whose block has more coefficients
                got = symbol(p[on], tables[ac])
                failed[on[got == 0]] = True
                p[on] = np.minimum(p[on] + (got >> 8) + (got & 15), limit[on] + 1)
                k[on] += np.where(got & 255 == 0xF0, 16, ((got & 255) >> 4) + 1)
                on = on[(got & 255 != 0) & (k[on] < 64)]
            bad[:live] |= failed | (p > limit[:live])
            pos[:live] = np.minimum(p, limit[:live])
        values = np.ascontiguousarray(np.cumsum(diffs, axis=0, dtype=np.int32).T)
        for nth, i in enumerate(members):
            out[i] = None if bad[nth] else values[nth, : blocks[nth] // len(mcu) * luma]
    return out


def media(data: bytes) -> list[Image]:
    """All images of a media value: streams one after another."""
    out, at = [], 0
    while at < len(data):
        image, at = parse(data, at)
        out.append(image)
    return out


def average_hash(luma: np.ndarray, side: int = 8) -> str:
    """side * side bits: is a cell of the thumbnail brighter than all cells' mean?"""
    luma = np.repeat(np.repeat(luma, -(-side // luma.shape[0]), axis=0), -(-side // luma.shape[1]), axis=1)
    h, w = luma.shape
    rows, cols = np.arange(side) * h // side, np.arange(side) * w // side
    sums = np.add.reduceat(np.add.reduceat(luma.astype(np.float64), cols, axis=1), rows, axis=0)
    mean = sums / np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))
    return f"{int(''.join('1' if x else '0' for x in (mean > mean.mean()).ravel()), 2):0{side * side // 4}x}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded and stored as JPEG."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode([padded(x) for x in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def images_of(value: bytes | None) -> tuple[list[Image], str | None]:
    """The images of a media value, or what is wrong with it."""
    try:
        return (media(value), None) if value else ([], "no media")
    except ValueError as e:
        return [], str(e)


def described(rows: DataFrame) -> DataFrame:
    """What the stored bytes hold: dimensions, thumbnail hash, and digests of the thumbnails' samples, which are the payload; or an error."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                data = part.column(2).to_pylist()
                images = [images_of(x) for x in data]
                thumbs = iter(thumbnails([im for own, _ in images for im in own]))
                out = []
                for x, (own, error) in zip(data, images):
                    lumas = [next(thumbs) for _ in own]
                    if error is None and any(t is None for t in lumas):
                        error = "scan is damaged"
                    stored_as = (None, None) if x is None else (len(x), hashlib.sha256(x).hexdigest())
                    if error is not None:
                        out.append((None, None, None, *stored_as, None, error))
                        continue
                    payload = b"".join(t.tobytes() for t in lumas)
                    luma = lumas[0] if len(lumas) == 1 else np.concatenate([t[:, : min(t.shape[1] for t in lumas)] for t in lumas])
                    size = "+".join(f"{im.width}x{im.height}" for im in own)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored_as, f"{size}:{average_hash(luma)}", None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(stored(table(spark, sf_dir, "documents")))
