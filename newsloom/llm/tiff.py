"""TIFF media columns: a writer for byte payloads, and a reader that gives one row for each page.

The reader takes classic and Big TIFF in either byte order, follows the chain of image directories, decodes uncompressed,
PackBits, LZW and deflate strips or tiles, undoes the horizontal and floating-point predictors, and gives chunky samples in
little-endian order.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 and Big TIFF formats.
NONE, LZW, ADOBE_DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CLEAR, END, FIRST_FREE, LAST_FREE, MAX_CODES = 256, 257, 258, 4095, 4096
#: Width of each code after a clear (widths change one code early) and where it ends, until the table is full, and from then on;
#: places, in 16 bits a code, of the bits that are stored.
CODE_WIDTHS = np.array([min(12, code.bit_length()) for code in range(FIRST_FREE, MAX_CODES + 1)])
FULL_WIDTHS = np.full(len(CODE_WIDTHS), 12)
CODE_ENDS, FULL_ENDS = np.cumsum(CODE_WIDTHS), np.cumsum(FULL_WIDTHS)
CODE_BITS = np.flatnonzero(np.arange(16) >= 16 - CODE_WIDTHS[:, None])

#: Bytes that a byte of a strip can stand for at most.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: MAX_CODES, ADOBE_DEFLATE: 1032, OLD_DEFLATE: 1032}
#: Larger pages are errors, whatever the file says.
MAX_PAGE_BYTES = 1 << 30

#: A payload row: 64 pixels of 3 samples.
PIXELS, CHANNELS = 64, 3
ROW = PIXELS * CHANNELS
PAD = b" "


def packbits_encode(data: bytes) -> bytes:
    """Runs of three bytes or more as runs, what lies between them as literals."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1]) if len(raw) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(raw)))
    out, done = bytearray(), 0

    def literals(upto: int) -> None:
        for i in range(done, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for at, n in zip(starts[sizes >= 3].tolist(), sizes[sizes >= 3].tolist(), strict=True):
        literals(at)
        while n >= 2:
            k = min(n, 128)
            out.extend((257 - k, data[at]))
            at, n = at + k, n - k
        done = at
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, most: int = MAX_PAGE_BYTES) -> bytes:
    """At least the first ``most`` bytes; not many more."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    bits = [np.unpackbits(np.array([CLEAR], ">u2").view(np.uint8))[-9:]]
    prefix, at = data[0] if data else -1, 1
    codes: list[int] = []
    while not codes or codes[-1] == CLEAR:
        codes, free = [], FIRST_FREE
        table: dict[int, int] = {}  # code of a string and the byte after it
        add = codes.append
        # a byte makes at most one entry, so a part of this length can't overfill the table
        while part := data[at : at + LAST_FREE - free]:
            at += len(part)
            for byte in part:
                longer = prefix << 8 | byte
                if longer in table:
                    prefix = table[longer]
                else:
                    add(prefix)
                    table[longer] = free
                    free += 1
                    prefix = byte
        if free == LAST_FREE:
            add(CLEAR)
        else:
            codes += [prefix, END] if prefix >= 0 else [END]
        halves = np.frombuffer(array("H", codes), np.uint16).astype(">u2").view(np.uint8)
        bits.append(np.unpackbits(halves)[CODE_BITS[: CODE_ENDS[len(codes) - 1]]])
    return np.packbits(np.concatenate(bits)).tobytes()


def _string_sizes(codes: np.ndarray) -> np.ndarray:
    """Bytes that each code after a clear stands for: one more than the code whose output its entry begins with."""
    strings = np.flatnonzero(codes >= FIRST_FREE)
    up, size = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    up[strings] = codes[strings] - FIRST_FREE
    size[strings] = 1
    while (more := size[up]).any():
        size += more
        up = up[up]
    return size + 1


def _strings(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of codes after a clear: entry i is what code i stands for and the byte after it, as they lie in the output."""
    begin = np.cumsum(size) - size
    if size.sum() > 64 * len(codes):
        # long strings are copied one by one
        out, starts = bytearray(), begin.tolist()
        for code, n in zip(codes.tolist(), size.tolist(), strict=True):
            if code < FIRST_FREE:
                out.append(code)
            else:
                at = starts[code - FIRST_FREE]
                word = out[at : at + n]
                out += word if len(word) == n else word + word[:1]
        return np.frombuffer(out, np.uint8)
    strings = np.flatnonzero(codes >= FIRST_FREE)
    back = np.zeros(len(codes), np.int64)
    back[strings] = begin[codes[strings] - FIRST_FREE] - begin[strings]
    # where each byte comes from, until it is a literal's
    source = np.arange(size.sum()) + np.repeat(back, size)
    while not np.array_equal(further := source[source], source):
        source = further
    literal = np.zeros(len(source), np.uint8)
    literal[begin] = codes
    return literal[source]


def lzw_decode(data: bytes, most: int = MAX_PAGE_BYTES) -> bytes:
    """At least the first ``most`` bytes; not many more. The codes after a clear are decoded together, as their widths depend on
    their number alone; a table that is full stays for the codes that follow it."""
    out: list[bytes] = []
    made = bit = 0
    table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # bytes, start and size of each code's string
    while made < most:
        widths, ends = (CODE_WIDTHS, CODE_ENDS) if table is None else (FULL_WIDTHS, FULL_ENDS)
        n = min(int(np.searchsorted(ends, len(data) * 8 - bit, "right")), most - made)
        if not n:
            break
        raw = np.frombuffer(data[bit // 8 : (bit + int(ends[n - 1])) // 8 + 1] + b"\0\0", np.uint8).astype(np.int32)
        first = ends[:n] - widths[:n] + bit % 8
        at, low = first >> 3, 24 - (first & 7) - widths[:n]
        codes = (raw[at] << 16 | raw[at + 1] << 8 | raw[at + 2]) >> low & (1 << widths[:n]) - 1
        stops = np.flatnonzero(codes >> 1 == CLEAR >> 1)
        stop = int(codes[stops[0]]) if len(stops) else -1
        bit += int(ends[stops[0] if len(stops) else n - 1])
        codes = codes[: stops[0]] if len(stops) else codes
        # an entry is made with the code after the one that it begins with
        wrong = np.flatnonzero(codes - FIRST_FREE >= np.arange(len(codes))) if table is None else ()
        codes = codes[: wrong[0]] if len(wrong) else codes
        size = _string_sizes(codes) if table is None else table[2][codes]
        need = int(np.searchsorted(np.cumsum(size), most - made)) + 1
        codes, size = codes[:need], size[:need]
        if table is None:
            text = _strings(codes, size)
        else:
            text = table[0][np.arange(size.sum()) + np.repeat(table[1][codes] - np.cumsum(size) + size, size)]
        out.append(text.tobytes())
        made += len(text)
        if made < most and len(wrong):
            raise ValueError("LZW code out of range")
        if stop == END or stop < 0 and n < len(ends):
            break
        if stop == CLEAR:
            table = None
        elif table is None and made < most:
            ones, begin = np.arange(FIRST_FREE), np.cumsum(size) - size
            table = (
                np.concatenate([ones.astype(np.uint8), text]),
                np.concatenate([ones, begin[:-1] + FIRST_FREE]),
                np.concatenate([np.ones(FIRST_FREE, np.int64), size[:-1] + 1]),
            )
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes, so that a small strip can't grow without end."""
    return zlib.decompressobj().decompress(data, most) if most else b""


def _predict(block: np.ndarray) -> np.ndarray:
    """Horizontal differences of (rows, pixels, samples)."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def encode_tiff(
    pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 2, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, order: str = "<", big: bool = False, planar: int = 1
) -> bytes:
    """A TIFF of pages, each (rows, pixels, samples) of an unsigned type, in strips or in tiles (height, width)."""
    out = bytearray(b"II" if order == "<" else b"MM")
    out += struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 0) if big else (42, 0)))
    link = len(out) - (8 if big else 4)
    for page in pages:
        rows, pixels, samples = page.shape
        kind = page.dtype.newbyteorder(order)
        pack = {NONE: bytes, LZW: lzw_encode, ADOBE_DEFLATE: lambda x: zlib.compress(x, 1), OLD_DEFLATE: zlib.compress, PACKBITS: packbits_encode}[compression]
        chunks: list[bytes] = []
        for plane in [page] if planar == 1 else [page[:, :, i : i + 1] for i in range(samples)]:
            if tile:
                th, tw = tile
                padded = np.zeros((-(-rows // th) * th, -(-pixels // tw) * tw, plane.shape[2]), page.dtype)
                padded[:rows, :pixels] = plane
                parts = [padded[y : y + th, x : x + tw] for y in range(0, rows, th) for x in range(0, pixels, tw)]
            else:
                parts = [plane[y : y + rows_per_strip] for y in range(0, rows, rows_per_strip)]
            chunks += [pack((_predict(p) if predictor == 2 else p).astype(kind).tobytes()) for p in parts]
        offsets = []
        for c in chunks:
            offsets.append(len(out))
            out += c
        if len(out) % 2:
            out.append(0)
        long = 16 if big else 4
        tags = {
            WIDTH: (4, [pixels]), HEIGHT: (4, [rows]), BITS: (3, [page.dtype.itemsize * 8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]),
            SAMPLES: (3, [samples]), PLANAR: (3, [planar]), PREDICTOR: (3, [predictor]),
        }
        if tile:
            tags |= {TILE_WIDTH: (4, [tile[1]]), TILE_HEIGHT: (4, [tile[0]]), TILE_OFFSETS: (long, offsets), TILE_BYTES: (long, [len(c) for c in chunks])}
        else:
            tags |= {ROWS_PER_STRIP: (4, [rows_per_strip]), STRIP_OFFSETS: (long, offsets), STRIP_BYTES: (long, [len(c) for c in chunks])}
        slot, entries = (8 if big else 4), bytearray()
        for tag, (code, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{TYPES[code]}", *values)
            if len(raw) > slot:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + ("Q" if big else "I"), where)
            entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, code, len(values)) + raw.ljust(slot, b"\0")
        struct.pack_into(order + ("Q" if big else "I"), out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(out)
        out += b"\0" * slot
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """(byte order, tags) of each image directory in the chain; a chain that comes back to a directory ends there."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise ValueError("no TIFF")
    big = magic == 43
    pointer, number, head = ("Q", "Q", "HHQ") if big else ("I", "H", "HHI")
    (at,) = struct.unpack_from(order + pointer, data, 8 if big else 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + number, data, at)
        at += struct.calcsize(number)
        tags: dict[int, list] = {}
        slot = struct.calcsize(pointer)
        for _ in range(n):
            tag, code, count = struct.unpack_from(order + head, data, at)
            at += struct.calcsize("=" + head)
            kind = TYPES.get(code)
            if kind:
                size = struct.calcsize("=" + kind) * count
                where = at if size <= slot else struct.unpack_from(order + pointer, data, at)[0]
                if where + size > len(data):
                    raise ValueError(f"tag {tag} beyond the end")
                tags[tag] = list(struct.unpack_from(f"{order}{count * len(kind)}{kind[0]}", data, where))
            at += slot
        yield order, tags
        (at,) = struct.unpack_from(order + pointer, data, at)


def read_page(data: bytes, order: str, tags: dict[int, list]) -> dict:
    """Shape and samples of one page; ``pixels`` are the samples row by row, chunky, little-endian."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    depth, packing, predictor, planar = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if len(set(tags.get(BITS, [1]))) > 1:
        raise ValueError("samples of several depths")
    tiled = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    inner = samples if planar == 1 else 1
    planes = 1 if planar == 1 else samples
    if not (width and height and tw and th):
        raise ValueError("empty page")
    across, down = -(-width // tw), -(-height // th)
    if len(offsets) < across * down * planes or len(sizes) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    if depth in (8, 16, 32, 64):
        kind = np.dtype(f"{order}u{depth // 8}") if depth > 8 else np.dtype("u1")
        line = tw * inner * depth // 8
    else:
        kind, line = None, -(-tw * inner * depth // 8)
        if tiled or planes > 1:
            raise ValueError(f"tiles or planes of {depth} bits")
    # what the file claims is checked against what its strips can hold, before any of it is allocated
    size = height * -(-width * samples * depth // 8)
    stored = sum(min(n, len(data)) for n in sizes[: across * down * planes])
    if packing not in EXPANSION:
        raise ValueError(f"compression {packing}")
    if max(size, th * line) > min(MAX_PAGE_BYTES, stored * EXPANSION[packing]):
        raise ValueError("page larger than its strips can be")
    out = np.zeros((height, width, samples), kind.newbyteorder("<")) if kind is not None else None
    loose: list[bytes] = []
    for i in range(across * down * planes):
        plane, y, x = i // (across * down), i % (across * down) // across * th, i % across * tw
        rows = th if tiled else min(th, height - y)
        raw = data[offsets[i] : offsets[i] + sizes[i]]
        if one(FILL_ORDER, 1) == 2:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tobytes()
        if packing == PACKBITS:
            raw = packbits_decode(raw, rows * line)
        elif packing == LZW:
            raw = lzw_decode(raw, rows * line)
        elif packing != NONE:
            raw = inflate(raw, rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile is short")
        raw = raw[: rows * line]
        if kind is None:
            loose.append(raw)
            continue
        if predictor == 3:
            lanes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(rows, depth // 8, -1)
            block = np.ascontiguousarray(lanes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, tw, inner)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, tw, inner)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            elif predictor != 1:
                raise ValueError(f"predictor {predictor}")
        h, w = min(rows, height - y), min(tw, width - x)
        out[y : y + h, x : x + w, plane if planes > 1 else slice(None)] = block[:h, :w, 0] if planes > 1 else block[:h, :w]
    return {
        "width": width, "height": height, "samples": samples, "bits": depth, "compression": packing, "predictor": predictor, "tiled": tiled,
        "pixels": out.tobytes() if kind is not None else b"".join(loose),
    }


def average_hash(pixels: bytes, line: int) -> int:
    """64 bits: whether the mean of each cell of an 8 x 8 grid over the bytes of a page is above the mean of all cells."""
    a = np.frombuffer(pixels, np.uint8)[: len(pixels) // line * line].reshape(-1, line)
    if not a.size:
        return 0
    rows, columns = np.arange(8) * a.shape[0] // 8, np.arange(8) * line // 8
    sums = np.add.reduceat(np.add.reduceat(a, rows, axis=0, dtype=np.int64), columns, axis=1)
    high = np.maximum(np.diff(np.append(rows, a.shape[0])), 1)[:, None] * np.maximum(np.diff(np.append(columns, line)), 1)[None, :]
    cells = sums / high
    return int(np.packbits((cells > cells.mean()).ravel()).view(">u8")[0])


PAGE_FIELDS = {
    "page": pa.int32(), "width": pa.int64(), "height": pa.int64(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.int32(),
    "predictor": pa.int32(), "tiled": pa.bool_(), "pixels": pa.binary(), "feature": pa.string(), "error": pa.string(),
}
PAGE_SHAPE = "page int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, feature string, error string"


def walk_pages(data: bytes | None) -> Iterator[dict]:
    """The pages of a TIFF in order. What can't be read is a page with only ``error`` set, and pages before it stay."""
    n = 0
    try:
        for order, tags in directories(data) if data is not None else ():
            try:
                page = read_page(data, order, tags)
                line = len(page["pixels"]) // page["height"]
                mean = np.frombuffer(page["pixels"], np.uint8).mean()
                page["feature"] = f"{page['width']}x{page['height']}:{mean:.3f}:{average_hash(page['pixels'], line):016x}"
            except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                page = {"error": str(e)[:200] or type(e).__name__}
            yield {"page": n, **page}
            n += 1
    except (ValueError, OverflowError, struct.error) as e:
        yield {"page": n, "error": str(e)[:200]}
        return
    if not n:
        yield {"page": 0, "error": "null" if data is None else "no page"}


def pages_of(data: bytes | None) -> list[dict]:
    """All pages of walk_pages()."""
    return list(walk_pages(data))


def tiff_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row for each page of each TIFF in ``column``: the row's other columns (but those named like a page's fields) and
    page, width, height, samples, bits, compression, predictor, tiled, pixels, feature, error.

    Null, empty or damaged media give one row with ``error``; a damaged page doesn't hide the others. A page that claims more
    bytes than its strips can hold, or more than MAX_PAGE_BYTES, is damaged. Rows are independent of each other: repeats give
    repeated rows, an empty table none.
    """
    kept = [f for f in media.schema.fields if f.name == column or f.name not in PAGE_FIELDS]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            at: list[int] = []

            def made() -> pa.RecordBatch:
                arrays = [batch.column(n).take(pa.array(at, pa.int64())) for n in names]  # noqa: B023
                arrays += [pa.array([r.get(k) for r in rows], t) for k, t in PAGE_FIELDS.items()]  # noqa: B023
                return pa.RecordBatch.from_arrays(arrays, [*names, *PAGE_FIELDS])

            size = 0
            for i, data in enumerate(batch.column(column).to_pylist()):
                for page in walk_pages(data):
                    rows.append(page)
                    at.append(i)
                    size += len(page.get("pixels") or b"") + len(data or b"")
                    if size > 4 << 20:
                        yield made()
                        rows, at, size = [], [], 0
            if rows:
                yield made()

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return media.select(*names).mapInArrow(run, f"{shape}, {PAGE_SHAPE}")


def payload_tiff(text: bytes) -> bytes:
    """The TIFF of a text: bytes padded with spaces to whole rows of 64 RGB pixels with horizontal differences; a checksum of
    the text deals out PackBits, LZW and deflate; tall pages are in tiles, others in strips."""
    rows = max(1, -(-len(text) // ROW))
    page = np.frombuffer(text.ljust(rows * ROW, PAD), np.uint8).reshape(rows, PIXELS, CHANNELS)
    packing = (PACKBITS, LZW, ADOBE_DEFLATE)[zlib.crc32(text) % 3]
    return encode_tiff([page], packing, 2, tile=(64, PIXELS) if rows >= 256 else None)


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of docs (doc_id, text): the text's bytes (null: none) as a TIFF.

    Whole texts, however long, are one page each. The media depend on the text alone, so repeated rows and null ids are like
    any other; other columns, also such with names of the result, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, media, size = 0, [], 0
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                media.append(payload_tiff(text or b""))
                size += len(media[-1])
                if size > 4 << 20 or i + 1 == len(texts):
                    n = pa.array([len(t or b"") for t in texts[begin : i + 1]], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(media)), n, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    begin, media, size = i + 1, [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
