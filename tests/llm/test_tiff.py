import struct
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import tiff

COMPRESSIONS = [tiff.NONE, tiff.LZW, tiff.ADOBE_DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600) | st.lists(st.sampled_from([b"a" * 9, b"ab", b"\0", b"xyz" * 50]), max_size=30).map(b"".join))
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_through_all_code_widths():
    data = np.random.default_rng(1).integers(0, 256, 60000, dtype=np.uint8).tobytes() + b"ab" * 30000
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_known_stream():
    # 7 7 7 8 8 7 7 6 6 as clear, 7, 258, 8, 8, 258, 6, 6, end in codes of nine bits
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def lines_run(f, *args):
    """How many lines of Python f runs: its work apart from numpy's, whatever the machine."""
    n, before = 0, sys.gettrace()

    def count(frame, event, arg):
        nonlocal n
        n += event == "line"
        return count

    sys.settrace(count)
    try:
        f(*args)
    finally:
        sys.settrace(before)
    return n


def test_lzw_work_a_byte():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(500)]
    text = b" ".join(words[i] for i in rng.integers(0, 500, 6000))
    page = np.frombuffer(text[: len(text) // 192 * 192], np.uint8).reshape(-1, 64, 3)
    data = tiff._predict(page).tobytes()
    coded = tiff.lzw_encode(data)
    assert lines_run(tiff.lzw_encode, data) < 7 * len(data)
    assert lines_run(tiff.lzw_decode, coded) < len(data) / 20


def lzw_stream(codes):
    """Codes as bits, with the widths of a table that grows with each code but the first."""
    out, known = [], 257
    for code in codes:
        out.append(f"{code:0{min(12, max(9, (known + 1).bit_length()))}b}")
        known = 257 if code == tiff.CLEAR else known + 1
    bits = "".join(out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("n", [10, 3837, 3838, 3839, 3840, 3841, 7678, 12000])
@pytest.mark.parametrize("longest", [False, True])
def test_lzw_table_that_stays_full(n, longest):
    rng = np.random.default_rng(n)
    codes, strings, want = [], [bytes((b,)) for b in range(256)] + [b"", b""], []
    for i in range(n):
        top = min(4095, 257 + i)
        code = 97 if i < 2 else top if longest else int(rng.choice([rng.integers(97, 123), rng.integers(258, top + 1)]))
        if i and len(strings) < 4096:
            strings.append(want[-1] + (strings[code] if code < len(strings) else want[-1])[:1])
        codes.append(code)
        want.append(strings[code])
    whole = b"".join(want)
    for end in ([], [tiff.END], [tiff.CLEAR, 98, 99, 258, tiff.END, 65]):
        assert tiff.lzw_decode(lzw_stream(codes + end)) == whole + (b"bcbc" if len(end) > 1 else b"")
    most = len(whole) // 2
    assert tiff.lzw_decode(lzw_stream(codes), most)[:most] == whole[:most]


def test_lzw_codes_that_do_not_exist_yet():
    for codes in ([258], [65, 259], [65, 66, 300, 67]):
        with pytest.raises((ValueError, IndexError)):
            tiff.lzw_decode(lzw_stream(codes))
    # what was asked for comes before it
    assert tiff.lzw_decode(lzw_stream([65, 66, 300, 67]), 2) == b"AB"


@pytest.mark.parametrize("compression", COMPRESSIONS)
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 48)])
@pytest.mark.parametrize(("order", "big", "planar"), [("<", False, 1), (">", False, 2), ("<", True, 1), (">", True, 1)])
def test_pages_round_trip(compression, tile, order, big, planar):
    rng = np.random.default_rng(2)
    for dtype in (np.uint8, np.uint16):
        pages = [rng.integers(0, 9, (rows, 37, samples)).astype(dtype) for rows, samples in ((1, 3), (50, 3), (33, 1))]
        for predictor in (1, 2):
            found = tiff.pages_of(tiff.encode_tiff(pages, compression, predictor, 20, tile, order, big, planar))
            assert [p.get("error") for p in found] == [None] * 3
            for p, want in zip(found, pages, strict=True):
                assert p["pixels"] == want.tobytes() and (p["height"], p["width"], p["samples"]) == want.shape
                assert (p["compression"], p["predictor"], p["tiled"]) == (compression, predictor, tile is not None)


def test_float_predictor():
    values = np.arange(24, dtype=np.float32).reshape(3, 8, 1) / 7
    data = tiff.encode_tiff([values.view(np.uint32)], tiff.NONE, 1)
    lanes = values[:, :, 0].astype(">f4").view(np.uint8).reshape(3, 8, 4).transpose(0, 2, 1).reshape(3, 32).astype(int)
    coded = np.diff(lanes, axis=1, prepend=0).astype(np.uint8).tobytes()
    order, tags = next(tiff.directories(data))
    at = tags[tiff.STRIP_OFFSETS][0]
    data = data[:at] + coded + data[at + len(coded) :]
    page = tiff.read_page(data, order, {**tags, tiff.PREDICTOR: [3]})
    assert np.frombuffer(page["pixels"], "<f4").tolist() == values.ravel().tolist()


def test_damaged_files():
    page = np.zeros((10, 64, 3), np.uint8)
    data = tiff.encode_tiff([page, page])
    assert tiff.pages_of(None)[0]["error"] == "null"
    for bad in (b"", b"II", b"PK\3\4", b"II*\0\xff\xff\xff\xff", data[:-20], data[:60]):
        assert any(p.get("error") for p in tiff.pages_of(bad))
    # a chain that returns to its first directory
    first = struct.unpack_from("<I", data, 4)[0]
    loop = bytearray(tiff.encode_tiff([page]))
    n = struct.unpack_from("<H", loop, struct.unpack_from("<I", loop, 4)[0])[0]
    head = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, head + 2 + 12 * n, head)
    assert len(tiff.pages_of(bytes(loop))) == 1 and first


def test_text_media(spark):
    texts = ["", None, "a", "é" * 100, "x" * 192, "word " * 30000, "a"]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, pixels string")
    got = sorted(tiff.tiff_pages(tiff.text_media(docs)).collect(), key=lambda r: r.doc_id)
    for row, text in zip(got, texts, strict=True):
        raw = (text or "").encode()
        assert row.n_bytes == len(raw) and row.error is None
        assert bytes(row.pixels) == raw.ljust(max(1, -(-len(raw) // 192)) * 192)
    assert got[2].feature == got[6].feature and got[2].media == got[6].media
    assert [r.tiled for r in got] == [False] * 5 + [True, False]
    many = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    assert {r.compression for r in tiff.tiff_pages(tiff.text_media(many)).collect()} == {tiff.PACKBITS, tiff.LZW, tiff.ADOBE_DEFLATE}
    assert tiff.tiff_pages(tiff.text_media(docs.filter("false"))).count() == 0


def test_column_names_that_clash(spark):
    media = spark.createDataFrame([(1, bytearray(tiff.payload_tiff(b"hi")), "mine", 5)], "doc_id long, media binary, error string, page int")
    row = tiff.tiff_pages(media).first()
    assert row.error is None and row.page == 0


@pytest.mark.parametrize("compression", COMPRESSIONS)
@pytest.mark.parametrize("sizes", [{tiff.WIDTH: 4_000_000, tiff.HEIGHT: 4_000_000_000}, {tiff.HEIGHT: 4_000_000_000}, {tiff.WIDTH: 4_000_000_000}, {tiff.SAMPLES: 60_000}])
def test_claims_of_huge_pages_are_errors(compression, sizes):
    data = tiff.encode_tiff([np.zeros((4, 64, 3), np.uint8)], compression)
    order, tags = next(tiff.directories(data))
    with pytest.raises(ValueError):
        tiff.read_page(data, order, tags | {k: [v] for k, v in sizes.items()} | ({tiff.BITS: [8] * 3}))
    tiles = tiff.encode_tiff([np.zeros((4, 64, 3), np.uint8)], compression, tile=(16, 64))
    order, tags = next(tiff.directories(tiles))
    with pytest.raises(ValueError):
        tiff.read_page(tiles, order, tags | {tiff.TILE_HEIGHT: [4_000_000_000]})


def test_decoders_stop():
    assert len(tiff.packbits_decode(bytes((129, 7)) * 10_000, 1000)) < 1200
    assert len(tiff.lzw_decode(tiff.lzw_encode(b"a" * 2_000_000), 1000)) < 6000
    assert len(tiff.inflate(zlib.compress(b"a" * 2_000_000), 1000)) == 1000


def test_damage_anywhere_is_an_error_or_a_page():
    rng = np.random.default_rng(8)
    for compression in COMPRESSIONS:
        data = tiff.encode_tiff([rng.integers(0, 9, (20, 64, 3)).astype(np.uint8)] * 2, compression)
        for _ in range(150):
            bad = bytearray(data)
            for at in rng.integers(0, len(bad), 4):
                bad[at] = rng.integers(0, 256)
            assert tiff.pages_of(bytes(bad))
