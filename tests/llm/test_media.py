import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenta.llm import jpeg, media


class Writer:
    """A plain progressive encoder for any coefficients: every symbol has a nine-bit code."""

    def __init__(self):
        self.out = []

    def table(self, kind):
        symbols = list(range(256)) if kind else list(range(12))
        return jpeg._segment(0xC4, bytes([kind, *[0] * 8, 255 if kind else 12, *([1] if kind else [0]), *[0] * 6, *symbols]))

    def code(self, symbol):
        self.out.append(format(symbol, "09b") if symbol < 255 else format(255 << 1, "010b"))

    def bits(self, value, n):
        self.out.append(format(value, f"0{n}b") if n else "")

    def signed(self, v):
        n = abs(v).bit_length()
        self.bits(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        bits = np.frombuffer("".join(self.out).encode(), np.uint8) - 48
        self.out = []
        return jpeg._packed(bits)


def shift(v, low):
    return int(abs(v) >> low) * (1 if v > 0 else -1)


def dc_first(w, blocks, low):
    last = {}
    for c, values in blocks:
        v = int(values[0]) >> low
        d = v - last.get(c, 0)
        last[c] = v
        w.code(abs(d).bit_length())
        w.signed(d)


def ac_first(w, blocks, first, last, low):
    ended = 0

    def flush():
        nonlocal ended
        if ended:
            n = ended.bit_length() - 1
            w.code(n << 4)
            w.bits(ended - (1 << n), n)
            ended = 0

    for values in blocks:
        run = 0
        for k in range(first, last + 1):
            v = shift(int(values[k]), low)
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                w.code(0xF0)
                run -= 16
            w.code(run << 4 | abs(v).bit_length())
            w.signed(v)
            run = 0
        ended += run > 0
    flush()


def ac_more(w, blocks, first, last, low):
    """Each block ends with a run of one block, or with runs joined where a block has nothing new."""
    ended, kept = 0, []

    def flush():
        nonlocal ended, kept
        if ended:
            n = ended.bit_length() - 1
            w.code(n << 4)
            w.bits(ended - (1 << n), n)
            w.out += kept
        ended, kept = 0, []

    for values in blocks:
        run, fix, newest = 0, [], max([k for k in range(first, last + 1) if abs(shift(int(values[k]), low)) == 1], default=-1)
        for k in range(first, last + 1):
            v = shift(int(values[k]), low)
            if abs(v) > 1:
                fix.append(str(abs(v) & 1))
                continue
            if v:
                flush()
                w.code(run << 4 | 1)
                w.out += ["1" if v > 0 else "0", *fix]
                run, fix = 0, []
                continue
            if run == 15 and k < newest:
                flush()
                w.code(0xF0)
                w.out += fix
                run, fix = 0, []
                continue
            run += 1
        if run or fix:
            ended += 1
            kept += fix
    flush()


@pytest.mark.parametrize(("h", "v", "width", "height"), [(2, 2, 37, 50), (2, 1, 33, 9), (1, 1, 24, 24)])
def test_decoder_reads_any_scans(h, v, width, height):
    rng = np.random.default_rng(width)
    parts = [jpeg.Component(1, h, v, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)]
    for c in parts:
        c.lay_out(width, height, h, v)
        x = rng.integers(-40, 41, c.coefficients.shape) * (rng.random(c.coefficients.shape) < rng.random((len(c.coefficients), 1)) * 0.5)
        mask = np.zeros(len(x), bool)
        mask[c.by_row()] = True
        x[~mask, 1:] = 0
        c.coefficients[:] = x
    w, head = Writer(), [b"\xff\xd8", jpeg._segment(0xDB, bytes([0] + [2] * 64))]
    head.append(jpeg._segment(0xC2, bytes([8, height >> 8, height & 255, width >> 8, width & 255, 3, 1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])))
    head += [w.table(0), w.table(16)]
    order = [(c.name, c.coefficients[b]) for row in zip(*(c.by_mcu() for c in parts), strict=True) for c, bs in zip(parts, row, strict=True) for b in bs]
    dc_first(w, order, 1)
    head += [jpeg._start([1, 2, 3], 0, 0, 0, 1), w.data()]
    w.out = [str(int(x[0]) & 1) for _, x in order]
    head += [jpeg._start([1, 2, 3], 0, 0, 1, 0), w.data()]
    for c in parts:
        for first, last in ((1, 5), (6, 63)):
            ac_first(w, c.coefficients[c.by_row()], first, last, 2)
            head += [jpeg._start([c.name], first, last, 0, 2), w.data()]
        for low in (1, 0):
            ac_more(w, c.coefficients[c.by_row()], 1, 63, low)
            head += [jpeg._start([c.name], 1, 63, low + 1, low), w.data()]
    got, info = jpeg.decode(b"".join([*head, b"\xff\xd9"]))
    for a, b in zip(got, parts, strict=True):
        assert (a.coefficients == b.coefficients).all()
    image, most_h, most_v = jpeg.rgb(got, info), h, v
    assert image.shape == (height, width, 3)

    def sample(c, y, x):
        """A component's sample for a pixel of the image, from its block's coefficients by the definition."""
        y, x = y * c.v // most_v, x * c.h // most_h
        grid = np.zeros(64)
        grid[jpeg.ZIGZAG] = c.coefficients[(y // 8) * c.across + x // 8] * 2.0
        k = np.arange(8)
        a = np.where(k == 0, np.sqrt(0.5), 1.0) / 2
        row, column = (a * np.cos((2 * (i % 8) + 1) * k * np.pi / 16) for i in (y, x))
        return min(255.0, max(0.0, row @ grid.reshape(8, 8) @ column + 128))

    for y, x in [(0, 0), (height - 1, width - 1), *zip(rng.integers(0, height, 40).tolist(), rng.integers(0, width, 40).tolist(), strict=True)]:
        luma, blue, red = (sample(c, y, x) for c in parts)
        want = np.clip([luma + 1.402 * (red - 128), luma - 0.344136 * (blue - 128) - 0.714136 * (red - 128), luma + 1.772 * (blue - 128)], 0, 255)
        assert np.abs(want - image[y, x]).max() <= 0.6


def test_inverse_transform_against_its_definition():
    rng = np.random.default_rng(1)
    c = jpeg.Component(1, 1, 1, 0)
    c.lay_out(8, 8, 1, 1)
    c.coefficients[0] = rng.integers(-30, 31, 64)
    grid = np.zeros(64)
    grid[jpeg.ZIGZAG] = c.coefficients[0]
    grid = grid.reshape(8, 8)
    a = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    want = [[sum(a(u) * a(v) / 4 * grid[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128 for x in range(8)] for y in range(8)]
    got = jpeg.rgb([c], {"tables": {0: np.ones(64, np.float32)}, "width": 8, "height": 8})[:, :, 0]
    assert np.abs(np.clip(want, 0, 255) - got).max() <= 0.51


@pytest.mark.parametrize("n", [0, 1, 576, 5760, 576 * 40, 63 * 6 * 33_000])
def test_payloads_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert jpeg.stored(*jpeg.decode(jpeg.store(data))) == data


def check(r, text):
    data = (text or "").encode()
    payload = data + b"\xff" * ((576 - len(data) % 576) % 576 if data else 576)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_rows(spark, odd, none, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abé \n😀") for _ in range(rng.choice([0, 5, 576, 3000, 400_000])))) for i in range(30)]
    got = {r.doc_id: r for r in media.read_back(media.images(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        check(got[i], t)
    seen = media.read_back(media.images(odd("images"))).collect()
    assert len(seen) == 9 and len({r.media_sha256 + r.feature for r in seen if r.doc_id == 7}) == 1
    for r in seen:
        check(r, next(x.text for x in odd().collect() if x.doc_id == r.doc_id))
    assert media.read_back(media.images(none)).count() == 0


def test_feature_against_its_definition(spark):
    text = "Some text, ünïcode too. " * 40
    r = media.read_back(media.images(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    t = jpeg.rgb(*jpeg.decode(jpeg.store(media.padded(text.encode())))).astype(float)
    assert r.feature == f"{t.shape[0]}x{t.shape[1]}x1;" + ",".join(f"{t[:, :, k].mean():.2f}/{t[:, :, k].std():.2f}" for k in range(3))


def test_tensors(spark):
    good = jpeg.store(b"abc" * 700)
    df = spark.createDataFrame([(1, good, "x"), (2, None, "y")], "i int, image binary, width string")
    got = {r.i: r for r in media.tensors(df).collect()}
    t = jpeg.rgb(*jpeg.decode(good))
    assert got[1].rgb == t.tobytes() and (got[1].height, got[1].width) == t.shape[:2] and got[1].error is None
    assert got[2].rgb is None and got[2].error is None


def test_damaged_images_have_an_error(spark):
    good = jpeg.store(b"abc" * 700)
    at = good.index(b"\xff\xc2")
    bad = [b"", b"no image", good[:100], good[: len(good) // 2], good[: at + 6], good[: at + 1] + b"\xc0" + good[at + 2 :], good[: at + 5] + b"\xff\xff\xff\xff" + good[at + 9 :], good.replace(b"\xff\xc4", b"\xff\xfe")]
    got = media.tensors(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([*bad, good])], "i int, image binary")).collect()
    assert len(got) == len(bad) + 1
    for r in got:
        assert (r.error is None) == (r.rgb is not None) == (r.i == len(bad)), r.i


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 255)), min_size=1, max_size=6))
def test_any_damage_is_a_value_error_or_an_image(changes):
    data = bytearray(jpeg.store(b"abc" * 700))
    for i, x in changes:
        data[i % len(data)] = x
    try:
        jpeg.rgb(*jpeg.decode(bytes(data), 1 << 18))
    except ValueError:
        pass
