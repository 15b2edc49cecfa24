"""Progressive JPEG in numpy: a decoder for any such file, and an encoder for byte payloads.

A progressive file sends its coefficients in scans: of a band of frequencies
(spectral selection) and of leading bits first, then one bit more at a time
(successive approximation). The decoder accumulates the scans into coefficient arrays;
then it inverts the transform, brings chroma to full size and converts to RGB.

Where a scan's codes vary, symbols are looked up by the next sixteen bits. Where a table
has a single code, and in runs of blocks that hold correction bits alone, whole
stretches are read at once.

The format's unit is the quantised coefficient, so bytes are stored without loss as
coefficients, one for each of a block's 63 places but the first. The upper seven bits of
a byte are a magnitude of seven bits with its sign, as the format writes it, the last bit
is the correction. So a symbol of the first scan takes eight bits, and what repeats in
the payload repeats byte by byte in the file. Table values are 1.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

#: The zigzag order of an 8 x 8 block, as places in rows of eight.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
#: Pixels of one image at most, unless the caller says otherwise: what a header may make a task allocate.
PIXELS = 1 << 26
_K = np.arange(8)
_DCT = np.sqrt(np.where(_K == 0, 1 / 8, 1 / 4))[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
#: From 64 coefficients in zigzag order to 64 samples.
_INVERSE = np.kron(_DCT, _DCT)[ZIGZAG].astype(np.float32)


class Component:
    def __init__(self, name: int, h: int, v: int, table: int) -> None:
        self.name, self.h, self.v, self.table = name, h, v, table

    def lay_out(self, width: int, height: int, most_h: int, most_v: int) -> None:
        self.mcus_x, self.mcus_y = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        self.across, self.down = self.mcus_x * self.h, self.mcus_y * self.v
        own_w, own_h = -(-width * self.h // most_h), -(-height * self.v // most_v)
        self.own_across, self.own_down = -(-own_w // 8), -(-own_h // 8)
        self.coefficients = np.zeros((self.across * self.down, 64), np.int32)

    def by_mcu(self) -> np.ndarray:
        """Blocks of each MCU, a row each."""
        y, x = np.divmod(np.arange(self.mcus_x * self.mcus_y), self.mcus_x)
        dy, dx = np.divmod(np.arange(self.h * self.v), self.h)
        return (y[:, None] * self.v + dy) * self.across + x[:, None] * self.h + dx

    def by_row(self) -> np.ndarray:
        """The blocks that a scan of this component alone has, in its order."""
        return (np.arange(self.own_down)[:, None] * self.across + np.arange(self.own_across)).ravel()


class Bits:
    """The bits of one stretch between markers; past the end there are ones."""

    def __init__(self, data: bytes) -> None:
        self.raw, self.at = data.replace(b"\xff\x00", b"\xff"), 0
        self.bits = np.unpackbits(np.frombuffer(self.raw, np.uint8))

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        self.at += n
        return out if len(out) == n else np.append(out, np.ones(n - len(out), np.uint8))

    def _peek(self, n: int) -> int:
        """The next n bits, 16 at most, as a number."""
        i = self.at >> 3
        return int.from_bytes(self.raw[i : i + 3].ljust(3, b"\xff"), "big") >> (24 - (self.at & 7) - n) & ((1 << n) - 1)

    def number(self, n: int) -> int:
        out = self._peek(n)
        self.at += n
        return out

    def signed(self, n: int) -> int:
        """A value of n magnitude bits: a leading 0 means negative."""
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: Huffman) -> int:
        length, symbol = divmod(int(table.lookup[self._peek(16)]), 256)
        if not length or self.at > len(self.bits):
            raise ValueError("no such code")
        self.at += length
        return symbol


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes) -> None:
        #: For every next sixteen bits: 256 times the code's length, and its symbol; 0 where there is no code.
        self.lookup = np.zeros(1 << 16, np.int32)
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.lookup[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        #: (code length, symbol) if there is only one
        self.single = divmod(int(self.lookup[0]), 256) if k == 1 else None


def _signed(bits: np.ndarray) -> np.ndarray:
    """Values of rows of magnitude bits: a leading 0 means negative."""
    n = bits.shape[-1]
    if not n:
        return np.zeros(bits.shape[:-1], np.int64)
    if n <= 8:
        value = (np.packbits(bits, axis=-1)[..., 0] >> (8 - n)).astype(np.int32)
    else:
        value = bits @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
    return np.where(bits[..., 0] == 0, value - (1 << n) + 1, value)


def _dc(bits: Bits, blocks: list[tuple[Component, np.ndarray, Huffman]], high: int, low: int) -> None:
    """blocks: for each component its (MCUs, blocks of an MCU) of this stretch."""
    total = sum(b.size for _, b, _ in blocks)
    if high:  # one more bit of each
        got = bits.take(total).reshape(len(blocks[0][1]), -1)
        at = 0
        for c, b, _ in blocks:
            c.coefficients[b, 0] |= got[:, at : at + b.shape[1]].astype(np.int32) << low
            at += b.shape[1]
        return
    single = {t.single for _, _, t in blocks}
    if len(single) == 1 and None not in single:
        length, size = single.pop()
        diff = _signed(bits.take(total * (length + size)).reshape(len(blocks[0][1]), -1, length + size)[:, :, length:])
        at = 0
        for c, b, _ in blocks:
            own = np.cumsum(diff[:, at : at + b.shape[1]].ravel())
            c.coefficients[b.ravel(), 0] = own << low
            at += b.shape[1]
        return
    last = [0] * len(blocks)
    for i in range(len(blocks[0][1])):
        for k, (c, b, table) in enumerate(blocks):
            for block in b[i]:
                last[k] += bits.signed(bits.symbol(table))
                c.coefficients[block, 0] = last[k] << low


def _ac_first(bits: Bits, c: Component, blocks: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    if table.single and table.single[1] >> 4 == 0 and table.single[1] & 15:
        length, size = table.single
        width = last - first + 1
        got = bits.take(len(blocks) * width * (length + size)).reshape(len(blocks), width, length + size)
        c.coefficients[blocks, first : last + 1] = _signed(got[:, :, length:]) << low
        return
    skip = 0
    for block in blocks:
        if skip:
            skip -= 1
            continue
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                c.coefficients[block, k] = bits.signed(size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.number(run) - 1
                break


def _correct(bits: Bits, values: np.ndarray, low: int) -> None:
    """A correction bit for each value that isn't 0, in place."""
    known = values != 0
    got = bits.take(int(known.sum())).astype(np.int32) << low
    values[known] += np.sign(values[known]) * got


def _ac_more(bits: Bits, c: Component, blocks: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    at = 0
    while at < len(blocks):
        own = c.coefficients[blocks[at]]
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if not size and run < 15:  # correction bits alone, here and in the blocks of the run
                n = (1 << run) + bits.number(run)
                rest = own[k : last + 1]
                _correct(bits, rest, low)
                more = blocks[at + 1 : at + n]
                held = c.coefficients[more, first : last + 1]
                _correct(bits, held, low)
                c.coefficients[more, first : last + 1] = held
                at += len(more)
                break
            new = (1 if bits.take(1)[0] else -1) << low if size else 0
            while k <= last:
                if own[k]:
                    _correct(bits, own[k : k + 1], low)
                elif run:
                    run -= 1
                else:
                    own[k] = new
                    k += 1
                    break
                k += 1
        at += 1


def decode(data: bytes, most: int = PIXELS) -> tuple[list[Component], dict]:
    """Components with their coefficients in zigzag order; width, height, quantisation tables and comments.

    A ValueError says that data isn't a progressive Huffman-coded JPEG of one or three
    components, is damaged or cut off, or announces more than most pixels.
    """
    try:
        return _decoded(data, most)
    except (ArithmeticError, AttributeError, LookupError, TypeError, struct.error) as e:
        raise ValueError("a damaged JPEG") from e


def _decoded(data: bytes, most: int) -> tuple[list[Component], dict]:
    info: dict = {"tables": {}, "comments": []}
    huffman: dict[int, Huffman] = {}
    parts: list[Component] = []
    at, restart = 2, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while data[at + 1] != 0xD9:
        marker, (size,) = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            info["comments"].append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                info["tables"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, info["height"], info["width"], n = struct.unpack(">BHHB", body[:6])
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if not info["height"] or not info["width"] or info["height"] * info["width"] > most:
                raise ValueError("an image without pixels, or of too many")
            if any(not c.h or not c.v or max(x.h for x in parts) % c.h or max(x.v for x in parts) % c.v for c in parts):
                raise ValueError("sampling factors that do not divide each other")
            for c in parts:
                c.lay_out(info["width"], info["height"], max(x.h for x in parts), max(x.v for x in parts))
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDA:
            end = _END.search(data, at).start()  # None if the file is cut off
            names = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            first, last, steps = body[-3:]
            _scan([(c, names[c.name]) for c in parts if c.name in names], _RESTART.split(data[at:end]), restart, huffman, first, last, steps >> 4, steps & 15)
            at = end
    if len(parts) not in (1, 3) or any(c.table not in info["tables"] or len(info["tables"][c.table]) < 64 for c in parts):
        raise ValueError("not one or three components, or no quantisation tables for them")
    return parts, info


def _scan(chosen: list[tuple[Component, int]], stretches: list[bytes], restart: int, huffman: dict, first: int, last: int, high: int, low: int) -> None:
    rows = [c.by_mcu() if len(chosen) > 1 else c.by_row()[:, None] for c, _ in chosen]
    step = restart or len(rows[0])
    for i, stretch in enumerate(stretches):
        bits, own = Bits(stretch), [r[i * step : (i + 1) * step] for r in rows]
        if first == 0:
            _dc(bits, [(c, b, huffman.get(names >> 4)) for (c, names), b in zip(chosen, own, strict=True)], high, low)
        else:
            c, names = chosen[0]
            (_ac_more if high else _ac_first)(bits, c, own[0].ravel(), huffman[16 + (names & 15)], first, last, low)


def rgb(parts: list[Component], info: dict) -> np.ndarray:
    """(height, width, 3) of uint8, from one or three components."""
    planes = []
    for c in parts:
        samples = (c.coefficients.astype(np.float32) * info["tables"][c.table]) @ _INVERSE + 128
        plane = samples.reshape(c.down, c.across, 8, 8).swapaxes(1, 2).reshape(c.down * 8, c.across * 8)
        plane = plane.repeat(max(x.v for x in parts) // c.v, axis=0).repeat(max(x.h for x in parts) // c.h, axis=1)
        planes.append(np.clip(plane[: info["height"], : info["width"]], 0, 255))
    if len(planes) == 1:
        return np.rint(planes[0]).astype(np.uint8)[:, :, None].repeat(3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.rint(np.clip(out, 0, 255)).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int]) -> bytes:
    """A Huffman table with codes 0, 10, 110, ... for symbols."""
    return _segment(0xC4, bytes([kind, *[1] * len(symbols), *[0] * (16 - len(symbols)), *symbols]))


def _packed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes of bits: filled up with ones, and a 0 after each 255."""
    full = np.append(bits, np.ones(-len(bits) % 8, np.uint8))
    return np.packbits(full).tobytes().replace(b"\xff", b"\xff\x00")


def _start(names: list[int], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(names), *[x for n in names for x in (n, 0)], first, last, high << 4 | low]))


def _runs(n: int) -> Iterator[tuple[int, int]]:
    """End-of-band runs over n blocks: (size, run)."""
    while n:
        run = min(n, 32767)
        yield run.bit_length() - 1, run
        n -= run


#: Bands of frequencies for luma and for chroma.
BANDS = {1: [(1, 5), (6, 63)], 2: [(1, 63)], 3: [(1, 63)]}


def store(payload: bytes) -> bytes:
    """A colour image, chroma at half size both ways, whose coefficients are payload.

    Scans: the first coefficients of all components but their last bit, then that bit; for
    each component and band all values but their last bit, then that.
    """
    mcus = max(1, -(-len(payload) // (6 * 63)))
    across = min(4095, int(mcus**0.5) or 1)
    down = -(-mcus // across)
    mcus = across * down
    values = np.zeros(mcus * 6 * 63, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = values.reshape(-1, 63)
    own = {1: values[: 4 * mcus], 2: values[4 * mcus : 5 * mcus], 3: values[5 * mcus :]}
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0] + [1] * 64))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_table(0, [0]), _start([1, 2, 3], 0, 0, 0, 1), _packed(np.zeros(6 * mcus, np.uint8))]
    out += [_start([1, 2, 3], 0, 0, 1, 0), _packed(np.zeros(6 * mcus, np.uint8))]
    out.append(_table(16, [7]))
    for name, bands in BANDS.items():
        for first, last in bands:
            band = own[name][:, first - 1 : last]
            out += [_start([name], first, last, 0, 1), (band >> 1).tobytes()]  # the code 0 and seven bits: never 255
    for name, bands in BANDS.items():
        runs = list(_runs(len(own[name])))
        sizes = sorted({s for s, _ in runs}, reverse=True)
        out.append(_table(16, [s << 4 for s in sizes]))
        for first, last in bands:
            band, bits, at = own[name][:, first - 1 : last] & 1, [], 0
            for s, run in runs:
                head = "1" * sizes.index(s) + "0" + (format(run - (1 << s), f"0{s}b") if s else "")
                bits += [np.frombuffer(head.encode(), np.uint8) - 48, band[at : at + run].ravel()]
                at += run
            out += [_start([name], first, last, 1, 0), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def stored(parts: list[Component], info: dict) -> bytes:
    """The payload of an image made by store()."""
    n = struct.unpack(">Q", info["comments"][0])[0]
    values = np.concatenate([c.coefficients[:, 1:].ravel() for c in parts])[:n]
    high = np.abs(values) >> 1
    return (np.where(values > 0, high, 127 - high) << 1 | np.abs(values) & 1).astype(np.uint8).tobytes()
