"""Progressive scans with every kind of token, written by a plain encoder, against the coefficients."""

import struct

import numpy as np
import pytest

jpeg = pytest.importorskip("tidewright.llm.jpeg")

# 162 or fewer symbols with codes of eight bits
SYMBOLS = bytes(r << 4 | s for r in range(16) for s in range(11))[:176]
TABLE = bytes([0] * 7 + [len(SYMBOLS)] + [0] * 8) + SYMBOLS


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def symbol(self, s):
        self.put(SYMBOLS.index(s), 8)

    def done(self):
        return jpeg._entropy(np.array(self.bits, np.uint8))


def signed(w, v, s):
    w.put(v if v > 0 else v + (1 << s) - 1, s)


def ac_first(blocks, ss, se, al):
    w, run = Writer(), 0

    def flush():
        nonlocal run
        if run:
            r = run.bit_length() - 1
            w.symbol(r << 4)
            w.put(run - (1 << r), r)
            run = 0

    for b in blocks:
        zeros, ended = 0, True
        for k in range(ss, se + 1):
            v = int(abs(b[k]) >> al) * (1 if b[k] > 0 else -1)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            s = abs(v).bit_length()
            w.symbol(zeros << 4 | s)
            signed(w, v, s)
            zeros = 0
        if zeros:
            run += 1
    flush()
    return w.done()


def ac_refine(blocks, ss, se, al):
    """Each block ends with a run of its own."""
    w = Writer()
    for b in blocks:
        new = [k for k in range(ss, se + 1) if abs(b[k]) >> al == 1]
        last, k, zeros, held = (new[-1] if new else -1), ss, 0, []
        for k in range(ss, last + 1):
            m = abs(int(b[k])) >> al
            if m > 1:
                held.append(m & 1)
            elif m == 0:
                zeros += 1
                if zeros == 16 and any(x > k for x in new):
                    w.symbol(0xF0)
                    [w.put(x, 1) for x in held]
                    zeros, held = 0, []
            else:
                w.symbol(zeros << 4 | 1)
                w.put(int(b[k] > 0), 1)
                [w.put(x, 1) for x in held]
                zeros, held = 0, []
        if last < se:
            w.symbol(0x00)
            [w.put(x, 1) for x in held]
            for k in range(max(last + 1, ss), se + 1):
                m = abs(int(b[k])) >> al
                if m > 1:
                    w.put(m & 1, 1)
    return w.done()


def test_all_scan_kinds():
    rng = np.random.default_rng(3)
    rows, cols = 3, 5
    c = np.where(rng.random((rows * cols, 64)) < 0.3, rng.integers(-60, 61, (rows * cols, 64)), 0).astype(int)
    c[4] = 0
    c[7, 40:] = 0
    c[:, 0] = rng.integers(-300, 300, rows * cols)
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\x00" + bytes(range(1, 65))), jpeg._segment(0xC2, struct.pack(">BHHB", 8, rows * 8 - 3, cols * 8 - 1, 1) + bytes((1, 0x11, 0))), jpeg._segment(0xC4, b"\x00" + TABLE + b"\x10" + TABLE)]
    w, before = Writer(), 0
    for v in (c[:, 0] >> 1).tolist():
        d, before = v - before, v
        s = abs(d).bit_length()
        w.symbol(s)
        if s:
            signed(w, d, s)
    out.append(jpeg._segment(0xDA, bytes((1, 1, 0, 0, 0, 0x01))) + w.done())
    out.append(jpeg._segment(0xDA, bytes((1, 1, 0, 0, 0, 0x10))) + jpeg._entropy((c[:, 0] & 1).astype(np.uint8)))
    for a, b in ((1, 5), (6, 63)):
        out.append(jpeg._segment(0xDA, bytes((1, 1, 0, a, b, 0x02))) + ac_first(c, a, b, 2))
        out.append(jpeg._segment(0xDA, bytes((1, 1, 0, a, b, 0x21))) + ac_refine(c, a, b, 1))
        out.append(jpeg._segment(0xDA, bytes((1, 1, 0, a, b, 0x10))) + ac_refine(c, a, b, 0))
    data = b"".join(out) + b"\xff\xd9"
    frame = jpeg.read_coefficients(data)
    assert (frame.components[0].coefficients.reshape(-1, 64) == c).all()
    assert jpeg.decode(data).shape == (rows * 8 - 3, cols * 8 - 1, 3)


def test_inverse_transform_of_a_constant_block():
    z = np.zeros(64, np.float32)
    z[0] = 80
    assert np.allclose(z @ jpeg.INVERSE, 10)


def test_zigzag_starts_and_ends():
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[-2:].tolist() == [62, 63]
