"""Progressive JPEG in numpy.

`decode` accumulates the spectral-selection and successive-approximation scans
of a progressive file into coefficient arrays, transforms them back with one
matrix product a component, repeats chroma to full resolution and returns an
RGB tensor. Any Huffman tables, sampling factors, scan scripts and restart
intervals are read. Where a scan's codes have one length (a table of a single
symbol) its bits are read as a matrix; end-of-band runs of refinement scans
are corrected at once; all else goes token by token.

`encode` writes coefficient arrays as such a file with a fixed script: DC of
all components, two AC bands, and one refinement of each.
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass, field

import numpy as np

# Zigzag order, as natural index of each position.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else -(i // 8))))
_MARKER = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _inverse_matrix() -> np.ndarray:
    """Zigzag coefficients (64) to samples (64), row-vector form."""
    k = np.arange(8)
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


INVERSE = _inverse_matrix()


@dataclass
class Huffman:
    """16-bit lookup: symbol and code length; `only` is the symbol of a table that has one."""

    symbols: list[int]
    lengths: list[int]
    only: int | None
    only_bits: int


def huffman(counts: bytes, values: bytes) -> Huffman:
    sym, length, code, at = np.zeros(65536, np.int32), np.zeros(65536, np.int32), 0, 0
    for bits, n in enumerate(counts, 1):
        for v in values[at : at + n]:
            a, b = code << (16 - bits), (code + 1) << (16 - bits)
            sym[a:b], length[a:b] = v, bits
            code += 1
        at += n
        code <<= 1
    bits = next((i for i, n in enumerate(counts, 1) if n), 0)
    return Huffman(sym.tolist(), length.tolist(), values[0] if len(values) == 1 else None, bits)


_tables: dict[bytes, Huffman] = {}


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    rows: int = 0
    cols: int = 0
    coefficients: np.ndarray | None = None  # rows, cols, 64 in zigzag order


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class _Bits:
    """Bits of one entropy-coded segment."""

    def __init__(self, raw: bytes) -> None:
        self.data = raw.replace(b"\xff\x00", b"\xff")
        self.size = len(self.data) * 8
        self.padded = self.data + b"\xff\xff\xff\xff"
        self.at = 0

    def window(self) -> int:
        i, d = self.at >> 3, self.padded
        if i + 3 > len(d):
            raise ValueError("entropy-coded data ends early")
        return (((d[i] << 16) | (d[i + 1] << 8) | d[i + 2]) >> (8 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: Huffman) -> int:
        w = self.window()
        n = table.lengths[w]
        if not n:
            raise ValueError("no such Huffman code")
        self.at += n
        return table.symbols[w]

    def take(self, n: int) -> int:
        if not n:
            return 0
        w = self.window() >> (16 - n)
        self.at += n
        return w

    def array(self, n: int) -> np.ndarray:
        """The next n bits as 0 and 1."""
        a = self.at
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, (a + n + 7) // 8 - a // 8, a // 8))[a % 8 : a % 8 + n]
        if len(bits) < n:
            raise ValueError("entropy-coded data ends early")
        self.at += n
        return bits


def _extend(v: int, s: int) -> int:
    return v if not s or v >= 1 << (s - 1) else v - (1 << s) + 1


@functools.lru_cache(256)
def _block_order(width: int, height: int, most: tuple[int, int], scan: tuple[tuple[int, int, int], ...]) -> tuple[np.ndarray, np.ndarray, int]:
    hmax, vmax = most
    if len(scan) == 1:
        h, v, wide = scan[0]
        rows = -(-(-(-height * v // vmax)) // 8)
        cols = -(-(-(-width * h // hmax)) // 8)
        at = (np.arange(rows)[:, None] * wide + np.arange(cols)[None, :]).ravel()
        return np.zeros(len(at), np.int64), at, 1
    mr, mc = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    which, index = [], []
    for k, (h, v, wide) in enumerate(scan):
        r = np.arange(mr)[:, None, None, None] * v + np.arange(v)[None, None, :, None]
        q = np.arange(mc)[None, :, None, None] * h + np.arange(h)[None, None, None, :]
        index.append((r * wide + q).reshape(mr * mc, -1))
        which.append(np.full_like(index[-1], k))
    every = np.concatenate(index, 1)
    return np.concatenate(which, 1).ravel(), every.ravel(), every.shape[1]


def _scan_blocks(frame: Frame, scan: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
    """Scan component and flat block index in coding order, and blocks a restart unit (MCU)."""
    most = max(c.h for c in frame.components), max(c.v for c in frame.components)
    order = _block_order if frame.width * frame.height < 1 << 20 else _block_order.__wrapped__  # large orders aren't kept
    return order(frame.width, frame.height, most, tuple((c.h, c.v, c.cols) for c in scan))


def _dc_first(bits: _Bits, which: list[int], tables: list[Huffman], al: int) -> list[int]:
    before = [0] * len(tables)
    out = []
    for k in which:
        s = bits.symbol(tables[k])
        if s:
            before[k] += _extend(bits.take(s), s)
        out.append(before[k] << al)
    return out


def _ac_first(bits: _Bits, blocks: np.ndarray, table: Huffman, ss: int, se: int, al: int) -> None:
    """blocks: n, 64, changed in place."""
    n, band = len(blocks), se - ss + 1
    only = table.only
    if only is not None and only >> 4 == 0 and 0 < only <= 8:  # every token: no run, one size
        width = table.only_bits + only
        raw = bits.array(n * band * width).reshape(-1, width)[:, table.only_bits :]
        v = np.packbits(raw, axis=1).ravel().astype(np.int32) >> (8 - only)
        v = np.where(v >= 1 << (only - 1), v, v - (1 << only) + 1)
        blocks[:, ss : se + 1] = v.reshape(n, band) << al
        return
    run = 0
    for i in range(n):
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                blocks[i, k] = _extend(bits.take(s), s) * (1 << al)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _correct(bits: _Bits, part: np.ndarray, al: int) -> None:
    """One more bit for every nonzero coefficient of part."""
    at = np.nonzero(part)
    old = part[at]
    part[at] = old + np.where(bits.array(len(old)) == 1, np.where(old > 0, 1 << al, -(1 << al)), 0)


def _ac_refine(bits: _Bits, blocks: np.ndarray, table: Huffman, ss: int, se: int, al: int) -> None:
    i, n = 0, len(blocks)
    while i < n:
        k = ss
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if not s and r < 15:
                run = (1 << r) + bits.take(r)
                part = blocks[i, k : se + 1]
                _correct(bits, part, al)
                if run > 1:
                    rest = blocks[i + 1 : i + run, ss : se + 1].copy()
                    _correct(bits, rest, al)
                    blocks[i + 1 : i + run, ss : se + 1] = rest
                i += run - 1
                break
            new = (1 if bits.take(1) else -1) << al if s else 0
            while k <= se:
                old = blocks[i, k]
                if old:
                    if bits.take(1):
                        blocks[i, k] = old + ((1 << al) if old > 0 else -(1 << al))
                elif r == 0:
                    if s:
                        blocks[i, k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        i += 1


def read_coefficients(data: bytes) -> Frame:
    """All scans of a progressive file, accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, quants, tables, interval, comments = 2, None, {}, {}, 0, []
    while True:
        m = _MARKER.search(data, at)
        if not m or data[m.end() - 1] == 0xD9:
            break
        kind, at = data[m.end() - 1], m.end()
        (size,) = struct.unpack(">H", data[at : at + 2])
        body = data[at + 2 : at + size]
        at += size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                spec = body[1 : 17 + n]
                if spec not in _tables:
                    _tables[spec] = huffman(spec[:16], spec[16:])
                tables[body[0]] = _tables[spec]
                body = body[17 + n :]
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", body[:2])
        elif kind == 0xFE:
            comments.append(body)
        elif kind == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.rows, c.cols = -(-height // (8 * vmax)) * c.v, -(-width // (8 * hmax)) * c.h
                c.coefficients = np.zeros((c.rows, c.cols, 64), np.int32)
            frame = Frame(width, height, parts)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only Huffman-coded progressive JPEG is read")
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            n = body[0]
            chosen = [(next(c for c in frame.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            ah, al = approx >> 4, approx & 15
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            segments = _RESTART.split(data[at:stop]) if interval else [data[at:stop]]
            at = stop
            scan = [c for c, _ in chosen]
            which, index, unit = _scan_blocks(frame, scan)
            step = interval * unit if interval else len(index)
            for g, raw in enumerate(segments):
                bits, part, of = _Bits(raw), index[g * step : (g + 1) * step], which[g * step : (g + 1) * step]
                if ss == 0:
                    if ah:
                        value = bits.array(len(part)).astype(np.int32) << al
                    else:
                        value = np.array(_dc_first(bits, of.tolist(), [tables[t >> 4] for _, t in chosen], al), np.int32)
                    for k, c in enumerate(scan):
                        flat = c.coefficients.reshape(-1, 64)
                        own = part[of == k] if len(scan) > 1 else part
                        if ah:
                            flat[own, 0] |= value[of == k] if len(scan) > 1 else value
                        else:
                            flat[own, 0] = value[of == k] if len(scan) > 1 else value
                else:
                    flat = scan[0].coefficients.reshape(-1, 64)
                    whole = len(part) == len(flat)
                    blocks = flat if whole else flat[part]
                    (_ac_refine if ah else _ac_first)(bits, blocks, tables[0x10 | (chosen[0][1] & 15)], ss, se, al)
                    if not whole:
                        flat[part] = blocks
    if frame is None:
        raise ValueError("no progressive frame")
    frame.quants, frame.comments = quants, comments
    return frame


def planes(frame: Frame) -> list[np.ndarray]:
    """Samples of each component at its own resolution, level-shifted, not clipped."""
    out = []
    for c in frame.components:
        q = c.coefficients.reshape(-1, 64).astype(np.float32) * frame.quants[c.quant]
        s = q @ INVERSE + np.float32(128)
        out.append(s.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8))
    return out


def to_rgb(frame: Frame) -> np.ndarray:
    """height, width, 3 of uint8; chroma repeated to full resolution."""
    hmax, vmax = max(c.h for c in frame.components), max(c.v for c in frame.components)

    def whole(k: int, p: np.ndarray) -> np.ndarray:
        """Plane k's resolution raised to the frame's."""
        c = frame.components[k]
        if c.v != vmax:
            p = p.repeat(vmax // c.v, 0)
        if c.h != hmax:
            p = p.repeat(hmax // c.h, 1)
        return p[: frame.height, : frame.width]

    parts = planes(frame)
    for p in parts:
        np.maximum(p, 0, out=p)
        np.minimum(p, 255, out=p)
    out = np.empty((frame.height, frame.width, 3), np.uint8)
    if len(parts) == 1:
        out[...] = (whole(0, parts[0]) + np.float32(0.5)).astype(np.uint8)[..., None]
        return out
    y = whole(0, parts[0]) + np.float32(0.5)
    cb, cr = parts[1] - np.float32(128), parts[2] - np.float32(128)
    # the weights are applied before chroma is repeated
    shifts = (whole(2, cr * np.float32(1.402)), (whole(1, cb * np.float32(-0.344136)) + whole(2, cr * np.float32(-0.714136))) if (frame.components[1].h, frame.components[1].v) != (frame.components[2].h, frame.components[2].v) else whole(1, cb * np.float32(-0.344136) + cr * np.float32(-0.714136)), whole(1, cb * np.float32(1.772)))
    for k, shift in enumerate(shifts):
        shift = shift + y
        np.maximum(shift, 0, out=shift)
        np.minimum(shift, 255, out=shift)
        out[..., k] = shift
    return out


def decode(data: bytes) -> np.ndarray:
    return to_rgb(read_coefficients(data))


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    """Bits to bytes: padded with ones, zeros stuffed."""
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate([bits, np.ones(pad, bits.dtype)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


#: Code lengths and values of the writer's tables: DC sizes 0 to 11 with four bits; size 8 alone; end-of-band runs with four bits.
_DC_TABLE = bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12))
_AC_TABLE = bytes([1, *[0] * 15]) + bytes([0x08])
_RUN_TABLE = bytes([0, 0, 0, 15, *[0] * 12]) + bytes(r << 4 for r in range(15))
#: Blocks that one end-of-band run covers at most.
_RUN = (1 << 15) - 1


def encode(coefficients: list[np.ndarray], width: int, height: int, sampling: list[tuple[int, int]], comment: bytes = b"") -> bytes:
    """Write coefficients (rows, cols, 64 each, zigzag, whole MCUs) as a progressive file.

    AC values must be 256 to 511 and DC values 0 to 1023, as `media.pack` makes them of bytes.
    """
    n = len(coefficients)
    out = [b"\xff\xd8", _segment(0xDB, b"\x00" + b"\x01" * 64)]
    if comment:
        out.append(_segment(0xFE, comment))
    parts = [Component(i + 1, h, v, 0, a.shape[0], a.shape[1]) for i, ((h, v), a) in enumerate(zip(sampling, coefficients, strict=True))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes((c.ident, c.h << 4 | c.v, 0)) for c in parts)))
    out.append(_segment(0xC4, b"\x00" + _DC_TABLE + b"\x10" + _AC_TABLE + b"\x11" + _RUN_TABLE))
    flat = [a.reshape(-1, 64) for a in coefficients]
    frame = Frame(width, height, parts)
    which, index, _ = _scan_blocks(frame, parts)
    dc = np.empty(len(index), np.int64)
    diff = np.empty(len(index), np.int64)
    for k, f in enumerate(flat):
        own = which == k
        dc[own] = f[index[own], 0]
        diff[own] = np.diff(dc[own] >> 1, prepend=0)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    token = (size << size) | value
    place = np.arange(15)[None, :]
    total = size[:, None] + 4
    bits = (token[:, None] >> np.maximum(total - 1 - place, 0)) & 1
    head = bytes([n]) + b"".join(bytes((c.ident, 0)) for c in parts)
    out.append(_segment(0xDA, head + b"\x00\x00\x01") + _entropy(bits[place < total].astype(np.uint8)))
    out.append(_segment(0xDA, head + b"\x00\x00\x10") + _entropy((dc & 1).astype(np.uint8)))
    for c, f in zip(parts, flat, strict=True):
        for a, b in ((1, 5), (6, 63)):
            v = (f[:, a : b + 1] >> 1).astype(np.uint8).reshape(-1, 1)
            token = np.zeros((len(v), 9), np.uint8)
            token[:, 1:] = np.unpackbits(v, axis=1)
            out.append(_segment(0xDA, bytes((1, c.ident, 0x00, a, b, 0x01))) + _entropy(token.ravel()))
        low = (f[:, 1:] & 1).astype(np.uint8)
        pieces = []
        for at in range(0, len(low), _RUN):  # all blocks are corrected by runs
            m = min(_RUN, len(low) - at)
            r = m.bit_length() - 1
            pieces += [np.array([(r << r | m - (1 << r)) >> (3 + r - i) & 1 for i in range(4 + r)], np.uint8), low[at : at + m].ravel()]
        out.append(_segment(0xDA, bytes((1, c.ident, 0x01, 1, 63, 0x10))) + _entropy(np.concatenate(pieces)))
    out.append(b"\xff\xd9")
    return b"".join(out)
