"""Progressive JPEG in numpy: byte payloads in, coefficient arrays and RGB tensors out.

The decoder takes progressive files of 8-bit samples with spectral selection and successive approximation, any Huffman
tables, sampling factors and restart intervals. Many files of one shape of scans are decoded together: every restart
interval is a stream of its own, and all streams advance in lockstep, a symbol at a time, on arrays. The encoder writes
such files with a restart interval of one unit, 4:2:0 sampling and a quantiser of ones, which loses nothing: a payload
byte is one quantised coefficient.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the format: the zigzag walk over an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Huffman tables of the encoder, by rule: (symbols of short codes, their length), all others at the longer length.
_DC_LENGTHS = {s: 4 for s in range(12)}
_AC_LENGTHS = {s: 4 if s < 9 else 10 for s in range(256)}
#: (components, first, last coefficient, high bit, low bit) of each scan that the encoder writes.
SCRIPT = ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 5, 0, 1), ((2,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 6, 63, 0, 1), ((2,), 6, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """BITS and HUFFVAL of a table, and code and length by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits, codes, size = bytearray(16), np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = last = 0
    for s in order:
        n = lengths[s]
        code <<= n - last
        codes[s], size[s], last = code, n, n
        code += 1
        bits[n - 1] += 1
    return bytes(bits), bytes(order), codes, size


_DC, _AC = _canonical(_DC_LENGTHS), _canonical(_AC_LENGTHS)


_SIZE = np.array([i.bit_length() for i in range(1 << 12)])


def _magnitude(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    a = np.abs(v)
    return _SIZE[a]


_U = np.arange(65, dtype=np.uint64)


def _full_codes(low: int) -> np.ndarray:
    """By coefficient + 256: code of no zeros and the value's size, with the value's bits, << 5 | its length."""
    c = np.arange(-256, 257)
    v = np.where(c < 0, -(-c >> low), c >> low)
    s = _magnitude(v)
    return ((_AC[2][s] << s) | np.where(v < 0, v + (1 << s) - 1, v)) << 5 | (_AC[3][s] + s)


_FULL = [_full_codes(x) for x in range(3)]


def _or_bits(out: np.ndarray, at: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
    """Set codes of up to 57 bits at ascending positions in a buffer of 64-bit words."""
    if not len(at):
        return
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    top = value.astype(np.uint64) << (64 - size).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[first]] |= np.bitwise_or.reduceat(top >> shift, first)
    over = np.flatnonzero((at & 63) + size > 64)
    out[word[over] + 1] |= top[over] << (_U[64] - shift[over])


def _pack(interval: np.ndarray, value: np.ndarray, size: np.ndarray, counts: np.ndarray, rows: np.ndarray | None = None, row_value: np.ndarray | None = None, row_size: np.ndarray | None = None) -> list[bytes]:
    """Entropy-coded data of files with counts[i] restart intervals: bits, ones to the byte, stuffing, markers.

    Codes come one by one, by interval in order, or as rows: intervals that are given whole, all with as many codes.
    """
    n = int(counts.sum())
    bits = np.bincount(interval, size, n).astype(np.int64)
    if rows is not None and len(rows):
        inner_at = np.cumsum(row_size, 1)
        bits[rows] = inner_at[:, -1]
        inner_at -= row_size
    width = -(-bits // 8)
    begin = np.concatenate(([0], np.cumsum(width)))
    words = np.zeros((begin[-1] >> 3) + 2, np.uint64)
    if len(interval):
        before = np.cumsum(size) - size
        new = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
        base = np.zeros(n, np.int64)
        base[interval[new]] = before[new]
        _or_bits(words, begin[interval] * 8 + before - base[interval], value, size)
    if rows is not None and len(rows):
        _or_bits(words, (begin[rows][:, None] * 8 + inner_at).ravel(), row_value.ravel(), row_size.ravel())
    tail = width * 8 - bits
    some = np.flatnonzero(tail)
    _or_bits(words, begin[some] * 8 + bits[some], (1 << tail[some]) - 1, tail[some])
    out = words.astype(">u8").view(np.uint8)[: begin[-1]]
    # 0 after each 255, a restart marker after each interval but a file's last
    last = np.cumsum(counts) - 1
    within = np.arange(n) - np.repeat(last + 1 - counts, counts)
    inner = np.ones(n, bool)
    inner[last] = False
    ends = begin[1:][inner] - 1
    wide = (out == 255).astype(np.int64) + 1
    wide[ends] += 2
    stop = np.cumsum(wide)
    full = np.zeros(int(stop[-1]), np.uint8)
    full[stop - wide] = out
    full[stop[ends] - 2], full[stop[ends] - 1] = 255, 0xD0 + within[inner] % 8
    edge = [0, *stop[begin[1:][last] - 1].tolist()]
    raw = full.tobytes()
    return [raw[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _dc_scan(blocks: np.ndarray, comp: np.ndarray, counts: np.ndarray, low: int) -> list[bytes]:
    """First scan of the DC coefficients (units x blocks of a unit); prediction starts anew in each unit."""
    v = blocks.astype(np.int64) >> low
    diff = v.copy()
    for c in np.unique(comp):
        own = np.flatnonzero(comp == c)
        diff[:, own[1:]] = v[:, own[1:]] - v[:, own[:-1]]
    diff = diff.ravel()
    s = _magnitude(diff)
    extra = np.where(diff < 0, diff + (1 << s) - 1, diff)
    return _pack(np.repeat(np.arange(len(blocks)), blocks.shape[1]), (_DC[2][s] << s) | extra, _DC[3][s] + s, counts)


def _ac_scan(coefs: np.ndarray, counts: np.ndarray, low: int) -> list[bytes]:
    """First scan of a band (blocks x coefficients of the band), a block an interval."""
    width = coefs.shape[1]
    full = (np.abs(coefs) >> low).all(1)
    dense, other = np.flatnonzero(full), np.flatnonzero(~full)
    # bands without zeros: a code for each coefficient by its value, four codes joined to one
    code = _FULL[low][coefs[dense] + 256]
    size, value = code & 31, code >> 5
    pad = -width % 4
    if pad:
        size, value = np.pad(size, ((0, 0), (0, pad))), np.pad(value, ((0, 0), (0, pad)))
    for _ in range(2):
        value = (value[:, ::2] << size[:, 1::2]) | value[:, 1::2]
        size = size[:, ::2] + size[:, 1::2]
    c = coefs[other].astype(np.int64)
    v = np.where(c < 0, -(-c >> low), c >> low)
    b, k = np.nonzero(v)
    x = v[b, k]
    prior = np.concatenate(([-1], k[:-1])) if len(k) else k
    if len(k):
        prior[np.concatenate(([True], b[1:] != b[:-1]))] = -1
    run = k - prior - 1
    s = _magnitude(x)
    sym = ((run & 15) << 4) | s
    codes, sizes = (_AC[2][sym] << s) | np.where(x < 0, x + (1 << s) - 1, x), _AC[3][sym] + s
    last = np.full(len(other), -1)
    last[b] = k
    open_ = np.flatnonzero(last < width - 1)
    long = np.repeat(np.arange(len(k)), run >> 4)
    rank = np.concatenate((k * 4 + 3, np.full(len(open_), 1 << 20), k[long] * 4))
    block = np.concatenate((b, open_, b[long]))
    codes = np.concatenate((codes, np.full(len(open_), _AC[2][0]), np.full(len(long), _AC[2][0xF0])))
    sizes = np.concatenate((sizes, np.full(len(open_), _AC[3][0]), np.full(len(long), _AC[3][0xF0])))
    o = np.lexsort((rank, block))
    return _pack(other[block[o]], codes[o], sizes[o], counts, dense, value, size)


def _refine_scan(coefs: np.ndarray, counts: np.ndarray, low: int) -> list[bytes]:
    """Refinement scan of a band: new coefficients with the zeros before them, and a bit of each that was there."""
    width = coefs.shape[1]
    full = ((np.abs(coefs) >> low) > 1).all(1)
    dense, other = np.flatnonzero(full), np.flatnonzero(~full)
    # bands with nothing new: the code of their end, then a bit of each coefficient, in stretches of up to 57 bits
    bit = (np.abs(coefs[dense]) >> low) & 1
    cuts = [*range(0, width, 50), width]
    join = [(bit[:, i:j].astype(np.int64) << np.arange(j - i - 1, -1, -1)).sum(1) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    row_value = np.stack([np.full(len(dense), _AC[2][0]), *join], 1)
    row_size = np.tile([_AC[3][0], *np.diff(cuts)], (len(dense), 1))
    coefs = coefs[other].astype(np.int64)
    n = len(coefs)
    a = np.abs(coefs) >> low
    old, new = a > 1, a == 1
    zeros = np.cumsum(~old & ~new, 1)
    last_new = np.where(new.any(1), width - 1 - np.argmax(new[:, ::-1], 1), -1)
    toks: list[tuple] = []
    b, k = np.nonzero(new)
    prior = np.concatenate(([False], b[1:] == b[:-1])) if len(b) else np.zeros(0, bool)
    z = zeros[b, k]
    run = z - np.where(prior, np.concatenate(([0], z[:-1])), 0) if len(b) else z
    odd = np.unique(b[run > 15])  # runs that need a symbol of their own are written one by one
    fine = ~np.isin(b, odd)
    b, k, run = b[fine], k[fine], run[fine]
    sym = (run << 4) | 1
    toks.append((b, k * 256, (_AC[2][sym] << 1) | (coefs[b, k] > 0), _AC[3][sym] + 1))
    plain = np.setdiff1d(np.arange(n), odd)
    open_ = plain[last_new[plain] < width - 1]
    toks.append((open_, np.full(len(open_), width * 256), np.full(len(open_), _AC[2][0]), np.full(len(open_), _AC[3][0])))
    # a correction bit follows the symbol that ends the stretch it stands in
    nxt = np.where(new, np.arange(width), width)
    nxt = np.minimum.accumulate(nxt[:, ::-1], 1)[:, ::-1]
    ob, ok = np.nonzero(old)
    fine = ~np.isin(ob, odd)
    ob, ok = ob[fine], ok[fine]
    toks.append((ob, nxt[ob, ok] * 256 + 1 + ok, a[ob, ok] & 1, np.ones(len(ob), np.int64)))
    for i in odd.tolist():
        rows, held, r = [], [], 0
        for j in range(width):
            if not old[i, j] and not new[i, j]:
                r += 1
                continue
            while r > 15 and j <= last_new[i]:
                rows += [(int(_AC[2][0xF0]), int(_AC[3][0xF0])), *held]
                held, r = [], r - 16
            if old[i, j]:
                held.append((int(a[i, j] & 1), 1))
            else:
                rows += [(int(_AC[2][(r << 4) | 1]) << 1 | int(coefs[i, j] > 0), int(_AC[3][(r << 4) | 1]) + 1), *held]
                held, r = [], 0
        if r or held:
            rows += [(int(_AC[2][0]), int(_AC[3][0])), *held]
        toks.append((np.full(len(rows), i), np.arange(len(rows)), np.array([x for x, _ in rows]), np.array([x for _, x in rows])))
    block, rank, code, size = (np.concatenate(x).astype(np.int64) for x in zip(*toks, strict=True))
    o = np.lexsort((rank, block))
    return _pack(other[block[o]], code[o], size[o], counts, dense, row_value, row_size)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose quantised coefficients are the payload's bytes less 128, 64 to a block in zigzag order.

    Blocks fill units of four luminance and two chroma blocks; the image is nearly square, unused blocks are zero, and
    a comment holds the payload's length, which must be a multiple of 64.
    """
    return encode_all([payload])[0]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)), _segment(0xC4, bytes([0x00]) + _DC[0] + _DC[1]) + _segment(0xC4, bytes([0x10]) + _AC[0] + _AC[1]) + _segment(0xDD, struct.pack(">H", 1))
_HEADS = [_segment(0xDA, bytes([len(c)]) + b"".join(bytes([x + 1, 0]) for x in c) + bytes([first, last, up << 4 | low])) for c, first, last, up, low in SCRIPT]


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """encode() of each payload; the scans of all are written together."""
    units = np.array([-(-len(p) // 384) for p in payloads])
    wide = np.ceil(np.sqrt(units)).astype(np.int64)
    high = -(-units // np.maximum(wide, 1))
    if len(payloads) and max(wide.max(), high.max()) > 4095:
        raise ValueError("a payload is too large for one image")
    total = wide * high
    cells = np.full((int(total.sum()), 384), 128, np.uint8)
    edge = np.concatenate(([0], np.cumsum(total)))
    for p, lo in zip(payloads, edge, strict=False):
        cells.reshape(-1)[lo * 384 : lo * 384 + len(p)] = np.frombuffer(p, np.uint8)
    cells = cells.reshape(-1, 6, 64).astype(np.int16) - 128
    y = np.concatenate([cells[lo : lo + h * w, :4].reshape(h, w, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64) for lo, h, w in zip(edge, high, wide, strict=False)])
    planes, counts = (y, cells[:, 4], cells[:, 5]), (total * 4, total, total)
    scans = []
    for comps, first, last, up, low in SCRIPT:
        if first:
            scans.append((_refine_scan if up else _ac_scan)(planes[comps[0]][:, first : last + 1], counts[comps[0]], low))
        elif up:
            bits = ((cells[:, :, 0] >> low) & 1).astype(np.int64)
            scans.append(_pack(np.repeat(np.arange(len(cells)), 6), bits.ravel(), np.ones(bits.size, np.int64), total))
        else:
            scans.append(_dc_scan(cells[:, :, 0], np.array([0, 0, 0, 0, 1, 2]), total, low))
    out = []
    for i, p in enumerate(payloads):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, int(high[i]) * 16, int(wide[i]) * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        body = b"".join(h + s[i] for h, s in zip(_HEADS, scans, strict=True))
        out.append(b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + _TABLES[0] + frame + _TABLES[1] + body + b"\xff\xd9")
    return out


@dataclass
class Scan:
    comps: tuple[int, ...]
    first: int
    last: int
    up: int
    low: int
    tables: tuple  # Huffman lookups by component: (dc, ac)
    restart: int
    data: bytes


@dataclass
class Image:
    height: int = 0
    width: int = 0
    factors: list[tuple[int, int]] = field(default_factory=list)
    quant: list[np.ndarray] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    def units(self) -> tuple[int, int]:
        h, v = max(f[0] for f in self.factors), max(f[1] for f in self.factors)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code there << 8 | its symbol; 0 where there is none."""
    if table not in _lookups:
        out = np.zeros(1 << 16, np.int64)
        code, at = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                lo = code << (16 - n)
                out[lo : lo + (1 << (16 - n))] = n << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _lookups[table] = out
    return _lookups[table]


_MARKER = re.compile(b"\xff[^\x00\xd0-\xd7]")


def parse(data: bytes) -> Image:
    """Frame, tables and scans of a progressive file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    img, quants, huff, ids, restart, at = Image(), {}, {}, {}, 0, 2
    which: list[int] = []
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            img.comment = body
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                raw = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1)
                quants[body[i] & 15] = raw.astype(np.int64)
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                huff[body[i]] = body[i + 1 : i + 17 + n]
                i += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            bits, img.height, img.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples")
            for c in range(n):
                ids[body[6 + 3 * c]] = c
                img.factors.append((body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15))
                which.append(body[8 + 3 * c])
        elif marker == 0xDA:
            k = body[0]
            comps = tuple(ids[body[1 + 2 * i]] for i in range(k))
            tables = tuple((huff.get(body[2 + 2 * i] >> 4), huff.get(16 | body[2 + 2 * i] & 15)) for i in range(k))
            end = _MARKER.search(data, at).start()
            img.scans.append(Scan(comps, body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k] >> 4, body[3 + 2 * k] & 15, tables, restart, data[at:end]))
            at = end
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive Huffman-coded frame")
    img.quant = [quants[q] for q in which]
    return img


class _Bits:
    """Streams of bits cut from entropy-coded data at restart markers, stuffing removed."""

    def __init__(self, parts: list[bytes]):
        raw = np.frombuffer(b"".join(p + b"\xff\xd0" for p in parts), np.uint8)
        after = np.concatenate((raw[1:], [0]))
        mark = (raw == 255) & (after >= 0xD0) & (after <= 0xD7)
        drop = mark | np.concatenate(([False], mark[:-1])) | (np.concatenate(([False], (raw == 255)[:-1])) & (raw == 0))
        keep = np.cumsum(~drop)
        self.end = keep[np.flatnonzero(mark)]
        data = np.concatenate((raw[~drop], np.full(8, 255, np.uint8)))
        self.at = np.concatenate(([0], self.end[:-1])).astype(np.int64) * 8
        self.count = np.diff(np.searchsorted(np.flatnonzero(mark), np.cumsum([0, *(len(p) + 2 for p in parts)])))
        self.words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(">u8").ravel().astype(np.uint64)
        self.bits = np.unpackbits(data)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 57 bits and more from each position on, at the high end."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)


_HALF = np.array([0, *(1 << n >> 1 for n in range(1, 17))])
_LESS = np.array([0, *(1 - (1 << n) for n in range(1, 17))])


def _next(bits: _Bits, table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols at the positions, their run and size halves, and the bits after them."""
    x = bits.window(at)
    e = table[(x >> _U[48]).astype(np.int64)]
    return e >> 8, (e >> 4) & 15, e & 15, x << (e >> 8).astype(np.uint64)


def _extra(rest: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ((rest >> _U[1]) >> _U[63 - n]).astype(np.int64)


def _signed(raw: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(raw < _HALF[s], raw + _LESS[s], raw)


def _decode_ac_first(bits: _Bits, table: np.ndarray, lo: np.ndarray, hi: np.ndarray, out: np.ndarray, s: Scan) -> None:
    flat = out.reshape(-1)
    some = lo < hi
    at, blk, end = bits.at[some], lo[some], hi[some]
    k = np.full(len(at), s.first)
    while len(at):
        size, r, n, rest = _next(bits, table, at)
        stop = (n == 0) & (r < 15)
        any_stop = stop.any()
        more = np.where(stop, r, n) if any_stop else n
        raw = _extra(rest, more)
        at = at + size + more
        k = k + r  # a run of sixteen zeros has run 15 and no value
        value = n > 0
        if value.all():
            flat[blk * 64 + k] = _signed(raw, n) << s.low
        else:
            flat[blk[value] * 64 + k[value]] = _signed(raw[value], n[value]) << s.low
        k += 1
        done = k > s.last
        if any_stop:
            done |= stop
            blk = blk + np.where(stop, (1 << r) - 1 + raw, 0)  # blocks of a run of ends have nothing here
        if done.any():
            blk = blk + done
            k[done] = s.first
            go = blk < end
            if not go.all():
                at, blk, end, k = at[go], blk[go], end[go], k[go]


def _decode_ac_refine(bits: _Bits, table: np.ndarray, lo: np.ndarray, hi: np.ndarray, out: np.ndarray, s: Scan) -> None:
    at, blk, end = bits.at.copy(), lo.copy(), hi
    k, eob = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    width, span = s.last - s.first + 1, np.arange(s.last - s.first + 1)
    live = np.flatnonzero(blk < end)
    while len(live):
        p = at[live]
        skip = eob[live] > 0
        size, r, n, rest = _next(bits, table, p)
        ends = ~skip & (n == 0) & (r < 15)
        more = np.where(skip, 0, np.where(ends, r, n))
        raw = _extra(rest, more)
        p = p + np.where(skip, 0, size + more)
        eob[live] = np.where(skip, eob[live], np.where(ends, (1 << r) + raw, 0))
        tail = skip | ends
        rows = out[blk[live], s.first : s.last + 1]
        fix = rows != 0
        stop = np.full(len(live), width)
        if k[live].any():
            fix &= span >= k[live][:, None]
        odd = np.flatnonzero(~tail)
        if len(odd):  # a symbol reaches up to the zero after its run, the end of a block up to its last coefficient
            zeros = np.cumsum((rows[odd] == 0) & (span >= k[live[odd]][:, None]), 1)
            reach = np.argmax(zeros == (r[odd] + 1)[:, None], 1)
            stop[odd] = np.where(zeros[:, -1] <= r[odd], width, reach)
            fix[odd] &= span < stop[odd][:, None]
        counts = fix.sum(1)
        where = np.flatnonzero(fix)
        ahead = np.cumsum(counts) - counts
        hit = bits.bits[np.arange(len(where)) + np.repeat(p - ahead, counts)] == 1
        flat = rows.reshape(-1)
        v = flat[where]
        flat[where] = v + np.where(hit, np.sign(v) << s.low, 0).astype(v.dtype)
        put = odd[(n[odd] > 0) & (stop[odd] < width)]
        rows[put, stop[put]] = np.where(raw[put] == 1, 1, -1) << s.low
        out[blk[live], s.first : s.last + 1] = rows
        at[live] = p + counts
        done = tail | (stop + 1 >= width)
        eob[live] -= tail
        k[live] = np.where(done, 0, stop + 1)
        blk[live] += done
        live = live[blk[live] < end[live]]


@lru_cache(4096)
def _unit_blocks(high: int, wide: int, factors: tuple) -> list[np.ndarray]:
    """For each component of an interleaved scan, its blocks (units x blocks of a unit) in the padded raster."""
    out = []
    for h, v in factors:
        r, q = np.divmod(np.arange(high * wide), wide)
        out.append(((r[:, None, None] * v + np.arange(v)[:, None]) * (wide * h) + q[:, None, None] * h + np.arange(h)).reshape(len(r), -1))
    return out


@lru_cache(4096)
def _own_blocks(height: int, width: int, factors: tuple, c: int) -> np.ndarray:
    """Blocks of a component alone in a scan: those that hold samples, in raster order of the padded plane."""
    h, v = factors[c]
    top, side = max(f[1] for f in factors), max(f[0] for f in factors)
    wide = -(-width // (8 * side))
    rows, cols = -(-(-(-height * v // top)) // 8), -(-(-(-width * h // side)) // 8)
    return (np.arange(rows)[:, None] * (wide * h) + np.arange(cols)).ravel()


def coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """Quantised coefficients of each image and component (blocks in raster order x 64 in zigzag order).

    Scans accumulate in order. Those of images with the same tables and parameters are decoded together, and so are
    neighbouring scans of the same band of different components.
    """
    planes = []
    for img in images:
        high, wide = img.units()
        planes.append([np.zeros((high * v * wide * h, 64), np.int16) for h, v in img.factors])
    rounds: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
    for i, img in enumerate(images):
        turn, before = -1, None
        comps: set[int] = set()
        for number, s in enumerate(img.scans):
            key = (s.first, s.last, s.up, s.low, s.tables[0] if s.first else (s.comps, s.tables))
            if key != before or not s.first or comps & set(s.comps):
                turn, before, comps = turn + 1, key, set()
            comps |= set(s.comps)
            rounds.setdefault(turn, {}).setdefault(key, []).append((i, number))
    for turn in sorted(rounds):
        for who in rounds[turn].values():
            scans = [images[i].scans[number] for i, number in who]
            s, bits = scans[0], _Bits([x.data for x in scans])
            if s.first == 0:
                _decode_dc([images[i] for i, _ in who], [planes[i] for i, _ in who], bits, scans)
                continue
            maps = [_own_blocks(images[i].height, images[i].width, tuple(images[i].factors), x.comps[0]) for (i, _), x in zip(who, scans, strict=True)]
            size = np.array([len(m) for m in maps])
            edge = np.concatenate(([0], np.cumsum(size)))
            step = np.array([x.restart or n for x, n in zip(scans, size, strict=True)])
            owner = np.repeat(np.arange(len(who)), bits.count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(bits.count) - bits.count, bits.count)
            lo = edge[owner] + np.minimum(nth * step[owner], size[owner])
            hi = edge[owner] + np.minimum((nth + 1) * step[owner], size[owner])
            own = [planes[i][x.comps[0]] for (i, _), x in zip(who, scans, strict=True)]
            whole = [len(m) == len(p) for m, p in zip(maps, own, strict=True)]
            work = np.concatenate([p if w else p[m] for p, m, w in zip(own, maps, whole, strict=True)])
            (_decode_ac_refine if s.up else _decode_ac_first)(bits, _lookup(s.tables[0][1]), lo, hi, work, s)
            for (i, _), x, m, w, a, b in zip(who, scans, maps, whole, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if w:
                    planes[i][x.comps[0]] = work[a:b]
                else:
                    planes[i][x.comps[0]][m] = work[a:b]
    return planes


def _decode_dc(images: list[Image], planes: list[list[np.ndarray]], bits: _Bits, scans: list[Scan]) -> None:
    """A DC scan, first or refining, of images with the same sampling order."""
    s = scans[0]
    groups: dict[tuple, list[int]] = {}
    for j, img in enumerate(images):
        groups.setdefault(tuple(img.factors) if len(s.comps) > 1 else (), []).append(j)
    offset = np.concatenate(([0], np.cumsum(bits.count)))
    for own in groups.values():
        layout = [_unit_blocks(*images[j].units(), tuple(images[j].factors[c] for c in s.comps)) if len(s.comps) > 1 else [_own_blocks(images[j].height, images[j].width, tuple(images[j].factors), s.comps[0])[:, None]] for j in own]
        comp = np.concatenate([np.full(m.shape[1], c) for c, m in zip(range(len(s.comps)), layout[0], strict=True)])
        cells = [np.concatenate(m, 1) for m in layout]
        edge = np.concatenate(([0], np.cumsum([len(c) for c in cells])))
        lo, hi, at = [], [], []
        for n, j in enumerate(own):
            step = scans[j].restart or len(cells[n])
            starts = np.minimum(np.arange(bits.count[j]) * step, len(cells[n]))
            lo.append(edge[n] + starts)
            hi.append(edge[n] + np.minimum(starts + step, len(cells[n])))
            at.append(bits.at[offset[j] : offset[j + 1]])
        lo, hi, at = np.concatenate(lo), np.concatenate(hi), np.concatenate(at).copy()
        got = np.zeros((edge[-1], len(comp)), np.int64)
        pred = np.zeros((len(lo), len(s.comps)), np.int64)
        unit, live = lo.copy(), np.flatnonzero(lo < hi)
        while len(live):
            for b, c in enumerate(comp):
                p = at[live]
                if s.up:
                    got[unit[live], b] = bits.bits[p].astype(np.int64) << s.low
                    at[live] = p + 1
                    continue
                size, high, n, rest = _next(bits, _lookup(s.tables[c][0]), p)
                n = high << 4 | n
                raw = _extra(rest, n)
                at[live] = p + size + n
                pred[live, c] += np.where(n > 0, _signed(raw, n), 0)
                got[unit[live], b] = pred[live, c] << s.low
            unit[live] += 1
            live = live[unit[live] < hi[live]]
        for n, j in enumerate(own):
            part = got[edge[n] : edge[n + 1]]
            for c in range(len(s.comps)):
                plane, where, v = planes[j][s.comps[c]], cells[n][:, comp == c], part[:, comp == c]
                plane[where, 0] = (plane[where, 0] | v) if s.up else v


# The inverse transform on whole numbers, so that equal coefficients give equal samples whatever stands beside them.
_SCALE = 11
_BASIS = np.round((1 << _SCALE) * np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for k in range(8)] for x in range(8)]))


def samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples 0-255 of blocks (n x 64, zigzag) as n x 8 x 8."""
    flat = np.zeros((len(blocks), 64))
    flat[:, ZIGZAG] = blocks * quant
    once = (flat.reshape(-1, 8) @ _BASIS.T).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)
    both = (once @ _BASIS.T).reshape(-1, 8, 8).transpose(0, 2, 1)  # whole numbers below 2 ** 53: exact
    return np.clip(np.floor(both / (1 << 2 * _SCALE) + 0.5) + 128, 0, 255).astype(np.uint8)


def rgb_all(images: list[Image], planes: list[list[np.ndarray]]) -> list[np.ndarray]:
    """rgb() of each image; the inverse transforms of all planes with one quantiser are taken together."""
    blocks: dict[bytes, list[tuple[int, int]]] = {}
    for i, img in enumerate(images):
        for c, q in enumerate(img.quant):
            blocks.setdefault(q.tobytes(), []).append((i, c))
    got: list[list] = [[None] * len(p) for p in planes]
    for who in blocks.values():
        cut = np.cumsum([len(planes[i][c]) for i, c in who])[:-1]
        for (i, c), x in zip(who, np.split(samples(np.concatenate([planes[i][c] for i, c in who]), images[who[0][0]].quant[who[0][1]]), cut), strict=True):
            got[i][c] = x
    return [rgb(img, p, g) for img, p, g in zip(images, planes, got, strict=True)]


def rgb(img: Image, planes: list[np.ndarray], done: list[np.ndarray] | None = None) -> np.ndarray:
    """Height x width x 3: inverse transform, chroma repeated to full resolution, colours in whole numbers."""
    done = done or [samples(p, q) for p, q in zip(planes, img.quant, strict=True)]
    high, wide = img.units()
    top, side = max(f[1] for f in img.factors), max(f[0] for f in img.factors)
    full = []
    for (h, v), p in zip(img.factors, done, strict=True):
        s = p.reshape(high * v, wide * h, 8, 8).transpose(0, 2, 1, 3).reshape(high * v * 8, wide * h * 8)
        full.append(s.repeat(top // v, 0).repeat(side // h, 1)[: img.height, : img.width].astype(np.int32))
    if len(full) == 1:
        return np.stack(full * 3, -1).astype(np.uint8)
    y, b, r = full[0] << 16, full[1] - 128, full[2] - 128
    half = 1 << 15
    # Fixed values of the colour transform, times 65536.
    out = np.empty((*y.shape, 3), np.uint8)
    for i, m in enumerate((y + 91881 * r + half, y - 22554 * b - 46802 * r + half, y + 116130 * b + half)):
        out[:, :, i] = np.clip(m >> 16, 0, 255)
    return out


def payload(img: Image, planes: list[np.ndarray]) -> bytes:
    """What encode() was given, from the coefficients read back."""
    high, wide = img.units()
    y = planes[0].reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    cells = np.concatenate((y, planes[1][:, None], planes[2][:, None]), 1).reshape(-1)
    return (cells[: int(img.comment.split()[-1])] + 128).astype(np.uint8).tobytes()
