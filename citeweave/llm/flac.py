"""FLAC codec for batches of mono streams, vectorised over frames with numpy.

Frames of many streams are coded in lockstep: step *i* of the loop handles
sample *i* of every frame at once, so the Python cost per step is shared by
thousands of frames.  The stream layout is the published FLAC format: marker,
STREAMINFO (with the PCM's MD5), SEEKTABLE with one point per frame, then
frames with CRC-8 headers and CRC-16 footers.  Predictors are constant,
verbatim, fixed (orders 0-2 written, 0-4 read) and quantised linear
prediction (order 4 written, 1-32 read); residuals are partitioned Rice codes,
and escaped partitions are read too.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

BLOCK = 512
LPC_ORDER = 4
LPC_PRECISION = 12
PARTITION_ORDER = 2
CHUNK_FRAMES = 4096
#: Fixed polynomial predictors of the format, as linear-prediction coefficients.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that breaks the format, or whose checksums disagree."""


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """Remainders of all ``bits``-wide words shifted through a CRC register."""
    reg = np.arange(1 << bits, dtype=np.uint32) << (width - bits)
    top, mask = np.uint32(1 << (width - 1)), np.uint32((1 << width) - 1)
    for _ in range(bits):
        reg = np.where(reg & top, (reg << 1) ^ np.uint32(poly), reg << 1) & mask
    return reg


_CRC8 = _crc_table(0x07, 8, 8)
_CRC16 = _crc_table(0x8005, 16, 8)
_CRC16_WORD = _crc_table(0x8005, 16, 16)


def _crc8(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), np.uint32)
    for i in range(int(length.max(initial=0))):
        on = length > i
        crc[on] = _CRC8[crc[on] ^ buf[start[on] + i]]
    return crc


def _crc16(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, two bytes a step."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    crc = np.zeros(len(s), np.uint32)
    pairs = n // 2
    left = np.searchsorted(-pairs, -np.arange(int(pairs.max(initial=0))), side="left")
    for i, c in enumerate(left):
        at = s[:c] + 2 * i
        crc[:c] = _CRC16_WORD[crc[:c] ^ (buf[at].astype(np.uint32) << 8 | buf[at + 1])]
    odd = n % 2 == 1
    crc[odd] = (crc[odd] << 8 & 0xFFFF) ^ _CRC16[(crc[odd] >> 8) ^ buf[s[odd] + n[odd] - 1]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# ---------------------------------------------------------------- encoding


def _linear_coefficients(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors (frames x order) and shifts, by Levinson-Durbin over all frames."""
    f = x.astype(np.float64)
    auto = np.stack([(f[:, lag:] * f[:, : f.shape[1] - lag]).sum(1) for lag in range(LPC_ORDER + 1)], 1)
    auto[:, 0] = auto[:, 0] * 1.0001 + 1e-3
    a = np.zeros((len(x), LPC_ORDER))
    err = auto[:, 0].copy()
    for m in range(LPC_ORDER):
        k = (auto[:, m + 1] - (a[:, :m] * auto[:, m:0:-1]).sum(1)) / err
        a[:, :m] = a[:, :m] - k[:, None] * a[:, :m][:, ::-1]
        a[:, m] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.abs(a).max(1)
    shift = np.clip(LPC_PRECISION - 2 - np.ceil(np.log2(np.maximum(top, 1e-9))), 0, 14).astype(np.int64)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (2.0 ** shift)[:, None]), -limit, limit).astype(np.int64), shift


def _put(bits: np.ndarray, pos: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[pos + j] = (value >> (width - 1 - j)) & 1


def _encode_chunk(x: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames for rows of ``x`` (int32, zero beyond ``n``); bytes and frame offsets (one more than frames)."""
    count, width = x.shape
    col = np.arange(width)
    valid = col < n[:, None]
    coef, shift = _linear_coefficients(x, n)
    pred = np.zeros_like(x)
    for j in range(LPC_ORDER):
        pred[:, LPC_ORDER:] += coef[:, j : j + 1].astype(np.int32) * x[:, LPC_ORDER - 1 - j : width - 1 - j]
    pred >>= shift[:, None].astype(np.int32)
    d1 = np.diff(x, axis=1, prepend=0)
    candidates = [(0, x), (1, d1), (2, np.diff(d1, axis=1, prepend=0)), (LPC_ORDER, x - pred)]
    cost = np.stack([np.where(valid & (col >= o), np.abs(r), 0).sum(1) + (20 * o if i < 3 else 40 * o) for i, (o, r) in enumerate(candidates)], 1)
    pick = cost.argmin(1)
    order = np.array([o for o, _ in candidates])[pick]
    resid = np.choose(pick[:, None], [r for _, r in candidates])
    coded = valid & (col >= order[:, None])
    u = np.where(coded, (resid << 1) ^ (resid >> 31), 0).astype(np.int64)

    parts = 1 << PARTITION_ORDER
    plen = n >> PARTITION_ORDER
    part = np.minimum(col // plen[:, None], parts - 1)
    sums = np.zeros((count, parts))
    sizes = np.zeros((count, parts))
    for p in range(parts):
        inside = coded & (part == p)
        sums[:, p], sizes[:, p] = np.where(inside, u, 0).sum(1), inside.sum(1)
    mean = sums / np.maximum(sizes, 1)
    rice = np.clip(np.ceil(np.log2(np.maximum(mean * 0.6931, 0.5))), 0, 14).astype(np.int64)
    k = np.take_along_axis(rice, part, 1)
    q = u >> k
    starts_part = coded & ((col % plen[:, None] == 0) | (col == order[:, None]))
    length = np.where(coded, q + 1 + k, 0) + 4 * starts_part
    fixed_bits = 8 + 8 * order + np.where(pick == 3, 9 + LPC_PRECISION * LPC_ORDER, 0) + 6
    body = fixed_bits + length.sum(1)
    constant = ((x == x[:, :1]) | ~valid).all(1)
    verbatim = ~constant & (body > 8 + 8 * n)
    rice_coded = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))

    digits = np.select([number < 0x80, number < 0x800, number < 0x10000, number < 0x200000, number < 0x4000000], [1, 2, 3, 4, 5], 6)
    odd = n != BLOCK
    head = 4 + digits + 2 * odd + 1
    size = head + (body + 7) // 8 + 2
    offset = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(offset[-1]) * 8, np.uint8)
    at = (offset[:-1] + head) * 8
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(pick == 3, 32 + LPC_ORDER - 1, 8 + order)))
    _put(bits, at, kind << 1, 8)
    _put(bits, at[constant] + 8, x[constant, 0] & 0xFF, 8)
    if verbatim.any():
        r, c = np.nonzero(verbatim[:, None] & valid)
        _put(bits, at[r] + 8 + 8 * c, x[r, c] & 0xFF, 8)
    r, c = np.nonzero(rice_coded[:, None] & valid & (col < order[:, None]))
    _put(bits, at[r] + 8 + 8 * c, x[r, c] & 0xFF, 8)
    lp = np.nonzero(rice_coded & (pick == 3))[0]
    base = at[lp] + 8 + 8 * LPC_ORDER
    _put(bits, base, np.full(len(lp), LPC_PRECISION - 1), 4)
    _put(bits, base + 4, shift[lp], 5)
    for j in range(LPC_ORDER):
        _put(bits, base + 9 + LPC_PRECISION * j, coef[lp, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    rc = np.nonzero(rice_coded)[0]
    _put(bits, at[rc] + fixed_bits[rc] - 4, np.full(len(rc), PARTITION_ORDER), 4)
    begin = at[rc, None] + fixed_bits[rc, None] + np.cumsum(length[rc], 1) - length[rc]
    on, mark = coded[rc], starts_part[rc]
    _put(bits, begin[mark], k[rc][mark], 4)
    pos = (begin + 4 * mark + q[rc])[on]
    kk, uu = k[rc][on], u[rc][on]
    bits[pos] = 1
    for j in range(int(kk.max(initial=0))):
        sel = kk > j
        if sel.all():
            bits[pos + 1 + j] = (uu >> (kk - 1 - j)) & 1
        else:
            bits[pos[sel] + 1 + j] = (uu[sel] >> (kk[sel] - 1 - j)) & 1
    buf = np.packbits(bits)

    start = offset[:-1]
    buf[start], buf[start + 1], buf[start + 2], buf[start + 3] = 0xFF, 0xF8, np.where(odd, 0x70, 0x90), 0x02
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])
    for d in range(1, 7):
        sel = np.nonzero(digits == d)[0]
        for j in range(d):
            part_bits = number[sel] >> (6 * (d - 1 - j))
            buf[start[sel] + 4 + j] = (part_bits | lead[d]) if j == 0 else (part_bits & 0x3F) | 0x80
    so = np.nonzero(odd)[0]
    buf[start[so] + 4 + digits[so]], buf[start[so] + 5 + digits[so]] = (n[so] - 1) >> 8, (n[so] - 1) & 0xFF
    buf[start + head - 1] = _crc8(buf, start, head - 1)
    crc = _crc16(buf, start, size - 2)
    buf[start + size - 2], buf[start + size - 1] = crc >> 8, crc & 0xFF
    return buf, offset


def encode_streams(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """One FLAC stream per payload of unsigned 8-bit samples (each a positive multiple of 64 bytes long)."""
    counts = [-(-len(p) // BLOCK) for p in payloads]
    owner = np.repeat(np.arange(len(payloads)), counts)
    number = np.concatenate([np.arange(c) for c in counts]) if payloads else np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in payloads], np.int64)
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK) if payloads else np.zeros(0, np.int64)
    frames: list[list[bytes]] = [[] for _ in payloads]
    for lo in range(0, len(owner), CHUNK_FRAMES):
        hi = min(lo + CHUNK_FRAMES, len(owner))
        x = np.zeros((hi - lo, BLOCK), np.int32)
        row = 0
        while row < hi - lo:
            doc = owner[lo + row]
            run = int(np.searchsorted(owner[lo:hi], doc, side="right")) - row
            first = int(number[lo + row]) * BLOCK
            piece = np.frombuffer(payloads[doc], np.uint8, min(run * BLOCK, len(payloads[doc]) - first), first)
            full = len(piece) // BLOCK
            x[row : row + full] = piece[: full * BLOCK].reshape(full, BLOCK)
            if len(piece) % BLOCK:
                x[row + full, : len(piece) % BLOCK] = piece[full * BLOCK :]
            row += run
        x -= 128
        x[np.arange(BLOCK) >= length[lo:hi, None]] = 0
        buf, offset = _encode_chunk(x, length[lo:hi], number[lo:hi])
        raw = buf.tobytes()
        for i in range(hi - lo):
            frames[owner[lo + i]].append(raw[offset[i] : offset[i + 1]])
    out = []
    for payload, own in zip(payloads, frames, strict=True):
        pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        points, at = [], 0
        for i, frame in enumerate(own):
            points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(payload) - i * BLOCK)))
            at += len(frame)
        table = b"".join(points)
        info = struct.pack(">HH", BLOCK, BLOCK) + min(map(len, own)).to_bytes(3, "big") + max(map(len, own)).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        # A metadata block holds 24 bits of length; later seek points of enormous streams are left out.
        table = table[: ((1 << 24) - 1) // 18 * 18]
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


# ---------------------------------------------------------------- decoding


@dataclass
class StreamInfo:
    """What a stream's metadata says, and where its frames lie in it."""

    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    starts: list[int]
    first_sample: list[int]
    end: int


def _header_at(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(frame number, block size, header length) if a frame header with a right CRC-8 stands here."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] != 0xF8:
        return None
    code, p = data[at + 2] >> 4, at + 4
    lead = data[p]
    more = 0 if lead < 0x80 else next((i for i in range(1, 6) if (lead >> (6 - i)) & 1 == 0), 6)
    value = lead if not more else lead & ((1 << (6 - more)) - 1)
    for b in data[p + 1 : p + 1 + more]:
        value = value << 6 | (b & 0x3F)
    p += 1 + more
    extra = {6: 1, 7: 2}.get(code, 0)
    if len(data) < p + extra + 1:
        return None
    size = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}.get(code, int.from_bytes(data[p : p + extra], "big") + 1)
    p += extra
    crc = 0
    for b in data[at:p]:
        crc = int(_CRC8[crc ^ b])
    return (value, size, p + 1 - at) if crc == data[p] else None


def read_info(data: bytes) -> StreamInfo:
    """Parse metadata; frame places come from the seek table, or from a scan for checked headers."""
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info, points, last = 4, None, [], False
    while not last:
        if len(data) < at + 4:
            raise FlacError("metadata ends early")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), block[18:34])
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != (1 << 64) - 1]
    if info is None:
        raise FlacError("no STREAMINFO")
    rate, channels, bits, samples, md5 = info
    if channels != 1 or bits not in (8, 16):
        raise FlacError("only mono streams of 8 or 16 bits are read")
    starts, firsts = [at + p[1] for p in points], [p[0] for p in points]
    covered = bool(points) and firsts[0] == 0 and all(a + p[2] == b for a, p, b in zip(firsts, points, firsts[1:], strict=False)) and firsts[-1] + points[-1][2] == samples
    if not covered:
        starts, firsts, here, done, number = [], [], at, 0, 0
        while done < samples:
            found = _header_at(data, here)
            if not found or found[0] != number:
                raise FlacError(f"frame {number} does not start at byte {here}")
            starts.append(here)
            firsts.append(done)
            done, number, probe = done + found[1], number + 1, here + found[2]
            while True:  # the next header is one with the next number, where this frame's CRC-16 comes out
                probe = data.find(b"\xff\xf8", probe) if done < samples else len(data)
                if probe < 0:
                    raise FlacError(f"frame {number} is missing")
                after = None if probe == len(data) else _header_at(data, probe)
                if probe == len(data) or (after and after[0] == number):
                    raw = np.frombuffer(data, np.uint8, probe - here, here)
                    if _crc16(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0] == 0:
                        break
                    if probe == len(data):
                        raise FlacError(f"frame {number - 1}: CRC-16 differs")
                probe += 1
            here = probe
    return StreamInfo(rate, channels, bits, samples, md5, starts, firsts, len(data))


def _decode_chunk(buf: np.ndarray, start: np.ndarray, end: np.ndarray, bps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames x widest block), block sizes and frame numbers; ``buf`` has 16 spare bytes at its end."""
    window = np.ndarray((len(buf) - 8,), ">u8", buf, strides=(1,))

    def take(pos: np.ndarray, width) -> np.ndarray:
        w = window[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        return (w >> np.uint64(1) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def signed(v: np.ndarray, width) -> np.ndarray:
        return v - ((v >> (np.asarray(width) - 1) & 1) << np.asarray(width))

    if _crc16(buf, start, end - start).any():
        raise FlacError("a frame's CRC-16 differs")
    if (buf[start] != 0xFF).any() or (buf[start + 1] != 0xF8).any():
        raise FlacError("a frame lacks its sync code")
    code, lead = (buf[start + 2] >> 4).astype(np.int64), buf[start + 4].astype(np.int64)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
    number = np.where(more == 0, lead, lead & ((1 << (6 - more)) - 1))
    for j in range(1, int(more.max(initial=0)) + 1):
        sel = more >= j
        number[sel] = number[sel] << 6 | (buf[start[sel] + 4 + j] & 0x3F)
    extra = np.select([code == 6, code == 7], [1, 2], 0)
    at = start + 5 + more
    sizes = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0] + [256 << c for c in range(8)])
    n = np.where(code == 6, buf[at].astype(np.int64) + 1, np.where(code == 7, (buf[at].astype(np.int64) << 8 | buf[at + 1]) + 1, sizes[code]))
    head = 5 + more + extra + 1
    if (_crc8(buf, start, head - 1) != buf[start + head - 1]).any():
        raise FlacError("a frame header's CRC-8 differs")

    perm = np.argsort(-n, kind="stable")
    n_, bps_ = n[perm], bps[perm]
    pos = (start + head)[perm] * 8
    kind = take(pos, 8) >> 1 & 63
    if (take(pos, 8) & 1).any():
        raise FlacError("wasted bits are not read")
    pos += 8
    width, count = int(n_[0]), len(n_)
    out = np.zeros((width, count), np.int64)
    const, verb = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (const | verb | fixed | linear).all():
        raise FlacError("reserved subframe type")
    out[:, const] = signed(take(pos[const], bps_[const]), bps_[const])
    if verb.any():
        p2 = pos[verb] + bps_[verb] * np.arange(width)[:, None]
        p2 = np.minimum(p2, (len(buf) - 9) * 8)
        out[:, verb] = signed(take(p2, bps_[verb]), bps_[verb])
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    deepest = int(order.max(initial=0))
    for j in range(deepest):
        sel = order > j
        out[j, sel] = signed(take(pos[sel], bps_[sel]), bps_[sel])
        pos[sel] += bps_[sel]
    coef, shift = np.zeros((max(1, deepest), count), np.int64), np.zeros(count, np.int64)
    for o in range(1, min(4, deepest) + 1):
        for j, c in enumerate(FIXED[o]):
            coef[j, fixed & (order == o)] = c
    if linear.any():
        li = np.nonzero(linear)[0]
        precision = take(pos[li], 4) + 1
        shift[li] = signed(take(pos[li] + 4, 5), 5)
        pos[li] += 9
        for j in range(deepest):
            sel = order[li] > j
            coef[j, li[sel]] = signed(take(pos[li[sel]], precision[sel]), precision[sel])
            pos[li[sel]] += precision[sel]
    coded = fixed | linear
    method, porder = np.zeros(count, np.int64), np.zeros(count, np.int64)
    method[coded], porder[coded] = take(pos[coded], 2), take(pos[coded] + 2, 4)
    pos[coded] += 6
    plen = np.maximum(n_ >> porder, 1)
    field = np.where(method == 0, 4, 5)
    next_part = np.where(coded, order, -1)
    k, raw = np.zeros(count, np.int64), np.full(count, -1, np.int64)
    alive = np.searchsorted(-n_, -np.arange(width), side="left")
    all_coded = bool(coded.all())
    for i in range(width):
        c = int(alive[i])
        if all_coded and i >= deepest:
            idx = slice(0, c)
        else:
            idx = np.nonzero(coded[:c] & (order[:c] <= i))[0]
            if not len(idx):
                continue
        p = pos[idx]
        fresh = next_part[idx] == i
        if fresh.any():
            sub = np.arange(count)[idx][fresh]
            param = take(pos[sub], field[sub])
            pos[sub] += field[sub]
            escaped = param == (1 << field[sub]) - 1
            raw[sub] = np.where(escaped, take(pos[sub], 5), -1)
            pos[sub] += 5 * escaped
            k[sub] = np.where(escaped, 0, param)
            next_part[sub] = (i // plen[sub] + 1) * plen[sub]
            p = pos[idx]
        kk = k[idx]
        w = window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        high = (w >> np.uint64(32)).astype(np.int64)
        q = 31 - ((high.astype(np.float64).view(np.int64) >> 52) - 1023)
        if (high == 0).any():  # a unary run that leaves the window: walk on in steps of 32 bits
            q = q.copy()
            for s in np.nonzero(high == 0)[0]:
                far, here = 0, int(p[s])
                while (v := int(take(np.array([here + far]), 32)[0])) == 0:
                    far += 32
                    if here + far >= (len(buf) - 8) * 8:
                        raise FlacError("a residual runs past the end")
                q[s] = far + 32 - v.bit_length()
            low = take(p + q + 1, kk)
        else:
            low = (w << (q + 1).astype(np.uint64) >> np.uint64(1) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        u = q << kk | low
        r = (u >> 1) ^ -(u & 1)
        step = q + 1 + kk
        esc = raw[idx] >= 0
        if esc.any():
            wide = raw[idx][esc]
            v = take(p[esc], wide)
            r[esc] = np.where(wide > 0, signed(v, np.maximum(wide, 1)), 0)
            step[esc] = wide
        pos[idx] = p + step
        if deepest:
            past = min(deepest, i)
            if past:
                r += (coef[:past, idx] * out[i - past : i, idx][::-1]).sum(0) >> shift[idx]
        out[i, idx] = r
    if (pos[coded] > end[perm][coded] * 8 - 16).any():
        raise FlacError("a residual runs past its frame")
    back = np.empty(count, np.int64)
    back[perm] = np.arange(count)
    return out.T[back], n, number


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """PCM samples of each stream (int64), after CRC-8, CRC-16, length and MD5 checks."""
    return [np.concatenate([b for _, b in blocks]) if blocks else np.zeros(0, np.int64) for blocks in decode_blocks(streams)]


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """Per stream its PCM blocks as (first sample, samples), every checksum verified."""
    infos = [read_info(s) for s in streams]
    jobs = [(d, i) for d, info in enumerate(infos) for i in range(len(info.starts))]
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    for lo in range(0, len(jobs), CHUNK_FRAMES):
        part = jobs[lo : lo + CHUNK_FRAMES]
        spans, pieces, at = [], [], 0
        for d, i in part:
            info = infos[d]
            stop = info.starts[i + 1] if i + 1 < len(info.starts) else info.end
            pieces.append(streams[d][info.starts[i] : stop])
            spans.append((at, at + len(pieces[-1])))
            at = spans[-1][1]
        buf = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
        start, end = np.array(spans, np.int64).T
        x, n, number = _decode_chunk(buf, start, end, np.array([infos[d].bits for d, _ in part], np.int64))
        for j, (d, i) in enumerate(part):
            if number[j] != i:
                raise FlacError(f"frame {number[j]} stands where {i} is due")
            found[d].append((infos[d].first_sample[i], x[j, : n[j]]))
    for info, blocks in zip(infos, found, strict=True):
        digest, total = hashlib.md5(), 0
        for _, b in blocks:
            digest.update(b.astype("<i1" if info.bits == 8 else "<i2").tobytes())
            total += len(b)
        if total != info.samples or (any(info.md5) and digest.digest() != info.md5):
            raise FlacError("decoded PCM differs from STREAMINFO")
    return found


def decode_from(stream: bytes, sample: int, count: int) -> np.ndarray:
    """``count`` samples from ``sample`` on, touching only the frames that hold them."""
    info = read_info(stream)
    lo = max(0, int(np.searchsorted(info.first_sample, sample, side="right")) - 1)
    hi = int(np.searchsorted(info.first_sample, sample + count, side="left"))
    starts = np.array(info.starts[lo:hi] + [info.starts[hi] if hi < len(info.starts) else info.end], np.int64)
    if hi <= lo:
        return np.zeros(0, np.int64)
    buf = np.frombuffer(stream[starts[0] : starts[-1]] + bytes(16), np.uint8)
    x, n, _ = _decode_chunk(buf, starts[:-1] - starts[0], starts[1:] - starts[0], np.full(hi - lo, info.bits, np.int64))
    pcm = np.concatenate([x[j, : n[j]] for j in range(hi - lo)])
    skip = sample - info.first_sample[lo]
    return pcm[skip : skip + count]
