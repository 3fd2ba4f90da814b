"""FLAC streams of 8-bit mono samples, many frames at a time.

Frames are independent, so all frames of a chunk are coded side by side: one numpy step handles sample i of every
frame. The decoder parses headers and subframes of any 8-bit mono stream (constant, verbatim, fixed and linear
predictors, partitioned Rice residuals with escapes), checks the CRC-8 of each header, the CRC-16 of each frame
and the MD5 of the samples, and raises on any difference.
"""

from __future__ import annotations

import hashlib
import struct
from functools import cache

import numpy as np

#: Samples of a frame, and the precision and shift of the encoder's linear predictors.
BLOCK, PRECISION, SHIFT = 1024, 9, 7
# Fixed values of the format.
MARK, STREAMINFO, SEEKTABLE, RATE, RATE_8K = b"fLaC", 0, 3, 8000, 4
CRC8, CRC16 = 0x07, 0x8005


@cache
def crc_table(polynomial: int, bits: int, length: int) -> np.ndarray:
    """[d, b]: what byte b adds to the CRC when d bytes follow; a CRC is the exclusive or of these."""
    top, mask = 1 << bits - 1, (1 << bits) - 1
    base = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        base = np.where(base & top, base << 1 ^ polynomial, base << 1) & mask
    out = np.empty((length, 256), np.uint16)
    out[0] = now = base
    for d in range(1, length):
        now = (now << 8 & mask) ^ base[now >> (bits - 8)]
        out[d] = now
    return out


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, polynomial: int, bits: int) -> np.ndarray:
    """CRC of each data[start:end]; none is empty."""
    size = ends - starts
    longest = 1 << int(size.max() - 1).bit_length() if size.max() > 1 else 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    return np.bitwise_xor.reduceat(crc_table(polynomial, bits, longest)[np.repeat(ends, size) - 1 - at, data[at]], np.cumsum(size) - size)


def utf8_number(n: int) -> bytes:
    """The format's coded number: UTF-8 continued to 36 bits."""
    if n < 128:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << 6 * k + 6 - k)
    return bytes([(0xFF80 >> more & 0xFF) | n >> 6 * more]) + bytes(0x80 | n >> 6 * j & 0x3F for j in reversed(range(more)))


def encode(payloads: list[bytes], block: int = BLOCK, most: int = 1 << 18) -> list[bytes]:
    """A stream for each non-empty payload, whose seek table has every frame; about ``most`` bytes at a time."""
    parts = [(i, at, payload[at : at + most]) for i, payload in enumerate(payloads) for at in range(0, len(payload), most)]
    frames: list[list[bytes]] = [[] for _ in payloads]
    first = 0
    while first < len(parts):
        end, size = first + 1, len(parts[first][2])
        while end < min(len(parts), first + 512) and size + len(parts[end][2]) <= most:
            size += len(parts[end][2])
            end += 1
        for (i, _, _), found in zip(parts[first:end], encode_frames([x[2] for x in parts[first:end]], [x[1] // block for x in parts[first:end]], block)):
            frames[i] += found
        first = end
    return [assembled(payload, found, block) for payload, found in zip(payloads, frames)]


def assembled(payload: bytes, frames: list[bytes], block: int) -> bytes:
    sizes = [len(x) for x in frames]
    points, offset = [], 0
    for i, size in enumerate(sizes):
        points.append(struct.pack(">QQH", i * block, offset, min(block, len(payload) - i * block)))
        offset += size
    table = b"".join(points[: 0xFFFFFF // 18])  # what a metadata block can hold; later frames are found from there
    sample_bits = RATE << 44 | 7 << 36 | len(payload)
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + sample_bits.to_bytes(8, "big") + hashlib.md5(signed).digest()
    return MARK + bytes([STREAMINFO]) + len(info).to_bytes(3, "big") + info + bytes([0x80 | SEEKTABLE]) + len(table).to_bytes(3, "big") + table + b"".join(frames)


def encode_frames(payloads: list[bytes], first: list[int], block: int) -> list[list[bytes]]:
    """The frames of each payload, numbered from ``first``; a payload fills whole blocks or ends its stream."""
    sizes = np.array([len(x) for x in payloads], np.int64)
    frames_of = -(-sizes // block)
    owner = np.repeat(np.arange(len(payloads)), frames_of)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    number = inside + np.array(first)[owner]
    n = np.minimum(block, sizes[owner] - inside * block)
    flat = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    valid = np.arange(block) < n[:, None]
    x = np.zeros((len(owner), block), np.int32)
    x[valid] = flat

    # Predictors: fixed of order 0 to 2, and linear of order 2 from the autocorrelation.
    r0, r1, r2 = ((x[:, : block - j].astype(np.int64) * x[:, j:]).sum(1) for j in range(3))
    with np.errstate(all="ignore"):
        low = r0.astype(float) ** 2 - r1.astype(float) ** 2
        coefficients = np.stack([np.where(low > 0, r1 * (r0 - r2) / low, 0), np.where(low > 0, (r0 * r2 - r1.astype(float) ** 2) / low, 0)])
    most = (1 << PRECISION - 1) - 1
    coefficients = np.clip(np.rint(coefficients * (1 << SHIFT)), -most, most).astype(np.int32)
    residuals = [x, np.diff(x, axis=1, prepend=0), None, None]
    residuals[2] = np.diff(residuals[1], axis=1, prepend=0)
    residuals[3] = x.copy()
    residuals[3][:, 2:] -= (coefficients[0][:, None] * x[:, 1:-1] + coefficients[1][:, None] * x[:, :-2]) >> SHIFT
    orders = np.array([0, 1, 2, 2])
    for res, order in zip(residuals[1:], orders[1:]):
        res[:, :order] = 0
    cost = np.stack([(np.abs(res) * valid).sum(1) for res in residuals])
    choice = cost.argmin(0)
    order = orders[choice]
    z = np.empty_like(x)
    for j, res in enumerate(residuals):
        z[choice == j] = res[choice == j]
    z = (z << 1) ^ (z >> 31)
    coded = valid & (np.arange(block) >= order[:, None])
    constant = np.where(valid, x == x[:, :1], True).all(1)
    coded &= ~constant[:, None]
    z[~coded] = 0
    mean = z.sum(1) / np.maximum(1, coded.sum(1))
    k = np.clip(np.log2(np.maximum(mean * 0.7, 1)).astype(np.int32), 0, 14)
    peak = z.max(1)
    while (long := (peak >> k) + 1 + k > 16).any():  # a code then fits a 32-bit window at any bit
        k[long & (k < 14)] += 1
        if not (long & (k < 14)).any():
            break

    # Tokens: each a value at the end of so many bits.
    width = 8 + block
    value, bits = np.zeros((len(owner), width), np.int32), np.zeros((len(owner), width), np.int32)
    linear = ~constant & (choice == 3)
    value[:, 0] = np.where(constant, 0, np.where(linear, 0b100001, 0b001000 + order)) << 1
    bits[:, 0] = 8
    for j in range(2):
        has = (order > j) & ~constant | (constant if j == 0 else False)
        value[has, 1 + j], bits[has, 1 + j] = x[has, j] & 0xFF, 8
        value[linear, 4 + j], bits[linear, 4 + j] = coefficients[j][linear] & ((1 << PRECISION) - 1), PRECISION
    value[linear, 3], bits[linear, 3] = (PRECISION - 1) << 5 | SHIFT, 9
    value[~constant, 6], bits[~constant, 6] = k[~constant], 10
    one = np.int32(1) << k[:, None]
    value[:, 8:] = (one | z & (one - 1)) * coded
    bits[:, 8:] = ((z >> k[:, None]) + (1 + k[:, None])) * coded

    heads = [b"\xff\xf8" + bytes([0x70 | RATE_8K, 0x02]) + utf8_number(int(i)) + struct.pack(">H", int(m) - 1) for i, m in zip(number, n)]
    head = np.array([len(h) + 1 for h in heads])
    body = -(-bits.sum(1) // 8)
    total = head + body + 2
    ends = np.cumsum(total)
    starts = ends - total
    out = np.zeros(int(ends[-1]) + 8, np.uint8)
    stop = np.cumsum(bits, axis=1, dtype=np.int32) + ((starts + head) * 8).astype(np.int32)[:, None]
    used = bits > 0
    stop, value = stop[used], value[used]
    last = (stop + 7) >> 3
    value <<= last * 8 - stop
    for j in range(3):
        out[: int(ends[-1])] += np.bincount(last - 1 - j, (value >> 8 * j) & 0xFF, minlength=int(ends[-1]))[: int(ends[-1])].astype(np.uint8)
    joined = np.frombuffer(b"".join(heads), np.uint8)
    at = np.repeat(starts - (np.cumsum(head - 1) - (head - 1)), head - 1) + np.arange(len(joined))
    out[at] = joined
    out[starts + head - 1] = crcs(out, starts, starts + head - 1, CRC8, 8)
    check = crcs(out, starts, ends - 2, CRC16, 16)
    out[ends - 2], out[ends - 1] = check >> 8, check & 0xFF

    data = out.tobytes()
    cut = [data[a:b] for a, b in zip(starts, ends)]
    last_of = np.cumsum(frames_of)
    return [cut[b - m : b] for b, m in zip(last_of, frames_of)]


def layout(stream: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int]]]:
    """Where frames begin, how many samples there are, their MD5, and the seek points (sample, offset, samples)."""
    if stream[:4] != MARK:
        raise ValueError("not a FLAC stream")
    at, last, samples, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == STREAMINFO:
            bits = int.from_bytes(block[10:18], "big")
            if bits >> 41 & 7 or (bits >> 36 & 31) != 7:
                raise ValueError("only 8-bit mono streams are read")
            samples, md5 = bits & (1 << 36) - 1, block[18:34]
        elif kind == SEEKTABLE:
            points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != 2**64 - 1]
        at += 4 + size
    return at, samples, md5, points


def leading_zeros() -> np.ndarray:
    out = np.full(1 << 16, 16, np.int64)
    for j in range(16):
        out[1 << j : 2 << j] = 15 - j
    return out


ZEROS = leading_zeros()


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (as bytes, a column for each frame), sample counts and ends of the frames that begin at ``starts``."""
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    words = (data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]).astype(np.int64)
    b2, b3, b4 = data[starts + 2].astype(np.int64), data[starts + 3], data[starts + 4]
    if (data[starts] != 0xFF).any() or (data[starts + 1] & 0xFE != 0xF8).any() or (b3 >> 4 != 0).any():
        raise ValueError("no mono frame where one should begin")
    number_size = np.select([b4 < 0x80, b4 < 0xE0, b4 < 0xF0, b4 < 0xF8, b4 < 0xFC, b4 < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    at = starts + 4 + number_size
    code, rate = b2 >> 4, b2 & 15
    size = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.clip(code - 2, 0, 3), data[at].astype(np.int64) + 1, (data[at].astype(np.int64) << 8 | data[at + 1]) + 1, 256 << np.clip(code - 8, 0, 7)], 0)
    at = at + (code == 6) + 2 * (code == 7) + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    if (size == 0).any() or (crcs(data, starts, at, CRC8, 8) != data[at]).any():
        raise ValueError("a frame header doesn't match its checksum")

    by_size = np.argsort(-size, kind="stable")  # so that frames still being read come first
    pos, n, frames = (at[by_size] + 1) * 8, size[by_size], len(starts)

    def take(lanes, width) -> np.ndarray:
        """The next so many bits (25 at most) of these lanes."""
        p = pos[lanes]
        pos[lanes] = p + width
        return words[p >> 3] >> (32 - width - (p & 7)) & ((1 << width) - 1)

    signed = lambda v, width: v - ((v >> (width - 1) & 1) << width)
    every = np.arange(frames)
    kind = take(every, 8)
    if (kind & 0x81).any():
        raise ValueError("subframes with wasted bits aren't read")
    kind >>= 1
    constant, verbatim, linear = kind == 0, kind == 1, kind >= 32
    order = np.where(linear, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if (~(constant | verbatim | linear | ((kind >= 8) & (kind <= 12)))).any():
        raise ValueError("a reserved subframe type")
    high = int(n.max())
    x = np.zeros((high, frames), np.int64)
    if constant.any():
        x[:, constant] = signed(take(every[constant], 8), 8)
    for i in range(high if verbatim.any() else int(order.max())):
        lanes = every[(verbatim & (i < n)) | (order > i)]
        if len(lanes):
            x[i, lanes] = signed(take(lanes, 8), 8)
    coefficients, shift = np.zeros((int(order[linear].max()) if linear.any() else 0, frames), np.int64), np.zeros(frames, np.int64)
    if linear.any():
        lanes = every[linear]
        precision = take(lanes, 4) + 1
        shift[lanes] = take(lanes, 5)
        for j in range(len(coefficients)):
            some = order[lanes] > j
            coefficients[j, lanes[some]] = signed(take(lanes[some], precision[some]), precision[some])

    rice = every[~(constant | verbatim)]
    if len(rice):
        head = take(rice, 6)
        method, parts = head >> 4, head & 15
        width = np.where(method == 0, 4, 5)
        length = n[rice] >> parts
        k, raw = np.zeros(len(rice), np.int64), np.full(len(rice), -1, np.int64)

        def parameters(some: np.ndarray) -> None:
            k[some] = take(rice[some], width[some])
            escape = some[k[some] == (1 << width[some]) - 1]
            raw[some] = -1
            raw[escape] = take(rice[escape], 5)

        parameters(np.arange(len(rice)))
        plain = (parts == 0).all() and (raw < 0).all()
        p, own_order, own_n = pos[rice], order[rice], n[rice]
        most_order = int(own_order.max())
        active = np.searchsorted(-own_n, -np.arange(high), side="left")  # frames of more than i samples
        for i in range(high):
            a = active[i]
            if i < most_order or not plain:
                lanes = np.nonzero(own_order[:a] <= i)[0]
                if not plain:
                    pos[rice] = p
                    if i and len(some := np.nonzero((i % length[:a] == 0) & (i < own_n[:a]))[0]):
                        parameters(some)
                    p = pos[rice]
                    if len(some := lanes[raw[lanes] >= 0]):
                        wide = some[raw[some] > 0]
                        pos[rice] = p
                        x[i, rice[wide]] = signed(take(rice[wide], raw[wide]), raw[wide])
                        p = pos[rice]
                        lanes = lanes[raw[lanes] < 0]
            else:
                lanes = slice(0, a)
            q, now, kk = 0, p[lanes], k[lanes]
            w = words[now >> 3] << (now & 7) & 0xFFFFFFFF
            q = ZEROS[w >> 16]
            if q.max(initial=0) == 16 or (q + kk).max(initial=0) > 23:  # a code that the window doesn't hold
                run = np.zeros(len(q), np.int64)
                while (more := q == 16).any():
                    run += 16 * more
                    now = now + 16 * more
                    w = words[now >> 3] << (now & 7) & 0xFFFFFFFF
                    q = np.where(more, ZEROS[w >> 16], q)
                    if (now >> 3).max() >= len(words) - 4:
                        raise ValueError("a frame without end")
                now = now + q + 1
                v = (words[now >> 3] << 32 | words[(now >> 3) + 4]) >> (64 - kk - (now & 7)) & ((1 << kk) - 1)
                z = (run + q) << kk | np.where(kk > 0, v, 0)
                p[lanes] = now + kk
            else:
                used = q + kk + 1
                z = q << kk | (w >> (32 - used)) & ((1 << kk) - 1)
                p[lanes] = now + used
            x[i, rice[lanes]] = z >> 1 ^ -(z & 1)
        pos[rice] = p

    for o in range(1, int(order[~linear].max(initial=0)) + 1):
        lanes = every[~linear & (order == o)]
        if len(lanes):
            y = x[:, lanes]
            for j in range(1, o):  # first values of the j-th difference, in place
                y[j:o] = np.diff(y[j - 1 : o], axis=0)
            for j in reversed(range(o)):
                y[j:] = np.cumsum(y[j:], axis=0)
            x[:, lanes] = y
    if linear.any():
        lanes = every[linear]
        y, c, s, o = x[:, lanes], coefficients[:, lanes], shift[lanes], order[lanes]
        for i in range(1, high):
            guess = sum(c[j] * y[i - 1 - j] for j in range(min(i, len(c))))
            y[i] += np.where(o <= i, guess >> s, 0)
        x[:, lanes] = y

    ends = np.empty(frames, np.int64)
    ends[by_size] = ((pos + 7) >> 3) + 2
    if (crcs(data, starts, ends - 2, CRC16, 16) != (data[ends - 2].astype(np.int64) << 8 | data[ends - 1])).any():
        raise ValueError("a frame doesn't match its checksum")
    back = np.empty(frames, np.int64)
    back[by_size] = every
    return (x[:, back] + 128).astype(np.uint8), size, ends


def decode(streams: list[bytes], lanes: int = 4096) -> list[bytes]:
    """The payloads of streams."""
    return [payload for payload, _ in decode_with_frames(streams, lanes)]


def covers(points: list[tuple[int, int, int]], samples: int) -> bool:
    """Whether each seek point begins where the one before ends, from the first sample to the last."""
    ends = [0, *(first + n for first, _, n in points)]
    return bool(points) and ends[-1] == samples and all(p[0] == end for p, end in zip(points, ends))


def decode_with_frames(streams: list[bytes], lanes: int = 4096) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """The payload of each stream, and first sample, samples and byte offset of each frame that was read: so many frames
    side by side where seek points cover a stream, else one after another, to its end if it doesn't say how many samples it has."""
    laid = [layout(s) for s in streams]
    covered = [covers(points, samples) for _, samples, _, points in laid]
    base = np.cumsum([0, *map(len, streams)])
    starts = np.array([int(base[i]) + at + p[1] for i, (at, _, _, points) in enumerate(laid) if covered[i] for p in points], np.int64)
    out: list[tuple[bytes, list[tuple[int, int, int]]]] = []
    flat, sizes, data = [], [np.zeros(0, np.int64)], np.frombuffer(b"".join(streams), np.uint8)
    limits = base[np.searchsorted(base, starts, side="right")]
    for k in range(0, len(starts), lanes):
        own = starts[k : k + lanes]
        x, size, ends = decode_frames(data[own[0] : starts[k + lanes] if k + lanes < len(starts) else limits[-1]], own - own[0])
        if (ends + own[0] > limits[k : k + lanes]).any():
            raise ValueError("a frame runs past its stream")
        flat.append(x.T[np.arange(x.shape[0]) < size[:, None]].tobytes())
        sizes.append(size)
    flat, sizes = b"".join(flat), np.concatenate(sizes).tolist()
    at = frame = 0
    for i, (begin, samples, md5, points) in enumerate(laid):
        frames, total = [], 0
        if covered[i]:
            for _, offset, _ in points:
                frames.append((total, sizes[frame], begin + offset))
                total += sizes[frame]
                frame += 1
            if total != samples:
                raise ValueError("the frames aren't as long as the seek points say")
            payload = flat[at : at + samples]
            at += samples
        else:
            own, found, place = np.frombuffer(streams[i], np.uint8), [], begin
            while total < samples if samples else place < len(streams[i]):
                x, size, ends = decode_frames(own, np.array([place]))
                found.append(x[: size[0], 0].tobytes())
                frames.append((total, int(size[0]), place))
                total += int(size[0])
                place = int(ends[0])
            payload = b"".join(found)
        if any(md5) and hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the samples don't match their checksum")
        out.append((payload, frames))
    return out
