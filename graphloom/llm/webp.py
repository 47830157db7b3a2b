"""Lossless WebP (VP8L) reading and writing, on pixel arrays of uint8 with channels red, green, blue, alpha.

``decode`` reads any VP8L stream: simple and normal prefix codes, meta prefix images, LZ77 back-references with
the neighbourhood distances, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms, each undone in reverse order. ``encode`` writes them; which transforms, cache and copies it uses are
arguments. Streams with one group of prefix codes are read by windows: what starts at every bit of a window is
worked out for all bits at once, then only the chain of starts is followed. Images of one varying channel are
written with the longest copies that the nearest earlier six pixels give, all found by sorting.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE = 0x2F
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
MAX_SIDE = 1 << 14
MATCH, REACH, LONGEST = 6, 1 << 16, 4096  # what this encoder looks for: pixels alike, within how many, copied at once
WINDOW = 1 << 15  # bytes of a stream that are read together
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Corrupt(ValueError):
    pass


# ---- bits -------------------------------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0  # at: the next bit

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + (n + 14) // 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.at += n
        if self.at > 8 * len(self.data):
            raise Corrupt("the stream ends early")
        return value


class Writer:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 8:
            whole = self.n // 8
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def put_bytes(self, own: np.ndarray) -> None:
        """Many whole bytes at once, at any bit."""
        if self.n and len(own):
            shift = np.uint8(self.n)
            moved = own << shift
            moved[1:] |= own[:-1] >> np.uint8(8 - self.n)
            moved[0] |= np.uint8(self.value)
            self.value = int(own[-1]) >> (8 - self.n)
            own = moved
        self.done += own.tobytes()

    def put_bits(self, bits: np.ndarray) -> None:
        """Many bits at once, each a 0 or 1."""
        own = np.concatenate([np.array([self.value >> k & 1 for k in range(self.n)], np.uint8), bits])
        whole = len(own) // 8
        packed = np.packbits(own, bitorder="little").tobytes()
        self.done += packed[:whole]
        self.n = len(own) - 8 * whole
        self.value = packed[whole] if self.n else 0

    def finish(self) -> bytes:
        return bytes(self.done) + (bytes([self.value & 255]) if self.n else b"")


class _Number:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


# ---- prefix codes -----------------------------------------------------------------------------------------


# each 16-bit number with its bits in reverse order
REVERSED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8)).reshape(-1, 16)[:, ::-1]).view(">u2").tolist()


@lru_cache(256)
def canonical(lengths: tuple[int, ...]) -> list[int]:
    """The canonical code of each symbol, bits in stream order."""
    used = [i for i, n in enumerate(lengths) if n]
    counts = [0] * 17
    for i in used:
        counts[lengths[i]] += 1
    code, first = 0, [0] * 17
    for n in range(1, 17):
        code = (code + counts[n - 1]) << 1
        first[n] = code
    out = [0] * len(lengths)
    for i in used:
        n = lengths[i]
        out[i] = REVERSED[first[n]] >> 16 - n
        first[n] += 1
    return out


@dataclass
class Prefix:
    """width: of all codes, or -1 when they differ; found: for the next ``depth`` bits, symbol << 4 | width."""

    depth: int
    found: np.ndarray
    width: int
    symbols: np.ndarray | None = None

    @cached_property
    def table(self) -> list[int]:
        return self.found.tolist()

    @classmethod
    @lru_cache(32)
    def of(cls, lengths: tuple[int, ...]) -> Prefix:
        used = [i for i, n in enumerate(lengths) if n]
        if not used:
            return cls(0, np.zeros(1, np.int64), 0, np.zeros(1, np.int64))
        if len(used) == 1:
            return cls(0, np.array(used) << 4, 0, np.array(used))
        depth = max(lengths)
        if sum([1 << depth - lengths[i] for i in used]) != 1 << depth:
            raise Corrupt("a prefix code isn't complete")
        table = np.zeros(1 << depth, np.int64)
        codes = canonical(lengths)
        for symbol in used:
            n = lengths[symbol]
            table[codes[symbol] :: 1 << n] = symbol << 4 | n
        even = len({lengths[i] for i in used}) == 1
        return cls(depth, table, depth if even else -1, table >> 4 if even else None)

    def read(self, bits: Reader) -> int:
        if not self.depth:
            return self.table[0] >> 4
        found = self.table[bits.peek(self.depth)]
        bits.at += found & 15
        return found >> 4


#: Extra bits and the fewest repeats of code lengths 16 to 18.
REPEATS = ((2, 3), (3, 3), (7, 11))


def read_prefix(bits: Reader, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.take(1):
        two = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Prefix.of(tuple(lengths))
    first = [0] * 19
    for k in range(4 + bits.take(4)):
        first[CODE_LENGTH_ORDER[k]] = bits.take(3)
    code = Prefix.of(tuple(first))
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    at, last, used = 0, 8, 0
    value, table, mask = bits.peek(14 * alphabet), code.table, (1 << code.depth) - 1
    while at < alphabet and left:
        left -= 1
        found = table[value & mask]
        n, width = found >> 4, found & 15 if mask else 0
        if n < 16:
            lengths[at] = n
            last = n or last
            at += 1
        else:
            extra, fewest = REPEATS[n - 16]
            times = fewest + (value >> width & (1 << extra) - 1)
            if at + times > alphabet:
                raise Corrupt("code lengths run over the alphabet")
            lengths[at : at + times] = [last if n == 16 else 0] * times
            at += times
            width += extra
        value >>= width
        used += width
    bits.take(used)
    return Prefix.of(tuple(lengths))


def code_lengths(counts, most: int = 15) -> list[int]:
    """Lengths of a prefix code for these counts, none over ``most``."""
    counts = list(counts)
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    n = len(counts)
    while True:
        heap = [counts[i] << 20 | i for i in used]  # the count, then the node
        heapq.heapify(heap)
        parent = [0] * (n + len(used) - 1)
        for fresh in range(n, len(parent)):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a & 0xFFFFF] = parent[b & 0xFFFFF] = fresh
            heapq.heapreplace(heap, (a >> 20) + (b >> 20) << 20 | fresh)
        depth = [0] * len(parent)
        for k in range(len(parent) - 2, n - 1, -1):
            depth[k] = depth[parent[k]] + 1
        for i in used:
            out[i] = depth[parent[i]] + 1
        if max(out) <= most:
            return out
        counts = [(c + 1) // 2 if c else 0 for c in counts]  # flatter counts, a shallower tree


def write_prefix(out: Writer, lengths) -> None:
    out.put(*_prefix_bits(tuple(lengths)))


@lru_cache(256)
def _prefix_bits(lengths: tuple[int, ...]) -> tuple[int, int]:
    """The description of a prefix code, as one number and its bits."""
    out = _Number()
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):  # one symbol takes no bits
        symbol = used[0] if used else 0
        out.put(1, 1), out.put(0, 1), out.put(int(symbol > 1), 1), out.put(symbol, 8 if symbol > 1 else 1)
        return out.value, out.n
    out.put(0, 1)
    runs = []  # (code, extra bits, their number)
    for length, own in groupby(lengths):
        left = len(list(own))
        if length:
            runs.append((length, 0, 0))
            left -= 1
        while left >= 3:
            code, n, fewest, most = (16, 2, 3, 6) if length else (17, 3, 3, 10) if left < 11 else (18, 7, 11, 138)
            runs.append((code, min(left, most) - fewest, n))
            left -= min(left, most)
        runs += [(length, 0, 0)] * left
    counts = [0] * 19
    for code, _, _ in runs:
        counts[code] += 1
    own = code_lengths(counts, 7)
    if sum(n > 0 for n in own) == 1:  # a lone symbol: give it a partner so that the code is complete
        own[next(i for i in range(19) if not own[i])] = 1
    codes = canonical(tuple(own))
    kept = max(4, 1 + max(k for k in range(19) if own[CODE_LENGTH_ORDER[k]]))
    out.put(kept - 4, 4)
    for k in range(kept):
        out.put(own[CODE_LENGTH_ORDER[k]], 3)
    out.put(0, 1)  # lengths for the whole alphabet follow
    value, width = out.value, out.n
    for code, extra, n in runs:
        value |= (codes[code] | extra << own[code]) << width
        width += own[code] + n
    return value, width


# ---- entropy-coded images: pixels as uint32 alpha, red, green, blue -----------------------------------------


def _value(code: int, bits: Reader) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.take(extra) + 1


def read_image(bits: Reader, width: int, height: int, top: bool) -> np.ndarray:
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise Corrupt("colour cache too large")
    meta, shift, groups = None, 0, 1
    if top and bits.take(1):
        shift = 2 + bits.take(3)
        meta = (read_image(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF).tolist()
        groups = 1 + max(max(r) for r in meta)
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = [[read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, distance = codes[0]
    if groups == 1 and not cache_bits and min(c.width for c in codes[0][:4]) >= 0 and int(green.symbols.max()) < 256:
        return _read_even(bits, codes[0][:4], total).reshape(height, width)
    if groups == 1 and green.depth:
        return _read_windows(bits, codes[0], total, width, cache_bits).reshape(height, width)
    out, cache, at = [0] * total, [0] * (1 << cache_bits), 0
    drop = 32 - cache_bits
    while at < total:
        if meta is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, distance = codes[meta[y >> shift][x >> shift]]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            pixel = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            new = 1
        elif s < 256 + LENGTH_CODES:
            new = _value(s - 256, bits)
            d = _value(distance.read(bits), bits)
            if d <= len(NEAR):
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            else:
                d -= len(NEAR)
            if d > at or at + new > total:
                raise Corrupt("a copy reaches outside the image")
            for k in range(at, at + new):
                out[k] = p = out[k - d]
                if cache_bits:
                    cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> drop] = p
            at += new
            continue
        else:
            pixel = cache[s - 256 - LENGTH_CODES]
        out[at] = pixel
        if cache_bits:
            cache[(CACHE_MULTIPLIER * pixel & 0xFFFFFFFF) >> drop] = pixel
        at += 1
    if bits.at > 8 * len(bits.data):
        raise Corrupt("the stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


# by length or distance code: the number of extra bits, and the value that they are added to
AFTER = np.maximum(np.arange(DISTANCE_CODES) - 2, 0) >> 1
LEAST = np.where(np.arange(DISTANCE_CODES) < 4, np.arange(DISTANCE_CODES), (2 + (np.arange(DISTANCE_CODES) & 1)) << AFTER) + 1
MASKS = (np.uint64(1) << np.arange(58, dtype=np.uint64)) - np.uint64(1)
AFTER_GREEN = np.zeros(256 + LENGTH_CODES + (1 << 11), np.uint8)
AFTER_GREEN[256 : 256 + LENGTH_CODES] = 64 + AFTER[:LENGTH_CODES]


@lru_cache(16)
def _near(width: int) -> np.ndarray:
    return np.array([max(1, dx + dy * width) for dx, dy in NEAR])


def _read_windows(bits: Reader, codes: list[Prefix], total: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels of a stream with one group of codes; in a window, each bit is taken as the start of a token."""
    green, red, blue, alpha, distance = codes
    near = _near(width)
    literal = red.depth or blue.depth or alpha.depth
    # bits up to the next part of a token, by the bits that come; of green, 64 more where a copy starts
    jump = (green.found & 15).astype(np.uint8) + AFTER_GREEN[green.found >> 4]
    far = ((distance.found & 15) * (distance.depth > 0) + AFTER[distance.found >> 4]).astype(np.uint8)
    parts, made, at, length = [], 0, bits.at, 8 * len(bits.data)
    while made < total:
        if at >= length:
            raise Corrupt("the stream ends early")
        first = at >> 3
        own = bits.data[first : first + WINDOW + 16]
        own = np.frombuffer(own + bytes(24), np.uint8)
        words = np.ndarray(len(own) - 7, "<u8", own, strides=(1,)).copy()
        span = 8 * min(WINDOW, len(bits.data) - first)

        def peek(q, n):  # up to 57 bits from each bit of q
            return (words[q >> 3] >> (q & 7).astype(np.uint64) & MASKS[n]).astype(np.int64)

        here = (words[: span // 8].astype(np.uint32)[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << green.depth) - 1)).ravel().astype(np.int64)
        step = jump.take(here, mode="clip")
        copies = np.flatnonzero(step >= 64)
        if literal:
            own = np.flatnonzero(green.found[here] < 256 << 4)
            q = start = own + step[own]
            for c in (red, blue, alpha):
                q = q + (c.found[peek(q, c.depth)] & 15 if c.depth else 0)
            step[own] += (q - start).astype(np.uint8)
        if len(copies):
            step[copies] -= 64
            q = copies + step[copies]
            step[copies] += far[peek(q, distance.depth)]
        chain, follow, p = bytearray(span), step.tobytes(), at - 8 * first
        while p < span:
            chain[p] = 1
            p += follow[p]
        chain = np.flatnonzero(np.frombuffer(chain, np.uint8))
        found = green.found[here[chain]]
        symbol, q = found >> 4, chain + (found & 15)
        steps, back = np.ones(len(chain), np.int64), np.zeros(len(chain), np.int64)
        copies = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_CODES))
        if len(copies):
            to, code = q[copies], symbol[copies] - 256
            n = AFTER[code]
            steps[copies] = LEAST[code] + peek(to, n)
            to = to + n
            seen = distance.found[peek(to, distance.depth)]
            to, code = to + (seen & 15 if distance.depth else 0), seen >> 4
            d = LEAST[code] + peek(to, AFTER[code])
            back[copies] = np.where(d <= len(NEAR), near[np.minimum(d, len(NEAR)) - 1], d - len(NEAR))
        ends = made + np.cumsum(steps)
        kept = len(chain)
        if ends[-1] >= total:  # the image ends here: what follows belongs to something else
            kept = int(np.searchsorted(ends, total)) + 1
            p = int(chain[kept - 1]) + follow[chain[kept - 1]]
        made, at = int(ends[kept - 1]), 8 * first + p
        pixel = (symbol << 8).astype(np.uint32)
        for c, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if c.depth:
                seen = c.found[peek(q, c.depth)]
                q = q + (seen & 15)
                pixel |= (seen >> 4).astype(np.uint32) << np.uint32(shift)
            else:
                pixel |= np.uint32(int(c.found[0] >> 4) << shift)
        parts.append([x[:kept] for x in (symbol, pixel, steps, back)])
    if made != total or at > length:
        raise Corrupt("a copy reaches outside the image" if made != total else "the stream ends early")
    bits.at = at
    symbol, pixel, steps, back = (np.concatenate(x) for x in zip(*parts))
    starts = np.cumsum(steps) - steps
    if (back > starts).any():
        raise Corrupt("a copy reaches outside the image")
    out = np.zeros(total, np.uint32)
    plain = symbol < 256
    out[starts[plain]] = pixel[plain]
    if cache_bits:
        return _with_cache(out.tolist(), symbol.tolist(), starts.tolist(), steps.tolist(), back.tolist(), cache_bits)
    copied = np.flatnonzero(back)
    if not len(copied):
        return out
    raw = bytearray(out.tobytes())
    to = 4 * starts[copied]
    for a, end, source in zip(to.tolist(), (to + 4 * steps[copied]).tolist(), (to - 4 * back[copied]).tolist()):
        while a < end:  # what was copied may be copied in turn
            n = min(end, 2 * a - source)
            raw[a:n] = raw[source : source + n - a]
            a = n
    return np.frombuffer(raw, np.uint32)


def _with_cache(out: list, symbols: list, starts: list, steps: list, back: list, cache_bits: int) -> np.ndarray:
    """The pixels left open by copies and by references to the colour cache, in the order of the stream."""
    cache, drop = [0] * (1 << cache_bits), 32 - cache_bits
    for s, a, n, d in zip(symbols, starts, steps, back):
        if s >= 256 + LENGTH_CODES:
            out[a] = cache[s - 256 - LENGTH_CODES]
        for k in range(a, a + n):
            if d:
                out[k] = out[k - d]
            cache[(CACHE_MULTIPLIER * out[k] & 0xFFFFFFFF) >> drop] = out[k]
    return np.array(out, np.uint32)


def _read_even(bits: Reader, codes: list[Prefix], total: int) -> np.ndarray:
    """Pixels whose codes have one width per channel: their bits form a matrix."""
    each = sum(c.width for c in codes)
    end = bits.at + each * total
    if end > 8 * len(bits.data):
        raise Corrupt("the stream ends early")
    first = bits.at >> 3
    own = np.frombuffer(bits.data, np.uint8, (end + 7) // 8 - first, first)
    shift = bits.at & 7
    if shift:  # move the bits to a byte's edge
        more = np.append(own[1:], np.uint8(0))
        own = (own >> np.uint8(shift)) | (more << np.uint8(8 - shift))
    bits.at = end
    channels, at = [], 0
    if each % 8 == 0 and all(c.width % 8 == 0 for c in codes):
        rows = own[: each // 8 * total].reshape(total, each // 8)
        for c in codes:
            channels.append(c.symbols.astype(np.uint32)[rows[:, at]] if c.width else np.full(total, c.symbols[0], np.uint32))
            at += c.width // 8
    else:
        rows = np.unpackbits(own, bitorder="little")[: each * total].reshape(total, each)
        for c in codes:
            value = np.zeros(total, np.int64)
            for k in range(c.width):
                value |= rows[:, at + k].astype(np.int64) << k
            channels.append(c.symbols.astype(np.uint32)[value])
            at += c.width
    green, red, blue, alpha = channels
    return alpha << np.uint32(24) | red << np.uint32(16) | green << np.uint32(8) | blue


def _parts(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number for a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << top - 1) - 1), top - 1


@lru_cache(1)
def _all_parts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_parts`` gives for each value that a copy can have here."""
    value = np.arange(REACH + len(NEAR))
    v = np.maximum(value - 1, 0)
    top = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1
    low, n = value <= 4, np.maximum(top - 1, 0)
    return np.where(low, value - 1, 2 * top + (v >> n & 1)), np.where(low, 0, v & ((1 << n) - 1)), np.where(low, 0, n)


def _copies(plane: np.ndarray) -> np.ndarray:
    """(start, length, distance) of the copies taken, in order, from one channel's values."""
    out = []
    for base in range(0, len(plane) - MATCH + 1, REACH):
        v = plane[base : base + REACH].astype(np.uint64)
        m = len(v) - MATCH + 1
        if m < 2:
            break
        key = np.arange(m, dtype=np.uint64)
        for k in range(MATCH):
            key |= v[k : k + m] << np.uint64(16 + 8 * k)
        key.sort()
        place = (key & np.uint64(REACH - 1)).astype(np.int64)
        again = np.flatnonzero(key[1:] >> np.uint64(16) == key[:-1] >> np.uint64(16)) + 1
        back = np.zeros(m, np.int64)
        back[place[again]] = place[again] - place[again - 1]
        first = np.concatenate([[0], np.flatnonzero(back[1:] != back[:-1]) + 1])  # runs of one distance
        last = np.append(first[1:], m)
        kept = back[first] > 0
        at = 0
        for a, b, d in zip(first[kept].tolist(), last[kept].tolist(), back[first[kept]].tolist()):
            if b <= at:
                continue
            if a < at:
                a = at
            at = b + MATCH - 1
            while at - a > LONGEST:
                out += (base + a, LONGEST, d)
                a += LONGEST
            out += (base + a, at - a, d)
    return np.array(out, np.int64).reshape(-1, 3)


@lru_cache(256)
def _single(symbol: int) -> tuple[int, ...]:
    return (0,) * symbol + (1,) + (0,) * (255 - symbol)


def _write_plane(out: Writer, plane: np.ndarray, rest: tuple[int, int, int]) -> None:
    """An image whose green alone varies; red, blue and alpha are single symbols."""
    start, length, back = _copies(plane).T
    inside = np.zeros(len(plane) + 1, np.int64)
    inside[start] += 1
    inside[start + length] -= 1
    token = np.cumsum(inside)[:-1] == 0
    token[start] = True
    symbol = plane.astype(np.int64)
    length_code, length_extra, length_n = (x[length] for x in _all_parts())
    back_code, back_extra, back_n = (x[back + len(NEAR)] for x in _all_parts())
    symbol[start] = 256 + length_code
    symbol = symbol[token]
    lengths = [code_lengths(np.bincount(symbol, minlength=256 + LENGTH_CODES).tolist())]
    lengths += [_single(r) for r in rest]
    lengths.append(code_lengths(np.bincount(back_code, minlength=DISTANCE_CODES).tolist()))
    for own in lengths:
        write_prefix(out, own)

    def coded(own):
        n = np.array(own, np.uint64)
        return np.array(canonical(tuple(own)), np.uint64), n if np.count_nonzero(n) > 1 else n * np.uint64(0)

    (code, n), (far_code, far_n) = coded(lengths[0]), coded(lengths[4])
    value, width = code[symbol], n[symbol]
    where = np.flatnonzero(symbol >= 256)
    for v, k in ((length_extra, length_n), (far_code[back_code], far_n[back_code]), (back_extra, back_n)):
        value[where] |= v.astype(np.uint64) << width[where]
        width[where] += k.astype(np.uint64)
    width = width.astype(np.int64)
    # Each token's bits, the lowest first: as many in a row as the longest has, of which its width is kept.
    most = int(width.max(initial=0))
    rows = np.unpackbits(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : most + 7 >> 3], axis=1, bitorder="little")
    out.put_bits(rows[np.arange(rows.shape[1]) < width[:, None]])


def write_image(out: Writer, pixels: np.ndarray, top: bool, cache_bits: int = 0, copies: bool = False, even: bool = False) -> None:
    """even: codes of eight bits for all of red, green and blue, which are quick to read."""
    height, width = pixels.shape
    flat = pixels.ravel()
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)  # one group of prefix codes
    if not (cache_bits or copies):
        planes = [(flat >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24)]
        lengths = []
        for k, plane in enumerate(planes):
            own = [8] * 256 if even and k < 3 else code_lengths(np.bincount(plane, minlength=256).tolist())
            lengths.append(own + [0] * LENGTH_CODES * (k == 0))
        for own in [*lengths, [0] * DISTANCE_CODES]:
            write_prefix(out, own)
        codes = [np.array(canonical(tuple(own))) for own in lengths]
        widths = [np.array([0] * len(own) if sum(n > 0 for n in own) == 1 else own) for own in lengths]
        if even and not widths[3].any():
            out.put_bytes(np.stack([codes[k][planes[k]].astype(np.uint8) for k in range(3)], 1).ravel())
            return
        n = np.stack([widths[k][planes[k]] for k in range(4)], 1).ravel()
        v = np.stack([codes[k][planes[k]] for k in range(4)], 1).ravel()
        ends = np.cumsum(n)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        out.put_bits((np.repeat(v, n) >> inside & 1).astype(np.uint8))
        return
    if not cache_bits and (flat & np.uint32(0xFFFF00FF) == flat[0] & np.uint32(0xFFFF00FF)).all():
        first = int(flat[0])
        _write_plane(out, (flat >> np.uint32(8) & np.uint32(255)).astype(np.uint8), (first >> 16 & 255, first & 255, first >> 24))
        return
    tokens, cache, seen, at, values = [], {}, {}, 0, flat.tolist()
    while at < len(values):
        pixel, key = values[at], tuple(values[at : at + 3])
        new, start = 0, seen.get(key) if copies else None
        if start is not None:
            while at + new < len(values) and new < 4096 and values[start + new] == values[at + new]:
                new += 1
        slot = (CACHE_MULTIPLIER * pixel & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if new >= 3:
            tokens.append(("copy", new, at - start + len(NEAR)))
        elif slot is not None and cache.get(slot) == pixel:
            tokens.append(("cache", slot, 0))
            new = 1
        else:
            tokens.append(("pixel", pixel, 0))
            new = 1
        for k in range(at, at + new):
            seen[tuple(values[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_MULTIPLIER * values[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[k]
        at += new
    counts = [[0] * (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * DISTANCE_CODES]
    for kind, a, b in tokens:
        if kind == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                counts[k][a >> s & 255] += 1
        elif kind == "cache":
            counts[0][256 + LENGTH_CODES + a] += 1
        else:
            counts[0][256 + _parts(a)[0]] += 1
            counts[4][_parts(b)[0]] += 1
    lengths = [code_lengths(c) for c in counts]
    for own in lengths:
        write_prefix(out, own)
    codes = [canonical(tuple(own)) for own in lengths]
    alone = [sum(n > 0 for n in own) == 1 and next(i for i, n in enumerate(own) if n) < 256 for own in lengths]

    def put(k: int, symbol: int) -> None:
        if not alone[k]:
            out.put(codes[k][symbol], lengths[k][symbol])

    for kind, a, b in tokens:
        if kind == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                put(k, a >> s & 255)
        elif kind == "cache":
            put(0, 256 + LENGTH_CODES + a)
        else:
            for k, v, base in ((0, a, 256), (4, b, 0)):
                code, extra, n = _parts(v)
                put(k, base + code)
                out.put(extra, n)


# ---- transforms: pixels as int array (height, width, 4) of alpha, red, green, blue ---------------------------


def _split(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _join(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predict(mode: int, left, above, corner, right) -> list[int]:
    """left, above, above left and above right neighbour -> prediction, channel by channel."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return list((left, above, right, corner)[mode - 1])
    if mode == 5:
        return mean(mean(left, right), above)
    if mode in (6, 7, 8, 9):
        return mean(*{6: (left, corner), 7: (left, above), 8: (corner, above), 9: (above, right)}[mode])
    if mode == 10:
        return mean(mean(left, corner), mean(above, right))
    if mode == 11:
        by_left = sum(abs(a - c) for a, c in zip(above, corner))  # what L + T - TL differs from L by
        by_above = sum(abs(a - c) for a, c in zip(left, corner))
        return list(left) if by_left < by_above else list(above)
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(left, above, corner)]
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(left, above), corner)]


def predictor(pixels: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Undo the predictor transform, or apply it (forward). modes: one per block of 2**bits pixels a side."""
    height, width = pixels.shape[:2]
    if not forward and (modes == 2).all():  # every row adds to the one above: running sums
        out = pixels.copy()
        out[0, :, :] = np.cumsum(out[0], 0)
        out[0, :, 0] += 255
        out[:, :, :] = np.cumsum(out, 0)
        return out & 255
    given = pixels.tolist()
    full = given if forward else [[None] * width for _ in range(height)]
    out = [[None] * width for _ in range(height)] if forward else full
    sign = -1 if forward else 1
    for y in range(height):
        row, up = full[y], full[y - 1] if y else None
        for x in range(width):
            if y == 0:
                p = row[x - 1] if x else (255, 0, 0, 0)
            elif x == 0:
                p = up[0]
            else:
                right = up[x + 1] if x + 1 < width else row[0]
                p = _predict(int(modes[y >> bits, x >> bits]), row[x - 1], up[x], up[x - 1], right)
            out[y][x] = [(v + sign * q) & 255 for v, q in zip(given[y][x], p)]
    return np.array(out, np.int64).reshape(height, width, 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def cross_colour(pixels: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """elements: (rows, columns, 4) with red_to_blue, green_to_blue, green_to_red in channels 1, 2, 3."""
    height, width = pixels.shape[:2]
    e = _signed(np.repeat(np.repeat(elements, 1 << bits, 0), 1 << bits, 1)[:height, :width])
    delta = lambda t, c: (t * _signed(c)) >> 5
    alpha, red, green, blue = (pixels[..., k] for k in range(4))
    sign = -1 if forward else 1
    new_red = red + sign * delta(e[..., 3], green) & 255
    true_red = red if forward else new_red
    new_blue = blue + sign * (delta(e[..., 2], green) + delta(e[..., 1], true_red)) & 255
    return np.stack([alpha, new_red, green, new_blue], -1)


def subtract_green(pixels: np.ndarray, forward: bool) -> np.ndarray:
    out = pixels.copy()
    for k in (1, 3):
        out[..., k] = out[..., k] + (-1 if forward else 1) * out[..., 2] & 255
    return out


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    shift = _bundle(len(palette))
    green = pixels[..., 2]
    if shift:
        each, n = 8 >> shift, 1 << shift
        green = np.stack([green >> (each * k) & ((1 << each) - 1) for k in range(n)], -1).reshape(green.shape[0], -1)[:, :width]
    full = np.zeros((256, 4), np.int64)
    full[: len(palette)] = palette
    return full[green]


def to_palette(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(bundled indexes, palette), or None when there are over 256 colours."""
    colours, index = np.unique(_join(pixels), return_inverse=True)
    if len(colours) > 256:
        return None
    index = index.reshape(pixels.shape[:2])
    shift = _bundle(len(colours))
    if shift:
        each, n = 8 >> shift, 1 << shift
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % n))).reshape(index.shape[0], -1, n)
        index = sum(index[..., k] << (each * k) for k in range(n))
    out = np.zeros((*index.shape, 4), np.int64)
    out[..., 0], out[..., 2] = 255, index
    return out, _split(colours)


# ---- files --------------------------------------------------------------------------------------------------


def _swapped(pixels: np.ndarray) -> np.ndarray:
    """Red and blue change places."""
    out = np.empty(pixels.shape, np.uint8)
    for k, other in enumerate((2, 1, 0, 3)):
        out[..., k] = pixels[..., other]
    return out


def decode(data: bytes) -> np.ndarray:
    """One RIFF file -> uint8 array (height, width, 4): red, green, blue, alpha."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise Corrupt("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if len(data) < 20 + size:
        raise Corrupt("the stream ends early")
    bits = Reader(data[20 : 20 + size])
    if bits.take(8) != SIGNATURE:
        raise Corrupt("bad signature")
    width, height = 1 + bits.take(14), 1 + bits.take(14)
    bits.take(1)
    if bits.take(3):
        raise Corrupt("unknown version")
    transforms, coded, seen = [], width, set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise Corrupt("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = 2 + bits.take(3)
            block = read_image(bits, (coded + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
            transforms.append((kind, shift, _split(block)))
        elif kind == PALETTE:
            n = 1 + bits.take(8)
            palette = np.cumsum(_split(read_image(bits, n, 1, False))[0], 0) & 255
            transforms.append((kind, coded, palette))
            shift = _bundle(n)
            coded = (coded + (1 << shift) - 1) >> shift
        else:
            transforms.append((kind, 0, None))
    packed = read_image(bits, coded, height, True)
    if transforms and transforms[-1][0] == SUBTRACT_GREEN:  # undone on whole pixels
        transforms.pop()
        green = packed >> np.uint32(8) & np.uint32(255)
        packed = packed & np.uint32(0xFF00FF00) | (packed & np.uint32(0xFF00FF)) + green * np.uint32(0x10001) & np.uint32(0xFF00FF)
    if not transforms:
        return _swapped(packed.astype("<u4").view(np.uint8).reshape(height, coded, 4))
    pixels = _split(packed)
    for kind, shift, own in reversed(transforms):
        if kind == PREDICTOR:
            pixels = predictor(pixels, own[..., 2], shift, False)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, own, shift, False)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, False)
        else:
            pixels = from_palette(pixels, own, shift)
    return pixels[..., [1, 2, 3, 0]].astype(np.uint8)


def encode(rgba: np.ndarray, transforms: tuple = (), cache_bits: int = 0, copies: bool = False, even: bool = False) -> bytes:
    """transforms: in the order applied, of (PREDICTOR, bits, modes), (CROSS_COLOUR, bits, elements),
    (SUBTRACT_GREEN,) and (PALETTE,)."""
    height, width = rgba.shape[:2]
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("a side must have 1 to 16384 pixels")
    pixels = None if transforms == ((SUBTRACT_GREEN,),) else rgba[..., [3, 0, 1, 2]].astype(np.int64)
    out = Writer()
    out.put(SIGNATURE, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(int((rgba[..., 3] != 255).any()), 1), out.put(0, 3)
    for kind, *own in transforms:
        out.put(1, 1), out.put(kind, 2)
        if pixels is None:  # bytes wrap around
            less = _swapped(rgba)
            less[..., 0] -= rgba[..., 1]
            less[..., 2] -= rgba[..., 1]
            packed = less.view("<u4")[..., 0].astype(np.uint32)
        elif kind == PREDICTOR:
            shift, modes = own
            out.put(shift - 2, 3)
            write_image(out, (modes.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
            pixels = predictor(pixels, modes, shift, True)
        elif kind == CROSS_COLOUR:
            shift, elements = own
            out.put(shift - 2, 3)
            write_image(out, _join(elements & 255), False)
            pixels = cross_colour(pixels, elements, shift, True)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
        else:
            found = to_palette(pixels)
            if found is None:
                raise ValueError("over 256 colours")
            pixels, palette = found
            out.put(len(palette) - 1, 8)
            write_image(out, _join(np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255)[None, :], False)
    out.put(0, 1)
    write_image(out, packed if pixels is None else _join(pixels), True, cache_bits, copies, even)
    body = out.finish()
    body += b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
