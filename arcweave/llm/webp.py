"""Lossless WebP (VP8L): an encoder of literal and repeated pixels, and a full decoder.

Pixels are rows of four bytes A, R, G, B.  decode() reads any VP8L stream:
prefix codes, meta codes, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms.  encode_many() and
decode_many() treat many images at once: images that hold literals only (what
encode_many() writes unless long runs repeat) are decoded in lockstep, one
pixel of every image at a step, with numpy.
"""

from __future__ import annotations

import heapq

import numpy as np

LIMIT = 12  # longest code that the encoder writes
LENGTHS, DISTANCES = 24, 40
#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
_REVERSED = np.array([int(f"{i:0{LIMIT}b}"[::-1], 2) for i in range(1 << LIMIT)])


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


class BitReader:
    def __init__(self, data: bytes):
        self.value, self.at, self.n = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.data = data

    def get(self, n: int) -> int:
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        return word & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7) & ((1 << n) - 1)


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of a complete prefix code for the symbols that occur, none over limit; counts are flattened until it fits."""
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    weights = [counts[i] for i in used]
    while True:
        m = len(used)
        parent = [0] * (2 * m - 1)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        for node in range(m, 2 * m - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node))
        depth = [0] * (2 * m - 1)
        for node in range(2 * m - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:m]) <= limit:
            for i, d in zip(used, depth[:m], strict=True):
                out[i] = d
            return out
        weights = [(w + 1) // 2 for w in weights] if max(weights) > 1 else weights


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code as its bits are sent, length)."""
    code, before, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, before = code + 1, n
    return out


def write_code(w: BitWriter, lengths: list[int]) -> None:
    """A prefix code's lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if not used or len(used) == 1 and used[0] < 256:
        s = used[0] if used else 0
        w.put(1, 1)
        w.put(0, 1)
        w.put(s > 1, 1)
        w.put(s, 8 if s > 1 else 1)
        return
    tokens, i, before = [], 0, 8
    end = used[-1] + 1
    while i < end:
        n, run = lengths[i], 1
        while i + run < end and lengths[i + run] == n:
            run += 1
        i += run
        if n:
            if n != before:
                tokens.append((n, 0, 0))
                before, run = n, run - 1
            while run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
                run -= k
            tokens += [(n, 0, 0)] * run
        else:
            while run >= 11:
                k = min(run, 138)
                tokens.append((18, k - 11, 7))
                run -= k
            if run >= 3:
                tokens.append((17, run - 3, 3))
                run = 0
            tokens += [(0, 0, 0)] * run
    counts = [0] * 19
    for t, *_ in tokens:
        counts[t] += 1
    outer = code_lengths(counts, 7)
    codes = canonical(outer)
    w.put(0, 1)
    last = max(i for i, s in enumerate(LENGTH_ORDER) if outer[s]) + 1
    w.put(max(last, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(last, 4)]:
        w.put(outer[s], 3)
    w.put(1, 1)
    bits = max(2, (len(tokens) - 2).bit_length() + (len(tokens) - 2).bit_length() % 2) if len(tokens) > 2 else 2
    w.put((bits - 2) // 2, 3)
    w.put(len(tokens) - 2, bits)
    alone = sum(c > 0 for c in counts) == 1
    for t, extra, n in tokens:
        if not alone:
            w.put(*codes[t])
        w.put(extra, n)


def prefixed(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


class Code:
    """A prefix code to read with."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        self.lengths = lengths
        self.longest = max((n for n, _ in used), default=0)
        if self.only is None and sum(2.0**-n for n, _ in used) != 1:
            raise ValueError("a prefix code is not complete")
        self.table = None

    def read(self, r: BitReader) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = {(n, c): s for s, (c, n) in canonical(self.lengths).items()}
            self.sizes = sorted({n for n, _ in self.table})
        word = r.peek(self.longest)
        for n in self.sizes:
            s = self.table.get((n, word & ((1 << n) - 1)))
            if s is not None:
                r.at += n
                return s
        raise ValueError("no such code")


def read_code(r: BitReader, symbols: int) -> Code:
    if r.get(1):
        lengths = [0] * symbols
        two = r.get(1)
        lengths[r.get(8 if r.get(1) else 1)] = 1
        if two:
            lengths[r.get(8)] = 1
        return Code(lengths)
    outer = [0] * 19
    for s in LENGTH_ORDER[: 4 + r.get(4)]:
        outer[s] = r.get(3)
    inner = Code(outer)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else symbols
    lengths, before = [], 8
    while len(lengths) < symbols and left:
        left -= 1
        t = inner.read(r)
        if t < 16:
            lengths.append(t)
            before = t or before
        elif t == 16:
            lengths += [before] * (3 + r.get(2))
        else:
            lengths += [0] * (3 + r.get(3) if t == 17 else 11 + r.get(7))
    if len(lengths) > symbols:
        raise ValueError("too many code lengths")
    return Code(lengths + [0] * (symbols - len(lengths)))


def read_codes(r: BitReader, cache_bits: int) -> list[Code]:
    """Five codes; a code whose bits repeat those of the one before is not built again."""
    out: list[Code] = []
    start = r.at
    for symbols in (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES):
        n = r.at - start
        if out and symbols == 256 and n > 16 and r.at + n <= r.n and not any(out[-1].lengths[256:]):
            mask = (1 << n) - 1
            if r.value >> start & mask == r.value >> r.at & mask:
                start, r.at = r.at, r.at + n
                out.append(out[-1])
                continue
        start = r.at
        out.append(read_code(r, symbols))
    return out


def value_of(prefix: int, r: BitReader) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + r.get(n) + 1


def read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (rows of A, R, G, B) of an entropy-coded image."""
    cache_bits = r.get(4) if r.get(1) else 0
    groups, tile, block = None, 0, 0
    if main and r.get(1):
        tile = r.get(3) + 2
        block = -(-width // (1 << tile))
        meta = read_image(r, block, -(-height // (1 << tile)), False)
        groups = (meta[:, 1].astype(int) << 8 | meta[:, 2]).tolist()
    codes = [read_codes(r, cache_bits) for _ in range(max(groups) + 1 if groups else 1)]
    total, out = width * height, []
    cache = [0] * (1 << cache_bits)
    current = codes[0]
    while len(out) < total:
        if groups:
            y, x = divmod(len(out), width)
            current = codes[groups[(y >> tile) * block + (x >> tile)]]
        green, red, blue, alpha, distance = current
        s = green.read(r)
        begin = len(out)
        if s < 256:
            a, b = red.read(r), blue.read(r)
            out.append(alpha.read(r) << 24 | a << 16 | s << 8 | b)
        elif s < 256 + LENGTHS:
            length = value_of(s - 256, r)
            d = value_of(distance.read(r), r)
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width)
            if d > begin or begin + length > total:
                raise ValueError("a back-reference leaves the image")
            if d >= length:
                out += out[begin - d : begin - d + length]
            else:
                period = out[begin - d :]
                out += (period * (length // d + 1))[:length]
        else:
            out.append(cache[s - 256 - LENGTHS])
        if cache_bits:
            for p in out[begin:]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, ">u4").view(np.uint8).reshape(-1, 4)


def average(a, b):
    return (a + b) >> 1


def predicted(mode: int, left, top, top_right, top_left):
    """The prediction of a pixel from four int arrays (A, R, G, B) by its neighbours."""
    if mode == 11:
        p = left + top - top_left
        return left if abs(p - left).sum() < abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = average(left, top)
        return np.clip(m + np.trunc((m - top_left) / 2).astype(int), 0, 255)
    return (
        lambda: np.array([255, 0, 0, 0]), lambda: left, lambda: top, lambda: top_right, lambda: top_left, lambda: average(average(left, top_right), top), lambda: average(left, top_left), lambda: average(left, top),
        lambda: average(top_left, top), lambda: average(top, top_right), lambda: average(average(left, top_left), average(top, top_right)), lambda: np.array([255, 0, 0, 0]), None, None, lambda: np.array([255, 0, 0, 0]), lambda: np.array([255, 0, 0, 0]),
    )[mode]()


def predict(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Add (sign 1, decoding) or subtract (-1, encoding) the predictions."""
    used = set((modes[:, 2] & 15).tolist())
    if used in ({1}, {2}):
        return predict_from_one(pixels, width, used == {2}, sign)
    out = pixels.astype(int)
    known = out if sign > 0 else pixels.astype(int)
    result = out if sign > 0 else out.copy()
    block = -(-width // (1 << bits))
    for i in range(width * height):
        y, x = divmod(i, width)
        if i == 0:
            p = np.array([255, 0, 0, 0])
        elif y == 0:
            p = known[i - 1]
        elif x == 0:
            p = known[i - width]
        else:
            p = predicted(int(modes[(y >> bits) * block + (x >> bits), 2]) & 15, known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        result[i] = (pixels[i].astype(int) + sign * p) & 255
    return result.astype(np.uint8)


def predict_from_one(pixels: np.ndarray, width: int, above: bool, sign: int) -> np.ndarray:
    """predict() where every block takes the pixel to the left, or the one above: differences, or running sums, of whole rows and columns."""
    grid = pixels.reshape(-1, width, 4)
    first = np.array([255, 0, 0, 0], np.uint8)
    if sign < 0:
        out = grid.copy()
        out[1:, 0] -= grid[:-1, 0]
        out[0, 1:] -= grid[0, :-1]
        out[0, 0] -= first
        if above:
            out[1:, 1:] -= grid[:-1, 1:]
        else:
            out[1:, 1:] -= grid[1:, :-1]
        return out.reshape(-1, 4)
    out = grid.copy()
    out[0, 0] += first
    if above:
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        return np.cumsum(out, axis=0, dtype=np.uint8).reshape(-1, 4)
    out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    return np.cumsum(out, axis=1, dtype=np.uint8).reshape(-1, 4)


def cross(pixels: np.ndarray, width: int, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Undo (sign 1) or do (-1) the cross-colour transform; a factor pixel holds red to blue, green to blue, green to red."""
    i = np.arange(len(pixels))
    f = factors[(i // width >> bits) * -(-width // (1 << bits)) + (i % width >> bits)].view(np.int8).astype(int)
    p = pixels.astype(int)
    signed = lambda v: ((v & 255) ^ 128) - 128
    green, red = signed(p[:, 2]), p[:, 1]
    new_red = red + sign * (f[:, 3] * green >> 5)
    of = signed(new_red if sign > 0 else red)
    out = p.copy()
    out[:, 1] = new_red & 255
    out[:, 3] = (p[:, 3] + sign * ((f[:, 2] * green >> 5) + (f[:, 1] * of >> 5))) & 255
    return out.astype(np.uint8)


def bundle_bits(colours: int) -> int:
    """Pixels share a byte, two to the power of this many, if the palette is small."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unbundle(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    k = bundle_bits(len(palette))
    each = 8 >> k
    packed = pixels[:, 2].reshape(height, -1)
    index = (packed[:, :, None] >> (np.arange(1 << k) * each)) & ((1 << each) - 1)
    index = index.reshape(height, -1)[:, :width].ravel()
    return np.vstack([palette, np.zeros((256, 4), np.uint8)])[index]


def parse(data: bytes) -> tuple[BitReader, int, int]:
    """The bit reader after the header, width and height."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    r = BitReader(data[20 : 20 + size])
    r.at = 8
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    return r, width, height


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """Pixels, width and height of any lossless WebP file."""
    r, width, height = parse(data)
    undo, w = [], width
    while r.get(1):
        kind = r.get(2)
        if kind in (PREDICTOR, CROSS):
            bits = r.get(3) + 2
            undo.append((kind, w, bits, read_image(r, -(-w // (1 << bits)), -(-height // (1 << bits)), False)))
        elif kind == GREEN:
            undo.append((kind, w, 0, None))
        else:
            n = r.get(8) + 1
            palette = np.cumsum(read_image(r, n, 1, False), axis=0, dtype=np.uint8)
            undo.append((kind, w, 0, palette))
            w = -(-w // (1 << bundle_bits(n)))
    pixels = read_image(r, w, height, True)
    for kind, w, bits, image in reversed(undo):
        if kind == PREDICTOR:
            pixels = predict(pixels, w, height, image, bits, 1)
        elif kind == CROSS:
            pixels = cross(pixels, w, image, bits, 1)
        elif kind == GREEN:
            pixels = pixels.copy()
            pixels[:, 1] += pixels[:, 2]
            pixels[:, 3] += pixels[:, 2]
        else:
            pixels = unbundle(pixels, w, height, image)
    return pixels, width, height


def tokens_of(values: list[int], cache_bits: int, repeats: bool) -> list[tuple]:
    """Literals ("p", pixel), back-references ("r", length, distance) and cache hits ("c", index)."""
    out, at, seen, cache = [], 0, {}, {}
    while at < len(values):
        length = 0
        if repeats and at + 3 <= len(values):
            before = seen.get(tuple(values[at : at + 3]))
            if before is not None:
                while at + length < len(values) and length < 4096 and values[before + length] == values[at + length]:
                    length += 1
        if length >= 3:
            out.append(("r", length, at - before))
        else:
            length = 1
            p = values[at]
            key = (CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            out.append(("c", key) if cache_bits and cache.get(key) == p else ("p", p))
        for i in range(at, at + length):
            if cache_bits:
                cache[(CACHE_MULTIPLIER * values[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[i]
            if repeats and i + 3 <= len(values):
                seen[tuple(values[i : i + 3])] = i
        at += length
    return out


def write_image(w: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0, repeats: bool = False) -> None:
    values = np.ascontiguousarray(pixels).view(">u4").ravel().tolist()
    tokens = tokens_of(values, cache_bits, repeats)
    counts = [[0] * (256 + LENGTHS + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * DISTANCES]
    for t in tokens:
        if t[0] == "p":
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                counts[k][t[1] >> shift & 255] += 1
        elif t[0] == "r":
            counts[0][256 + prefixed(t[1])[0]] += 1
            counts[4][prefixed(t[2] + len(NEAR))[0]] += 1
        else:
            counts[0][256 + LENGTHS + t[1]] += 1
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    lengths = [code_lengths(c, 15) for c in counts]
    for n in lengths:
        write_code(w, n)
    codes = [canonical(n) if sum(x > 0 for x in n) > 1 else {s: (0, 0) for s, x in enumerate(n) if x} for n in lengths]
    for t in tokens:
        if t[0] == "p":
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                w.put(*codes[k][t[1] >> shift & 255])
        elif t[0] == "r":
            for k, first, (prefix, extra, n) in ((0, 256, prefixed(t[1])), (4, 0, prefixed(t[2] + len(NEAR)))):
                w.put(*codes[k][first + prefix])
                w.put(extra, n)
        else:
            w.put(*codes[0][256 + LENGTHS + t[1]])


def file_of(bits: bytes) -> bytes:
    body = b"VP8L" + len(bits).to_bytes(4, "little") + bits + b"\0" * (len(bits) % 2)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def header(w: BitWriter, width: int, height: int) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)


def encode(pixels: np.ndarray, width: int, transforms: tuple[int, ...] = (), cache_bits: int = 0, repeats: bool = True, bits: int = 3, seed: int = 0, mode: int | None = None, factors: tuple[int, int, int] | None = None) -> bytes:
    """One image with the given transforms; mode, factors: the predictor and the colour factors of all blocks, else they are dealt out by the seed."""
    w, height = BitWriter(), len(pixels) // width
    header(w, width, height)
    r = np.random.Generator(np.random.PCG64(seed))
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        blocks = -(-width // (1 << bits)) * -(-height // (1 << bits))
        if kind in (PREDICTOR, CROSS):
            image = np.zeros((blocks, 4), np.uint8)
            image[:, 0] = 255
            if kind == PREDICTOR:
                image[:, 2] = r.integers(0, 14, blocks) if mode is None else mode
            else:
                image[:, 1:] = r.integers(0, 256, (blocks, 3)) if factors is None else factors
            w.put(bits - 2, 3)
            write_image(w, image, False)
            pixels = predict(pixels, width, height, image, bits, -1) if kind == PREDICTOR else cross(pixels, width, image, bits, -1)
        elif kind == GREEN:
            pixels = pixels.copy()
            pixels[:, 1] -= pixels[:, 2]
            pixels[:, 3] -= pixels[:, 2]
        else:
            palette, index = np.unique(pixels, axis=0, return_inverse=True)
            w.put(len(palette) - 1, 8)
            write_image(w, np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.uint8)), False)
            k = bundle_bits(len(palette))
            rows = np.zeros((height, -(-width // (1 << k)) << k), np.uint8)
            rows[:, :width] = index.reshape(height, width)
            rows = rows.reshape(height, -1, 1 << k) << (np.arange(1 << k) * (8 >> k)).astype(np.uint8)
            packed = rows.sum(2).astype(np.uint8).ravel()
            pixels = np.zeros((len(packed), 4), np.uint8)
            pixels[:, 0], pixels[:, 2] = 255, packed
            width = -(-width // (1 << k))
    w.put(0, 1)
    write_image(w, pixels, True, cache_bits, repeats)
    return file_of(w.bytes())


def coded_bits(values: np.ndarray) -> float:
    """Least bits of a prefix code of the values, with 6 for each distinct one."""
    counts = np.bincount(values.ravel(), minlength=256)
    counts = counts[counts > 0].astype(float)
    return float(counts.sum() * np.log2(counts.sum()) - (counts * np.log2(counts)).sum()) + 6 * len(counts)


#: Bits of a table of prefix codes beside its symbols; the part of the plain form's size that another form must stay below.
TABLES, GAIN = 400, 0.8
FEW, ALL = 64, 256


def form_of(pixels: np.ndarray, width: int) -> dict | None:
    """The form that encode() should give an image, by estimated size: None for plain literals, else its arguments.

    Weighed are a palette, the pixel above or to the left as predictor, less
    green, one channel from another by colour, the colour cache and
    back-references.  A form other than plain must save a fifth: it is written
    and read pixel by pixel, plain literals of many images at once.
    """
    if len(pixels) < FEW:
        return None
    plain = coded_bits(pixels)
    flat = np.ascontiguousarray(pixels).view("<u4").ravel()
    values, counts = np.unique(flat, return_counts=True)
    n, kinds = len(pixels), len(values)
    forms: list[tuple[float, int, dict]] = []

    def weigh(estimate: float, **form) -> None:
        forms.append((estimate + TABLES, len(forms), form))

    if kinds <= ALL:
        index = float(n * np.log2(n) - (counts * np.log2(counts)).sum())
        weigh(index + kinds * 30, transforms=(PALETTE,), repeats=False)
    weigh(kinds * 28 + (n - kinds) * np.log2(kinds + 1), cache_bits=min(11, max(4, kinds.bit_length())), repeats=False)
    if kinds <= n // 4:
        runs = flat[:-2] * np.uint32(0x9E3779B1) + flat[1:-1] * np.uint32(0x85EBCA6B) + flat[2:]
        weigh(len(np.unique(runs)) * 30, repeats=True)  # a run of three seen before is a back-reference
    by_channel = [coded_bits(pixels[:, k]) for k in range(4)]
    for mode in (1, 2):
        rest = predict_from_one(pixels, width, mode == 2, -1)
        weigh(sum(coded_bits(rest[:, k]) for k in range(4)), transforms=(PREDICTOR,), mode=mode, bits=9, repeats=False)
    lessened = [coded_bits(pixels[:, k] - pixels[:, j]) for k, j in ((1, 2), (3, 2), (3, 1))]  # red and blue less green, blue less red
    weigh(by_channel[0] + by_channel[2] + lessened[0] + lessened[1], transforms=(GREEN,), repeats=False)
    for factors, red, blue in (((0, 0, 32), lessened[0], by_channel[3]), ((0, 32, 0), by_channel[1], lessened[1]), ((32, 0, 0), by_channel[1], lessened[2])):
        weigh(by_channel[0] + by_channel[2] + red + blue, transforms=(CROSS,), factors=factors, bits=9, repeats=False)
    least, _, form = min(forms, key=lambda f: f[:2])
    return form if least < GAIN * plain else None


def encode_many(images: list[np.ndarray], width: int) -> list[bytes]:
    """Each image in the form that form_of() chooses; those of plain literals, under one prefix code each, all at once."""
    out: list[bytes | None] = [None] * len(images)
    plain = []
    for i, p in enumerate(images):
        form = form_of(p, width)
        if form is None:
            plain.append(i)
        else:
            out[i] = encode(p, width, **form)
    if not plain:
        return out
    sizes = np.array([len(images[i]) for i in plain])
    flat = np.concatenate([images[i] for i in plain])[:, [2, 1, 3, 0]]
    of = np.repeat(np.arange(len(plain)), sizes)
    counts = np.bincount((of[:, None] * 256 + flat).ravel(), minlength=256 * len(plain)).reshape(-1, 256)
    lengths, codes = np.zeros((len(plain), 256), np.uint64), np.zeros((len(plain), 256), np.uint64)
    heads = []
    for row in range(len(plain)):
        n = code_lengths(counts[row].tolist(), LIMIT)
        w = BitWriter()
        header(w, width, int(sizes[row]) // width)
        w.put(0, 3)  # no transform, no cache, no meta codes
        one = BitWriter()
        write_code(one, n)
        for _ in range(4):
            w.put(one.value, one.n)
        write_code(w, [0] * DISTANCES)
        heads.append(w)
        if sum(x > 0 for x in n) > 1:
            lengths[row] = n
            found = canonical(n)
            codes[row, list(found)] = [c for c, _ in found.values()]
    n, c = lengths[of[:, None], flat], codes[of[:, None], flat]
    value, total = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.uint64)
    for k in range(4):
        value |= c[:, k] << total
        total += n[:, k]
    ends = np.cumsum(total)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = ends - total - np.repeat(ends[first] - total[first], sizes)
    head_bits = np.array([w.n for w in heads], np.uint64)
    bits = head_bits + np.add.reduceat(total, first)
    words = -(-bits.astype(np.int64) // 64) + 1
    base = np.concatenate([[0], np.cumsum(words)[:-1]])
    at = inside + np.repeat(head_bits + base.astype(np.uint64) * np.uint64(64), sizes)
    buffer = np.zeros(int(words.sum()) + 1, np.uint64)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    starts = np.flatnonzero(np.append(True, np.diff(word) > 0))
    buffer[word[starts]] |= np.bitwise_or.reduceat(value << shift, starts)
    high = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    buffer[word[starts] + 1] |= np.bitwise_or.reduceat(high, starts)
    data = bytearray(buffer.tobytes())
    for row, i in enumerate(plain):
        start, size = 8 * int(base[row]), -(-int(bits[row]) // 8)
        own = heads[row].bytes()
        last = data[start + len(own) - 1]
        data[start : start + len(own)] = own
        data[start + len(own) - 1] |= last
        out[i] = file_of(bytes(data[start : start + size]))
    return out


def decode_many(files: list[bytes], lanes: int = 1024) -> list[np.ndarray]:
    """Pixels of each file."""
    out: list[np.ndarray | None] = [None] * len(files)
    plain = []
    for i, data in enumerate(files):
        r, width, height = parse(data)
        if r.get(3) == 0:
            codes = read_codes(r, 0)
            if all(c.longest <= LIMIT for c in codes[:4]) and not any(codes[0].lengths[256:]) and all(c is codes[0] or c.lengths == codes[0].lengths[:256] for c in codes[1:4]):
                plain.append((width * height, i, r, codes[0]))
                continue
        out[i] = decode(data)[0]
    plain.sort(key=lambda x: (-x[0], x[1]))
    for k in range(0, len(plain), lanes):
        _lockstep(plain[k : k + lanes], out)
    return out


def _lockstep(images: list, out: list) -> None:
    m = len(images)
    table = np.zeros((m, 1 << LIMIT), np.uint16)
    blobs, at, base = [], np.zeros(m, np.int64), 0
    for lane, (_, _, r, code) in enumerate(images):
        if code.only is not None:
            table[lane] = code.only
        else:
            n = np.array(code.lengths[:256])
            order = np.lexsort((np.arange(256), n))
            order = order[n[order] > 0]
            table[lane] = np.repeat(order | n[order] << 8, 1 << (LIMIT - n[order]))[_REVERSED]
        at[lane] = 8 * base + r.at
        blobs.append(r.data)
        base += len(r.data)
    data = b"".join(blobs) + b"\0" * 16
    words = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
    flat = table.ravel()
    sizes = np.array([x[0] for x in images])
    pixels = np.empty((int(sizes[0]), m, 4), np.uint8)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left").tolist()  # lanes with more pixels than that
    mask = np.uint64((1 << LIMIT) - 1)
    row = np.arange(m, dtype=np.uint64) << np.uint64(LIMIT)
    for step, n in enumerate(active):
        pos = at[:n]
        w = words[pos >> 3] >> (pos & 7).astype(np.uint64)
        mine = row[:n]
        line = pixels[step]
        for k in (2, 1, 3, 0):
            e = flat[(w & mask) | mine]
            line[:n, k] = e
            size = e >> 8
            w >>= size.astype(np.uint64)
            pos += size
    for lane, (size, i, *_) in enumerate(images):
        out[i] = np.ascontiguousarray(pixels[:size, lane])
