"""Codecs between bytes and pixels, in zlib and numpy: PNG, JPEG (baseline and progressive are read, baseline is written),
lossless WebP (any is read). What a codec cannot read or write is a ``CodecError``, which becomes the row's error; no other
format steps in. Pillow is asked only where that is asked for, so results do not depend on what a worker has installed.
Images of over ``MAX_PIXELS`` pixels are refused, as a few bytes can claim to hold any number.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MAX_PIXELS = 1 << 26


class CodecError(ValueError):
    pass


def sniff(data: bytes) -> str | None:
    if len(data) < 12:
        return None
    if data[:3] == b"\xff\xd8\xff":
        return "jpg"
    if data[:4] == SIGNATURE[:4]:
        return "png"
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


# PNG


def encode_png(image: np.ndarray) -> bytes:
    h, w, channels = image.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    rows = np.zeros((h, 1 + w * channels), np.uint8)
    flat = image.reshape(h, w * channels)
    rows[1:, 0], rows[0, 1:] = 2, flat[0]  # each row as its difference from the one above
    rows[1:, 1:] = flat[1:] - flat[:-1]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of filter kind and bytes, to bytes. Runs of rows of the first three kinds go row by row; others go along
    diagonals, of which each needs only what the two before it hold."""
    kinds, h, w = rows[:, 0], len(rows), (rows.shape[1] - 1) // step
    if (kinds > 4).any():
        raise CodecError("png: unknown filter")
    out = np.zeros((h + 1, w + 1, step), np.uint8)  # with an empty row above and an empty column to the left
    lines = rows[:, 1:].reshape(h, w, step)
    y = 0
    while y < h:
        if kinds[y] < 3:
            line = lines[y]
            out[y + 1, 1:] = line if kinds[y] == 0 else np.cumsum(line, 0, dtype=np.uint8) if kinds[y] == 1 else line + out[y, 1:]
            y += 1
            continue
        end = y + int(np.append(kinds[y:] < 3, True).argmax())
        for t in range(w + end - y - 1):
            r = np.arange(max(0, t - w + 1), min(end - y, t + 1))
            x, r = t - r, r + y
            a, b, c = (out[r + i, x + j].astype(np.int16) for i, j in ((1, 0), (0, 1), (0, 0)))
            far = [np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)]
            nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), a, np.where(far[1] <= far[2], b, c))
            guess = np.where((kinds[r] == 3)[:, None], (a + b) >> 1, nearest)
            out[r + 1, x + 1] = (lines[r, x] + guess) & 255
        y = end
    return out[1:, 1:].reshape(h, w * step)


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != SIGNATURE:
        raise CodecError("png: no signature")
    at, body, head, palette, alpha = 8, b"", None, None, None
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) != size or zlib.crc32(name + part) != struct.unpack_from(">I", data.ljust(at + 12 + size), at + 8 + size)[0]:
            raise CodecError("png: broken chunk")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif name == b"IDAT":
            body += part
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise CodecError("png: no header")
    w, h, depth, kind, _, _, laced = head
    if depth not in (8, 16) or laced or kind not in (0, 2, 3, 4, 6) or not 0 < w * h <= MAX_PIXELS:
        raise CodecError("png: unsupported layout")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step = channels * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise CodecError(f"png: {e}") from e
    if len(raw) != h * (1 + w * step):
        raise CodecError("png: wrong data length")
    image = _unfiltered(raw.reshape(h, -1), step).reshape(h, w, channels, depth // 8)[..., 0]
    if kind == 3:
        if palette is None or image.max() >= len(palette):
            raise CodecError("png: no such colour")
        full = np.full(len(palette), 255, np.uint8)
        if alpha is not None:
            full[: len(alpha)] = alpha
            return np.dstack([palette[image[..., 0]], full[image[..., 0]]])
        return palette[image[..., 0]]
    return np.ascontiguousarray(image)


# JPEG, baseline

#: The example quantisation tables of the JPEG standard, row by row.
LUMA_STEPS = """
16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99
"""
CHROMA_STEPS = """
17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99
"""
QUALITY = 75
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def _steps(text: str, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(text.split(), int) * scale + 50) // 100, 1, 255)


def _huffman(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """Code counts by length (16 of them) and symbols by code, from how often symbols occur; no code is all ones."""
    import heapq

    present = np.flatnonzero(counts)
    heap = [(int(counts[s]), i, [int(s)]) for i, s in enumerate(present)] + [(0, 10_000, [-1])]  # -1 takes the code of ones
    heapq.heapify(heap)
    length = dict.fromkeys([-1, *map(int, present)], 0)
    serial = 20_000
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        serial += 1
        heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
    bits = [0] * (max(length.values()) + 2)
    for n in length.values():
        bits[n] += 1
    for n in range(len(bits) - 1, 16, -1):  # codes over 16 bits are moved up, as the standard shows
        while bits[n] > 0:
            j = n - 2
            while not bits[j]:
                j -= 1
            bits[n] -= 2
            bits[n - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    bits = (bits + [0] * 17)[:17]
    bits[max(n for n in range(17) if bits[n])] -= 1
    order = sorted((s for s in length if s >= 0), key=lambda s: (length[s], -int(counts[s]), s))
    return bits[1:], order


def _codes(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for n, many in enumerate(bits, 1):
        for _ in range(many):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _ycc(image: np.ndarray) -> np.ndarray:
    r, g, b = (image[..., c].astype(float) for c in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.dstack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402])


def encode_jpeg(image: np.ndarray, quality: int = QUALITY) -> bytes:
    """Baseline, full-resolution chroma, Huffman codes made for the image. Alpha falls away."""
    planes = image[..., :1].astype(float) if image.shape[2] < 3 else _ycc(image)
    h, w, n = planes.shape
    padded = np.pad(planes, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8, n).transpose(0, 2, 4, 1, 3)
    tables = [_steps(LUMA_STEPS, quality), _steps(CHROMA_STEPS, quality)]
    freq = DCT @ blocks @ DCT.T
    steps = np.stack([tables[c > 0].reshape(8, 8) for c in range(n)])
    coded = np.rint(freq / steps).astype(int).reshape(-1, n, 64)[:, :, ZIGZAG]
    coded[:, :, 0] = np.diff(coded[:, :, 0], axis=0, prepend=0)
    runs: list[tuple[int, int, int, int]] = []  # table, symbol, value, bits
    for block in coded:
        for c in range(n):
            own = block[c]
            size = int(abs(int(own[0]))).bit_length()
            runs.append((2 * (c > 0), size, int(own[0]), size))
            last = 0
            for k in np.flatnonzero(own[1:]) + 1:
                gap = int(k) - last - 1
                while gap > 15:
                    runs.append((2 * (c > 0) + 1, 0xF0, 0, 0))
                    gap -= 16
                size = int(abs(int(own[k]))).bit_length()
                runs.append((2 * (c > 0) + 1, gap << 4 | size, int(own[k]), size))
                last = int(k)
            if last != 63:
                runs.append((2 * (c > 0) + 1, 0, 0, 0))
    counts = np.zeros((4, 256), int)
    for t, s, _, _ in runs:
        counts[t, s] += 1
    huff = [_huffman(counts[t]) for t in range(4 if n == 3 else 2)]
    codes = [_codes(*x) for x in huff]
    acc, held, out = 0, 0, bytearray()
    for t, s, value, size in runs:
        code, bits = codes[t][s]
        acc = acc << bits | code
        if size:
            acc = acc << size | (value if value > 0 else value + (1 << size) - 1)
        held += bits + size
        while held >= 8:
            byte = acc >> (held - 8) & 255
            out.append(byte)
            if byte == 255:
                out.append(0)
            held -= 8
        acc &= (1 << held) - 1
    if held:
        byte = (acc << (8 - held) | (1 << (8 - held)) - 1) & 255
        out += bytes([byte, 0]) if byte == 255 else bytes([byte])
    seg = lambda m, body: struct.pack(">BBH", 255, m, len(body) + 2) + body
    parts = [b"\xff\xd8", seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    parts += [seg(0xDB, bytes([t]) + bytes(tables[t][ZIGZAG].tolist())) for t in range(2 if n == 3 else 1)]
    parts.append(seg(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, int(c > 0)]) for c in range(n))))
    parts += [seg(0xC4, bytes([(t % 2) << 4 | t // 2]) + bytes(bits) + bytes(symbols)) for t, (bits, symbols) in enumerate(huff)]
    parts.append(seg(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0x11 if c else 0]) for c in range(n)) + b"\x00\x3f\x00"))
    return b"".join(parts) + bytes(out) + b"\xff\xd9"


class _Scan:
    """The entropy-coded bits of a scan."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.acc, self.held = data, at, 0, 0

    def bits(self, n: int) -> int:
        while self.held < n:
            byte = self.data[self.at]
            if byte == 255:
                if self.data[self.at + 1]:
                    raise CodecError("jpeg: the scan ends early")
                self.at += 1
            self.acc, self.held, self.at = (self.acc << 8 | byte) & 0xFFFFFFFFFF, self.held + 8, self.at + 1
        self.held -= n
        return self.acc >> self.held & ((1 << n) - 1)

    def symbol(self, tree: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits(1)
            if (s := tree.get((n, code))) is not None:
                return s
        raise CodecError("jpeg: no such code")

    def value(self, n: int) -> int:
        v = self.bits(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def restart(self) -> None:
        self.held = 0
        if self.data[self.at] != 255 or not 0xD0 <= self.data[self.at + 1] <= 0xD7:
            raise CodecError("jpeg: no restart marker")
        self.at += 2


class _Part:
    """A component: sampling, quantisation table, coefficients (block rows, block columns, 64) in coded order."""

    def __init__(self, name: int, across: int, down: int, table: int) -> None:
        self.name, self.across, self.down, self.table, self.before = name, across, down, table, 0


def decode_jpeg(data: bytes) -> np.ndarray:
    """Baseline and progressive, any sampling, restart markers; gray or three channels."""
    try:
        return _jpeg(data)
    except (IndexError, KeyError, struct.error, TypeError) as e:
        raise CodecError(f"jpeg: cut short or broken ({type(e).__name__})") from e


def _jpeg(data: bytes) -> np.ndarray:
    steps, trees, parts, restart, at, size, progressive, scans = {}, {}, [], 0, 2, (0, 0), False, 0
    while True:
        while at < len(data) and (data[at] != 255 or data[at + 1] in (0, 255)):  # fill bytes, and what a scan left
            at += 1
        if at >= len(data) and scans:
            break
        mark = data[at + 1]
        if mark == 0xD9:
            break
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xDB:
            while body:
                wide, t = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                steps[t], body = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(int), body[1 + n :]
        elif mark == 0xC4:
            while body:
                bits = list(body[1:17])
                n = sum(bits)
                if len(set(body[17 : 17 + n])) != n:
                    raise CodecError("jpeg: a symbol has two codes")
                trees[body[0]] = {(length, code): s for s, (code, length) in _codes(bits, list(body[17 : 17 + n])).items()}
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not 0 < h * w <= MAX_PIXELS or parts:
                raise CodecError("jpeg: unsupported frame")
            progressive, size = mark == 0xC2, (h, w)
            parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            wide, tall = max(p.across for p in parts), max(p.down for p in parts)
            units = -(-h // (8 * tall)), -(-w // (8 * wide))
            for p in parts:
                p.coded = np.zeros((units[0] * p.down, units[1] * p.across, 64), np.int32)
                p.own = -(-(-(-h * p.down // tall)) // 8), -(-(-(-w * p.across // wide)) // 8)
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise CodecError("jpeg: only baseline and progressive are supported")
        elif mark == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif mark == 0xDA:
            if not parts:
                raise CodecError("jpeg: no frame")
            named = {p.name: p for p in parts}
            uses = [(named[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            band = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            at = _scanned(_Scan(data, at), uses, trees, restart, units, progressive, band[0], band[1] if progressive else 63, band[2] >> 4, band[2] & 15)
            scans += 1
            if not progressive and scans and sum(p.coded.any() for p in parts) == len(parts):
                break
    if not scans:
        raise CodecError("jpeg: no scan")
    h, w = size
    zig, full = np.argsort(ZIGZAG), []
    for p in parts:
        rows, columns = p.coded.shape[:2]
        block = (p.coded * steps[p.table])[:, :, zig].reshape(rows, columns, 8, 8).astype(float)
        plane = (DCT.T @ block @ DCT + 128).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        full.append(np.repeat(np.repeat(plane, tall // p.down, 0), wide // p.across, 1)[:h, :w])
    if len(full) == 1:
        out = full[0][..., None]
    else:
        y, cb, cr = full
        r, b = y + 1.402 * (cr - 128), y + 1.772 * (cb - 128)
        out = np.dstack([r, (y - 0.299 * r - 0.114 * b) / 0.587, b])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _scanned(scan: _Scan, uses: list, trees: dict, restart: int, units: tuple[int, int], progressive: bool, first: int, last: int, high: int, low: int) -> int:
    """Reads a scan into the components' coefficients; returns where it ends."""
    if len(uses) == 1:  # blocks of one component stand one by one, without the padding of units
        part, tables = uses[0]
        places = [[(part, tables, y, x)] for y in range(part.own[0]) for x in range(part.own[1])]
    else:
        places = [[(p, t, uy * p.down + y, ux * p.across + x) for p, t in uses for y in range(p.down) for x in range(p.across)] for uy in range(units[0]) for ux in range(units[1])]
    for p, _ in uses:
        p.before = 0
    run = 0
    for unit, blocks in enumerate(places):
        if restart and unit and unit % restart == 0:
            scan.restart()
            run = 0
            for p, _ in uses:
                p.before = 0
        for part, tables, y, x in blocks:
            block = part.coded[y, x]
            if first == 0:
                if high:
                    block[0] |= scan.bits(1) << low
                else:
                    part.before += scan.value(scan.symbol(trees[tables >> 4]))
                    block[0] = part.before * (1 << low)
            if last:
                ac, k = trees[0x10 | tables & 15], max(first, 1)
                run = _refined(scan, block, ac, k, last, low, run) if high else _coefficients(scan, block, ac, k, last, low, run, progressive)
    return scan.at


def _coefficients(scan: _Scan, block: np.ndarray, tree: dict, k: int, last: int, low: int, run: int, progressive: bool) -> int:
    """A block's coefficients from ``k`` on; the blocks that are still empty after it."""
    if run:
        return run - 1
    while k <= last:
        s = scan.symbol(tree)
        gap, n = s >> 4, s & 15
        if not n:
            if gap == 15:
                k += 16
                continue
            return (1 << gap) - 1 + (scan.bits(gap) if gap else 0) if progressive else 0
        k += gap
        block[k] = scan.value(n) * (1 << low)
        k += 1
    return 0


def _refined(scan: _Scan, block: np.ndarray, tree: dict, k: int, last: int, low: int, run: int) -> int:
    """One more bit of a block's coefficients; the blocks that get no new ones after it."""
    one = 1 << low

    def correct(i: int) -> None:
        if scan.bits(1) and not abs(int(block[i])) & one:
            block[i] += one if block[i] > 0 else -one

    if not run:
        while k <= last:
            s = scan.symbol(tree)
            gap, new = s >> 4, 0
            if s & 15:
                new = one if scan.bits(1) else -one
            elif gap < 15:
                run = (1 << gap) + (scan.bits(gap) if gap else 0)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif gap == 0:
                    break
                else:
                    gap -= 1
                k += 1
            if new:
                block[k] = new
            k += 1
    if run:
        for i in range(k, last + 1):
            if block[i]:
                correct(i)
        run -= 1
    return run


# WebP, lossless

#: In which order the lengths of code lengths stand.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Short distances by code: places above and to the left, nearest first.
NEAR = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
LONGEST_RUN = 4096


def _lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits (1 for a lone symbol, though it takes none); where they would be
    longer, counts are evened out until they fit."""
    import heapq

    counts = counts.astype(np.int64)
    if (counts > 0).sum() == 1:
        return (counts > 0).astype(np.int64)
    while True:
        used, out = np.flatnonzero(counts), np.zeros(len(counts), np.int64)
        heap = [(int(counts[s]), int(s), [int(s)]) for s in used]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            out[a[2] + b[2]] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if out.max(initial=0) <= most:
            return out
        counts[used] = counts[used] // 2 + 1


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, its first bit lowest."""
    out, code = np.zeros(len(lengths), np.int64), 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        for s in np.flatnonzero(lengths == n):
            out[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
        code <<= 1
    return out


def _spoken(lengths: np.ndarray) -> list[tuple[int, int]]:
    """The fields (value, bits) that tell a code."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        s = int(used[0]) if len(used) else 0
        return [(1, 1), (0, 1), (int(s > 1), 1), (s, 8 if s > 1 else 1)]
    said: list[tuple[int, int, int]] = []  # symbol, extra value, its bits
    i = 0
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i] and n < 138:
            n += 1
        if lengths[i] == 0 and n >= 3:
            said.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
        else:
            n = 1
            said.append((int(lengths[i]), 0, 0))
        i += n
    counts = np.bincount([s for s, _, _ in said], minlength=19)
    own = _lengths(counts, 7)
    codes, last = _canonical(own), max(i for i, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    last = max(last, 4)
    out = [(0, 1), (last - 4, 4), *[(int(own[s]), 3) for s in LENGTH_ORDER[:last]], (0, 1)]
    lone = (own > 0).sum() < 2
    for s, value, bits in said:
        out += [(int(codes[s]), 0 if lone else int(own[s])), (value, bits)]
    return out


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra values and their bits of lengths or distances."""
    d = values - 1
    top = np.floor(np.log2(np.maximum(d, 1))).astype(np.int64)
    extra = np.where(d < 4, 0, top - 1)
    return np.where(d < 4, d, 2 * top + (d >> np.maximum(top - 1, 0) & 1)), d & ((1 << extra) - 1), extra


def _packed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fields one after another, as bits."""
    starts = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(sizes)), sizes)
    return (values[which] >> (np.arange(len(which)) - starts[which]) & 1).astype(np.uint8)


def _guesses(x: np.ndarray) -> dict[int, np.ndarray]:
    """What some of the predictors expect at each pixel, by mode; on the edges what the format says."""
    left, top, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], top[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    toward_left = np.abs(top.astype(int) - corner).sum(2) < np.abs(left.astype(int) - corner).sum(2)
    modes = {1: left, 2: top, 7: ((left.astype(int) + top) >> 1).astype(np.uint8), 11: np.where(toward_left[..., None], left, top), 12: np.clip(left.astype(int) + top - corner, 0, 255).astype(np.uint8)}
    for guess in modes.values():
        guess[0, 1:], guess[1:, 0], guess[0, 0] = left[0, 1:], top[1:, 0], [0, 0, 0, 255]
    return modes


def encode_webp(image: np.ndarray) -> bytes:
    """Green is taken from red and blue, each pixel is predicted from its neighbours by whichever of five modes leaves
    least, equal neighbours become runs, and all is coded by Huffman codes of its own."""
    h, w, channels = image.shape
    if not (0 < w <= 16384 and 0 < h <= 16384):
        raise CodecError("webp: size out of range")
    rgb = np.repeat(image[..., :1], 3, 2) if channels < 3 else image[..., :3]
    alpha = image[..., -1:] if channels in (2, 4) else np.full((h, w, 1), 255, np.uint8)
    x = np.concatenate([rgb, alpha], 2)
    x[..., 0] -= x[..., 1]
    x[..., 2] -= x[..., 1]
    left = {m: x - g for m, g in _guesses(x).items()}
    mode = min(left, key=lambda m: int(np.abs(left[m].view(np.int8).astype(int)).sum()))
    flat = left[mode].reshape(-1, 4)
    # Tokens: literals, and runs of the pixel before (distance code 2).
    same = np.zeros(len(flat), bool)
    same[1:] = (flat[1:] == flat[:-1]).all(1)
    begin = np.flatnonzero(np.diff(np.concatenate([[False], same])) & same)
    size = np.diff(np.append(begin, 0))[:0] if not len(begin) else np.array([int(np.append(same[b:], False).argmin()) for b in begin])
    begin, size = begin[size >= 4], size[size >= 4]
    run = np.zeros(len(flat), np.int64)
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        run[b : b + n] = -1
        run[np.arange(b, b + n, LONGEST_RUN)] = np.minimum(LONGEST_RUN, b + n - np.arange(b, b + n, LONGEST_RUN))
    token = np.flatnonzero(run >= 0)
    run, literal = run[token], flat[token].astype(np.int64)
    is_run = run > 0
    symbol, extra, extra_bits = _prefixed(np.where(is_run, run, 1))
    green = np.where(is_run, LITERALS + symbol, literal[:, 1])
    alphabets = [(green, LITERALS + LENGTHS), (literal[~is_run, 0], 256), (literal[~is_run, 2], 256), (literal[~is_run, 3], 256), (np.full(int(is_run.sum()), 1), DISTANCES)]
    lengths = [_lengths(np.bincount(v, minlength=n), 15) for v, n in alphabets]
    codes, told = [_canonical(n) for n in lengths], [n * ((n > 0).sum() > 1) for n in lengths]
    head: list[tuple[int, int]] = [(w - 1, 14), (h - 1, 14), (int(channels in (2, 4)), 1), (0, 3)]
    head += [(1, 1), (2, 2), (1, 1), (0, 2), (7, 3), (0, 1)]  # subtract green; predictor, in blocks of 512, no colour cache
    for value in (mode, 0, 0, 0, 0):  # every block has the one mode
        lone = np.zeros(256, np.int64)
        lone[value] = 1
        head += _spoken(lone)
    head += [(0, 1), (0, 1), (0, 1)]  # no more transforms, no colour cache, one group of codes
    for n in lengths:
        head += _spoken(n)
    value, bits = np.zeros((len(token), 4), np.int64), np.zeros((len(token), 4), np.int64)
    value[:, 0], bits[:, 0] = codes[0][green], told[0][green]
    for k, c in ((1, 0), (2, 2), (3, 3)):
        own = literal[:, c]
        value[:, k], bits[:, k] = codes[k][own], told[k][own]
    value[is_run, 1], bits[is_run, 1] = extra[is_run], extra_bits[is_run]
    value[is_run, 2], bits[is_run, 2] = codes[4][1], told[4][1]
    bits[is_run, 3] = 0
    every = np.array(head, np.int64)
    packed = np.concatenate([_packed(every[:, 0], every[:, 1]), _packed(value.ravel(), bits.ravel())])
    data = b"\x2f" + np.packbits(packed, bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


class _Lossless:
    """A reader of the lossless format."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + bytes(16), 0
        self.end = 8 * len(data)

    def bits(self, n: int) -> int:
        out = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise CodecError("webp: cut short")
        return out

    def code(self, alphabet: int) -> tuple[int, list[tuple[int, int]]]:
        """A code as (bits to look at, (bits, symbol) by what these say)."""
        lengths = np.zeros(alphabet, np.int64)
        if self.bits(1):
            two, wide = self.bits(1), self.bits(1)
            for n in [8 if wide else 1, 8][: 1 + two]:
                lengths[self.bits(n)] = 1
        else:
            own = np.zeros(19, np.int64)
            for s in LENGTH_ORDER[: 4 + self.bits(4)]:
                own[s] = self.bits(3)
            left = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else alphabet
            look, table, i, before = *self.table(own), 0, 8
            while i < alphabet and left:
                left -= 1
                n, s = table[self.peek(look)]
                self.at += n
                if s < 16:
                    lengths[i] = s
                    before, i = s or before, i + 1
                else:
                    many = self.bits((2, 3, 7)[s - 16]) + (3, 3, 11)[s - 16]
                    if i + many > alphabet:
                        raise CodecError("webp: too many code lengths")
                    lengths[i : i + many] = before if s == 16 else 0
                    i += many
        return self.table(lengths)

    def table(self, lengths: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            return 0, [(0, int(used[0]))]
        look = int(lengths.max(initial=0))
        if not len(used) or (2.0 ** -lengths[used]).sum() != 1:
            raise CodecError("webp: not a whole code")
        out: list[tuple[int, int]] = [(0, 0)] * (1 << look)
        for s, c in zip(used.tolist(), _canonical(lengths)[used].tolist(), strict=True):
            n = int(lengths[s])
            for v in range(c, 1 << look, 1 << n):
                out[v] = (n, s)
        return look, out

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7) & ((1 << n) - 1)

    def symbol(self, code: tuple) -> int:
        n, s = code[1][self.peek(code[0])]
        self.at += n
        if self.at > self.end:
            raise CodecError("webp: cut short")
        return s

    def value(self, symbol: int) -> int:
        if symbol < 4:
            return symbol + 1
        extra = (symbol - 2) >> 1
        return ((2 + (symbol & 1)) << extra) + self.bits(extra) + 1

    def image(self, w: int, h: int, outermost: bool) -> np.ndarray:
        """Entropy-coded pixels as numbers, alpha, red, green and blue from the top."""
        cache_bits = self.bits(4) if self.bits(1) else 0
        if cache_bits > 11:
            raise CodecError("webp: colour cache too large")
        shift, groups = 0, np.zeros((1, 1), np.int64)
        if outermost and self.bits(1):
            shift = self.bits(3) + 2
            groups = self.image((w + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF
        cache, alphabets = [0] * (1 << cache_bits), [LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES]
        codes = [[self.code(n) for n in alphabets] for _ in range(int(groups.max()) + 1)]
        out, at, total, kept = [0] * (w * h), 0, w * h, 0
        while at < total:
            green, red, blue, alpha, far = codes[int(groups[(at // w) >> shift, (at % w) >> shift])] if shift else codes[0]
            s = self.symbol(green)
            if s < LITERALS:
                r, b, a = self.symbol(red), self.symbol(blue), self.symbol(alpha)
                out[at] = a << 24 | r << 16 | s << 8 | b
                at += 1
            elif s < LITERALS + LENGTHS:
                n = self.value(s - LITERALS)
                d = self.value(self.symbol(far))
                if d > len(NEAR):
                    d -= len(NEAR)
                else:
                    x, y = NEAR[d - 1]
                    d = max(x + y * w, 1)
                if d > at or at + n > total:
                    raise CodecError("webp: a copy out of range")
                for i in range(at, at + n):
                    out[i] = out[i - d]
                at += n
            else:
                for c in out[kept:at]:
                    cache[(c * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = c
                kept = at
                out[at] = cache[s - LITERALS - LENGTHS]
                at += 1
        return np.array(out, np.uint32).reshape(h, w)


def _channels(x: np.ndarray) -> np.ndarray:
    """Red, green, blue and alpha of pixels that are numbers."""
    return np.stack([x >> 16 & 255, x >> 8 & 255, x & 255, x >> 24], -1).astype(np.uint8)


def _unpredicted(x: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    h, w = x.shape[:2]
    x = x.astype(int).tolist()
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    halfway = lambda a, b: [(i + j) >> 1 for i, j in zip(a, b, strict=True)]
    for y in range(h):
        for k in range(w):
            here = x[y][k]
            if not y or not k:
                guess = [0, 0, 0, 255] if not y and not k else x[y][k - 1] if not y else x[y - 1][k]
            else:
                left, top, corner = x[y][k - 1], x[y - 1][k], x[y - 1][k - 1]
                right = x[y - 1][k + 1] if k + 1 < w else x[y][0]
                m = int(modes[y >> shift, k >> shift])
                if m == 11:
                    guess = left if sum(abs(i - j) for i, j in zip(top, corner, strict=True)) < sum(abs(i - j) for i, j in zip(left, corner, strict=True)) else top
                elif m == 12:
                    guess = [clamp(i + j - c) for i, j, c in zip(left, top, corner, strict=True)]
                elif m == 13:
                    guess = [clamp(i + int((i - c) / 2)) for i, c in zip(halfway(left, top), corner, strict=True)]
                else:
                    guess = (
                        [0, 0, 0, 255] if m in (0, 14, 15) else left if m == 1 else top if m == 2 else right if m == 3 else corner if m == 4
                        else halfway(halfway(left, right), top) if m == 5 else halfway(left, corner) if m == 6 else halfway(left, top) if m == 7
                        else halfway(corner, top) if m == 8 else halfway(top, right) if m == 9 else halfway(halfway(left, corner), halfway(top, right))
                    )
            x[y][k] = [(i + j) & 255 for i, j in zip(here, guess, strict=True)]
    return np.array(x, np.uint8)


def decode_webp(data: bytes) -> np.ndarray:
    """Any lossless file of one image; lossy ones and animations are refused."""
    at, body = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            break
        if name in (b"VP8 ", b"ANIM", b"ANMF"):
            raise CodecError("webp: only lossless still images are supported")
        at += 8 + size + size % 2
    if body is None or body[:1] != b"\x2f":
        raise CodecError("webp: no lossless image")
    try:
        return _webp(_Lossless(body[1:]))
    except (IndexError, ValueError, OverflowError) as e:
        raise e if isinstance(e, CodecError) else CodecError(f"webp: broken ({type(e).__name__})") from e


def _webp(r: _Lossless) -> np.ndarray:
    w, h, alpha, version = r.bits(14) + 1, r.bits(14) + 1, r.bits(1), r.bits(3)
    if version or w * h > MAX_PIXELS:
        raise CodecError("webp: unsupported version or size")
    width, transforms = w, []
    while r.bits(1):
        kind = r.bits(2)
        if kind in [t[0] for t in transforms]:
            raise CodecError("webp: a transform stands twice")
        if kind in (0, 1):
            shift = r.bits(3) + 2
            transforms.append((kind, r.image((width + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift, False), shift, width))
        elif kind == 2:
            transforms.append((kind, None, 0, width))
        else:
            n = r.bits(8) + 1
            palette = np.cumsum(_channels(r.image(n, 1, False))[0], 0, dtype=np.uint8)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, palette, shift, width))
            width = (width + (1 << shift) - 1) >> shift
    x = _channels(r.image(width, h, True))
    for kind, own, shift, width in reversed(transforms):
        if kind == 0:
            x = _unpredicted(x, own >> 8 & 15, shift)
        elif kind == 1:
            block = _channels(own)[np.arange(h)[:, None] >> shift, np.arange(width)[None, :] >> shift].view(np.int8).astype(int)
            by = lambda t, c: t * c.view(np.int8).astype(int) >> 5
            green = np.ascontiguousarray(x[..., 1])
            red = (x[..., 0] + by(block[..., 2], green) & 255).astype(np.uint8)
            x[..., 2] = x[..., 2] + by(block[..., 1], green) + by(block[..., 0], red) & 255
            x[..., 0] = red
        elif kind == 2:
            x[..., 0] += x[..., 1]
            x[..., 2] += x[..., 1]
        else:
            per, bits = 1 << shift, 8 >> shift
            index = x[..., 1][..., None] >> (np.arange(per) * bits) & ((1 << bits) - 1)
            index = index.reshape(h, -1)[:, :width]
            full = np.zeros((256, 4), np.uint8)
            full[: len(own)] = own
            x = full[index]
    return x if alpha else x[..., :3]


ENCODERS = {"png": encode_png, "jpg": encode_jpeg, "webp": encode_webp}
DECODERS = {"png": decode_png, "jpg": decode_jpeg, "webp": decode_webp}


def decode(data: bytes, pillow: bool = False) -> np.ndarray:
    """By the first bytes; data without a known head is an error. ``pillow``: what is refused here goes to Pillow, which
    must be installed then."""
    kind = sniff(data) or ("png" if data[:8] == SIGNATURE else None)
    try:
        if kind is None:
            raise CodecError("unknown image format")
        return DECODERS[kind](data)
    except CodecError:
        if not pillow:
            raise
    import io

    from PIL import Image, UnidentifiedImageError

    try:
        image = Image.open(io.BytesIO(data))
        return np.asarray(image.convert("RGBA" if "A" in image.getbands() else "RGB"))
    except (UnidentifiedImageError, OSError) as e:
        raise CodecError(str(e)) from e


def encode(image: np.ndarray, fmt: str) -> bytes:
    if fmt not in ENCODERS:
        raise CodecError(f"no encoder for {fmt}")
    return ENCODERS[fmt](np.ascontiguousarray(image))
