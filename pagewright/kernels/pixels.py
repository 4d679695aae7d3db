"""Pixels as numpy arrays (height, width, channels) of bytes, blue first: decoding, resizing, cropping, turning, and tensors of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAX_SIDE, MAX_PIXELS, MAX_DECODED, MAX_ENCODED = 16_384, 40_000_000, 256 << 20, 64 << 20
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"


class ImageError(ValueError):
    """kind: unsupported, malformed, empty or limit."""

    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


def sniff(content: bytes) -> str:
    """The format by signature alone."""
    if content.startswith(JPEG):
        return "jpeg"
    if content.startswith(PNG):
        return "png"
    raise ImageError("unsupported", "image format")


def check_size(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise ImageError("empty", "image size")
    if max(width, height) > MAX_SIDE or width * height > MAX_PIXELS or 3 * width * height > MAX_DECODED:
        raise ImageError("limit", f"image of {width} x {height}")


def png_header(content: bytes) -> tuple[int, int, int, int, int]:
    """(width, height, bit depth, colour type, interlace) from the first chunk, before anything is allocated."""
    if not content.startswith(PNG) or content[12:16] != b"IHDR" or len(content) < 33:
        raise ImageError("malformed", "png header")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", content[16:29])
    check_size(width, height)
    return width, height, depth, colour, interlace


def _png_chunks(content: bytes):
    at = len(PNG)
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or content[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ImageError("malformed", "png chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ImageError("malformed", "png ends early")


def _unfilter(raw: np.ndarray, rows: int, stride: int, unit: int) -> np.ndarray:
    """Rows of bytes without their filters; unit is how many bytes a pixel to the left is away."""
    raw = raw[: rows * (stride + 1)].reshape(rows, stride + 1)
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        kind, line = int(raw[y, 0]), raw[y, 1:].copy()
        if kind == 1:
            for k in range(min(unit, stride)):
                line[k::unit] = np.cumsum(line[k::unit], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            got, up = line.tolist(), above.tolist()
            for x in range(stride):
                a, c = (got[x - unit], up[x - unit]) if x >= unit else (0, 0)
                if kind == 3:
                    guess = (a + up[x]) >> 1
                else:
                    p = a + up[x] - c
                    da, db, dc = abs(p - a), abs(p - up[x]), abs(p - c)
                    guess = a if da <= db and da <= dc else up[x] if db <= dc else c
                got[x] = (got[x] + guess) & 255
            line = np.array(got, np.uint8)
        elif kind:
            raise ImageError("malformed", "png filter")
        out[y] = above = line
    return out


#: First column, first row, column step and row step of interlaced passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(content: bytes) -> np.ndarray:
    """Blue, green, red bytes. Alpha is dropped, grey repeated, 16-bit samples keep their high byte."""
    width, height, depth, colour, interlace = png_header(content)
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if samples is None or depth not in (1, 2, 4, 8, 16) or interlace > 1:
        raise ImageError("unsupported", "png sample format")
    palette, packed = None, []
    for kind, body in _png_chunks(content):
        if kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8)[: len(body) // 3 * 3].reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    bits = samples * depth
    passes = PASSES if interlace else ((0, 0, 1, 1),)
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    need = sum((1 + -(-w * bits // 8)) * h for w, h in sizes if w > 0 and h > 0)
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), need), np.uint8)
    except zlib.error as e:
        raise ImageError("malformed", "png data") from e
    if len(raw) < need:
        raise ImageError("malformed", "png data ends early")
    out = np.zeros((height, width, samples), np.uint8)
    at = 0
    for (x, y, dx, dy), (w, h) in zip(passes, sizes):
        if w <= 0 or h <= 0:
            continue
        stride = -(-w * bits // 8)
        lines = _unfilter(raw[at:], h, stride, max(1, bits // 8))
        at += (stride + 1) * h
        if depth == 16:
            part = lines.reshape(h, w, samples, 2)[..., 0]
        elif depth == 8:
            part = lines.reshape(h, w, samples)
        else:
            part = np.unpackbits(lines, axis=1)[:, : w * depth].reshape(h, w, 1, depth)
            part = (part * (1 << np.arange(depth - 1, -1, -1))).sum(-1).astype(np.uint8)
            if colour == 0:
                part = part * np.uint8(255 // ((1 << depth) - 1))
        out[y::dy, x::dx] = part
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ImageError("malformed", "png palette")
        return np.ascontiguousarray(palette[out[..., 0]][..., ::-1])
    if samples <= 2:
        return np.repeat(out[..., :1], 3, axis=2)
    return np.ascontiguousarray(out[..., 2::-1])


def encode_png(pixels: np.ndarray) -> bytes:
    """A plain PNG of blue, green, red bytes."""
    height, width = pixels.shape[:2]
    lines = b"".join(b"\x00" + row[:, ::-1].tobytes() for row in pixels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def exif_orientation(content: bytes) -> int:
    """The orientation in a JPEG's first Exif segment; 1 if there is none or it makes no sense."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
        elif marker in (0xDA, 0xD9):
            return 1
        else:
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            body = content[at + 4 : at + 2 + size]
            if size < 2 or len(body) < size - 2:
                return 1
            if marker == 0xE1 and body.startswith(b"Exif\0\0"):
                return _tiff_orientation(body[6:])
            at += 2 + size
    return 1


def _tiff_orientation(tiff: bytes) -> int:
    order = {b"MM": ">", b"II": "<"}.get(tiff[:2])
    try:
        if order is None or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
            return 1
        start = struct.unpack_from(order + "I", tiff, 4)[0]
        for k in range(struct.unpack_from(order + "H", tiff, start)[0]):
            tag, value = struct.unpack_from(order + "H6xH", tiff, start + 2 + 12 * k)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        return 1
    return 1


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as an Exif orientation wants them seen."""
    if orientation >= 5:
        pixels = pixels.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return np.ascontiguousarray(pixels)


def decode(content: bytes, jpeg=None) -> np.ndarray:
    """Pixels of a PNG, or of a JPEG by a decoder that the caller brings (content to pixels, blue first, not yet turned)."""
    if not content:
        raise ImageError("empty", "image")
    if len(content) > MAX_ENCODED:
        raise ImageError("limit", f"{len(content)} bytes")
    if sniff(content) == "png":
        return decode_png(content)
    if jpeg is None:
        raise ImageError("unsupported", "jpeg without a decoder")
    pixels = jpeg(content)
    check_size(pixels.shape[1], pixels.shape[0])
    return upright(pixels, exif_orientation(content))


# -- resizing ----------------------------------------------------------------------------------------------------------


def opaque(rgba: np.ndarray) -> np.ndarray:
    """Blue, green and red of premultiplied red, green, blue and alpha: divided by alpha, halves up, at most 255; black where alpha is 0."""
    alpha = rgba[..., 3:].astype(np.uint32)
    plain = np.minimum((rgba[..., 2::-1].astype(np.uint32) * 255 + alpha // 2) // np.maximum(alpha, 1), 255)
    return np.where(alpha == 0, 0, plain).astype(np.uint8)


def _half_even(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def _taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Index below and single-precision fraction of each target sample, centres aligned."""
    at = ((np.arange(target) + 0.5) * (source / target) - 0.5).astype(np.float32)
    low = np.floor(at)
    return low.astype(np.int64), at - low


def _fixed(weights: np.ndarray) -> np.ndarray:
    return np.rint(weights.astype(np.float32) * np.float32(2048)).astype(np.int64)


def linear_resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with 11-bit weights. Beyond the outer columns the fraction is dropped; beyond the outer rows rows repeat."""
    h, w = pixels.shape[:2]
    x, fx = _taps(w, width)
    fx = np.where((x < 0) | (x >= w - 1), np.float32(0), fx)
    x = np.clip(x, 0, w - 1)
    y, fy = _taps(h, height)
    lines = pixels.astype(np.int64)
    across = lines[:, x] * _fixed(1 - fx)[None, :, None] + lines[:, np.minimum(x + 1, w - 1)] * _fixed(fx)[None, :, None]
    above, below = across[np.clip(y, 0, h - 1)] >> 4, across[np.clip(y + 1, 0, h - 1)] >> 4
    folded = ((above * _fixed(1 - fy)[:, None, None]) >> 16) + ((below * _fixed(fy)[:, None, None]) >> 16) + 2
    return np.clip(folded >> 2, 0, 255).astype(np.uint8)


def cubic_weights(alpha: np.ndarray) -> np.ndarray:
    """Four weights of each phase in single precision, the third as what the others leave."""
    a, one = np.asarray(alpha, np.float32), np.float32(1)
    c = np.float32(-0.75)
    first = c * a * ((one - a) * (one - a))
    fourth = c * (a * a) * (one - a)
    second = (a * a) * ((c + np.float32(2)) * a - (c + np.float32(3))) + one
    return np.stack([first, second, one - first - second - fourth, fourth], -1)


def cubic_resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic, across, then down; edge pixels repeat. Sums are fused as far as a wider product can stand in for that."""
    h, w = pixels.shape[:2]

    def taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
        at = (np.arange(target) + 0.5) * (source / target) - 0.5
        low = np.floor(at)
        index = np.clip(low[:, None].astype(np.int64) + np.arange(-1, 3), 0, source - 1)
        return index, cubic_weights((at - low).astype(np.float32))

    def fused(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.float64) * b + total).astype(np.float32)

    (x, wx), (y, wy) = taps(w, width), taps(h, height)
    lines = pixels.astype(np.float32)
    across = np.zeros((h, width, pixels.shape[2]), np.float32)
    for k in (3, 2, 1, 0):
        across = fused(across, lines[:, x[:, k]], wx[None, :, k, None])
    out = np.zeros((height, width, pixels.shape[2]), np.float32)
    for k in (3, 2, 1, 0):
        out = fused(out, across[y[:, k]], wy[:, k, None, None])
    return _half_even(out)


# -- crops and turns ---------------------------------------------------------------------------------------------------


def homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The 3 x 3 map from four corners to four others; all equations of x stand before those of y."""
    rows = [[x, y, 1, 0, 0, 0, -x * u, -y * u] for (x, y), (u, _) in zip(source, target)]
    rows += [[0, 0, 0, x, y, 1, -x * v, -y * v] for (x, y), (_, v) in zip(source, target)]
    matrix, right = np.array(rows, float), np.array([u for u, _ in target] + [v for _, v in target], float)
    if abs(np.linalg.det(matrix)) < 100 * np.finfo(float).eps:
        raise ImageError("malformed", "corners lie on a line")
    return np.append(np.linalg.solve(matrix, right), 1.0).reshape(3, 3)


def _sample(pixels: np.ndarray, x: np.ndarray, y: np.ndarray, repeat: bool) -> np.ndarray:
    """Cubic samples at positions: four across, then down. Outside, edges repeat or are black."""
    h, w = pixels.shape[:2]
    bx, by = np.floor(x), np.floor(y)
    wx, wy = cubic_weights(x - bx), cubic_weights(y - by)
    out = np.zeros((*x.shape, pixels.shape[2]), np.float32)
    for j in range(4):
        line = np.zeros_like(out)
        row = by.astype(np.int64) + j - 1
        for i in range(4):
            column = bx.astype(np.int64) + i - 1
            value = pixels[np.clip(row, 0, h - 1), np.clip(column, 0, w - 1)].astype(np.float32)
            if not repeat:
                value[(row < 0) | (row >= h) | (column < 0) | (column >= w)] = 0
            line += value * wx[..., i, None]
        out += line * wy[..., j, None]
    return out


def crop_quadrilateral(pixels: np.ndarray, corners: list[tuple[float, float]]) -> np.ndarray:
    """The area of four corners (from the top left, clockwise) made a rectangle; turned counter-clockwise if half as tall again as wide."""
    edge = lambda i, j: float(np.hypot(corners[i][0] - corners[j][0], corners[i][1] - corners[j][1]))
    width, height = int(max(edge(0, 1), edge(2, 3))), int(max(edge(0, 3), edge(1, 2)))
    if not width or not height:
        raise ImageError("empty", "crop")
    back = np.linalg.inv(homography(corners, [(0, 0), (width, 0), (width, height), (0, height)]))
    y, x = np.mgrid[0:height, 0:width].astype(float)
    z = back[2, 0] * x + back[2, 1] * y + back[2, 2]
    sx, sy = (back[0, 0] * x + back[0, 1] * y + back[0, 2]) / z, (back[1, 0] * x + back[1, 1] * y + back[1, 2]) / z
    out = _half_even(_sample(pixels, sx.astype(np.float32), sy.astype(np.float32), repeat=True))
    return np.ascontiguousarray(np.rot90(out)) if height / width >= 1.5 else out


def crop_box(pixels: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray | None:
    """The clamped box of the page; none if nothing is left."""
    h, w = pixels.shape[:2]
    x1, y1, x2, y2 = (min(max(int(v), 0), most) for v, most in zip(box, (w, h, w, h)))
    return pixels[y1:y2, x1:x2] if x1 < x2 and y1 < y2 else None


def rotate_page(pixels: np.ndarray, degrees: int) -> np.ndarray:
    """The page turned counter-clockwise about its centre by cubic sampling, black outside; sizes truncate."""
    if degrees not in (0, 90, 180, 270):
        raise ImageError("malformed", f"angle {degrees}")
    h, w = pixels.shape[:2]
    s, c = np.sin(np.radians(degrees)), np.cos(np.radians(degrees))
    nw, nh = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    cx, cy = w / 2, h / 2
    forward = np.array([[c, s, (1 - c) * cx - s * cy + (nw - w) / 2], [-s, c, s * cx + (1 - c) * cy + (nh - h) / 2], [0, 0, 1]])
    back = np.linalg.inv(forward)
    y, x = np.mgrid[0:nh, 0:nw].astype(float)
    value = _sample(pixels, back[0, 0] * x + back[0, 1] * y + back[0, 2], back[1, 0] * x + back[1, 1] * y + back[1, 2], repeat=False)
    return np.clip(np.floor(value + np.float32(0.5)), 0, 255).astype(np.uint8)


def centre_crop(pixels: np.ndarray, size: int) -> np.ndarray:
    h, w = pixels.shape[:2]
    if min(h, w) < size:
        raise ImageError("limit", "smaller than the crop")
    y, x = (h - size) // 2, (w - size) // 2
    return pixels[y : y + size, x : x + size]


# -- tensors -----------------------------------------------------------------------------------------------------------

#: Channel means and deviations, by position in the pixel.
MEAN, STD = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)
MAX_ELEMENTS, MAX_BATCH = 64_000_000, 256


def _bounded(*shape: int) -> None:
    if shape[0] > MAX_BATCH or int(np.prod(shape)) > MAX_ELEMENTS:
        raise ImageError("limit", f"tensor of {shape}")


def detector_tensor(images: list[np.ndarray]) -> np.ndarray:
    """(n, 3, h, w): scaled, then normalised; all of one size."""
    _bounded(len(images), 3, *images[0].shape[:2])
    if len({i.shape for i in images}) != 1:
        raise ImageError("malformed", "sizes differ")
    stack = np.stack(images).astype(np.float32)
    return ((stack * np.float32(1 / 255) - MEAN) / STD).transpose(0, 3, 1, 2)


def recognizer_tensor(crops: list[np.ndarray], width: int) -> np.ndarray:
    """(n, 3, h, width): from -1 to 1, filled up on the right with 0."""
    height = crops[0].shape[0]
    _bounded(len(crops), 3, height, width)
    out = np.zeros((len(crops), 3, height, width), np.float32)
    for k, c in enumerate(crops):
        if c.shape[0] != height or c.shape[1] > width:
            raise ImageError("malformed", "crop doesn't fit its batch")
        out[k, :, :, : c.shape[1]] = ((c.astype(np.float32) / np.float32(255) - np.float32(0.5)) / np.float32(0.5)).transpose(2, 0, 1)
    return out


def square_tensor(pixels: np.ndarray, side: int) -> np.ndarray:
    """(1, 3, side, side): cubic to the square, multiplied by the single-precision reciprocal of 255."""
    return (cubic_resize(pixels, side, side).astype(np.float32) * np.float32(1 / 255)).transpose(2, 0, 1)[None]


def scale_factors(pixels: np.ndarray, side: int) -> np.ndarray:
    """[height scale, width scale], in this order."""
    return np.array([[side / pixels.shape[0], side / pixels.shape[1]]], np.float32)


def page_class_tensor(pixels: np.ndarray, short: int = 256, crop: int = 224) -> np.ndarray:
    """Halves are rounded up, unlike the tensor of the table class."""
    scale = short / min(pixels.shape[:2])
    return detector_tensor([centre_crop(linear_resize(pixels, int(pixels.shape[1] * scale + 0.5), int(pixels.shape[0] * scale + 0.5)), crop)])


def unwarp_tensor(pixels: np.ndarray) -> np.ndarray:
    _bounded(1, *pixels.shape)
    return (pixels.astype(np.float32) * np.float32(1 / 255)).transpose(2, 0, 1)[None]


def unwarped(tensor: np.ndarray) -> np.ndarray:
    return _half_even(tensor[0].transpose(1, 2, 0) * np.float32(255))


def _folded(pixels: np.ndarray) -> np.ndarray:
    """Scale and shift folded in double precision, applied in single."""
    alpha = (1 / 255 / STD.astype(np.float64)).astype(np.float32)
    beta = (-MEAN.astype(np.float64) / STD.astype(np.float64)).astype(np.float32)
    return (pixels.astype(np.float32) * alpha + beta).transpose(2, 0, 1)[None]


def table_class_tensor(pixels: np.ndarray, short: int = 256, crop: int = 224) -> np.ndarray:
    scale = short / min(pixels.shape[:2])
    return _folded(centre_crop(linear_resize(pixels, int(np.rint(pixels.shape[1] * scale)), int(np.rint(pixels.shape[0] * scale))), crop))


def table_structure_tensor(pixels: np.ndarray, side: int = 512) -> np.ndarray:
    """Normalised first, then filled up with 0 to the square."""
    scale = side / max(pixels.shape[:2])
    w, h = int(np.rint(pixels.shape[1] * scale)), int(np.rint(pixels.shape[0] * scale))
    out = np.zeros((1, 3, side, side), np.float32)
    out[:, :, :h, :w] = _folded(pixels if (w, h) == pixels.shape[1::-1] else linear_resize(pixels, w, h))
    return out
