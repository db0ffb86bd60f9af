"""Tiled TIFF files: directories, tiles and codecs in Python. Raw, DEFLATE, LZW and PackBits data; JPEG where Pillow is installed;
LERC, and JPEG without it, by a codec of register_codec(), else they raise an error."""

from __future__ import annotations

import os
import struct
import urllib.request
import zlib
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: bytes of field types and their struct letters, tags, compressions.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, FORMAT = 256, 257, 258, 259, 277, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 42112, 42113
RAW, LZW, JPEG, DEFLATE, OLD_DEFLATE, PACKBITS, LERC, JPEG_TABLES = 1, 5, 7, 8, 32946, 32773, 34887, 347


#: Bytes of blocks that a file keeps at most.
KEPT_BYTES = 64 << 20


class RangeFile:
    """Bytes of a local file or an http(s) URL; the latter by ranges in blocks, of which those last used are kept (block_size 0: no blocks)."""

    def __init__(self, url: str, block_size: int = 65536):
        self.url, self.block_size, self.blocks = url.removeprefix("file://"), block_size, OrderedDict()
        self.file = None if url.startswith(("http://", "https://")) else open(self.url, "rb")  # noqa: SIM115

    def _fetch(self, at: int, n: int) -> bytes:
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={at}-{at + n - 1}"})
        with urllib.request.urlopen(request) as r:
            return r.read()

    def read(self, at: int, n: int) -> bytes:
        if self.file:
            self.file.seek(at)
            return self.file.read(n)
        if not self.block_size:
            return self._fetch(at, n)
        first, last = at // self.block_size, (at + n - 1) // self.block_size
        parts = []
        for k in range(first, last + 1):
            if k not in self.blocks:
                self.blocks[k] = self._fetch(k * self.block_size, self.block_size)
            self.blocks.move_to_end(k)
            parts.append(self.blocks[k])
            while len(self.blocks) * self.block_size > KEPT_BYTES and len(self.blocks) > 1:
                self.blocks.popitem(last=False)
        return b"".join(parts)[at - first * self.block_size :][:n]

    def close(self) -> None:
        if self.file:
            self.file.close()


class Bytes:
    """A file that is in memory already."""

    def __init__(self, data: bytes):
        self.data = data

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def close(self) -> None:
        pass


def unlzw(data: bytes) -> bytes:
    """Most significant bit first; 256 clears the table, 257 ends; codes widen one entry early."""
    out, table, width, last = bytearray(), [], 9, b""
    bits = have = 0
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        while have >= width:
            have -= width
            code, bits = bits >> have, bits & ((1 << have) - 1)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def lzw(data: bytes) -> bytes:
    bits = have = 0
    out, table, width, own = bytearray(), {bytes([i]): i for i in range(256)}, 9, b""

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    put(256)
    number = 258
    for byte in data:
        longer = own + bytes([byte])
        if longer in table:
            own = longer
            continue
        put(table[own])
        table[longer] = number
        number += 1
        if number == 4094:
            put(256)
            table, width, number = {bytes([i]): i for i in range(256)}, 9, 258
        elif number in (512, 1024, 2048):
            width += 1
        own = bytes([byte])
    if own:
        put(table[own])
        if number + 1 in (512, 1024, 2048):
            width += 1
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    """Literal runs only, which every reader takes."""
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))


_codecs: dict[int, Callable[[bytes, Image], bytes]] = {}


def register_codec(compression: int, decode: Callable[[bytes, Image], bytes] | None) -> None:
    """decode(data, image) gives a tile's raw bytes; None takes the codec away. Register it where tiles are read: in each worker."""
    if decode is None:
        _codecs.pop(compression, None)
    else:
        _codecs[compression] = decode


def _jpeg(data: bytes, image: Image | None) -> bytes:
    """By Pillow, if there is one; tables that tiles share stand before a tile's own data."""
    try:
        from PIL import Image as Picture
    except ImportError:
        raise ValueError("JPEG data can't be read: no codec for it is installed") from None
    import io

    tables = bytes(image.tags.get(JPEG_TABLES, ())) if image else b""
    whole = tables[:-2] + data[2:] if tables else data
    return np.asarray(Picture.open(io.BytesIO(whole))).tobytes()


def decompress(data: bytes, compression: int, image: Image | None = None) -> bytes:
    if compression in _codecs:
        return _codecs[compression](data, image)
    if compression == JPEG:
        return _jpeg(data, image)
    if compression == RAW:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == LZW:
        return unlzw(data)
    if compression == PACKBITS:
        return unpackbits(data)
    raise ValueError({LERC: "LERC"}.get(compression, f"compression {compression}") + " data can't be read: no codec for it is installed")


@dataclass
class Image:
    """A directory of the file: one resolution."""

    tags: dict[int, tuple]
    order: str

    def one(self, tag: int, other=None):
        return self.tags[tag][0] if tag in self.tags else other

    @property
    def tiled(self) -> bool:
        return TILE_WIDTH in self.tags

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}.get(self.one(FORMAT, 1), "f")
        return np.dtype(f"{self.order}{kind}{self.one(BITS, 8) // 8}")


@dataclass
class Tiff:
    """The images of a file, finest first; other directories than reduced ones (masks) are left out."""

    file: RangeFile | Bytes
    images: list[Image] = field(default_factory=list)

    @classmethod
    def open(cls, file: RangeFile | Bytes) -> Tiff:
        head = file.read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError("no TIFF file")
        big = version == 43
        at = struct.unpack(f"{order}{'Q' if big else 'I'}", head[8:16] if big else head[4:8])[0]
        out = cls(file)
        while at:
            n = struct.unpack(f"{order}{'Q' if big else 'H'}", file.read(at, 8 if big else 2))[0]
            size, skip = (20, 8) if big else (12, 2)
            body = file.read(at + skip, n * size + (8 if big else 4))
            tags = {}
            for k in range(n):
                e = body[k * size : (k + 1) * size]
                tag, kind = struct.unpack(f"{order}HH", e[:4])
                count = struct.unpack(f"{order}{'Q' if big else 'I'}", e[4:12] if big else e[4:8])[0]
                letters = _TYPES.get(kind, "B")
                width = struct.calcsize(f"={letters}") * count
                inline = e[12:] if big else e[8:]
                raw = inline[:width] if width <= len(inline) else file.read(struct.unpack(f"{order}{'Q' if big else 'I'}", inline)[0], width)
                tags[tag] = (raw,) if kind == 2 else struct.unpack(f"{order}{count * len(letters)}{letters[0]}", raw)
            image = Image(tags, order)
            if not (image.one(254, 0) & 4):
                out.images.append(image)
            at = struct.unpack(f"{order}{'Q' if big else 'I'}", body[n * size :])[0]
        return out

    def window(self, index: int, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        """height x width x bands of an image's pixels; the window lies in the image."""
        im = self.images[index]
        if not im.tiled:
            raise ValueError("the image isn't tiled")
        tw, th, bands, planar = im.one(TILE_WIDTH), im.one(TILE_HEIGHT), im.one(SAMPLES, 1), im.one(PLANAR, 1) == 2
        across, down = -(-im.one(WIDTH) // tw), -(-im.one(HEIGHT) // th)
        out = np.zeros((y1 - y0, x1 - x0, bands), im.dtype.newbyteorder("="))
        for b in range(bands if planar else 1):
            for ty in range(y0 // th, -(-y1 // th)):
                for tx in range(x0 // tw, -(-x1 // tw)):
                    k = (b * down + ty) * across + tx
                    tile = self._tile(im, im.tags[OFFSETS][k], im.tags[COUNTS][k], tw, th, 1 if planar else bands)
                    ya, yb, xa, xb = max(y0, ty * th), min(y1, (ty + 1) * th), max(x0, tx * tw), min(x1, (tx + 1) * tw)
                    part = tile[ya - ty * th : yb - ty * th, xa - tx * tw : xb - tx * tw]
                    out[ya - y0 : yb - y0, xa - x0 : xb - x0, b : b + part.shape[2]] = part
        return out

    def _tile(self, im: Image, at: int, n: int, tw: int, th: int, bands: int) -> np.ndarray:
        if not n:
            return np.zeros((th, tw, bands), im.dtype)
        data = decompress(self.file.read(at, n), im.one(COMPRESSION, RAW), im)
        predictor = im.one(PREDICTOR, 1)
        if predictor == 3:  # bytes of a row by significance, differences of bytes
            size = im.dtype.itemsize
            rows = np.cumsum(np.frombuffer(data, np.uint8).reshape(th, -1), axis=1, dtype=np.uint8) if bands == 1 else np.cumsum(np.frombuffer(data, np.uint8).reshape(th, -1, bands), axis=1, dtype=np.uint8).reshape(th, -1)
            return rows.reshape(th, size, tw * bands).transpose(0, 2, 1).copy().view(im.dtype.newbyteorder(">")).reshape(th, tw, bands)
        tile = np.frombuffer(data, im.dtype)[: th * tw * bands].reshape(th, tw, bands)
        return np.cumsum(tile, axis=1, dtype=im.dtype.newbyteorder("=")) if predictor == 2 else tile


def write_cog(path: str, levels: list[np.ndarray], resolution: float, origin: tuple[float, float], tile: int = 64, compression: int = DEFLATE, nodata: str | None = None, metadata: str | None = None, planar: bool = False) -> None:
    """A little-endian tiled TIFF of images (height x width x bands), finest first."""
    out = bytearray(b"II" + struct.pack("<HI", 42, 8))
    pack = {RAW: bytes, DEFLATE: zlib.compress, OLD_DEFLATE: zlib.compress, LZW: lzw, PACKBITS: packbits}.get(compression, bytes)
    directories, bodies = [], []
    for k, level in enumerate(levels):
        level = level[:, :, None] if level.ndim == 2 else level
        h, w, bands = level.shape
        kind = {"u": 1, "i": 2, "f": 3}[level.dtype.kind]
        chunks = []
        for plane in (np.moveaxis(level, 2, 0)[..., None] if planar else [level]):
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    block = np.zeros((tile, tile, plane.shape[2]), level.dtype)
                    part = plane[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    chunks.append(pack(block.astype(level.dtype.newbyteorder("<")).tobytes()))
        tags = [(254, 4, [int(k > 0)]), (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [level.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [compression]), (262, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [2 if planar else 1]), (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (OFFSETS, 4, None), (COUNTS, 4, [len(c) for c in chunks]), (FORMAT, 3, [kind] * bands)]
        if not k:
            tags += [(PIXEL_SCALE, 12, [resolution, resolution, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0])]
            tags += [(t, 2, s.encode() + b"\0") for t, s in ((GDAL_METADATA, metadata), (GDAL_NODATA, nodata)) if s is not None]
        directories.append(sorted(tags, key=lambda t: t[0]))
        bodies.append(chunks)
    at = 8
    for k, (tags, chunks) in enumerate(zip(directories, bodies, strict=True)):
        extra, start = bytearray(), at + 2 + 12 * len(tags) + 4
        values = []
        for tag, kind, v in tags:
            if v is None:
                v, values_at = [0] * len(chunks), len(values)
            values.append([tag, kind, v])
        size = sum(len(x) + len(x) % 2 for x in (v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_TYPES[kind]}", *v) for _, kind, v in values) if len(x) > 4)
        offsets, here = [], start + size
        for c in chunks:
            offsets.append(here)
            here += len(c)
        values[values_at][2] = offsets
        body = bytearray(struct.pack("<H", len(values)))
        for tag, kind, v in values:
            raw = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_TYPES[kind]}", *v)
            body += struct.pack("<HHI", tag, kind, len(v))
            if len(raw) <= 4:
                body += raw.ljust(4, b"\0")
            else:
                body += struct.pack("<I", start + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
        here += here % 2
        body += struct.pack("<I", here if k + 1 < len(directories) else 0)
        out += body + extra + b"".join(chunks)
        out += b"\0" * (here - len(out))
        at = here
    with open(path, "wb") as f:
        f.write(out)
        f.flush()
        os.fsync(f.fileno())
