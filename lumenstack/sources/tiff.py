"""TIFF and BigTIFF: strips and tiles, the common codecs and predictors, and a plain writer."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Tag numbers, and the size and struct letter of each value type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, PALETTE, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT, DESCRIPTION = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 322, 323, 324, 325, 339, 270
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def read_pages(data: bytes) -> list[dict[int, tuple]]:
    """The tags of every page in file order."""
    e = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack(e + "H", data[2:4])[0] == 43
    at = struct.unpack(e + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    head, entry, num, slot = (8, 20, "Q", 8) if big else (2, 12, "H", 4)
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(e + num, data[at : at + head])[0]
        tags: dict = {"endian": e}
        for i in range(n):
            b = at + head + entry * i
            tag, kind, count = struct.unpack(e + ("HHQ" if big else "HHI"), data[b : b + (12 if big else 8)])
            letter = TYPES.get(kind)
            if letter is None:
                continue
            size = count * struct.calcsize("<" + letter)
            place = b + entry - slot
            if size > slot:
                place = struct.unpack(e + ("Q" if big else "I"), data[place : place + slot])[0]
            tags[tag] = (data[place : place + size].rstrip(b"\0"),) if letter == "s" else struct.unpack(f"{e}{letter * count if len(letter) > 1 else f'{count}{letter}'}", data[place : place + size])
        out.append(tags)
        at = struct.unpack(e + ("Q" if big else "I"), data[at + head + entry * n : at + head + entry * n + slot])[0]
    return out


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    words, width, acc, held, last, out = list(fresh), 9, 0, 0, None, []
    for byte in data:
        acc, held = (acc << 8) | byte, held + 8
        while held >= width:
            held -= width
            code = acc >> held
            acc &= (1 << held) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                words, width, last = list(fresh), 9, None
                continue
            word = words[code] if code < len(words) else last + last[:1]
            out.append(word)
            if last is not None:
                words.append(last + word[:1])
            last = word
            if len(words) >= (1 << width) - 1 and width < 12:
                width += 1
    return b"".join(out)


CODECS = {1: lambda d: d, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def unpack_ints(data: bytes, bits: int, row: int) -> np.ndarray:
    """Whole numbers of `bits` bits, most significant first; each row of `row` numbers begins on a byte."""
    b = np.unpackbits(np.frombuffer(data, np.uint8))
    step = -(-row * bits // 8) * 8
    b = b[: len(b) // step * step].reshape(-1, step)[:, : row * bits].reshape(-1, row, bits)
    return (b @ (1 << np.arange(bits - 1, -1, -1))).ravel()


def unpack_rgb(data: bytes, kind: str = "<B", bits: tuple[int, ...] = (5, 6, 5), rescale: bool = True) -> np.ndarray:
    """Colours packed in one number, the first in the highest bits; rescaled to whole bytes if asked."""
    total = sum(bits)
    v = np.frombuffer(data, f"{kind[0]}u{-(-total // 8)}").astype(np.int64)
    out = np.empty((len(v), len(bits)), np.int64)
    for i, n in enumerate(bits):
        x = (v >> sum(bits[i + 1 :])) & ((1 << n) - 1)
        # To bytes by the power of two between the ranges, and the top value to the top.
        out[:, i] = np.where(x == (1 << n) - 1, 255, x << (8 - n)) if rescale else x
    return out.ravel()


def decode_page(data: bytes, tags: dict) -> np.ndarray:
    """(h, w) or (h, w, samples) of a page; a palette gives colours."""
    e, get = tags["endian"], lambda k, v: tags.get(k, (v,))[0]
    h, w, n, bits = tags[HEIGHT][0], tags[WIDTH][0], get(SAMPLES, 1), get(BITS, 1)
    separate = get(PLANAR, 1) == 2 and n > 1
    tiled = TILE_OFFSETS in tags
    th, tw = (tags[TILE_H][0], tags[TILE_W][0]) if tiled else (min(get(ROWS, h), h), w)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    inner = 1 if separate else n
    letter = {1: "u", 2: "i", 3: "f"}.get(get(FORMAT, 1), "u")
    kind = np.dtype(f"{e}{letter}{bits // 8}") if bits in (8, 16, 32, 64) else None
    out = np.zeros((n if separate else 1, -(-h // th) * th, -(-w // tw) * tw, inner))
    across, down = -(-w // tw), -(-h // th)
    for k, (o, c) in enumerate(zip(offsets, counts, strict=True)):
        plane, y, x = k // (across * down), k // across % down * th, k % across * tw
        raw = CODECS[get(COMPRESSION, 1)](data[o : o + c])
        if kind is None:
            v = unpack_ints(raw, bits, tw * inner)
        else:
            v = np.frombuffer(raw[: len(raw) // kind.itemsize * kind.itemsize], kind)
        rows = min(th, len(v) // (tw * inner))
        v = v[: rows * tw * inner].reshape(rows, tw, inner)
        if get(PREDICTOR, 1) == 2:
            v = np.cumsum(v, 1, dtype=v.dtype)
        out[plane, y : y + rows, x : x + tw] = v
    img = np.moveaxis(out[..., 0], 0, -1) if separate else out[0]
    img = img[:h, :w]
    if get(PHOTOMETRIC, 1) == 3 and PALETTE in tags:
        return np.array(tags[PALETTE], float).reshape(3, -1).T[img[..., 0].astype(int)]
    return img[..., 0] if img.shape[-1] == 1 else img


def read_images(data: bytes) -> Iterator[np.ndarray]:
    for tags in read_pages(data):
        yield decode_page(data, tags)


def series(data: bytes) -> list[list[int]]:
    """Numbers of the pages that follow one another with equal size, samples and bits: the series of a file."""
    out: list[list[int]] = []
    last = None
    for k, tags in enumerate(read_pages(data)):
        kind = tuple(tags.get(t, (1,)) for t in (HEIGHT, WIDTH, SAMPLES, BITS, FORMAT))
        if kind != last:
            out.append([])
        out[-1].append(k)
        last = kind
    return out


def ome_axes(data: bytes) -> dict[str, float]:
    """Sizes and physical steps that an OME description states: SizeX ... SizeT, PhysicalSizeX ... Z, TimeIncrement."""
    text = read_pages(data)[0].get(DESCRIPTION, (b"",))[0].decode("utf-8", "replace")
    return {k: float(v) for k, v in re.findall(r'\b(Size[XYZCT]|PhysicalSize[XYZ]|TimeIncrement)="([0-9.eE+\-]+)"', text)}


def image_description(data: bytes) -> dict[str, str]:
    """`key=value` lines of the first page's description."""
    text = read_pages(data)[0].get(DESCRIPTION, (b"",))[0].decode("utf-8", "replace")
    return dict(x.split("=", 1) for x in text.splitlines() if "=" in x)


def write_images(images: list[np.ndarray], big: bool | None = None, description: str = "") -> bytes:
    """A file of uncompressed pages, one strip each; BigTIFF beyond 2040 MB unless said."""
    images = [np.ascontiguousarray(x) for x in images]
    big = sum(x.nbytes for x in images) > 2040 << 20 if big is None else big
    head, entry, slot, num, off = (8, 20, 8, "Q", "Q") if big else (2, 12, 4, "H", "I")
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
    for i, x in enumerate(images):
        n = x.shape[2] if x.ndim == 3 else 1
        kind = {"u": 1, "b": 1, "i": 2, "f": 3}[x.dtype.kind]
        bits = x.dtype.itemsize * 8
        values = {WIDTH: [x.shape[1]], HEIGHT: [x.shape[0]], BITS: [bits] * n, COMPRESSION: [1], PHOTOMETRIC: [2 if n >= 3 else 1], OFFSETS: [0], SAMPLES: [n], ROWS: [x.shape[0]], COUNTS: [x.nbytes], FORMAT: [kind] * n}
        if description and not i:
            values[DESCRIPTION] = description.encode() + b"\0"
        extra, table = b"", []
        at = len(out) + head + entry * len(values) + slot
        for tag in sorted(values):
            v = values[tag]
            letter, code = ("s", 2) if isinstance(v, bytes) else (off, 16 if big else 4) if tag in (OFFSETS, COUNTS) else ("I", 4)
            raw = v if letter == "s" else struct.pack(f"<{len(v)}{letter}", *v)
            table.append([tag, code, len(v), raw])
        for row in table:
            if len(row[3]) > slot:
                place = at + len(extra)
                extra += row[3] + b"\0" * (len(row[3]) % 2)
                row[3] = struct.pack("<" + off, place)
        start = at + len(extra)
        out += struct.pack("<" + num, len(table))
        for tag, code, count, raw in table:
            raw = struct.pack("<" + off, start) if tag == OFFSETS else raw
            out += struct.pack("<HHQ" if big else "<HHI", tag, code, count) + raw.ljust(slot, b"\0")
        after = start + x.nbytes + x.nbytes % 2
        out += struct.pack("<" + off, after if i + 1 < len(images) else 0) + extra + x.astype(x.dtype.newbyteorder("<")).tobytes() + b"\0" * (x.nbytes % 2)
    return bytes(out)
