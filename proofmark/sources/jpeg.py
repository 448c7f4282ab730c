"""Baseline JPEG files of small rasters, for previews: block cosine transform, quantisation and Huffman coding, with numpy over all blocks at once.

Colour is coded in full resolution.  The quantisation table is a rule with one parameter; codes are given by how often a symbol occurs in
the image, in a fixed profile of lengths, so no table is carried along.
"""

from __future__ import annotations

import struct

import numpy as np

_K = np.arange(8)
#: The orthonormal cosine basis: rows are frequencies.
_COSINE = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 1 / 2)
#: Places of a block along its diagonals, to and fro.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
#: Lengths of codes by rank of frequency; what they use of the code space is under one, so no code is all ones.
_DC_LENGTHS, _AC_LENGTHS = [4] * 12, [2] + [4] * 2 + [5] * 4 + [6] * 8 + [9] * 147


def quantisation(coarse: int) -> np.ndarray:
    """Steps by frequency: 1 for the mean, more for finer detail the coarser it may be."""
    return np.minimum(1 + coarse * (_K[:, None] + _K[None, :]) // 8, 255)


def _blocks(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Quantised coefficients of a plane, (blocks, 64) in zigzag order."""
    height, width = plane.shape
    x = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge") - 128.0
    x = x.reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint(_COSINE @ x @ _COSINE.T / steps).astype(np.int64).reshape(-1, 64)[:, _ZIGZAG]


def _size(x: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.ceil(np.log2(np.abs(x) + 1)).astype(np.int64)


def _tail(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a size: negative numbers count up from zero."""
    return np.where(x < 0, x + (1 << size) - 1, x)


def _codes(symbols: np.ndarray, lengths: list[int], alphabet: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(table segment, code and length by symbol) for the symbols of an image."""
    n = np.bincount(symbols, minlength=256)
    ranked = sorted(alphabet, key=lambda s: (-n[s], s))
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    value = 0
    for i, s in enumerate(ranked):
        if i:
            value = (value + 1) << (lengths[i] - lengths[i - 1])
        code[s], length[s] = value, lengths[i]
    return bytes(lengths.count(k) for k in range(1, 17)) + bytes(ranked), code, length


def _pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bit strings one after the other, filled up with ones; a byte of ones is followed by a zero byte."""
    total = int(lengths.sum())
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total) - 1
    bits = (np.repeat(values, lengths) >> left & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-total % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def encode(raster: np.ndarray, coarse: int = 1) -> bytes:
    """A JPEG file of a raster (height, width, channels): grey, or blue, green, red."""
    height, width, channels = raster.shape
    x = raster.astype(np.float64)
    if channels == 1:
        planes = [x[:, :, 0]]
    else:
        b, g, r = x[:, :, 0], x[:, :, 1], x[:, :, 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    steps = quantisation(coarse)
    parts = [_blocks(p, steps) for p in planes]
    every = np.stack(parts, 1).reshape(-1, 64)  # the planes' blocks in turn
    first = np.stack([np.diff(p[:, 0], prepend=0) for p in parts], 1).reshape(-1)
    dc_size = _size(first)
    block, k = np.nonzero(every[:, 1:])
    k += 1
    value = every[block, k]
    size = _size(value)
    run = k - np.where(np.r_[True, block[1:] != block[:-1]], 0, np.r_[0, k[:-1]]) - 1
    skips = np.repeat(np.arange(len(k)), run // 16)
    last = np.zeros(len(every), np.int64)
    np.maximum.at(last, block, k)
    open_ = np.flatnonzero(last < 63)
    symbol = np.concatenate([run % 16 << 4 | size, np.full(len(skips), 0xF0), np.zeros(len(open_), np.int64)])
    extra = np.concatenate([_tail(value, size), np.zeros(len(skips) + len(open_), np.int64)])
    bits = np.concatenate([size, np.zeros(len(skips) + len(open_), np.int64)])
    place = np.concatenate([block * 256 + 2 * k + 1, block[skips] * 256 + 2 * k[skips], open_ * 256 + 200])
    dc_table, dc_code, dc_length = _codes(dc_size, _DC_LENGTHS, list(range(12)))
    ac_table, ac_code, ac_length = _codes(symbol, _AC_LENGTHS, [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))])
    values = np.concatenate([dc_code[dc_size] << dc_size | _tail(first, dc_size), ac_code[symbol] << bits | extra])
    lengths = np.concatenate([dc_length[dc_size] + dc_size, ac_length[symbol] + bits])
    order = np.argsort(np.concatenate([np.arange(len(first)) * 256, place]), kind="stable")
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    ids = range(1, len(planes) + 1)
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), segment(0xDB, b"\0" + steps.reshape(-1)[_ZIGZAG].astype(np.uint8).tobytes()),
        segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i, 0x11, 0]) for i in ids)), segment(0xC4, b"\x00" + dc_table), segment(0xC4, b"\x10" + ac_table),
        segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i, 0]) for i in ids) + b"\0\x3f\0"), _pack(values[order], lengths[order]), b"\xff\xd9"])
