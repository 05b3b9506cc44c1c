"""MD5 of many short texts at once, in arrays: for draws that hash each of many texts behind each of many leads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import sin

import numpy as np
import pyarrow as pa

# Operands are arrays without dimensions: as such they cost numpy half the time of its scalars.
_START = [np.array(x, "u4") for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
#: Of each step its word, its constant and how far it turns left, and right. The last sixteen subtract their function's complement, so one less is added.
_STEPS = [((i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, np.array(int(abs(sin(i + 1)) * 2**32) - i // 48, "u4"), np.array(_TURNS[i // 16][i % 4], "u4"), np.array(32 - _TURNS[i // 16][i % 4], "u4"))
          for i in range(64)]
#: Texts that are laid out at a time.
PIECE = 2**14


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(text, byte) of texts without NULL, zero beyond their ends, and their sizes."""
    ends = np.frombuffer(texts.buffers()[1], "i4")[texts.offset:texts.offset + len(texts) + 1]
    sizes = np.diff(ends).astype("int64")
    out = np.zeros((len(texts), max(1, int(sizes.max()))), "u1")
    if ends[-1] > ends[0]:
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(texts.buffers()[2], "u1")[ends[0]:ends[-1]]
    return out, sizes


def message_words(texts: np.ndarray, sizes: np.ndarray, lead: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The messages that MD5 hashes for texts behind ``lead`` bytes, which are left zero: their words by number, without those that are zero in all,
    and how many blocks of 16 words each has. ``texts`` is (text, byte), zero beyond the ``sizes``."""
    blocks = (sizes + (lead + 8)) // 64 + 1
    words = np.zeros((16 * int(blocks.max()), len(sizes)), "<u4")
    for at in range(0, len(sizes), PIECE):
        size, block = sizes[at:at + PIECE], blocks[at:at + PIECE]
        row = np.arange(len(size))
        laid = np.zeros((len(size), 4 * len(words)), "u1")
        laid[:, lead:lead + texts.shape[1]] = texts[at:at + PIECE]
        laid[row, lead + size] = 0x80
        laid = laid.view("<u4")
        laid[row, 16 * block - 2] = 8 * (lead + size)
        words[:, at:at + PIECE] = laid.T
    return {k: w.copy() for k, w in enumerate(words) if w.any()}, blocks


def _buffers(number: int, shape: tuple[int, int]) -> list[np.ndarray]:
    """Arrays that begin on cache lines, on which arithmetic is a fifth faster."""
    size = 4 * shape[0] * shape[1]
    apart = -(-size // 64) * 64 + 1088
    raw = np.empty(number * apart + 64, "u1")
    first = -raw.ctypes.data % 64
    return [raw[first + i * apart:first + i * apart + size].view("u4").reshape(shape) for i in range(number)]


def md5_heads(leads: Sequence[bytes], words: Mapping[int, np.ndarray], blocks: np.ndarray) -> np.ndarray:
    """(lead, text): the first 32 bits of each text's MD5 behind each of the leads, which are of one length; texts as ``message_words`` lays them out."""
    width = -(-len(leads[0]) // 4)
    front = np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in leads), "<u4").reshape(len(leads), width)
    shape = (len(leads), len(blocks))
    heads, *whole = _buffers(7, shape)
    # What goes before the first word of a text is the same for all texts.
    a, b, c, d, f, g = _buffers(6, (len(leads), 1))
    for x, start in zip((a, b, c, d), _START, strict=True):
        x[:] = start
    add, left, right, xor, both, either = np.add, np.left_shift, np.right_shift, np.bitwise_xor, np.bitwise_and, np.bitwise_or
    most = int(blocks.max())
    for block in range(most):
        before = [x.copy() for x in (a, b, c, d)] if block else _START
        # The first word of a digest is done three steps before the others.
        for i, (word, constant, turn, rest) in enumerate(_STEPS[:61 if block + 1 == most else 64]):
            at = 16 * block + word
            if at in words and f is not whole[4]:
                for x, to in zip((a, b, c, d), whole, strict=False):
                    to[:] = x
                a, b, c, d, f, g = whole
            if i < 16:
                xor(c, d, f)
                both(f, b, f)
                xor(f, d, f)
            elif i < 32:
                xor(b, c, f)
                both(f, d, f)
                xor(f, c, f)
            elif i % 2 == 0:
                # b ^ c of this step is c ^ d of the next.
                xor(b, c, g)
                if i < 48:
                    xor(g, d, f)
                else:
                    either(b, d, f)
                    xor(f, g, f)
            elif i < 48:
                xor(g, b, f)
            else:
                both(b, d, f)
                xor(f, g, f)
            if i < 48:
                add(a, f, a)
            else:
                np.subtract(a, f, a)
            if at in words:
                add(a, words[at] + constant, a)
                if at < width:
                    add(a, front[:, at:at + 1], a)
            else:
                add(a, front[:, at:at + 1] + constant if at < width else constant, a)
            left(a, turn, f)
            right(a, rest, a)
            either(a, f, a)
            add(a, b, a)
            a, b, c, d = d, a, b, c
        if block + 1 == most:
            a = b
        else:
            for x, y in zip((b, c, d), before[1:], strict=True):
                add(x, y, x)
        add(a, before[0], a)
        np.copyto(heads, a, where=blocks == block + 1)
    return heads.byteswap(inplace=True)
