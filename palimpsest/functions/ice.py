"""The ICE block cipher at its smallest level (eight rounds, keys of eight bytes), for scripts that are shipped encrypted.

After M. Kwan, "The Design of the ICE Encryption Algorithm" (1997), which is in the public domain.
"""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the cipher: moduli and offsets of the boxes, bits of the permutation, order of the key words.
MODULI = ((333, 313, 505, 369), (379, 375, 319, 391), (361, 445, 451, 397), (397, 425, 395, 505))
OFFSETS = ((0x83, 0x85, 0x9B, 0xCD), (0xCC, 0xA7, 0xAD, 0x41), (0x4B, 0x2E, 0xD4, 0x33), (0xEA, 0xCB, 0x2E, 0x04))
PERMUTED = (0, 7, 10, 13, 19, 21, 24, 30, 3, 5, 8, 14, 16, 23, 26, 29, 2, 4, 9, 15, 17, 22, 27, 28, 1, 6, 11, 12, 18, 20, 25, 31)
KEY_ORDER = (0, 1, 2, 3, 2, 1, 3, 0)


def _times(a: int, b: int, modulus: int) -> int:
    out = 0
    while b:
        out ^= a * (b & 1)
        a, b = a << 1, b >> 1
        if a > 255:
            a ^= modulus
    return out


@lru_cache(maxsize=1)
def boxes() -> tuple[tuple[int, ...], ...]:
    """Four boxes of 1024 words: the seventh power in a field of 256, spread by the permutation."""

    def word(box: int, i: int) -> int:
        row, col = (i & 1) | (i >> 8 & 2), i >> 1 & 255
        m = MODULI[box][row]
        x = col ^ OFFSETS[box][row]
        cube = _times(x, _times(x, x, m), m)
        power = _times(x, _times(cube, cube, m), m) << (24 - 8 * box)
        return sum(1 << PERMUTED[k] for k in range(32) if power >> k & 1)

    return tuple(tuple(word(box, i) for i in range(1024)) for box in range(4))


@lru_cache(maxsize=64)
def schedule(key: bytes) -> tuple[tuple[int, int, int], ...]:
    words = [key[6 - 2 * i] << 8 | key[7 - 2 * i] for i in range(4)]
    out = []
    for turn in KEY_ORDER:
        sub = [0, 0, 0]
        for j in range(15):
            for k in range(4):
                at = turn + k & 3
                bit = words[at] & 1
                sub[j % 3] = sub[j % 3] << 1 | bit
                words[at] = words[at] >> 1 | (bit ^ 1) << 15
        out.append(tuple(sub))
    return tuple(out)


def _round(half: int, sub: tuple[int, int, int]) -> int:
    left = half >> 16 & 0x3FF | (half >> 14 | half << 18) & 0xFFC00
    right = half & 0x3FF | half << 2 & 0xFFC00
    swap = sub[2] & (left ^ right)
    left, right = left ^ swap ^ sub[0], right ^ swap ^ sub[1]
    s = boxes()
    return s[0][left >> 10] | s[1][left & 0x3FF] | s[2][right >> 10] | s[3][right & 0x3FF]


def _block(data: bytes, keys: tuple) -> bytes:
    left, right = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:], "big")
    for i in range(0, len(keys), 2):
        left ^= _round(right, keys[i])
        right ^= _round(left, keys[i + 1])
    return right.to_bytes(4, "big") + left.to_bytes(4, "big")


def encrypt(data: bytes, key: bytes) -> bytes:
    """Block by block; what does not fill a block stays as it is."""
    keys, whole = schedule(key), len(data) // 8 * 8
    return b"".join(_block(data[i : i + 8], keys) for i in range(0, whole, 8)) + data[whole:]


def decrypt(data: bytes, key: bytes) -> bytes:
    keys, whole = schedule(key)[::-1], len(data) // 8 * 8
    return b"".join(_block(data[i : i + 8], keys) for i in range(0, whole, 8)) + data[whole:]
