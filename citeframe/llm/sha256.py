"""SHA-256 over hex digests, with its state between children kept as data.

A digest in hex text is 64 bytes, exactly one block of SHA-256. The hash of a parent is
therefore one compression per child and one for the padding, and the state before a child
is the eight words of the chaining value: it can be copied, stored in a column and resumed
in another task, which the states of hashlib cannot. All functions work on many messages
at once: states and digests are arrays of shape (rows, 8) of 32-bit words.
"""

from __future__ import annotations

import numpy as np

_M32 = 0xFFFFFFFF


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _root_bits(n: int, degree: int) -> int:
    """The first 32 bits of the fraction of the square or cube root of n, exactly."""
    low, high = 0, n << 32
    while low < high:  # greatest r with r ** degree <= n * 2 ** (32 * degree)
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**degree <= n << 32 * degree else (low, middle - 1)
    return low & _M32


START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
_ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint16)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _schedule(block: np.ndarray) -> list[np.ndarray]:
    """Message words of every round; `block` is (16, rows)."""
    w = list(block)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        small = _turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))
        large = _turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))
        w.append(w[t - 16] + small + w[t - 7] + large)
    return w


def _rounds(states: np.ndarray, w: list) -> np.ndarray:
    a, b, c, d, e, f, g, h = np.ascontiguousarray(states.T)
    for k, word in zip(_ROUND, w):
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (word + k)
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + first, c, b, a, first + second
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hex_bytes(digests: np.ndarray) -> np.ndarray:
    """(rows, 64) bytes of lowercase hex text."""
    raw = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(len(digests), 32)
    return _HEX[raw].view(np.uint8).reshape(len(digests), 64)


def from_hex(text: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(text)), ">u4").astype(np.uint32).reshape(len(text), 8)


def to_hex(digests: np.ndarray) -> list[str]:
    raw = hex_bytes(digests).tobytes().decode("ascii")
    return [raw[at : at + 64] for at in range(0, len(raw), 64)]


def absorb(states: np.ndarray, digests: np.ndarray, rows: int = 8192) -> np.ndarray:
    """The states after one more child, whose digest is taken as hex text."""
    out = np.empty_like(states)
    for at in range(0, len(states), rows):
        part = slice(at, at + rows)
        block = hex_bytes(digests[part]).view(">u4").astype(np.uint32).T
        out[part] = _rounds(states[part], _schedule(np.ascontiguousarray(block)))
    return out


def finish(states: np.ndarray, children: int) -> np.ndarray:
    """Digests of messages of so many children: the padding block is a constant."""
    block = np.zeros((16, 1), np.uint32)
    block[0] = 0x80000000
    bits = children * 512
    block[14], block[15] = bits >> 32, bits & _M32
    return _rounds(states, _schedule(block))


def start(rows: int) -> np.ndarray:
    return np.broadcast_to(START, (rows, 8)).copy()
