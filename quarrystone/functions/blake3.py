"""BLAKE3, vectorised with numpy over all 1 KiB leaves of a batch of messages.

The three modes of the published specification: hash, keyed hash (by its key words) and
derive_key, whose context string separates the domains of object kinds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

# Fixed values of the specification: the initial words, the message permutation and the flags.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_PERMUTE = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT, _CONTEXT, _MATERIAL = 1, 2, 4, 8, 32, 64
_LEAF, _BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mix(s: list, a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    s[a] = s[a] + s[b] + x
    s[d] = _turn(s[d] ^ s[a], 16)
    s[c] = s[c] + s[d]
    s[b] = _turn(s[b] ^ s[c], 12)
    s[a] = s[a] + s[b] + y
    s[d] = _turn(s[d] ^ s[a], 8)
    s[c] = s[c] + s[d]
    s[b] = _turn(s[b] ^ s[c], 7)


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """All rows at once: (n, 8), (n, 16), (n,), (n,), (n,) -> (n, 16)."""
    n = len(cv)
    s = [cv[:, i].copy() for i in range(8)] + [np.full(n, _IV[i], np.uint32) for i in range(4)]
    s += [(counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    m = [np.ascontiguousarray(block[:, i]) for i in range(16)]
    for r in range(7):
        for k in range(4):
            _mix(s, k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            _mix(s, k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        if r < 6:
            m = [m[i] for i in _PERMUTE]
    return np.stack([s[i] ^ s[i + 8] for i in range(8)] + [s[i + 8] ^ cv[:, i] for i in range(8)], axis=1)


def _roots(messages: Sequence[bytes], key: np.ndarray, mode: int, before: int = 0) -> tuple[np.ndarray, ...]:
    """The arguments of each message's last compression; ``before`` leaves of the same message went before."""
    sizes = np.array([len(m) for m in messages], np.int64)
    leaves = np.maximum(1, -(-sizes // _LEAF))
    first = np.cumsum(leaves) - leaves
    total = int(leaves.sum())
    data = np.zeros(total * _LEAF, np.uint8)
    for m, f in zip(messages, first.tolist(), strict=True):
        data[f * _LEAF : f * _LEAF + len(m)] = np.frombuffer(m, np.uint8)
    words = data.view("<u4").reshape(total, 16, 16)
    counter = (np.arange(total) - np.repeat(first, leaves)).astype(np.uint64)
    left = np.minimum(np.repeat(sizes, leaves) - counter.astype(np.int64) * _LEAF, _LEAF)
    blocks = np.maximum(1, -(-left // _BLOCK))
    counter += np.uint64(before)
    cv = np.repeat(key[None, :], total, axis=0)
    alone = np.repeat(leaves == 1, leaves)
    out = [np.zeros((len(messages), 8), np.uint32), np.zeros((len(messages), 16), np.uint32), np.zeros(len(messages), np.uint64), np.zeros(len(messages), np.int64), np.zeros(len(messages), np.int64)]
    owner = np.repeat(np.arange(len(messages)), leaves)
    for b in range(16):
        at = np.flatnonzero(blocks > b)
        if not len(at):
            break
        last = blocks[at] == b + 1
        flags = np.full(len(at), mode) | (_START if b == 0 else 0) | np.where(last, _END, 0)
        size = np.clip(left[at] - b * _BLOCK, 0, _BLOCK)
        end = last & alone[at]
        if end.any():  # a message of one leaf ends here
            who = owner[at[end]]
            for o, v in zip(out, (cv[at], words[at, b], counter[at], size, flags), strict=True):
                o[who] = v[end]
        cv[at] = _compress(cv[at], words[at, b], counter[at], size, flags)[:, :8]
    count, nodes = leaves.copy(), cv
    while (count > 1).any():
        start = np.cumsum(count) - count
        who = np.repeat(np.arange(len(messages)), count)
        place = np.arange(len(nodes)) - start[who]
        lead = np.flatnonzero((place % 2 == 0) & (place + 1 < count[who]))
        block = np.concatenate([nodes[lead], nodes[lead + 1]], axis=1)
        keys = np.repeat(key[None, :], len(lead), axis=0)
        zero, full, flags = np.zeros(len(lead), np.uint64), np.full(len(lead), _BLOCK), np.full(len(lead), mode | _PARENT)
        top = count[who[lead]] == 2
        if top.any():
            for o, v in zip(out, (keys, block, zero, full, flags), strict=True):
                o[who[lead[top]]] = v[top]
        nodes = nodes.copy()
        nodes[lead] = _compress(keys, block, zero, full, flags)[:, :8]
        nodes = nodes[place % 2 == 0]
        count = -(-count // 2)
    return tuple(out)


def _output(roots: tuple[np.ndarray, ...], n: int) -> list[bytes]:
    cv, block, _, size, flags = roots
    parts = [_compress(cv, block, np.full(len(cv), i, np.uint64), size, flags | _ROOT).astype("<u4") for i in range(-(-n // 64))]
    flat = np.concatenate(parts, axis=1)
    return [r.tobytes()[:n] for r in flat]


@lru_cache(maxsize=64)
def _context_key(context: str) -> bytes:
    return _output(_roots([context.encode()], _IV, _CONTEXT), 32)[0]


def digests(messages: Sequence[bytes], context: str | None = None, n: int = 32) -> list[bytes]:
    """n output bytes of each message, hashed plainly or, with a context, in derive_key mode."""
    if not len(messages):
        return []
    if context is None:
        return _output(_roots(messages, _IV, 0), n)
    return _output(_roots(messages, np.frombuffer(_context_key(context), "<u4").astype(np.uint32), _MATERIAL), n)


class Hasher:
    """B2: hashes a message that comes in parts, in bounded memory.

    Whole subtrees of ``SPAN`` leaves are reduced as soon as a byte follows them, and joined like
    the carries of a binary counter; what is left over closes the tree."""

    SPAN = 4096

    def __init__(self, context: str | None = None):
        self._key, self._mode = (_IV, 0) if context is None else (np.frombuffer(_context_key(context), "<u4").astype(np.uint32), _MATERIAL)
        self._held, self._spans, self._nodes = bytearray(), 0, []

    def _node(self, data: bytes) -> np.ndarray:
        return _compress(*_roots([data], self._key, self._mode, self._spans * self.SPAN))[:, :8]

    def _parent(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
        return self._key[None, :], np.concatenate([left, right], axis=1), np.zeros(1, np.uint64), np.full(1, _BLOCK), np.full(1, self._mode | _PARENT)

    def update(self, data: bytes) -> None:
        self._held += data
        step, at = self.SPAN * _LEAF, 0
        while len(self._held) - at > step:
            node, at = self._node(bytes(self._held[at : at + step])), at + step
            self._spans += 1
            done = self._spans
            while done % 2 == 0:
                node, done = _compress(*self._parent(self._nodes.pop(), node))[:, :8], done // 2
            self._nodes.append(node)
        del self._held[:at]

    def digest(self, n: int = 32) -> bytes:
        rest = bytes(self._held)
        if not self._nodes:
            return _output(_roots([rest], self._key, self._mode), n)[0]
        node, last = self._node(rest), None
        for left in reversed(self._nodes):
            last = self._parent(left, node)
            node = _compress(*last)[:, :8]
        return _output(last, n)[0]


def derive_bytes(context: str, n: int, material: bytes = b"") -> bytes:
    return digests([material], context, n)[0]
