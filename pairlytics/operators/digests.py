"""MD5 of many short texts at once: the digest's words as arrays, for draws and shuffles that hash each row of a table in each trial."""

from __future__ import annotations

import hashlib

import numpy as np

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADDED = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_FIRST = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes of a message that is hashed as one block, and messages that are hashed together (their words stay in a core's cache).
ONE_BLOCK, TOGETHER = 55, 1 << 14


def _one_block(block: list[np.ndarray]) -> np.ndarray:
    """Four words, as little-endian numbers, of messages of one block given as its 16 words (arrays, or numbers where all messages agree)."""
    a, b, c, d = _FIRST
    for i in range(64):
        turn, at = divmod(i, 16)
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), at
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * at + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * at + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * at % 16
        f = f + a + (block[g] + _ADDED[i])
        s = np.uint32(_TURNS[turn][i % 4])
        a, d, c, b = d, c, b, b + (f << s | f >> (np.uint32(32) - s))
    return np.stack([x + y for x, y in zip((a, b, c, d), _FIRST, strict=True)])


class Keys:
    """Texts whose digests behind many prefixes are wanted."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.laid: dict[int, list[tuple[np.ndarray, list[np.ndarray] | None]]] = {}

    def _lay(self, ahead: int) -> list[tuple[np.ndarray, list[np.ndarray] | None]]:
        """(rows, words of their block with `ahead` bytes left free) by length and some rows at a time; no words for long texts."""
        if ahead not in self.laid:
            out = []
            for size in np.unique(self.sizes).tolist():
                same = np.flatnonzero(self.sizes == size)
                for rows in np.split(same, range(TOGETHER, len(same), TOGETHER)):
                    if ahead + size > ONE_BLOCK:
                        out.append((rows, None))
                        continue
                    raw = np.zeros((len(rows), 64), np.uint8)
                    raw[:, ahead : ahead + size] = np.frombuffer(b"".join([self.texts[i] for i in rows]), np.uint8).reshape(len(rows), size)
                    raw[:, ahead + size] = 0x80
                    raw[:, 56:] = np.frombuffer((8 * (ahead + size)).to_bytes(8, "little"), np.uint8)
                    words = np.ascontiguousarray(raw.view("<u4").T)
                    out.append((rows, [w if (w != w[0]).any() else w[:1] for w in words]))
            self.laid[ahead] = out
        return self.laid[ahead]

    def words(self, prefix: bytes) -> np.ndarray:
        """Four words (first row: the leading ones, as big-endian numbers, so they sort as digests do) of md5(prefix + text) of each text."""
        out = np.empty((4, len(self.texts)), np.uint32)
        lead = np.frombuffer(prefix + bytes(-len(prefix) % 4), "<u4")
        for rows, block in self._lay(len(prefix)):
            if block is None:
                out[:, rows] = np.frombuffer(b"".join([hashlib.md5(prefix + self.texts[i]).digest() for i in rows]), ">u4").reshape(-1, 4).T
            else:
                found = _one_block([w | lead[k] if k < len(lead) else w for k, w in enumerate(block)])
                out[:, rows] = np.broadcast_to(found, (4, len(rows))).byteswap()
        return out

    def first32(self, prefix: bytes) -> np.ndarray:
        """The number that the first eight hexadecimal digits of each digest give."""
        return self.words(prefix)[0]
