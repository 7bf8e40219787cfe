"""The encoding of a text by the likelihood of its characters.

Each legacy encoding has classes of characters by the bytes it writes them with (kana, syllables, the common half of its ideographs, marks), and a
share of running text for each class; a character of a class is as likely as its share over its size. Of the encodings that a file can be
decoded by at all, the one under which its bytes are most likely is taken.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Shares of running text, with first and last bytes from and to: the classes of each encoding in order, the first that fits counts.
CLASSES: dict[str, list[tuple[float, int, int, int, int]]] = {
    "shift_jis": [(0.44, 0x82, 0x82, 0x9F, 0xF1), (0.12, 0x83, 0x83, 0x40, 0x96), (0.30, 0x88, 0x97, 0x40, 0xFC), (0.08, 0x81, 0x81, 0x40, 0xFC), (0.02, 0x82, 0x82, 0x40, 0x9E)],
    "gb18030": [(0.84, 0xB0, 0xD7, 0xA1, 0xFE), (0.02, 0xD8, 0xF7, 0xA1, 0xFE), (0.10, 0xA1, 0xA3, 0xA1, 0xFE)],
    "euc_jp": [(0.44, 0xA4, 0xA4, 0xA1, 0xF3), (0.12, 0xA5, 0xA5, 0xA1, 0xF6), (0.30, 0xB0, 0xCF, 0xA1, 0xFE), (0.08, 0xA1, 0xA1, 0xA1, 0xFE), (0.02, 0xA3, 0xA3, 0xA1, 0xFE)],
    "euc_kr": [(0.94, 0xB0, 0xC8, 0xA1, 0xFE), (0.03, 0xA1, 0xA3, 0xA1, 0xFE)],
    "big5": [(0.84, 0xA4, 0xC6, 0x40, 0xFE), (0.02, 0xC9, 0xF9, 0x40, 0xFE), (0.10, 0xA1, 0xA3, 0x40, 0xFE)],
    "cp1252": [(0.92, 0xC0, 0xFF, 0, 0), (0.06, 0x80, 0xBF, 0, 0)],
}
#: What is left for characters of no class, and for a byte of ASCII; a letter beyond ASCII beside another one is rare in an alphabet.
REST, ASCII, BESIDE = 0.005, 0.9, 0.08


@lru_cache(8)
def _likelihoods(encoding: str) -> np.ndarray:
    """The logarithm of the likelihood of each code unit of 16 bits."""
    of = np.full(1 << 16, -1)
    listed = CLASSES[encoding]
    for c in range(0x80, 1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        try:
            b = chr(c).encode(encoding)
        except UnicodeEncodeError:
            continue
        trail = b[1] if len(b) == 2 else 0
        of[c] = next((k for k, (_, a, z, low, high) in enumerate(listed) if a <= b[0] <= z and low <= trail <= high and len(b) <= 2), len(listed))
    out = np.full(1 << 16, np.log(REST / 30_000))
    for k, share in enumerate([*(c[0] for c in listed), REST]):
        size = int((of == k).sum())
        if size:
            out[of == k] = np.log(share / size)
    out[:0x80] = np.log(ASCII / 95)
    return out


def likelihood(text: str, encoding: str) -> float:
    """The logarithm of the likelihood of a text that an encoding gives."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    total = float(_likelihoods(encoding)[units].sum())
    if encoding == "cp1252":
        wide = units >= 0x80
        total += float((wide[1:] & wide[:-1]).sum()) * np.log(BESIDE)
    return total


def legacy(content: bytes) -> tuple[str, str] | None:
    """(text, encoding) of the likeliest encoding, None if there is none that the bytes can be decoded by."""
    best = None
    for encoding in CLASSES:
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        score = likelihood(text, encoding)
        if best is None or score > best[0]:
            best = score, text, encoding
    return best and best[1:]
