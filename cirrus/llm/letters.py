"""Letters of many texts at once, in lower case, words parted by one zero."""

from __future__ import annotations

import numpy as np

_fold: np.ndarray | None = None


def fold() -> np.ndarray:
    """Lower-case code point of every letter, 0 for other characters; built once in each process."""
    global _fold
    if _fold is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                out[c] = ord(ch.lower()[0])
        _fold = out
    return _fold


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all texts, and where each text begins in them (and the end).

    Every text begins with a zero; each run of other characters behind a letter is one zero.
    """
    joined = "\0" + "\0".join(t or "" for t in texts) + "\0"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = fold()[chars]
    marks = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=marks[1:])
    keep = low != 0
    keep[1:] |= low[:-1] != 0
    keep[marks] = True
    return low[keep], (np.cumsum(keep) - 1)[marks]
