"""Words of whole texts as UTF-8: runs of ASCII letters, digits and everything beyond ASCII, with A to Z in lower case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: What each byte becomes: bytes of characters beyond ASCII are all above 0x7F and stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of text that are lists of words at once.
STEP = 4 << 20


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in lists, of which a very long text has several."""
    text = (text or b"").translate(_BYTES)
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + STEP) if at + STEP < len(text) else -1
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


class Dictionary(dict):
    """Word to number, in the order of first use; a word that is not known gets the next number."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, and the n + 1 bounds of each text's words."""
        parts, bounds, n = [np.empty(0, np.int64)], np.zeros(len(texts) + 1, np.int64), 0
        for k, text in enumerate(texts):
            for piece in words(text):
                parts.append(np.fromiter(map(self.__getitem__, piece), np.int64, len(piece)))
                n += len(piece)
            bounds[k + 1] = n
        return np.concatenate(parts), bounds
