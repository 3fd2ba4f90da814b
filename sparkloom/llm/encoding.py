"""Token ids of many texts through the ``tokenizers`` library, which sees each different piece of text once.

A text is cut where the pre-tokenizer always cuts: before an isolated space or line end, and between a Latin
letter or digit and a comma or full stop. Such pieces encode alone to the same ids, and words repeat, so a piece is encoded
once and remembered. Texts with any construct for which this isn't certain are encoded whole.
"""

from __future__ import annotations

import os
from collections import defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker remembers at most; then it starts afresh. This bounds memory and changes no result.
REMEMBERED = 1_000_000
#: Classes of UTF-8 bytes.
SYMBOL, LETTER, BLANK, STOP, LEAD, ODD = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, SYMBOL, np.uint8)
    for byte in range(256):
        char = chr(byte)
        if byte < 128 and char.isalnum() or 0x80 <= byte < 0xC0:  # a byte that continues one of LEAD
            out[byte] = LETTER
        elif char in " \n":
            out[byte] = BLANK
        elif char in ",.":
            out[byte] = STOP
        elif byte == 0xC3:  # À to ÿ
            out[byte] = LEAD
        elif byte < 32 or byte == 127 or byte >= 0xC0:
            out[byte] = ODD
    return out


CLASS = _classes()


def uncertain(texts: list[bytes]) -> np.ndarray:
    """Which of the non-empty texts hold anything at which a break might not be one for the pre-tokenizer."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    kind = CLASS[data]
    before = np.concatenate([[BLANK], kind[:-1]]).astype(np.uint8)
    before[starts[:-1]] = BLANK
    bad = (kind == ODD) | ((kind == STOP) & (before != LETTER)) | ((kind == BLANK) & (before == BLANK))
    bad[1:] |= (before[1:] == LEAD) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # × and ÷
    bad[starts[1:] - 1] |= kind[starts[1:] - 1] == BLANK
    return np.logical_or.reduceat(bad, starts[:-1])


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches with the file at ``path``, never adding special tokens and taking their strings as text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.starts, self.ids, self.held = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32 and, for text i, where its ids start and end: ids[starts[i]:starts[i + 1]]."""
        if len(self.place) > REMEMBERED or self.held > REMEMBERED * 16:
            self.forget()
        place, old = self.place, len(self.place)
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        full = [i for i, text in enumerate(texts) if text]
        whole = []
        for i, odd in zip(full, uncertain([texts[i].encode() for i in full]) if full else ()):
            text = texts[i]
            if odd:
                whole.append(text)
                own = [text]
            else:
                own = text.replace(" ", "\0 ").replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.").split("\0")
            counts[i] = len(own)
            pieces += own
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        found = self.ids_of([*islice(reversed(place), len(place) - old)][::-1])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])
        self.held += sum(map(len, whole))
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        out = self.ids[np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))]
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return out, per_text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and file, so that it remembers pieces from task to task."""
    return Encoder(path)
