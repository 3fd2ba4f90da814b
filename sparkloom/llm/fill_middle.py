"""Fill-in-the-middle: documents cut into prefix, middle and suffix at unit boundaries and put in another order.

A unit is a run of ASCII letters or any other single code point. One scan of the bytes by a table-driven automaton
follows UTF-8 sequences, finds where units begin and recognises sentinels; what its transitions emit is counted by
document. A second pass turns the cuts, which are numbers of units, into byte positions.

All texts of a batch go through the table side by side: their bytes are folded into rows of ``WIDTH``, each row begins in
the state in which the row before it ends, guessed from its last bytes and put right if the guess was wrong.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, with_text

#: Fixed strings of the output format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Classes of bytes.
LETTER, NAME, OPEN, CLOSE, OTHER, CONTINUED, LEAD2, LEAD3, LEAD4 = range(9)
CLASSES = 9
#: States: between units, in a run of letters, after an opening bracket, after it and a sentinel's letter, and with one to
#: three bytes of a code point to come.
BETWEEN, WORD, OPENED, NAMED, NEED1, NEED2, NEED3 = range(7)
#: What a transition emits.
UNIT, CHAR, SENTINEL = 1, 2, 4
#: Bytes of a row; the last few of them tell the state in valid UTF-8.
WIDTH, TAIL = 512, 4


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for first, last, kind in ((0x41, 0x5A, LETTER), (0x61, 0x7A, LETTER), (0x80, 0xBF, CONTINUED), (0xC0, 0xDF, LEAD2), (0xE0, 0xEF, LEAD3), (0xF0, 0xF7, LEAD4)):
        out[first : last + 1] = kind
    for mark in (PREFIX, SUFFIX, MIDDLE):
        out[mark[1]] = NAME
    out[ord("<")], out[ord(">")] = OPEN, CLOSE
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission of each transition, state * 2 * CLASSES + class; classes from CLASSES on are those of a text's
    first byte, for which the state before doesn't count."""
    goes = np.zeros((7, 2 * CLASSES), np.uint8)
    emits = np.full((7, 2 * CLASSES), UNIT | CHAR, np.uint8)
    for state in range(7):
        goes[state, :CLASSES] = [WORD, NAMED if state == OPENED else WORD, OPENED, BETWEEN, BETWEEN, BETWEEN, NEED1, NEED2, NEED3]
        if state >= NEED1:  # a byte of the code point at hand; elsewhere such a byte is a code point of its own
            goes[state, CONTINUED], emits[state, CONTINUED] = (state - 1 if state > NEED1 else BETWEEN), 0
        if state in (WORD, NAMED):
            emits[state, [LETTER, NAME]] = CHAR
        if state == NAMED:
            emits[state, CLOSE] |= SENTINEL
    goes[:, CLASSES:], emits[:, CLASSES:] = goes[BETWEEN, :CLASSES], emits[BETWEEN, :CLASSES]
    return goes.ravel(), emits.ravel()


CLASS = _classes()
GOES, EMITS = _tables()
STEP = np.uint8(2 * CLASSES)


def emitted(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """What the transition at each byte emits; ``firsts`` are the places of the texts' first bytes."""
    kinds = np.full(-(-len(data) // WIDTH) * WIDTH, OTHER, np.uint8)
    kinds[: len(data)] = CLASS[data]
    kinds[firsts] += CLASSES
    columns = np.ascontiguousarray(kinds.reshape(-1, WIDTH).T)
    out = np.empty_like(columns)

    def run(state: np.ndarray, first: int, keep: bool) -> np.ndarray:
        for j in range(first, WIDTH):
            at = state * STEP + columns[j]
            if keep:
                out[j] = EMITS[at]
            state = GOES[at]
        return state

    begin = np.full(columns.shape[1], BETWEEN, np.uint8)
    begin[1:] = run(begin, WIDTH - TAIL, False)[:-1]
    while True:
        ends = run(begin, 0, True)
        if (ends[:-1] == begin[1:]).all():
            return out.T.reshape(-1)[: len(data)]
        begin[1:] = ends[:-1]


class Scan:
    """One scan of a batch of UTF-8 texts: units, code points and sentinels of each."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        full = np.flatnonzero(sizes)
        self.flags = emitted(np.frombuffer(b"".join(texts), np.uint8), self.starts[full]) if len(full) else np.zeros(0, np.uint8)
        self.units, self.chars, self.sentinels = (self._counted(flag, full) for flag in (UNIT, CHAR, SENTINEL))

    def _counted(self, flag: int, full: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ends), np.int64)
        if len(full):
            out[full] = np.add.reduceat((self.flags & flag) != 0, self.starts[full], dtype=np.int64)
        return out

    def cuts(self, i: int, *units: int) -> list[int]:
        """Byte positions in text i that so many of its units precede."""
        own = self.flags[self.starts[i] : self.ends[i]]
        places = np.flatnonzero(own & UNIT)
        return [int(places[k]) if k < len(places) else len(own) for k in units]

    def chars_between(self, i: int, begin: int, end: int) -> int:
        return int(np.count_nonzero(self.flags[self.starts[i] + begin : self.starts[i] + end] & CHAR))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document, from the SHA-256 of seed and id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(documents: DataFrame, seed: int = 1, changed: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, n_chars and n_sentinels of each row of ``documents``.

    Of 100 documents about ``changed`` change, of 100 changed ones about ``suffix_first`` take the form spm, the others psm. A
    null or empty text, and one that holds a sentinel, stays plain, with null prefix_chars and middle_chars. A null
    doc_id draws as an empty one; repeated rows give equal rows. Long texts are scanned whole. Of extra columns none is read.
    Stray bytes, which Spark's strings don't hold, count as a code point each.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, n_chars long, n_sentinels long"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            ids = part.column("doc_id").to_pylist()
            scan = Scan(texts)
            forms, heads, bodies, outputs = [], [], [], []
            for i, text in enumerate(texts):
                first, second, keep, order = draws(seed, ids[i])
                n = int(scan.units[i])
                if not text or scan.sentinels[i] or keep % 100 >= changed:
                    forms.append("plain"), heads.append(None), bodies.append(None), outputs.append(text)
                    continue
                left, right = sorted((first % (n + 1), second % (n + 1)))
                a, b = scan.cuts(i, left, right)
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                spm = order % 100 < suffix_first
                forms.append("spm" if spm else "psm")
                heads.append(scan.chars_between(i, 0, a)), bodies.append(scan.chars_between(i, a, b))
                outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
            columns = [part.column("doc_id"), pa.array(scan.units), pa.array(forms), pa.array(heads, pa.int64()), pa.array(bodies, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(scan.chars), pa.array(scan.sentinels)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(with_text(documents), work, schema)


def restored(output: Column, form: Column) -> Column:
    """The text from which ``transform`` made ``output``. A changed text held no sentinel and a sentinel can't begin within
    another, so the first of each kind is the one put there. Null where either is null."""
    first, second, third = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    psm = F.regexp_replace(output, f"(?s)^{first}(.*?){second}(.*?){third}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{second}(.*?){first}(.*?){third}(.*)$", "$2$3$1")
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
