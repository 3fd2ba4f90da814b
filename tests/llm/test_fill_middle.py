import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import fill_middle
from tests.llm.cases import documents, empty, rows

PIECES = ["a", "Z", "P", "S", "<", ">", "<P>", "<S", "M>", "é", "漢", "😀", "\n", " ", "word", "<<P", "\x7f", "ß"]


def brute(doc_id, text, seed=1):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    first, second, keep, order = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or keep % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if order % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_transform_matches_brute_force_and_goes_back(spark):
    rng = random.Random(5)
    data = rows() + [(100 + i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))), None, None, None, None, None, None) for i in range(300)]
    out = fill_middle.transform(documents(spark, data))
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = sorted((brute(r[0], r[1] or "") for r in data), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    texts = {(r[0], r[1] or "") for r in data}
    assert {(r.doc_id, r.back) for r in got} == texts
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert {r.n_chars - len(r.back) for r in got} == {0} and {r.n_sentinels - len(re.findall("<[PSM]>", r.back)) for r in got} == {0}


def test_empty_and_parameters(spark):
    assert fill_middle.transform(empty(spark)).collect() == []
    none = fill_middle.transform(documents(spark), changed=0)
    assert {r.form for r in none.collect()} == {"plain"}
    assert {r.form for r in fill_middle.transform(documents(spark), changed=100, suffix_first=100).where("n > 0 AND n_sentinels = 0").collect()} == {"spm"}


def stepped(data, firsts):
    """The automaton byte by byte."""
    state, out = fill_middle.BETWEEN, []
    for i, byte in enumerate(data):
        at = int(state) * 2 * fill_middle.CLASSES + int(fill_middle.CLASS[byte]) + (fill_middle.CLASSES if i in firsts else 0)
        state = fill_middle.GOES[at]
        out.append(fill_middle.EMITS[at])
    return out


def test_rows_side_by_side_equal_one_scan():
    rng = random.Random(2)
    for size in (1, 511, 512, 513, 5000):
        data = np.frombuffer(bytes(rng.choice([0x41, 0x50, 0x3C, 0x3E, 0x20, 0x80, 0xBF, 0xC3, 0xE6, 0xF0]) for _ in range(size)), np.uint8)
        firsts = np.array(sorted({0, *rng.sample(range(size), min(5, size))}))
        assert fill_middle.emitted(data, firsts).tolist() == stepped(data, set(firsts.tolist()))


def test_a_wrong_guess_is_put_right():
    """More bytes of one code point than UTF-8 has make rows whose last bytes don't tell the state."""
    data = np.frombuffer(b"<P" * 300 + b"\xf0" * 400 + b"\x80" * 1200 + b">", np.uint8)
    assert fill_middle.emitted(data, np.array([0])).tolist() == stepped(data, {0})
