import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from sparkloom.llm import packing, token_output
from sparkloom.llm.common import new_path
from sparkloom.llm.encoding import Encoder, vocabulary
from tests.llm.cases import documents, empty, rows


def plain(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(name):
    rng = np.random.default_rng(5)
    parts = ["a", "Zb", " ", "  ", "\n", ",", ".", "'s", "é", "$", "%%%", "\t", "1", "ß", "́", "漢", "<|endoftext|>", "'", "\xa0", "\x85", "\x1c", "²", "…", "don't", "İ", "÷", "œ", "\x7f", "the"]
    texts = ["".join(rng.choice(parts[: rng.integers(8, len(parts))], rng.integers(0, 14))) for _ in range(8000)]
    ids, ends = Encoder(vocabulary(name)).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == plain(name, texts)


def test_token_digest(spark):
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_output.token_digest(documents(spark)).collect()}
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, {}
    for r, ids in zip(data, plain("byte_bpe_50k.json", [r[1] or "" for r in data])):
        own = np.array([*ids, 0], "<u4")
        want[r[0], at] = (len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert got == want
    assert token_output.token_digest(empty(spark)).count() == 0


def test_frames_are_independent_and_checked(spark, tmp_path):
    index = token_output.write_tokens(documents(spark), new_path(spark, "t"), vocabulary("byte_bpe_50k.json"), frame_bytes=64)
    listed = [r.asDict() for r in index.collect()]
    assert len(listed) > 4
    found = token_output.read_documents(listed, {4, 6})
    assert found[6].tolist() == [*plain("byte_bpe_50k.json", [rows()[6][1]])[0], 0] and set(found) == {4, 6}
    system, name = token_output.file_of(listed[0]["path"])
    data = bytearray(open(name, "rb").read())
    data[listed[0]["compressed"] // 2] ^= 1
    bad = tmp_path / "bad.zst"
    bad.write_bytes(bytes(data))
    with pytest.raises(Exception):
        token_output.ShardReader(str(bad)).frame(0)


def check_packed(out, texts, most):
    lengths = {i: len(x) + 1 for i, x in enumerate(plain("word_bpe_49k.json", texts))}
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and 0 < r.length <= most
            at += r.length
        assert at <= most
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return lengths, by_sequence


def test_pack(spark):
    out = packing.pack(documents(spark), most=256).collect()
    _, sequences = check_packed(out, [], 256)
    ids = dict(zip(range(10), plain("word_bpe_49k.json", [r[1] or "" for r in rows()[:10]])))
    times = Counter(r[0] for r in rows())
    seen = Counter()
    for r in out:
        if r.doc_id is not None:
            own = np.array([*ids[r.doc_id], 1], "<u4")
            assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
            seen[r.doc_id] += r.length
    assert all(seen[i] == times[i] * (len(x) + 1) for i, x in ids.items())
    assert packing.pack(empty(spark)).count() == 0


def test_patterns_place_every_piece_once():
    rng = np.random.default_rng(2)
    for most in (16, 2048):
        histogram = Counter(int(x) for x in np.minimum(most, 1 + rng.geometric(0.01 if most > 99 else 0.2, 5000))) | {1: 10**9}
        found = packing.patterns(dict(histogram), most)
        total = Counter()
        for count, lengths in found:
            assert sum(lengths) <= most and count > 0
            for x in lengths:
                total[x] += count
        assert total == histogram
        if most > 99:
            assert sum(c for c, _ in found) * most < 1.02 * sum(k * v for k, v in histogram.items()) + 2 * most


def test_pieces_of_a_length_follow_files_and_rows_not_the_reader(spark, tmp_path):
    # Files of unequal size, the last the longest, which the reader takes first.
    for name, a, b, size in (("part-00000-x-c000", 0, 5, 1), ("part-00001-x-c000", 5, 9, 400), ("part-00001-x-c001", 9, 15, 10), ("part-00010-x-c000", 15, 40, 900)):
        rows = [(i, "same text", hashlib.sha512(str(i).encode()).hexdigest() * size) for i in range(a, b)]
        spark.createDataFrame(rows, "doc_id long, text string, filler string").coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/{name}")
        (tmp_path / "mix").mkdir(exist_ok=True)
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / "mix" / f"{name}.parquet")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "600k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            mix = spark.read.parquet(f"{tmp_path}/mix")
            length = packing.pack(mix).first().length
            assert [r.sequence_id for r in packing.pack(mix, most=length).orderBy("doc_id").collect()] == list(range(40))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
