import hashlib
import zlib

import numpy as np
import pytest

from sparkloom.llm import flac, media
from tests.llm.cases import documents, empty, rows


def payloads():
    rng = np.random.default_rng(0)
    noise = [bytes(rng.integers(low, high, 64 * int(rng.integers(1, 70)), dtype=np.uint8)) for low, high in ((0, 256), (90, 110), (0, 2), (127, 129)) for _ in range(6)]
    return [bytes(64), b"a" * 4096, b"hello..." * 64 * 40, b"\x00\xff" * 3200, bytes(range(256)) * 20, *noise]


def test_round_trip_and_equal_streams_alone_or_together():
    own = payloads()
    streams = flac.encode(own)
    assert flac.decode(streams) == own and flac.decode(streams, lanes=3) == own
    assert [flac.encode([x])[0] for x in own] == streams and flac.encode(own, most=1 << 11) == streams


def test_streams_without_seek_points_are_read_in_order():
    own = payloads()[:12]
    bare = []
    for s in flac.encode(own):
        begin, *_ = flac.layout(s)
        bare.append(s[:4] + bytes([0x80]) + s[5:42] + s[begin:])
    assert flac.decode(bare) == own


def bits(*fields):
    text = "".join(f"{v & (1 << w) - 1:0{w}b}" for v, w in fields)
    return text


def stream(samples, subframe):
    """A one-frame stream by hand, of the written-out bits of a subframe."""
    body = int(subframe + "0" * (-len(subframe) % 8), 2).to_bytes(-(-len(subframe) // 8), "big")
    head = b"\xff\xf8\x74\x02\x00" + (len(samples) - 1).to_bytes(2, "big")
    crc = lambda d, poly, width: _crc(d, poly, width).to_bytes(width // 8, "big")
    frame = head + crc(head, 7, 8) + body
    frame += crc(frame, 0x8005, 16)
    info = bytes([4, 0, 4, 0]) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(bytes(x & 255 for x in samples)).digest()
    return b"fLaC\x80\x00\x00\x22" + info + frame


def _crc(data, polynomial, width):
    now = 0
    for byte in data:
        now ^= byte << width - 8
        for _ in range(8):
            now = (now << 1 ^ (polynomial if now >> width - 1 & 1 else 0)) & (1 << width) - 1
    return now


def rice(v, k):
    z = v << 1 if v >= 0 else -v * 2 - 1
    return "0" * (z >> k) + "1" + (f"{z & (1 << k) - 1:0{k}b}" if k else "")


def test_forms_that_the_encoder_does_not_write():
    x = [3, 5, -4, 100, 90, -128, 127, 0, 1, 2, 3, 4, 7, 7, 7, -60]
    decoded = lambda s: [b - 128 for b in flac.decode([s])[0]]
    assert decoded(stream(x, bits((0b00000010, 8), *((v, 8) for v in x)))) == x  # verbatim
    partitions = bits((0b00010000, 8)) + bits((0, 2), (2, 4)) + "".join(bits((k, 4)) + "".join(rice(v, k) for v in x[4 * j : 4 * j + 4]) for j, k in enumerate((0, 5, 1, 7)))
    assert decoded(stream(x, partitions)) == x  # partitions, and codes longer than the window
    escape = bits((0b00010000, 8), (1, 2), (0, 4), (31, 5), (9, 5), *((v, 9) for v in x))
    assert decoded(stream(x, escape)) == x
    third, now = [], x
    for _ in range(3):
        now = [b - a for a, b in zip(now, now[1:])]
    fixed = bits((0b00010110, 8), *((v, 8) for v in x[:3]), (1, 2), (0, 4), (6, 5)) + "".join(rice(v, 6) for v in now)
    assert decoded(stream(x, fixed)) == x
    c = [5, -3, 2]
    res = [x[i] - (sum(c[j] * x[i - 1 - j] for j in range(3)) >> 2) for i in range(3, len(x))]
    linear = bits((0b01000100, 8), *((v, 8) for v in x[:3]), (4, 4), (2, 5), *((v, 5) for v in c), (0, 2), (0, 4), (6, 4)) + "".join(rice(v, 6) for v in res)
    assert decoded(stream(x, linear)) == x


def test_any_changed_byte_of_a_frame_is_found():
    s = flac.encode([b"some text, not much of it" * 20])[0]
    begin, *_ = flac.layout(s)
    for at in range(begin, len(s), 7):
        bad = bytearray(s)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_digests_and_blocks(spark):
    kept = media.store(documents(spark))
    got = {(r.doc_id, r.payload_sha256): r for r in media.digests(kept).collect()}
    for r in rows():
        data = (r[1] or "").encode()
        payload = data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)
        own = got[r[0], hashlib.sha256(payload).hexdigest()]
        assert (own.n_bytes, own.payload_bytes, own.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
    joined = {}
    for b in sorted(media.blocks(kept.where("doc_id = 6")).collect(), key=lambda b: b.block):
        assert b.first_sample == len(joined.get(6, b"")) and b.n_samples == len(b.pcm)
        joined[6] = joined.get(6, b"") + bytes(b.pcm)
    assert joined[6].rstrip(b"\0").decode() == rows()[6][1]
    assert media.digests(media.store(empty(spark))).count() == 0


def with_points(s, keep, samples=None):
    """The stream with only some of its seek points, and perhaps another number of samples."""
    begin, n, _, points = flac.layout(s)
    table = b"".join(first.to_bytes(8, "big") + offset.to_bytes(8, "big") + k.to_bytes(2, "big") for first, offset, k in points[:: keep])
    info = bytearray(s[8:42])
    info[10:18] = (int.from_bytes(info[10:18], "big") - n + (n if samples is None else samples)).to_bytes(8, "big")
    return s[:8] + bytes(info) + b"\x83" + len(table).to_bytes(3, "big") + table + s[begin:]


def test_blocks_cover_streams_with_few_seek_points(spark):
    own = [bytes((i * i + k) % 251 for i in range(64 * 160)) for k in range(3)]
    full = flac.encode(own)
    streams = [with_points(full[0], 3), full[1], with_points(full[2], 4, 0)]
    assert len(flac.layout(streams[0])[3]) == 4 and len(flac.layout(full[0])[3]) == 10
    assert flac.decode(streams) == own
    found = media.blocks(spark.createDataFrame(list(enumerate(streams)), "doc_id long, media binary")).collect()
    for i, data in enumerate(own):
        mine = sorted((b for b in found if b.doc_id == i), key=lambda b: b.block)
        assert b"".join(bytes(b.pcm) for b in mine) == data and len(mine) == 10
        assert all(streams[i][b.byte_offset : b.byte_offset + 2] == b"\xff\xf8" and data[b.first_sample :][: b.n_samples] == bytes(b.pcm) for b in mine)


def test_query_reads_written_blocks(spark, tmp_path):
    from sparkloom.llm.common import written
    from sparkloom.llm.queries import op2_media

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(str, media.digests(media.store(documents(spark))).collect()))
    assert sorted(map(str, op2_media(spark, str(tmp_path)).collect())) == want and len(want) == 12
    kept = written(media.numbered_blocks(media.store(documents(spark))), "blocks")
    assert sorted(map(str, media.block_digests(kept.repartition(5, "first_sample")).collect())) == want
    for lost in ("not (doc_id = 6 and block = 3)", "not (doc_id = 6 and block = n_blocks - 1)"):
        with pytest.raises(Exception, match="block"):
            media.block_digests(kept.where(lost)).collect()


def test_stored_blocks_of_all_parts_equal_digests_of_streams(spark):
    want = sorted(map(str, media.digests(media.store(documents(spark))).collect()))
    for parts in (1, 3):
        assert sorted(map(str, media.block_digests(media.stored_blocks(documents(spark), parts)).collect())) == want
    assert media.block_digests(media.stored_blocks(empty(spark))).count() == 0
