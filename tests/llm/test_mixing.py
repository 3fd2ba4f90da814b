from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.llm import mixing
from tests.llm.cases import SCHEMA, documents, empty


def test_no_source_is_ever_a_block_off_its_target():
    rng = np.random.default_rng(1)
    for k in range(12):
        weights = {f"s{i}": float(x) for i, x in enumerate(rng.exponential(size=int(rng.integers(2, 12))))} | ({"tiny": 1e-6} if k % 2 else {})
        exact, total = mixing.whole_weights(weights), sum(map(Fraction, weights.values()))
        assert all(Fraction(exact[s], sum(exact.values())) == Fraction(w) / total for s, w in weights.items())
        ends = dict.fromkeys(weights, 10**9)
        seen = Counter()
        for slot, s, block in mixing.replay(mixing.begun(ends, {}, exact, 0, 0), exact, ends, 4000):
            assert block == seen[s]
            seen[s] += 1
            assert all(abs(seen[x] - Fraction(w) / total * (slot + 1)) < 1 for x, w in weights.items())


def test_a_million_slots_stay_within_a_block():
    weights = {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1e-4}
    exact, ends, seen = mixing.whole_weights(weights), dict.fromkeys(weights, 10**9), Counter()
    for slot, s, _ in mixing.replay(mixing.begun(ends, {}, exact, 0, 0), exact, ends, 1_000_000):
        seen[s] += 1
    total = sum(map(Fraction, weights.values()))
    assert all(abs(seen[s] - Fraction(w) / total * 1_000_000) < 1 for s, w in weights.items())


def brute(blocks, weights):
    """Slot by slot, with releases and deadlines looked at anew."""
    done, out, slot = Counter(), {}, 0
    while any(done[s] < n for s, n in blocks.items()):
        left = {s: Fraction(weights.get(s, 0)) for s, n in blocks.items() if done[s] < n}
        active = {s: w for s, w in left.items() if w > 0} or dict.fromkeys(left, Fraction(1))
        total, phase, t, ended = sum(active.values()), Counter(), 0, False
        while not ended:
            ready = [(((phase[s] + 1) * total / w).__ceil__(), s) for s, w in active.items() if phase[s] * total / w // 1 <= t]
            s = min(ready)[1]
            out[s, done[s]] = slot
            done[s] += 1
            phase[s] += 1
            t += 1
            slot += 1
            ended = done[s] == blocks[s]
    return out


@pytest.mark.parametrize("length", [7, 64, 1000])
def test_segments_match_brute_force(length):
    blocks, weights = {"a": 50, "b": 7, "c": 200, "d": 1, "e": 3}, {"a": 3.0, "b": 1.0, "c": 2.0, "d": 0.5}
    got, exact = {}, mixing.whole_weights(weights)
    for state, n in mixing.segments(blocks, exact, length):
        for slot, s, block in mixing.replay(state, exact, blocks, n):
            got[s, block] = slot
    assert got == brute(blocks, weights)


def test_schedule(spark):
    data = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 7}", 1, "x", 1, 1) for i in range(900)] + [(5, "t5", "en", "hot", 1, "x", 1, 1)]
    out = mixing.schedule(spark.createDataFrame(data, SCHEMA), block=4, segment=50).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[3]) for r in data)
    sizes = Counter(r[3] for r in data)
    slots = defaultdict(list)
    for r in out:
        slots[r.slot].append(r)
    assert sorted(slots) == list(range(sum(-(-n // 4) for n in sizes.values())))
    for own in slots.values():
        assert len({(r.source, r.block) for r in own}) == 1 and sorted(r.place for r in own) == list(range(len(own)))
    want = brute({f"={s}": -(-n // 4) for s, n in sizes.items()}, {f"={s}": n**0.5 for s, n in sizes.items()})
    assert {(f"={r.source}", r.block): r.slot for r in out} == want
    phases = defaultdict(list)
    for slot in sorted(slots):
        phases[slots[slot][0].phase].append(slots[slot][0])
    for own in phases.values():  # against the weights that are returned
        shares, seen = {r.source: r.phase_weight for r in own}, Counter()
        for t, r in enumerate(own):
            seen[r.source] += 1
            assert all(abs(seen[s] - w * (t + 1)) < 1 + 1e-9 for s, w in shares.items())
    assert {r.source: r.weight for r in out} == {s: pytest.approx(n**0.5 / sum(x**0.5 for x in sizes.values())) for s, n in sizes.items()}


def test_cases(spark):
    assert mixing.schedule(empty(spark)).count() == 0
    assert mixing.schedule(documents(spark)).count() == 12
    assert mixing.in_order(documents(spark)).columns == documents(spark).columns
    assert mixing.in_order(documents(spark), {"s": 2.0, None: 1.0}).count() == 12
    names = ["_text", "_key", "_slot", "_hash", "_block", "_part", "_source", "slot", "place", "row", "s", "block", "weight", "rank", "_k", "_n", "_own", "_id"]
    extra = documents(spark).selectExpr("*", *(f"doc_id as `{n}`" for n in names))
    assert Counter(map(tuple, mixing.in_order(extra).collect())) == Counter(map(tuple, extra.collect()))


def test_ranks_of_a_hot_key_are_gapless(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') k")
    out = mixing.ranked(df, "k", ["id"], {"a": 334, "b": 666}, bucket=50).collect()
    assert sorted((r.k, r["rank"]) for r in out) == [("a", i) for i in range(334)] + [("b", i) for i in range(666)]
