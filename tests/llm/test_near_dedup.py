import random

import numpy as np

from sparkloom.llm import components, near_dedup
from tests.llm.cases import SCHEMA, documents, empty


def weighted(texts):
    own = near_dedup.Shingles(texts)
    df = {}
    for h in own.hashes.tolist():
        df[h] = df.get(h, 0) + 1
    n = int((np.diff(own.bounds) > 0).sum())
    w = own.counts * (1 + near_dedup.LARGEST * np.clip(np.log((n + 1) / np.array([df[h] for h in own.hashes.tolist()])) / np.log(near_dedup.RARE), 0, 1))
    return [dict(zip(own.hashes[a:b].tolist(), w[a:b])) for a, b in zip(own.bounds, own.bounds[1:])]


def brute_classes(ids, texts):
    sets = weighted(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = sum(min(sets[i][k], sets[j][k]) for k in sets[i].keys() & sets[j].keys())
                if both / (sum(sets[i].values()) + sum(sets[j].values()) - both) >= near_dedup.SIMILARITY:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return {x: low[find(i)] for i, x in enumerate(ids)}


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = []
    common = [word() for _ in range(25)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 140))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 7)):
            own = base[:]
            for _ in range(rng.choice([1, 1, 2, 3, 4, 9])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
        texts.append(" ".join(common + [word() for _ in range(15)]))
    hub = [word() for _ in range(200)]
    texts.append(" ".join(hub))
    for _ in range(60):
        own = hub[:]
        for _ in range(4):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    return texts + texts[:5] + ["a b c", "a b c", "a b d", "Tiny", "tiny"]


def test_classes_match_brute_force(spark):
    texts = corpus()
    data = [(i, t, *[None] * 6) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute_classes(range(len(texts)), texts)
    kept = [r.doc_id for r in near_dedup.one_of_each(spark.createDataFrame(data + data[:1], SCHEMA)).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_samples_agree_as_often_as_weights_overlap():
    rng = random.Random(1)
    a = [str(rng.random()) for _ in range(300)]
    b = a[:]
    for i in range(0, 300, 30):
        b[i] = "x" + b[i]
    own = near_dedup.Shingles([" ".join(a), " ".join(b)])
    common = np.isin(own.hashes, np.intersect1d(own.hashes[own.text == 0], own.hashes[own.text == 1]))
    for shared, single in ((1, 1), (3.5, 0.5), (0.4, 2.7)):
        w = (own.counts * np.where(common, shared, single) * (1 + own.hashes % np.uint64(7) / 5)).astype(np.float32)
        found = near_dedup.samples(own, w)
        want = near_dedup.similarity(own, w, 0, 1)
        assert abs((found[0] == found[1]).mean() - want) < 3.5 * (want * (1 - want) / found.shape[1]) ** 0.5 + 0.01


def test_frequencies_of_common_shingles_are_exact(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) + (" a b c d e f" if i % 3 == 0 else "") + (" p q r s t" if i % 200 == 0 else "") for i in range(900)]
    weights = near_dedup.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    own = near_dedup.Shingles(texts)
    found, times = np.unique(own.hashes, return_counts=True)
    want = {h: n for h, n in zip(found.tolist(), times.tolist()) if n >= 900 / near_dedup.RARE}
    assert dict(zip(weights.hashes.tolist(), weights.frequency.tolist())) == want and weights.documents == 900 and len(want) >= 3


def test_blocks_join_every_component_of_a_band(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    texts = corpus()
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame([(i, t, *[None] * 6) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == brute_classes(range(len(texts)), texts)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 6), (6, 7)] + [(1000, x) for x in rng.sample(range(1001, 2000), 300)] + [(200, 150)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[160] == got[200] == 100 and got[7] == 6 and 5 not in got and all(got[x] == 1000 for _, x in edges[63:-1])


def test_cases(spark):
    assert near_dedup.classes(empty(spark)).count() == 0
    out = sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(documents(spark)).collect()), key=str)
    assert out == sorted([(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 9), (None, None)], key=str)
    assert near_dedup.one_of_each(documents(spark)).count() == 10
    extra = documents(spark).selectExpr("*", *(f"concat('v', doc_id) as `{n}`" for n in ["_text", "_key", "key", "row", "node", "low", "component", "_low"]))
    kept = near_dedup.one_of_each(extra)
    assert kept.columns == extra.columns and kept.count() == 10 and all(r.asDict()[n] == f"v{r.doc_id}" for r in kept.where("doc_id is not null").collect() for n in extra.columns[8:])
