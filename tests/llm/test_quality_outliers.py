import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import quality_outliers as Q
from tests.llm.cases import SCHEMA, documents, empty, rows

WORDS = [a + b for a, b in itertools.product(["the", "of", "river", "stone", "lamp", "garden", "window", "evening", "a", "letter"], ["", "s", "ly", "ing", "er"])]


def prose(rng, n, line=12):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(line)) for _ in range(max(1, n // line)))


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(lines)


def test_counts_match_brute_force(spark):
    rng = random.Random(1)
    pieces = ["a", "bb", "é漢", " ", "\n", "\t", "\x0b", "#", "|x|", "<a>", "a b c d e f g h", "\r\n", "\x1c", "\x85", " "]
    data = rows() + [(50 + i, "".join(rng.choice(pieces) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 80))), None, None, None, None, None, None) for i in range(150)]
    got = {(r.doc_id, *(r[x] for x in Q.COUNTS), r.base_failed) for r in Q.judge(documents(spark, data)).collect()}
    want = set()
    for r in data:
        c = counts(r[1] or "")
        want.add((r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == want
    assert Q.judge(empty(spark)).collect() == []
    assert all(r.kept is (not r.base_failed) for r in Q.judge(documents(spark)).collect())  # too few for estimates


def corpus():
    rng = random.Random(4)
    data = []
    for i in range(400):
        lang, source = ("en", "a") if i < 150 else ("en", None) if i < 290 else (None, "b") if i < 380 else ("de", f"s{i % 3}")
        kind = "clean" if i % 8 else rng.choice(["symbols", "lines", "long"])
        text = prose(rng, rng.choice([30, 80, 200, 900]))
        if kind == "symbols":
            text = " ".join(w + "###" for w in text.split())
        elif kind == "lines":
            text = "\n".join(line + (" x" if k % 2 else "") + "\nbuy now\nbuy it" for k, line in enumerate(text.split("\n")))
        elif kind == "long":
            text = " ".join(w * 5 for w in text.split())
        data.append((i, text, lang, source, len(text), kind, 1, 2))
    return data + [(1000 + i, data[1][1], "en", "a", 1, "clean", 1, 2) for i in range(200)]  # copies of one text


def brute(data):
    """The same estimates row by row: all sums over texts, the subset taken by sorted classes of distance."""
    vectors, groups = {}, defaultdict(dict)
    for i, text, lang, source, *_ in data:
        n, chars, symbols, dup, again, lines = counts(text)
        vectors[i] = [round(256 * x) for x in (math.log(n + 20), math.log((chars + 100) / (n + 20)), math.sqrt(symbols / (n + 20)), math.sqrt(dup / (lines + 20)), math.sqrt(again / (n + 20)))]
        if n >= 20 and 100 * again <= 30 * n:
            groups[lang, source][text] = vectors[i]
    pooled, key = defaultdict(list), {}
    for g, own in groups.items():
        thin = len(own) < 50
        in_lang = sum(len(x) for h, x in groups.items() if h[0] == g[0] and len(x) < 50)
        rest = sum(len(x) for h, x in groups.items() if len(x) < 50 and sum(len(y) for k, y in groups.items() if k[0] == h[0] and len(y) < 50) < 50)
        key[g] = g if not thin else ("lang", g[0]) if in_lang >= 50 else "rest" if rest >= 50 else None
        pooled[key[g]] += own.values()
    floors = np.diag(np.square(256 * np.array([1.0, 0.05, 0.1, 0.15, 0.15])))
    models = {}
    for k, rows_ in pooled.items():
        if k is None:
            continue
        x = np.array(rows_, float)

        def again(center, scatter, within=None):
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
            near = np.floor(np.log2(np.maximum(d, 2.0**-10)) * 32)
            taken = near <= (np.sort(near)[math.ceil(0.75 * len(x)) - 1] if within is None else math.floor(32 * math.log2(within)))
            own = x[taken]
            return own.mean(0), np.cov(own.T, bias=True) / Q.too_small(min(len(own) / len(x), 0.999) if within is None else 0.975) + floors

        middle = np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
        off = np.sort(np.abs(x - middle), axis=0)[(len(x) + 1) // 2 - 1]
        found = []
        for center, scatter in ((x.mean(0), np.cov(x.T, bias=True) + floors), (middle, np.diag((1.4826 * off) ** 2) + floors)):
            for _ in range(12):
                center, scatter = again(center, scatter)
            found.append((np.linalg.slogdet(scatter)[1], center, scatter))
        best = min(found, key=lambda r: r[0])
        models[k] = again(best[1], best[2], Q.INNER)
    out = {}
    for i, text, lang, source, *_ in data:
        k = key.get((lang, source))
        if k is None:
            out[i] = 0.0
        else:
            off = np.array(vectors[i]) - models[k][0]
            out[i] = float(off @ np.linalg.inv(models[k][1]) @ off)
    return out


def test_estimates_match_brute_force_and_find_what_is_odd(spark):
    data = corpus()
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(data, SCHEMA)).collect()}
    want = brute(data)
    for i, d in want.items():
        assert got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-6)
        assert got[i].kept is (not got[i].base_failed and d <= Q.LIMIT)
    big = [r for r in data if r[0] < 380]
    assert all(got[r[0]].kept for r in big if r[5] == "clean")
    odd = [got[r[0]].kept for r in big if r[5] in ("symbols", "long") and got[r[0]].n_words >= 100 or got[r[0]].n_dup_lines > 100]
    assert len(odd) > 20 and not any(odd)
    assert all(got[1000 + i].kept for i in range(200))


def test_result_does_not_depend_on_the_split(spark):
    data = corpus()
    df = spark.createDataFrame(data, SCHEMA)
    a, b = ({(r.doc_id, r.distance, r.kept) for r in Q.judge(x).collect()} for x in (df.coalesce(1), df.repartition(7)))
    assert a == b


def test_chi_squared():
    assert Q.chi2_at(0.95, 5) == pytest.approx(11.0705, abs=1e-4) and Q.chi2(14.0671, 7) == pytest.approx(0.95, abs=1e-5)
