"""Queries over every row, on tables with ids beyond the parts that the SQL of their twins names."""

import random
from collections import defaultdict

import pytest

from sparkloom.functions import sequences as Q
from sparkloom.plans import QUERIES

rng = random.Random(3)
DOCUMENTS = [(i, "old text " * 40 + f"as of 2023-05-{i % 28 + 1:02d} compare", f"s{i % 3}", "en" if i % 2 else "de") for i in range(620)] + [(700, "alone", "own", "en"), (701, "", None, None)]
LABELS = [(i, i % 2) for i in range(0, 702, 3)]
CUSTOMERS = [(i,) for i in range(1, 420)]
ORDERS = [(i, rng.randint(1, 400), rng.choice("FOP"), float(rng.randint(1000, 400000))) for i in range(1, 2600)]
LINES = [(rng.randint(1, 30), rng.randint(1, 40)) for _ in range(900)]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    for name, rows, schema in (("documents", DOCUMENTS, "doc_id long, text string, source string, lang string"), ("labels", LABELS, "doc_id long, quality int"), ("customer", CUSTOMERS, "c_custkey long"), ("orders", ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"), ("lineitem", LINES, "l_suppkey long, l_partkey long")):
        spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")
    return out


def brute():
    quality = dict(LABELS)
    yield "join_rebuild_sources_whole", [(i, s, quality.get(i)) for i, _, s, _ in DOCUMENTS]
    groups = defaultdict(list)
    for i, _, s, lang in DOCUMENTS:
        if s is not None:
            groups[s, lang].append(i)
    yield "join_sibling_chunks_whole", [(i, j) for own in groups.values() for i in own for j in sorted(set(own) - {i})[-2:]]
    prices = defaultdict(list)
    for _, c, _, price in ORDERS:
        prices[c].append(price)
    yield "join_file_summaries_whole", [(c, len(prices[c]), round(sum(prices[c]), 2)) for (c,) in CUSTOMERS]
    yield "join_continuation_diff_whole", [(k, "deleted" if s == "P" else "changed" if p > 200000 else "same") for k, _, s, p in ORDERS]
    yield "kg_merge_whole", list({(1 if s in (2, 3) else s, p) for s, p in LINES})
    yield "mem_profile_sources_whole", [(c, all(s != "P" for _, d, s, _ in ORDERS if d == c)) for c in {x[1] for x in ORDERS}]


@pytest.mark.parametrize("name,want", list(brute()), ids=lambda x: x if isinstance(x, str) else "")
def test_every_row_counts(spark, path, name, want):
    assert sorted(map(tuple, QUERIES[name](spark, path).collect()), key=str) == sorted(want, key=str)


def plain_rouge_l(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0


def test_rouge_l_matches_the_table():
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert Q.rouge_l(" ".join(a), " ".join(b)) == pytest.approx(plain_rouge_l(a, b))


def test_whole_texts_are_read(spark, path):
    got = {r.doc_id: r.f1 for r in QUERIES["str_rouge_l"](spark, path).where("doc_id in (0, 700)").collect()}
    words = DOCUMENTS[0][1].split()
    assert got == {0: pytest.approx(plain_rouge_l(words[:-5], words[5:]), abs=1e-6), 700: 0.0}
    cutoffs = {r.doc_id: r.cutoffs for r in QUERIES["date_historical_cutoffs"](spark, path).collect()}
    assert cutoffs[3] == "2023-05-04|2024-01-04" and cutoffs[700] == "2024-01-01"
