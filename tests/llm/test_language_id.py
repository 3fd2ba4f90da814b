import zlib

import numpy as np

from sparkloom.llm import language_id
from tests.llm.cases import SCHEMA, documents, empty

WORDS = {"en": "the of and that with this have from which their would there".split(), "de": "der und nicht eine über straße für auch werden können schön".split(), "fr": "le la les être où déjà façon après même très était français".split()}


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(360):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang], int(rng.integers(4, 120)))), lang, f"s{i % 2}", 1, "x", 1, 1))
    junk = [(1000, "zqx" * 300, None, None, None, None, None, None), (1001, "12 %% --", None, None, None, None, None, None), (1002, None, "en", None, None, None, None, None)]
    return rows + junk + rows[:1]


def test_held_out_accuracy_and_rejection(spark):
    data = corpus()
    out = {r.doc_id: r for r in language_id.classify(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in out.items())
    held = [r for r in data[:360] if out[r[0]].held_out]
    assert len(held) > 50 and sum(out[r[0]].lang_pred == r[2] for r in held) > 0.97 * len(held)
    assert sum(out[r[0]].rejected for r in held) <= 1
    assert out[1000].rejected and out[1000].lang_pred in WORDS
    for i in (1001, 1002):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    kept = {r.doc_id for r in language_id.accepted(spark.createDataFrame(data, SCHEMA)).collect()}
    assert kept == {i for i, r in out.items() if not r.rejected}


def test_labels_of_held_out_rows_and_other_columns_are_never_used(spark):
    data = corpus()
    blind = [r if not language_id_held(r[0]) else (r[0], r[1], "zz", "other", *r[4:]) for r in data]
    a, b = ({(r.doc_id, r.lang_pred, round(r.score, 5)) for r in language_id.classify(spark.createDataFrame(x, SCHEMA)).collect()} for x in (data, blind))
    assert a == b


def language_id_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_cases(spark):
    assert language_id.classify(empty(spark)).count() == 0
    out = language_id.classify(documents(spark)).collect()
    assert len(out) == 12 and {r.lang_pred for r in out} == {"en", "und"}


def brute_counts(text):
    chars = language_id.WORDLESS.sub(" ", f" {text.lower()} ") + "\n\n"
    out = {}
    for n in (1, 2, 3):
        for i in range(len(chars) - 2):
            key = 0
            for k, c in enumerate(chars[i : i + n]):
                key = (key * language_id.MULTIPLIERS[k] + ord(c) + k + 1) % 2**64
            at = key * language_id.MULTIPLIERS[0] % 2**64 >> 52
            out[at] = out.get(at, 0) + 1
    return out


def test_predictions_match_brute_force(spark):
    """Document frequencies, cosines and the nearest centroid, one text and one n-gram at a time."""
    data = corpus()
    model = language_id.fit(spark.createDataFrame(data, SCHEMA))
    learn = [r[1] for r in data if r[1] is not None and r[2] is not None and not language_id_held(r[0])]
    seen = [brute_counts(t) for t in learn]
    df = {}
    for c in seen:
        for at in c:
            df[at] = df.get(at, 0) + 1
    idf = [np.log((1 + len(learn)) / (1 + df.get(k, 0))) + 1 for k in range(language_id.WIDTH)]
    assert np.allclose(idf, model.idf, atol=1e-5)
    got = {r.doc_id: r for r in language_id.classify(spark.createDataFrame(data, SCHEMA), model).collect()}
    for i, text, *_ in data[:60]:
        x = {at: np.log1p(n) * idf[at] for at, n in brute_counts(text).items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        cosines = [sum(v * c[at] for at, v in x.items()) / norm for c in model.centres]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(got[i].score - cosines[best]) < 1e-4 and got[i].lang_pred == model.languages[best]


def test_a_frequent_language_gives_just_its_sample(spark):
    rows = spark.createDataFrame([(i // 3, f"the of and w{i // 3}", "en" if i % 40 else "de", "s", 1, "x", 1, 1) for i in range(6000)], SCHEMA)
    model = language_id.fit(rows, sample=20)
    assert set(model.languages) == {"en", "de"} and (model.radius.shape == (len(model.languages), language_id.CLASSES))
