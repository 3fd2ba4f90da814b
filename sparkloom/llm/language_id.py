"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of hashed character n-grams, of unit length. Document frequencies come from all
learning documents; each language's centroids from a bounded sample of them. A text takes the language of the
centroid with the largest cosine, and is rejected if it is farther from it than learning texts are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, map_arrow

UNKNOWN = "und"
#: Hashed n-grams of 1 to 3 characters of the words fall into so many columns.
WIDTH = 1 << 12
#: Learning documents of a language from which its centroids come, at most; the ones with the smallest hashes of doc_id.
SAMPLE, OVERSHOOT = 1000, 8
CENTROIDS, ROUNDS = 4, 8
#: A text is rejected if its distance (1 - cosine) exceeds FACTOR times the distance that QUANTILE of the sampled
#: texts of its language and length class keep. Short texts are far from every centroid, so each class has a radius
#: of its own: class k holds texts of 2**k letters and spaces and more. A class with fewer sampled texts than ENOUGH
#: takes the wider radius of the next shorter class that has them, and rejects nothing if there is none.
#: Texts below class SHORT say too little to be rejected.
QUANTILE, FACTOR, ENOUGH, CLASSES, SHORT = 0.995, 1.4, 30, 24, 6
WORDLESS = re.compile(r"[\W\d_]+")
#: Texts whose vectors are held at a time, however short they are.
ROWS = 256
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def plain(text: str) -> str:
    """Lower-case words with one space around each."""
    return WORDLESS.sub(" ", f" {text.lower()} ")


def counts(texts: list[str]) -> np.ndarray:
    """Texts by columns: how often each hashed n-gram occurs."""
    lowered = [plain(x) for x in texts]
    # Two line ends close a text, and no n-gram begins at one: so none holds anything of the next text.
    chars = np.frombuffer("\n\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.flatnonzero(chars != 10)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in lowered]) * WIDTH
    out = np.zeros(len(texts) * WIDTH, np.int64)
    key = np.zeros(len(chars), np.uint64)
    for n, m in enumerate(MULTIPLIERS):
        key = key[: len(chars) - n] * np.uint64(m) + chars[n:] + np.uint64(n + 1)
        at = (key[begins] * np.uint64(MULTIPLIERS[0]) >> np.uint64(52)).astype(np.int64)
        out += np.bincount(row + at, minlength=len(out))
    return out.reshape(len(texts), WIDTH)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def length_class(texts: list[str]) -> np.ndarray:
    return np.minimum(np.array([len(plain(x)).bit_length() - 1 for x in texts], np.int64), CLASSES - 1)


def clustered(x: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit length, and for each length class the largest distance at which a text is taken."""
    first = [int((x @ x.mean(0)).argmax())]
    while len(first) < min(CENTROIDS, len(x)):
        first.append(int((x @ x[first].T).max(1).argmin()))
    centres = x[first]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(1)
        centres = np.stack([x[nearest == k].mean(0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    far = 1 - (x @ centres.T).max(1)
    radius = np.full(CLASSES, np.inf)
    for k in range(CLASSES):
        own = far[classes == k]
        radius[k] = FACTOR * np.quantile(own, QUANTILE) if len(own) >= ENOUGH else radius[max(k - 1, 0)]
    return centres, np.where(np.arange(CLASSES) < SHORT, np.inf, radius)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centres: np.ndarray
    radius: np.ndarray  # by centroid and length class

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, and whether the text is rejected."""
        lettered = [bool(x) and any(map(str.isalpha, x)) for x in texts]
        names, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, has in enumerate(lettered) if has]
        if rows and self.languages:
            near = vectors([texts[i] for i in rows], self.idf) @ self.centres.T
            best = near.argmax(1)
            cosine = near[np.arange(len(rows)), best]
            score[rows] = np.clip(cosine, 0, 1)
            rejected[rows] = 1 - cosine > self.radius[best, length_class([texts[i] for i in rows])]
            for i, k in zip(rows, best):
                names[i] = self.languages[k]
        return names, score, rejected


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows with text and lang that aren't held out. Idf uses all of them, centroids ``sample`` of a language."""
    learn = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WIDTH, np.int64), 0
        for part in slices(batches):
            total += (counts(part.column("text").to_pylist()) > 0).sum(0)
            n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH)), pa.array(np.append([n], total))], ["at", "n"])

    found = {r["at"]: r["n"] for r in map_arrow(learn.select("text"), frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # WIDTH + 1 rows
    idf = np.log((1 + found.get(-1, 0)) / (1 + np.array([found.get(k, 0) for k in range(WIDTH)]))).astype(np.float32) + 1

    # The smallest hashes are found on ids alone. So that a frequent language doesn't meet in one task, only hashes below a
    # bound that OVERSHOOT times ``sample`` of its ids can be expected to keep are ranked; that fewer than ``sample`` do
    # has no chance worth the name (a Poisson variable of mean 8,000 below 1,000).
    ids = learn.select("lang", "doc_id").distinct()
    share = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    bounds = ids.groupBy("lang").agg((F.lit(float(OVERSHOOT * sample)) / F.count("*")).alias("bound"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.join(bounds, "lang").where(share <= F.col("bound")).withColumn("k", rank).where(F.col("k") <= sample).select("lang", "doc_id")
    picked = learn.join(F.broadcast(chosen), ["lang", "doc_id"])  # at most ``sample`` ids for each language

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = vectors(part.column("text").to_pylist(), idf)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("doc_id"), pa.array(length_class(part.column("text").to_pylist())), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "doc_id", "class", "x"])

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "x"]).head(sample)
        centres, radius = clustered(np.stack([np.frombuffer(v, np.float32) for v in rows["x"]]), rows["class"].to_numpy())
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "k": range(len(centres)), "centre": [c.astype(np.float32).tobytes() for c in centres], "radius": [radius.tolist()] * len(centres)})

    made = map_arrow(picked.select("lang", "doc_id", "text"), features, "lang string, doc_id long, class long, x binary").groupBy("lang").applyInPandas(cluster, "lang string, k int, centre binary, radius array<double>")
    rows = made.orderBy("lang", "k").collect()  # CENTROIDS rows for each language
    return Model(idf, [r["lang"] for r in rows], np.stack([np.frombuffer(r["centre"], np.float32) for r in rows]) if rows else np.zeros((0, WIDTH), np.float32), np.array([r["radius"] for r in rows]).reshape(-1, CLASSES))


def classify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each document, from its text alone.

    Text that is null or has no letter is ``und`` with score 0, and rejected. Without learning rows, or in an empty
    table, there is no language to learn and every text is ``und``. Repeated rows give equal rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, score, rejected = shared.value.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return map_arrow(documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that aren't rejected, all their columns unchanged; so text that is null or has no letter goes, equal
    rows stay or go together, and an empty table stays empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(~shared.value.predict(part.column("text").to_pylist())[2]))

    return map_arrow(documents, work, documents.schema)
