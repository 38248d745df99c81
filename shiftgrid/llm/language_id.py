"""Language identification by the nearest centroid of TF-IDF n-gram vectors.

Texts become counts of byte pairs and triples of their letters, hashed into a fixed number of cells. Document frequencies are
counted over all learned texts; each language then gets several centroids, clustered by cosine from a bounded sample. A text
takes the language of its nearest centroid, and is marked as rejected when the nearest centroid is too far away.

Null texts and texts without a letter are ``und`` with score 0. A text that shares no cell with any centroid takes the language
with the most learned texts, with score 0. Ties between centroids go to the language that sorts first. Without a learned text
everything is ``und``. Repeated rows are judged alike and sampled once; columns besides the id, the text and the language are
ignored. Bytes that are no UTF-8 count as no letter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import map_rows, need
from shiftgrid.session import cut

CELLS = 8192
UNKNOWN = "und"
PLAIN_LETTER = re.compile(rb"[A-Za-z]")
# Upper case falls to lower case, everything of ASCII that is no letter becomes a space; other bytes stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def cells(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cells a text fills and how often, over the pairs and triples of bytes of its words."""
    b = np.frombuffer(b" " + b" ".join(text.translate(FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    code = np.concatenate(((two * np.uint32(2654435761)) >> np.uint32(19), (three * np.uint32(2246822519)) >> np.uint32(19)))
    count = np.bincount(code, minlength=CELLS)
    filled = np.flatnonzero(count)
    return filled, count[filled]


def has_letter(text: bytes | None) -> bool:
    """Whether the text holds a letter of any script; figures such as a half or a circled one are none."""
    return bool(text) and (PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text.decode(errors="replace"))))


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray  # unit rows, one for each centroid
    idf: np.ndarray
    most_common: str

    def weigh(self, filled: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = (1 + np.log(count)) * self.idf[filled]
        size = np.sqrt((v * v).sum())
        return v / size if size > 0 else v


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Number of texts that fill each cell, and of all texts; summed in the tasks, then over them."""
    source = texts.select(F.col(text).cast("binary").alias("_text"))

    def run(batches):
        total, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if has_letter(t):
                    total[cells(t)[0]] += 1
                    n += 1
        if n:
            filled = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(filled, -1)), pa.array(np.append(total[filled], n))],
                                             names=["cell", "n"])

    rows = source.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(CELLS), 0
    for r in rows:
        if r["cell"] < 0:
            n = r["n"]
        else:
            df[r["cell"]] = r["n"]
    return df, n


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit rows; starts from rows far from each other, so the result depends on the rows only."""
    start = [0]
    while len(start) < min(k, len(x)):
        near = (x @ x[start].T).max(axis=1)
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-9:
            break
        start.append(far)
    c = x[start]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def sampled(known: DataFrame, id_col: str, text: str, lang: str, per_language: int) -> DataFrame:
    """_lang, _h, _text: of every language the ``per_language`` different texts whose id and text have the smallest hashes.

    The hashes are chosen first, without the texts; Spark limits them per language before the shuffle.
    """
    rows = known.where(F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("_lang"), F.xxhash64(id_col, text).alias("_h"), F.col(text).alias("_text"))
    ordered = Window.partitionBy("_lang").orderBy("_h")
    picked = rows.select("_lang", "_h").distinct().withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= per_language)
    last = cut(picked.groupBy("_lang").agg(F.max("_h").alias("_last")))  # one row per language
    met = rows.join(last, "_lang").where(F.col("_h") <= F.col("_last"))
    return met.groupBy("_lang", "_h").agg(F.first("_text").alias("_text"))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", clusters: int = 3,
        per_language: int = 300) -> Centroids:
    """Learn from the rows where ``learn`` holds and the language is known.

    Document frequencies count all these rows. The centroids of every language are clustered in the tasks, each from at most
    ``per_language`` of its texts; only centroids come to the driver, ``clusters`` rows of at most ``CELLS`` numbers a language.
    """
    need(docs, id_col, text, lang)
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    df, n = document_frequencies(known, text)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    empty = Centroids([], np.zeros((0, CELLS)), idf, UNKNOWN)
    common = known.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(1).first()
    if not n or common is None:
        return empty

    def vector():
        def function(texts):
            for t in texts:
                if not has_letter(t):
                    yield ([], [])
                else:
                    filled, count = cells(t)
                    yield (filled.astype(np.int32), empty.weigh(filled, count).astype(np.float32))
        return function

    rows = map_rows(sampled(known, id_col, text, lang, per_language), ["_lang", "_h"], "_text", vector, T.StructType([
        T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.FloatType()))]))

    def centroids(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("_h").to_numpy(), kind="stable")
        filled, weights = group.column("cells").to_pylist(), group.column("weights").to_pylist()
        x = np.zeros((len(order), CELLS), np.float32)
        for i, r in enumerate(order):
            x[i, filled[r]] = weights[r]
        c = cluster(x, clusters)
        return pa.table({"lang": pa.array([group.column("_lang")[0].as_py()] * len(c), pa.string()), "place": pa.array(range(len(c)), pa.int32()),
                         "centroid": pa.array([row.astype("<f4").tobytes() for row in c], pa.binary())})

    found = rows.where(F.size("cells") > 0).groupBy("_lang").applyInArrow(centroids, "lang string, place int, centroid binary").collect()
    if not found:
        return empty
    found.sort(key=lambda r: (r["lang"], r["place"]))
    vectors = np.stack([np.frombuffer(r["centroid"], "<f4") for r in found])
    return Centroids([r["lang"] for r in found], vectors, idf, common[lang])


def identify(docs: DataFrame, model: Centroids, keep: list[str], text: str = "text", nearest: float = 0.15) -> DataFrame:
    """``keep``, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected (cosine below ``nearest``)."""
    vectors = np.ascontiguousarray(model.vectors.T, np.float32)

    def make():
        def function(texts):
            for t in texts:
                if not model.languages or not has_letter(t):
                    yield (UNKNOWN, 0.0, True)
                    continue
                filled, count = cells(t)
                near = model.weigh(filled, count).astype(np.float32) @ vectors[filled]
                best = int(np.argmax(near))
                score = float(min(1.0, max(0.0, near[best])))
                yield (model.languages[best] if score > 0 else model.most_common, score, score < nearest)

        return function

    return map_rows(docs, keep, text, make, T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType())]))
