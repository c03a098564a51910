"""Language identification by nearest centroids of TF-IDF character n-gram vectors.

A text's vector counts hashed byte trigrams around letters (ASCII case folded,
digits and marks as blanks) in ``DIMENSIONS`` cells, weighted by 1 + log tf and
inverse document frequency and normalised. Each language has several centroids
from spherical k-means, fitted in a task of its own on a bounded sample of its
texts; any number of languages can be learnt, and the model has 64 KB for each. The nearest centroid by cosine gives the language; a text
further from it than nearly all training texts of that language is marked
rejected (and is ``und`` when ``reject`` is asked for).

Edge cases: null text and text without a letter are ``und`` with score 0; whole
texts are scanned; equal cosines go to the first language in name order; repeated
rows give repeated results; with nothing to learn from all is ``und``; an empty
table gives an empty result; extra columns are ignored; rows with a null id are
judged and never learnt from; doc_id may have any type. Texts are judged in slices
of bounded bytes and rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.common import arrow_map, fold, held_out, kind, written

DIMENSIONS = 4096
#: Bounds of the fitted model: texts of each language, centroids of each language. Rows that are judged at once.
MOST_PER_LANGUAGE, CENTROIDS = 300, 4
ROWS = 256
#: Share of training texts of a language that its rejection distance leaves out.
REJECTED_SHARE = 0.005

_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_ASCII_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
_FOLDED = np.array([b | 32 if b < 0x80 and chr(b).isalpha() else b if b >= 0x80 else 32 for b in range(256)], np.uint8)


def counts(texts: pa.Array) -> np.ndarray:
    """texts x DIMENSIONS trigram counts."""
    from kithline.llm.textscan import flat, mix

    buf, offsets = flat(texts)
    n = len(offsets) - 1
    padded = np.full(len(buf) + 2, 32, np.uint8)
    padded[1:-1] = _FOLDED[buf]
    middle = np.flatnonzero(_LETTER[buf])
    doc = np.searchsorted(offsets, middle, "right") - 1
    before = np.where(middle == offsets[doc], 32, padded[middle]).astype(np.uint64)
    after = np.where(middle + 1 == offsets[doc + 1], 32, padded[middle + 2]).astype(np.uint64)
    code = before << np.uint64(16) | padded[middle + 1].astype(np.uint64) << np.uint64(8) | after
    cell = (mix(code) >> np.uint64(52)).astype(np.int64)
    return np.bincount(doc * DIMENSIONS + cell, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)


def has_letter(texts: pa.Array) -> np.ndarray:
    from kithline.llm.textscan import flat

    buf, offsets = flat(texts)
    seen = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])[offsets]) > 0
    for i in np.flatnonzero(~seen):
        text = texts[int(i)].as_py()
        seen[i] = text is not None and any(c.isalpha() for c in text)
    return seen


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centre: np.ndarray  # rows of unit length
    language: np.ndarray  # of each centre
    floor: np.ndarray  # least accepted cosine, by language

    def vectors(self, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)

    def nearest(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = np.round(self.vectors(n) @ self.centre.T, 9)
        best = cosine.argmax(1)
        return self.language[best], np.clip(cosine[np.arange(len(n)), best], 0, 1)


def _k_means(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart rows; deterministic."""
    mean = v.mean(0)
    chosen = [int((v @ mean).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    centre = v[chosen]
    for _ in range(20):
        own = (v @ centre.T).argmax(1)
        sums = np.stack([v[own == j].sum(0) if (own == j).any() else centre[j] for j in range(len(centre))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centre):
            break
        centre = new
    return centre


def _dense(cells: list, n: list) -> np.ndarray:
    out = np.zeros((len(cells), DIMENSIONS))
    for i, (at, k) in enumerate(zip(cells, n)):
        out[i, np.asarray(at, np.int64)] = k
    return out


def fit(docs: DataFrame, most_per_language: int = MOST_PER_LANGUAGE, centroids: int = CENTROIDS) -> Centroids:
    """Centroids from the most_per_language first documents of each language, by id hash, outside fold 2."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # each task passes on most_per_language ids of a language at most
    chosen = usable.select("doc_id", "lang").withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= most_per_language).select("doc_id", "lang").distinct()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = has_letter(batch.column("text"))
        cells, sizes = [], []
        for a in range(0, batch.num_rows, ROWS):
            for row in counts(batch.column("text").slice(a, ROWS)):
                cells.append(np.flatnonzero(row).astype(np.int32))
                sizes.append(row[cells[-1]].astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang").cast(pa.string()), pa.array(cells, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "lang", "cell", "n"]).filter(pa.array(ok))

    rows = written(arrow_map(usable.join(chosen, ["doc_id", "lang"]), work, f"doc_id {kind(docs, 'doc_id')}, lang string, cell array<int>, n array<int>"), "language-samples")
    total = rows.count()
    seen = np.zeros(DIMENSIONS)
    for r in rows.select(F.explode("cell").alias("cell")).groupBy("cell").count().collect():  # at most DIMENSIONS rows
        seen[r["cell"]] = r["count"]
    idf = np.log((total + 1) / (seen + 1)) + 1
    empty = Centroids([], idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.zeros(0))

    def one(texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.assign(key=[np.asarray(c).tobytes() + np.asarray(k).tobytes() for c, k in zip(texts["cell"], texts["n"])]).sort_values(["doc_id", "key"], ignore_index=True)
        v = empty.vectors(_dense(texts["cell"], texts["n"]))
        centre = _k_means(v, centroids).astype(np.float32)
        return pd.DataFrame({"lang": texts["lang"].iloc[:1], "centre": [centre.ravel()], "floor": [float(np.quantile((v @ centre.T.astype(float)).max(1), REJECTED_SHARE))]})

    fitted = rows.groupBy("lang").applyInPandas(one, "lang string, centre array<float>, floor double").toPandas().sort_values("lang", ignore_index=True)
    if not len(fitted):
        return empty
    centres = [np.asarray(c, np.float32).reshape(-1, DIMENSIONS) for c in fitted["centre"]]
    return Centroids(fitted["lang"].to_list(), idf, np.concatenate(centres), np.repeat(np.arange(len(centres)), [len(c) for c in centres]), fitted["floor"].to_numpy(float))


def identify(docs: DataFrame, model: Centroids, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine) and rejected."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        ok = has_letter(texts) & bool(len(model.centre))
        if len(model.centre):
            near = [model.nearest(counts(texts.slice(a, ROWS))) for a in range(0, len(texts), ROWS)]
            best, cosine = (np.concatenate([x[i] for x in near]) for i in (0, 1))
            far = cosine < model.floor[best]
            names = [model.languages[j] if good and not (reject and no) else "und" for j, good, no in zip(best, ok, far)]
        else:
            cosine, far, names = np.zeros(len(ok)), np.ones(len(ok), bool), ["und"] * len(ok)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(ok, cosine, 0.0)), pa.array(far | ~ok)],
            ["doc_id", "held_out", "lang_pred", "score", "rejected"],
        )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(rows, work, f"doc_id {kind(docs, 'doc_id')}, held_out boolean, lang_pred string, score double, rejected boolean")
