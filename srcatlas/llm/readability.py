"""Problem 9: reading level of each document.

From graders' marks of a sample of documents the grade at which a word is
acquired is estimated: the words' rates per grade give each word a distribution
over grades, and its acquisition grade is a low quantile of it - the grade from
which on the word is in use.  A document is described by quantiles of the
acquisition grades of its known words, the share of words it has beyond each
grade, and the length of its sentences; a cumulative logistic model,
calibrated on the marked documents, turns these into a grade from 1 to 5.  Words of
different languages are graded on the one scale of the marks, so grades are
comparable across languages and no declared language is needed.

Scale: counting words of the marked documents is a shuffle with partial
aggregation; grading is one map-only pass over all documents, whole texts.  The
model is fitted on at most ``max_marked`` marked documents (those with the least
hash), so what is sent to the tasks is bounded: the words that stand ``min_count`` times in at most ``max_marked`` marked documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_stage

GRADES = 5
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_HEAD = re.compile(r"(?m)^[ \t]*#.*$")
#: a line of code outside a fence: it ends as a statement does, or declares something
_CODE_LINE = re.compile(r"(?m)^[^\n]*(?:[{};]|[)=][ \t]*(?:then|do)?)[ \t]*$")
#: a word that is no part of a symbol, path, option, inline code, or speaker's mark
_WORD = re.compile(r"(?<![\w./\\:`>$@-])[^\W\d_]+(?![\w/\\:(`>=]|\.\w|\()")
_END = re.compile(r"[.!?…](?=[\s\"')\]]|$)|\n[ \t]*\n")
FEATURES = 14


def clean(text: str) -> str:
    """The text without fenced code, lines of code and headings; words of symbols and paths are passed over by ``_WORD``."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "#" in text:
        text = _HEAD.sub("", text)
    if ";\n" in text or "{\n" in text or ")\n" in text or "=\n" in text:
        text = _CODE_LINE.sub("", text)
    return text


def prose_words(text: str) -> list[str]:
    return _WORD.findall(clean(text).lower())


@dataclass
class Model:
    words: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray

    def features(self, text: str) -> np.ndarray:
        prose = clean(text)
        words = _WORD.findall(prose.lower())
        get = self.words.get
        known = np.array([g for g in map(get, words) if g is not None])
        x = np.zeros(FEATURES)
        n = len(known)
        if n:
            known.sort()
            x[0:5] = known[(np.array((0.25, 0.5, 0.7, 0.85, 0.95)) * (n - 1) + 0.5).astype(int)]
            x[5:9] = 1 - np.searchsorted(known, (1.5, 2.25, 3.0, 3.75)) / n
            x[9] = known.sum() / n
        # marks of the ends of sentences and paragraphs; several in a row end one sentence
        stops = [m.start() for m in _END.finditer(prose)]
        if len(stops) * 60 >= len(words) and stops:
            ends = 1 + sum(b - a > 8 for a, b in zip(stops, stops[1:]))
            x[10] = np.log1p(len(words) / ends)
            x[11] = x[10] ** 2
        else:
            x[12] = 1.0
        x[13] = np.log1p(sum(map(len, words)) / max(1, len(words)))
        return x

    def grade(self, x: np.ndarray) -> np.ndarray:
        z = design((x - self.mean) / self.scale) @ self.coef
        return 1 + (z > 0).sum(axis=1)


def design(x: np.ndarray) -> np.ndarray:
    """Features, squares and some products, with a constant."""
    return np.hstack([np.ones((len(x), 1)), x, x[:, :12] ** 2, x[:, 9:10] * x[:, 10:11], x[:, 8:9] * x[:, 10:11], x[:, 12:13] * x[:, :10]])


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, a.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def acquisition(counts: np.ndarray, totals: np.ndarray, quantile: float = 0.2, prior: float = 1.0) -> np.ndarray:
    """Acquisition grade (1 to 5, continuous) of words from their counts per grade (words x 5) and the grades' totals."""
    share = totals / totals.sum()
    rate = (counts + prior * share) / np.maximum(totals, 1)
    cum = np.cumsum(rate / rate.sum(axis=1, keepdims=True), axis=1)
    k = (cum < quantile).sum(axis=1)
    before = np.where(k > 0, np.take_along_axis(cum, np.maximum(k - 1, 0)[:, None], 1)[:, 0], 0.0)
    at = np.take_along_axis(cum, np.minimum(k, GRADES - 1)[:, None], 1)[:, 0]
    return np.minimum(k, GRADES - 1) + (quantile - before) / np.maximum(at - before, 1e-9) * 0.999 + 0.5


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for batch in batches:
        n: Counter = Counter()
        for text, grade in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in prose_words(text):
                n[w, grade] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.string()), pa.array([g for _, g in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["word", "grade", "n"])


def marked_documents(documents: DataFrame, labels: DataFrame, max_marked: int) -> DataFrame:
    """(text, grade): marked documents; several marks of one are averaged, marks outside 1 to 5 are left out."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("grade").between(1, GRADES)).groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_marked)
    return documents.where("text IS NOT NULL").select("doc_id", "text").join(one.hint("shuffle_hash"), "doc_id").select("text", "grade")


def fit(documents: DataFrame, labels: DataFrame, max_marked: int = 20000, min_count: int = 4) -> Model:
    """Word grades and document model from the marked documents (a bounded sample of labelled rows)."""
    marked = marked_documents(documents, labels, max_marked)
    counts = marked.mapInArrow(_words_of, "word string, grade int, n bigint").groupBy("word").agg(*[F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"g{g}") for g in range(1, 6)])
    counts = counts.withColumn("all", sum((F.col(f"g{g}") for g in range(2, 6)), F.col("g1")))
    rows = counts.where(F.col("all") >= min_count).orderBy("word").toPandas()
    table = rows[[f"g{g}" for g in range(1, 6)]].to_numpy(float) if len(rows) else np.zeros((0, 5))
    totals = table.sum(axis=0) + 1
    grades = acquisition(table, totals) if len(rows) else np.zeros(0)
    model = Model(dict(zip(rows["word"].tolist(), grades.tolist())) if len(rows) else {}, np.zeros(FEATURES), np.ones(FEATURES), np.zeros((0, 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "grade"])

    seen = marked.mapInArrow(run, "x array<double>, grade int").toPandas()
    x = np.array(seen["x"].tolist(), float).reshape(-1, FEATURES)
    y = seen["grade"].to_numpy(int) if len(seen) else np.zeros(0, int)
    if not len(x):
        model.coef = np.zeros((design(np.zeros((1, FEATURES))).shape[1], 4))
        model.coef[0] = (1, 1, -1, -1)  # nothing known: grade 3
        return model
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = design((x - model.mean) / model.scale)
    model.coef = np.stack([_logistic(a, (y > g).astype(float), 2.0) for g in range(1, GRADES)], axis=1)
    return model


def grades(documents: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None, **params: int) -> DataFrame:
    """(doc_id, grade): the reading grade of every document.

    A null or empty text has grade 1 (nothing to read); a null doc_id is kept.
    Repeated documents give a row each.  ``fit_on``: the documents that ``labels`` mark, if they are others.  Without any usable mark every text is graded 3.
    """
    model = fit(documents if fit_on is None else fit_on, labels, **params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            x = np.stack([model.features(t or "") for t in texts])
            g = np.where([bool(t) for t in texts], model.grade(x), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g, pa.int32())], names=["doc_id", "grade"])

    return documents.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("grade", T.IntegerType())]))


def held_out(documents: DataFrame, labels: DataFrame, folds: int = 5, **params: int) -> DataFrame:
    """(mark, grade, documents): marked documents by their mark and the grade that a model fitted without their fold gives them.

    Folds are by a hash of the document, so copies of a row fall in one; documents without a usable mark take no part.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("grade").between(1, GRADES)).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)))
    marked = write_stage(documents.where("doc_id IS NOT NULL").select("doc_id", "text").join(good.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi"), "marked")
    one = good.groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("mark"), F.min("fold").alias("fold"))
    out = None
    for k in range(folds):
        own = marked.join(one.where(F.col("fold") == k), "doc_id")
        got = grades(own, good.where(F.col("fold") != k), fit_on=marked, **params).join(one.select("doc_id", "mark"), "doc_id").select("mark", "grade")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("mark", "grade").agg(F.count("*").alias("documents"))
