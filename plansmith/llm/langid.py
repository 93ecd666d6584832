"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression.

The kernel is the blended-spectrum presence kernel: texts meet in how many n-grams of 1 to ``GRAMS`` letters both hold,
whatever their number, divided by the root of each one's own count. N-grams are hashed to ``BUCKETS`` features. It is taken
on windows of ``WINDOW`` characters, since in a long text every n-gram is present; a document's scores are the means of its
windows' scores by their lengths, over the whole text.

Training is on a bounded sample: at most ``PER_LANG`` documents a language (those with the least hash of their ids), at most
``PER_DOC`` windows of each, spread over the text. ``LANDMARKS`` of the windows, dealt evenly over the languages, span the
Nyström features; ridge regression fits one output a language against the rest. Since kernel values are inner products of
presence vectors, landmarks and coefficients fold into one matrix of buckets by languages: a batch of windows is scored by
one product of its presence matrix with it.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a language's name breaks ties; documents of
null language aren't learnt from; without any labelled document every prediction is ``und``; repeated rows each get their
prediction; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, pieces, read, schema_of, ship

GRAMS = 3
BUCKETS = 1 << 13
WINDOW = 1024
PER_LANG = 400
PER_DOC = 3
LANDMARKS = 256
RIDGE = 1e-2
#: The stage rejects documents whose best language has a lower score: no language is told.
LEAST = 0.35
#: Sharpness of the score: a softmax over the languages' outputs, which are near 1 and -1.
SHARPNESS = 4.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_ROWS = 256


def letters(text: str | None) -> str | None:
    """Lower-cased letters with single blanks between; None where there is no letter."""
    if not text:
        return None
    out = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {out} " if out and any(c.isalpha() for c in out) else None


def presence(windows: list[np.ndarray]) -> np.ndarray:
    """0/1 rows of the windows' code points, over the buckets."""
    x = np.zeros((len(windows), BUCKETS), np.float32)
    code = np.concatenate(windows)
    row = np.repeat(np.arange(len(windows)) * BUCKETS, [len(w) for w in windows])
    flat, h = x.reshape(-1), np.zeros(len(code), np.uint32)
    for n in range(GRAMS):
        if n >= len(code):
            break
        m = len(code) - n
        h = h[:m] * np.uint32(31) + (code[n:] + np.uint32(n + 1)) * _MULT[n]
        own = row[:m] == row[n:]  # the n-gram lies in one window
        flat[row[:m][own] + ((h ^ h >> np.uint32(15)) * _MULT[3] >> np.uint32(19))[own].astype(np.int64)] = 1
    return x


def windows_of(text: str) -> list[np.ndarray]:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return [code[i : i + WINDOW] for i in range(0, len(code), WINDOW)]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets by languages
    bias: np.ndarray

    def outputs(self, windows: list[np.ndarray]) -> np.ndarray:
        x = presence(windows)
        return x @ self.weights / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        docs = [letters(t) if self.langs else None for t in texts]
        total = np.zeros((len(docs), max(1, len(self.langs))))
        sizes = np.zeros(len(docs))
        pending: list[np.ndarray] = []
        owners: list[int] = []

        def score():
            if pending:
                n = np.array([len(w) for w in pending], np.float64)
                np.add.at(total, owners, self.outputs(pending) * n[:, None])
                np.add.at(sizes, owners, n)
                pending.clear()
                owners.clear()

        for i, d in enumerate(docs):
            if d is not None:
                for w in windows_of(d):
                    pending.append(w)
                    owners.append(i)
                    if len(pending) == _ROWS:
                        score()
        score()
        mean = total / np.maximum(sizes, 1)[:, None]
        e = np.exp(SHARPNESS * (mean - mean.max(1, keepdims=True)))
        best = mean.argmax(1)
        share = e[np.arange(len(docs)), best] / e.sum(1)
        return [("und", 0.0) if d is None else (self.langs[b], float(s)) for d, b, s in zip(docs, best, share, strict=True)]


def picked(text: str | None) -> list[str]:
    """At most PER_DOC windows of a text's letters, spread over it."""
    d = letters(text)
    if d is None:
        return []
    n = -(-len(d) // WINDOW)
    return [d[i * WINDOW : (i + 1) * WINDOW] for i in sorted({round(k * (n - 1) / max(PER_DOC - 1, 1)) for k in range(PER_DOC)})]


def train(rows: list[tuple[str, str | list[str] | None]]) -> Model:
    """rows of (language, text, or windows picked of it)."""
    samples: dict[str, list[np.ndarray]] = {}
    for lang, text in rows:
        ws = text if isinstance(text, list) else picked(text)
        if ws:
            samples.setdefault(lang, []).extend(np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in ws)
    langs = sorted(samples)
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    windows = [w for k in langs for w in samples[k]]
    y = np.repeat(np.arange(len(langs)), [len(samples[k]) for k in langs])
    rng = np.random.default_rng(0)
    share = max(1, LANDMARKS // len(langs))
    marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:share] for k in range(len(langs))])
    unit = lambda x: x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    land = unit(presence([windows[i] for i in marks]))
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])  # the inverse root of the landmarks' kernel matrix
    kernel = np.concatenate([unit(presence(windows[i : i + _ROWS])) @ land.T for i in range(0, len(windows), _ROWS)]).astype(np.float64)
    phi = kernel @ half
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = (len(y) / (len(langs) * np.bincount(y)))[y][:, None]  # languages count alike
    mean, centre = (weight * phi).sum(0) / weight.sum(), (weight * target).sum(0) / weight.sum()
    p, t = phi - mean, target - centre
    beta = np.linalg.solve(p.T @ (weight * p) + RIDGE * len(y) / phi.shape[1] * np.eye(phi.shape[1]), p.T @ (weight * t))
    return Model(langs, (land.T @ (half @ beta)).astype(np.float32), centre - mean @ beta)


def training_rows(docs: DataFrame, learnt: Column | None = None) -> list[tuple[str, list[str]]]:
    """The bounded sample: ids first, from two narrow columns, then their texts, of which executors pick the windows. Ranks are
    limited before the shuffle."""

    def cut(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("doc_id"), pa.array([picked(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["lang", "doc_id", "windows"])

    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    if learnt is not None:
        known = known.filter(learnt)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("doc_id", "lang").withColumn("_r", rank).filter(F.col("_r") <= PER_LANG).select("doc_id", "lang")
    texts = docs.select("doc_id", "text", F.col("lang").alias("_lang"))
    got = texts.join(F.broadcast(ids), "doc_id").filter("lang = _lang").select("lang", "doc_id", "text")
    rows = got.mapInArrow(cut, f"{schema_of(got.drop('text'))}, windows array<string>").groupBy("lang", "doc_id").agg(F.min("windows").alias("windows")).collect()
    return [(r[0], list(r[2])) for r in sorted(rows)]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns (text among them), lang_pred and score; given columns of these names give way."""
    held, docs = ship(docs.sparkSession, model), docs.drop("lang_pred", "score")

    def run(batches):
        m = held()
        for b in pieces(batches):
            got = m.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{schema_of(docs)}, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(training_rows(docs.select("doc_id", "lang", "text"), fold(F.col("doc_id"), 4) != 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def lettered(docs: DataFrame) -> DataFrame:
    """The rows whose text holds a letter."""

    def run(batches):
        for b in pieces(batches):
            yield b.filter(pa.array([letters(t) is not None for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_recognised(docs: DataFrame) -> DataFrame:
    """Documents that a language is told of stay; what is ``und`` goes, and what no language's score reaches ``LEAST`` for. Where
    no document is labelled, so that all are ``und``, letters alone decide. Columns stay as they are."""
    model = train(training_rows(docs.select("doc_id", "lang", "text")))
    cols = docs.columns
    packed = docs.select("text", F.struct(*[F.col(c) for c in cols if c != "text"]).alias("_rest"))
    kept = predict(packed, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST)) if model.langs else lettered(packed)
    return kept.select(*[F.col(c) if c == "text" else F.col(f"_rest.{c}").alias(c) for c in cols])
