"""Toxicity by compression distance: two Zstandard dictionaries, compared window by window.

A text's words are cut into windows of ``WORDS`` words. Each window is compressed twice, with a dictionary trained on toxic
text and with one trained on ordinary text; the bytes that the toxic dictionary saves are the window's evidence. Both
dictionaries end in the same content trained on ordinary text, so that lengths differ by what only one of them holds; toxic
training text is the words of toxic documents that hold n-grams which far more toxic than ordinary documents have.

A document's score is calibrated on labelled documents that neither dictionary has seen: a logistic fit over the largest
savings, the rates of windows above fixed numbers of saved bytes, and the length. The same rows choose among a few
settings of the dictionaries.

Training rows are bounded: at most ``TOXIC`` toxic and ``ORDINARY`` ordinary labelled documents, those with the least hash of
their ids, and of each at most ``TRAIN_WORDS`` words, taken evenly over the whole text; of the ordinary ones' words the
ordinary dictionary and the shared content are trained on ``DICTIONARY_WORDS``, drawn at random. Scoring reads whole texts, in one
narrow pass; dictionaries and fit are broadcast and of fixed size.

Defined results: null and empty texts have no windows and get the fit's score for that; without labelled toxic and ordinary
documents every score is 0; a document with several labels is toxic if one says so; repeated rows each get their score;
extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pieces, read, schema_of, ship

TOXIC, ORDINARY = 3000, 6000
TRAIN_WORDS = 4000
DICTIONARY_WORDS = 60_000
WORDS = 4
#: Settings tried: sizes in bytes of the n-grams looked at, how many times as many toxic as ordinary documents must hold
#: one, sizes of the dictionaries' own and of their shared content. The one whose scores order the calibration rows best stays.
SETTINGS = (((5,), 20, 16384, 16384), ((5, 6, 7, 8), 20, 8192, 16384), ((6, 7, 8), 20, 8192, 40960))
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Begins every window and ends both dictionaries, so that a window is never so short that it is stored as it is.
_LEAD = bytes(range(8)) * 2
_STEPS = (3, 4, 5, 6)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


def windows(ws: list[bytes], n: int = WORDS) -> list[bytes]:
    return [b" " + b" ".join(ws[i : i + n]) + b" " for i in range(0, len(ws), n)]


def _grams(ws, sizes: tuple[int, ...]) -> set[bytes]:
    return {p[i : i + n] for w in set(ws) for p in (b" " + w + b" ",) for n in sizes for i in range(len(p) - n + 1)}


def _trained(samples: list[bytes], size: int, d: int) -> bytes:
    """The content of a dictionary trained on the samples; where they are too few to train on, the samples."""
    try:
        return zstd.train_dictionary(size, samples, k=24, d=d).as_bytes()[-(size - 512) :]
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-(size - 512) :]


def features(saved: np.ndarray, n: int) -> np.ndarray:
    top = np.concatenate((np.sort(saved)[::-1][:4], np.zeros(4)))
    return np.array([top[0], top[:2].mean(), top[:4].mean(), *(min(8, (saved >= t).sum()) for t in _STEPS), *((saved >= t).sum() / np.sqrt(n + 1) for t in _STEPS), np.log1p(n)], np.float64)


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _compressors(self):
        if "_pair" not in self.__dict__:
            # tables fit the dictionaries, not the format's largest windows: a call clears little
            params = zstd.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=15, search_log=6, min_match=4, target_length=16, strategy=zstd.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
            pair = []
            for content in (self.ordinary, self.toxic):
                d = zstd.ZstdCompressionDict(content + _LEAD, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                pair.append(zstd.ZstdCompressor(dict_data=d, compression_params=params).compress)
            self._pair = pair
        return self._pair

    def saved(self, ws: list[bytes]) -> np.ndarray:
        plain, toxic = self._compressors()
        return np.array([len(plain(_LEAD + w)) - len(toxic(_LEAD + w)) for w in windows(ws)], np.int64)

    def features(self, ws: list[bytes]) -> np.ndarray:
        return features(self.saved(ws), len(ws))

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        z = np.append((self.features(words(text)) - self.mean) / self.scale, 1.0) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _spread(ws: list[bytes]) -> list[bytes]:
    """At most TRAIN_WORDS of the words: runs of 64, evenly over the whole text."""
    if len(ws) <= TRAIN_WORDS:
        return ws
    starts = np.linspace(0, len(ws) - 64, TRAIN_WORDS // 64).astype(int)
    return [w for i in starts.tolist() for w in ws[i : i + 64]]


def _dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], sizes: tuple[int, ...], ratio: float, own: int, shared: int) -> Model:
    t, o = Counter(), Counter()
    for ws in toxic:
        t.update(_grams(ws, sizes))
    least = max(3, len(toxic) // 140)
    t = {g: n for g, n in t.items() if n >= least}
    may = set(t)
    for ws in ordinary:  # only what may tell is counted
        o.update(_grams(ws, sizes) & may)
    telling = {g for g, n in t.items() if n / len(toxic) > ratio * (o[g] + 1) / len(ordinary)}
    tells = {w for w in {w for ws in toxic for w in ws} if not telling.isdisjoint(_grams([w], sizes))}
    marked = [b" " + w + b" " for ws in toxic for w in ws if w in tells]
    plain = [b" " + w + b" " for ws in ordinary for w in ws]
    pick = np.random.default_rng(1).permutation(len(plain))[:DICTIONARY_WORDS].tolist()
    plain = [plain[i] for i in pick]
    both = _trained(plain, shared, 6)
    return Model(_trained(marked or plain, own, 6) + both, _trained(plain[::2], own, 8) + both)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(b)), z.T @ (y - p) - 0.05 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def _order(z: np.ndarray, y: np.ndarray) -> float:
    """The share of (toxic, ordinary) pairs that the scores order rightly."""
    rank = np.empty(len(z))
    rank[np.argsort(z, kind="stable")] = np.arange(1, len(z) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / max(1.0, n * (len(y) - n))


def train(rows: list[tuple[int, str | None]], settings=SETTINGS) -> Model:
    """rows of (label, text), in a fixed order. Every third row of a label is left for calibration."""
    same: dict[bytes, bytes] = {}  # a word is held once
    by = {k: [[same.setdefault(w, w) for w in _spread(words(t))] for y, t in rows if y == k] for k in (0, 1)}
    if min(len(by[0]), len(by[1])) < 3:
        return Model()
    part = {k: ([w for i, w in enumerate(ws) if i % 3], ws[::3]) for k, ws in by.items()}
    y = np.repeat([0.0, 1.0], [len(part[0][1]), len(part[1][1])])
    best, found = -1.0, Model()
    for setting in settings:
        model = _dictionaries(part[1][0], part[0][0], *setting)
        x = np.array([model.features(ws) for k in (0, 1) for ws in part[k][1]])
        model.mean, model.scale, model.weights = _fit(x, y)
        good = _order(np.column_stack(((x - model.mean) / model.scale, np.ones(len(x)))) @ model.weights, y)
        if good > best:
            best, found = good, model
    return found


def training_rows(docs: DataFrame, labels: DataFrame, learnt: Column) -> list[tuple[int, str | None]]:
    """The bounded sample: ids from the labels alone, then one join of these few ids with the texts, which executors cut."""

    def cut(batches):
        for b in pieces(batches):
            texts = [b" ".join(_spread(words(t))).decode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(texts, pa.string())], names=["doc_id", "toxic", "text"])

    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(learnt).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter("toxic = 1").orderBy(*by).limit(TOXIC).unionByName(known.filter("toxic = 0").orderBy(*by).limit(ORDINARY))
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    got = got.mapInArrow(cut, schema_of(got)).collect()
    return [(r[1], r[2]) for r in sorted(got, key=lambda r: (r[0], r[2]))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns (text among them) and score; a given column of that name gives way."""
    held, docs = ship(docs.sparkSession, model), docs.drop("score")

    def run(batches):
        m = held()
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, f"{schema_of(docs)}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(training_rows(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), fold(F.col("doc_id"), 5) != 0))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
