"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the documents' token windows.

Words are maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A window is ``window``
consecutive words of a benchmark item; a shorter item that has words is one window. Documents are scanned in one narrow
pass: words become ids of the benchmark's vocabulary, runs of known words are hashed at every position, and hash hits are
verified word by word.

The hash set is broadcast. Its size is bounded: the benchmark is taken in blocks of at most ``block_chars`` characters
(an item is never split), each block is one pass over the documents, and passes add up their hits.

Defined results: a null or wordless document has no words, no hits and stays; items without words never occur; repeated
items all count; an item without an id hits, but isn't named; ids may be of any type; extra columns of documents are left alone; empty tables give empty or hitless results.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, pieces, read, schema_of, ship

WINDOW = 13
BLOCK_CHARS = 16_000_000
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SCAN = "n_words long, hits array<struct<s:int,e:int>>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class WindowSet:
    """Windows of one block of items: by length, hashes over vocabulary ids, and the words with their items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list]] = {}
        for item, text in items:
            ws = words(text)
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1 if n else 0):
                for w in ws[i : i + n]:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                held = self.windows.setdefault(n, {}).setdefault(b" ".join(ws[i : i + n]), [])
                if not held or held[-1] != item:
                    held.append(item)
        self.hashes = {n: np.unique(np.array([self._hash(np.array([[self.vocabulary[w] for w in k.split()]], np.uint64))[0] for k in by], np.uint64)) for n, by in self.windows.items()}

    @staticmethod
    def _hash(ids: np.ndarray) -> np.ndarray:
        h = np.zeros(len(ids), np.uint64)
        for j in range(ids.shape[1]):
            h = (h ^ (h >> np.uint64(29))) * _MULT + ids[:, j]
        return h

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word intervals (start, end exclusive), and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.uint64, len(ws))
        run = np.concatenate(([0], np.cumsum(ids > 0)))
        hits, items = [], set()
        for n, by in self.windows.items():
            if len(ws) < n:
                continue
            at = np.flatnonzero(run[n:] - run[:-n] == n)
            if len(at):
                at = at[np.isin(self._hash(ids[at[:, None] + np.arange(n)]), self.hashes[n])]
                for i in at.tolist():
                    found = by.get(b" ".join(ws[i : i + n]))
                    if found:
                        hits.append((i, i + n))
                        items.update(x for x in found if x is not None)
        return merged(hits), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without the characters from each hit's first word to its last."""
    data = text.encode()
    flat = data.translate(_WORDS)
    ends, starts, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, last = [], 0
    for s, e in hits:
        out.append(data[last : starts[s]])
        last = ends[e - 1]
    return b"".join([*out, data[last:]]).decode()


def _scanner(spark: SparkSession, block: list, window: int, first: bool, kind: pa.DataType):
    held = ship(spark, WindowSet(block, window))

    def scan(batches):
        found = held()
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            hits_was, items_was = ([[]] * len(texts), [[]] * len(texts)) if first else (b.column("hits").to_pylist(), b.column("items").to_pylist())
            n, hits, items = [], [], []
            for t, h0, i0 in zip(texts, hits_was, items_was, strict=True):
                ws = words(t)
                h, i = found.scan(ws) if ws else ([], set())
                n.append(len(ws))
                hits.append([{"s": s, "e": e} for s, e in merged(h + [(x["s"], x["e"]) for x in h0])])
                items.append(sorted(i | set(i0)))
            own = [c for c in b.schema.names if c not in ("n_words", "hits", "items")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(items, pa.list_(kind))], names=[*own, "n_words", "hits", "items"])

    return scan


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The given columns (text among them), n_words, hits (merged word intervals) and items (ids of items with occurring windows); given columns of these names give way."""
    spark, docs = docs.sparkSession, docs.drop("n_words", "hits", "items")
    bench = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // block_chars) or 1
    schema, kind = schema_of(docs), bench.schema["item_id"].dataType
    out, scratch, was = docs, Scratch(spark, "decontamination"), None
    for b in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        out = out.mapInArrow(_scanner(spark, sorted(map(tuple, rows), key=lambda r: (str(r[0]), r[1])), window, b == 0, to_arrow_type(kind)), f"{schema}, {_SCAN}, items array<{kind.simpleString()}>")
        if b + 1 < blocks:
            out = scratch.keep(out)
            scratch.drop(was)
            was = out
    return out


_n_hit = "aggregate(hits, 0L, (a, x) -> a + x.e - x.s)"


def contaminated() -> F.Column:
    return F.expr(f"{_n_hit} > 0 AND 20 * {_n_hit} >= n_words")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.expr(_n_hit).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents of the same columns: contaminated ones go, others lose their hit spans (n_chars follows the text)."""

    def cut(batches):
        for b in pieces(batches):
            texts = [without(t, [(x["s"], x["e"]) for x in h]) if h else t for t, h in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("_rest")], names=["doc_id", "text", "_rest"])

    cols = docs.columns
    # the row's other columns travel as one struct, so that no name can clash
    packed = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(c) for c in cols if c not in ("doc_id", "text")]).alias("_rest"))
    schema = schema_of(packed)
    kept = scan_documents(packed, benchmark, window).filter(~contaminated()).select("doc_id", "text", "_rest", "hits").mapInArrow(cut, schema)
    out = kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.{c}").alias(c) for c in cols])
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in cols else out


def _items_sql(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE_SQL = {
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {_items_sql('text')} AS w FROM documents),
b AS (SELECT item_id, {_items_sql('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw USING (k) WHERE dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
