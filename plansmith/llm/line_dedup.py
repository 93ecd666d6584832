"""Line dedup with sharded cuckoo filters over exact reference counts, incremental and reversible.

A document is split at newlines; a line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased.
Keys of at least ``MIN_CHARS`` code points that at least two documents hold lose all their lines except in the smallest
doc_id holding them. Keys are told apart by 128 bits of their MD5.

State of an index (Parquet tables in the shared folder):

* ``postings(key, doc_id)``: which documents hold a key, each pair once;
* ``refs(key, n_docs, first_doc)``: the exact reference counts, and the document that keeps the line;
* ``filters(shard, table)``: for each shard of the key space, a cuckoo filter over the keys with two or more references.

A line whose key isn't in its shard's filter stays without a look at the counts; a hit is verified against ``refs``, so a
false positive never drops a line. Filters meet postings shard by shard: both are dealt by (shard, salt of the document),
each task streams one filter and then the postings it belongs to, and nothing is broadcast. ``insert`` and ``delete``
change counts by deltas, put keys that become shared into the filters and take keys that are shared no more out again;
deletion recomputes the keeping document of the keys concerned from the postings. So a deletion gives back the lines that
were dropped in favour of the deleted document.

Defined results: null and empty texts are one empty line (too short to be a key); a null doc_id counts as one document
that comes after all others; rows that share a doc_id are one document, each row losing its lines alike; within the
keeping document repeated lines all stay; extra columns are left alone; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, pieces, read, salted, schema_of

MIN_CHARS = 10
#: Keys that one shard's filter is laid out for, and documents' salts that its probes are spread over.
SHARD_KEYS = 50_000
SALTS = 8
#: How many times the keys that a new filter takes it has room for.
ROOM = 2
_SPACE = b" \t\n\x0b\x0c\r"
_NO_ID = (1 << 63) - 1


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The key's digest, or None where the key is too short."""
    k = line.strip(_SPACE).lower()
    if len(k) < least or len(k) < 4 * least and len(k.decode()) < least:
        return None
    return hashlib.md5(k, usedforsecurity=False).digest()


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key, a stash for what finds no place. Supports deletion."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: list[tuple[int, int]] | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.stash = stash or []

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        n = 1
        while n * cls.SLOTS * 0.85 < keys:
            n *= 2
        return cls(n)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 16) bytes. Fingerprints and both buckets."""
        w = np.ascontiguousarray(keys).view(np.uint64).reshape(len(keys), 2)
        f = (w[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        f[f == 0] = 1
        a = (w[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        return f, a, a ^ self._jump(f)

    def _jump(self, f):
        return (f * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def add(self, keys: np.ndarray) -> None:
        rng = np.random.default_rng(len(keys))
        for f, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = f
                    break
            else:
                at = (a, b)[int(rng.integers(2))]
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    f, self.table[at, slot] = int(self.table[at, slot]), f
                    at ^= int(self._jump(f))
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = f
                        break
                else:
                    self.stash.append((f, min(at, int(at ^ self._jump(f)))))

    def remove(self, keys: np.ndarray) -> None:
        """Keys that were added, each once."""
        for f, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == f)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
            else:
                if (f, min(a, b)) in self.stash:
                    self.stash.remove((f, min(a, b)))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self._places(keys)
        got = (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)
        if self.stash:
            stash = set(self.stash)
            got |= np.fromiter(((x, min(y, z)) in stash for x, y, z in zip(f.tolist(), a.tolist(), b.tolist(), strict=True)), bool, len(f))
        return got

    def dump(self) -> bytes:
        head = np.array([self.buckets, len(self.stash), *(x for s in self.stash for x in s)], np.int64)
        return head.tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        n, k = np.frombuffer(data, np.int64, 2).tolist()
        stash = np.frombuffer(data, np.int64, 2 * k, 16).reshape(-1, 2).tolist()
        return cls(n, np.frombuffer(data, np.uint16, offset=16 + 16 * k).reshape(n, cls.SLOTS).copy(), [tuple(x) for x in stash])


def _bytes16(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 16)


def postings(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Distinct (key, doc_id)."""

    def keys(batches):
        for b in pieces(batches):
            ids, ks = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = {line_key(x, least) for x in t.encode().split(b"\n")} if t else set()
                found.discard(None)
                ids += [i] * len(found)
                ks += found
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    cut = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    return cut.mapInArrow(keys, "key binary, doc_id long").distinct()


def _counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _shard(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _streamed(df: DataFrame, by: list[str], order: list[str], function, schema: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *by).sortWithinPartitions(*by, *order).mapInArrow(function, schema)


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    """filters(shard, table) of the given keys; a shard's keys are the most that a task holds at once."""
    return update_filters(None, shared.select("key", F.lit(1).alias("sign")), shards)


def update_filters(filters: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """changes(key, sign): 1 puts a key in, -1 takes it out."""

    def apply(batches):
        shard, held, add, drop = None, None, [], []

        def done():
            f = held
            if drop:
                f.remove(np.frombuffer(b"".join(drop), np.uint8).reshape(-1, 16))
            if f is None:
                f = CuckooFilter.sized(max(ROOM * len(add), SHARD_KEYS // 64))
            if add:
                f.add(np.frombuffer(b"".join(add), np.uint8).reshape(-1, 16))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f.dump()], pa.binary())], names=["shard", "table"])

        for b in batches:
            for s, table, key, sign in zip(*(b.column(c).to_pylist() for c in ("shard", "table", "key", "sign")), strict=True):
                if s != shard:
                    if shard is not None:
                        yield done()
                    shard, held, add, drop = s, None, [], []
                if table is not None:
                    held = CuckooFilter.load(table)
                else:
                    (add if sign > 0 else drop).append(key)
        if shard is not None:
            yield done()

    rows = changes.select(_shard(shards).alias("shard"), F.lit(None).cast("binary").alias("table"), "key", F.col("sign").cast("int").alias("sign"))
    if filters is not None:
        rows = rows.unionByName(filters.select("shard", "table", F.lit(None).cast("binary").alias("key"), F.lit(0).alias("sign")))
    return _streamed(rows, ["shard"], ["key"], apply, "shard int, table binary")


def probe(posts: DataFrame, filters: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """The postings that their shard's filter may hold."""

    def run(batches):
        shard, held = None, None
        for b in batches:
            s, k = b.column("shard").to_numpy(), b.column("key")
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if s[i] != shard:
                    shard, held = s[i], None
                part = b.slice(i, j - i)
                isf = np.array(part.column("kind")) == 0
                if isf.any():
                    held = CuckooFilter.load(part.column("table")[int(np.flatnonzero(isf)[0])].as_py())
                part = part.filter(pa.array(~isf))
                if held is not None and len(part):
                    part = part.filter(pa.array(held.holds(_bytes16(part.column("key")))))
                    if len(part):
                        yield part.select(["key", "doc_id"])
            del k

    none = F.lit(None)
    rows = posts.select(_shard(shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), none.cast("binary").alias("table"), "key", "doc_id")
    each = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "table", none.cast("binary").alias("key"), none.cast("long").alias("doc_id"))
    return _streamed(rows.unionByName(each), ["shard", "salt"], ["kind"], run, "key binary, doc_id long")


class LineIndex:
    """Incremental line dedup. ``insert`` takes documents with new ids, ``delete`` ids that were inserted."""

    def __init__(self, spark: SparkSession, least: int = MIN_CHARS, shards: int | None = None):
        self.spark, self.least, self.fixed, self.shards, self.room = spark, least, shards, shards, 0
        self.scratch = Scratch(spark, "lines")
        self.postings = self.refs = self.filters = None

    def insert(self, docs: DataFrame) -> None:
        new = self.scratch.keep(postings(docs, self.least))
        if self.postings is None:
            self.postings = new
            self.refs = self.scratch.keep(_counts(new))
            shared = self.refs.filter("n_docs > 1")
            self.filters = self._laid_out(shared, shared.count())
            return
        delta = _counts(new)
        refs = self.refs.select("key", "n_docs", "first_doc", F.lit(True).alias("old")).unionByName(delta.withColumn("old", F.lit(False)))
        merged = refs.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.coalesce(F.sum(F.when(F.col("old"), F.col("n_docs"))), F.lit(0)).alias("was"))
        self._step(self.postings.unionByName(new), merged)

    def _laid_out(self, shared: DataFrame, n: int) -> DataFrame:
        self.shards, self.room = self.fixed or max(4, -(-n // SHARD_KEYS)), max(ROOM * n, SHARD_KEYS // 16)
        return self.scratch.keep(build_filters(shared, self.shards))

    def delete(self, ids: DataFrame) -> None:
        """ids(doc_id). Keys of deleted documents get their counts and keeping documents anew."""
        gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id")).distinct()
        left = self.postings.join(gone, "doc_id", "left_anti").select("key", "doc_id")
        touched = self.postings.join(gone, "doc_id", "left_semi").select("key").distinct()
        fresh = _counts(left.join(touched, "key", "left_semi"))
        same = self.refs.join(touched, "key", "left_anti").withColumn("was", F.col("n_docs"))
        again = touched.join(fresh, "key", "left").join(self.refs.select("key", F.col("n_docs").alias("was")), "key").select("key", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc", "was")
        self._step(left, same.unionByName(again))

    def _step(self, posts: DataFrame, merged: DataFrame) -> None:
        old = [self.postings, self.refs, self.filters]
        merged = self.scratch.keep(merged)
        crossing = merged.filter("(n_docs > 1) <> (was > 1)").select("key", F.when(F.col("n_docs") > 1, 1).otherwise(-1).alias("sign"))
        self.postings = self.scratch.keep(posts)
        shared = merged.filter("n_docs > 1")
        n = shared.count()
        # filters that the keys outgrow are laid out anew from the exact counts, over more shards
        self.filters = self._laid_out(shared, n) if n > self.room else self.scratch.keep(update_filters(self.filters, crossing, self.shards))
        self.refs = self.scratch.keep(merged.filter("n_docs > 0").select("key", "n_docs", "first_doc"))
        self.scratch.drop(merged, *old)

    def drops(self) -> DataFrame:
        """doc_id and the keys whose lines it loses."""
        maybe = probe(self.postings, self.filters, self.shards)
        shared = self.refs.filter("n_docs > 1").select("key", "first_doc")
        return salted(maybe, shared, "key", "doc_id").filter("doc_id <> first_doc").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """The documents' columns, with n_lines, n_dropped and the kept text in ``kept``; docs must be indexed. Given columns of
        these names give way."""
        least, docs = self.least, docs.drop("n_lines", "n_dropped", "kept", "_keys", "_drop_id")

        def keep(batches):
            for b in pieces(batches):
                n, dropped, kept = [], [], []
                for t, ks in zip(b.column("text").to_pylist(), b.column("_keys").to_pylist(), strict=True):
                    lines = (t or "").encode().split(b"\n")
                    n.append(len(lines))
                    if ks:
                        gone = set(ks)
                        lines = [x for x in lines if line_key(x, least) not in gone]
                        t = b"\n".join(lines).decode()
                    dropped.append(n[-1] - len(lines))
                    kept.append(t or "")
                own = [c for c in b.schema.names if c != "_keys"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*own, "n_lines", "n_dropped", "kept"])

        schema = schema_of(docs)
        drops = self.drops().select(F.col("doc_id").alias("_drop_id"), F.col("keys").alias("_keys")).hint("shuffle_hash")
        return docs.join(drops, F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)) == drops["_drop_id"], "left").drop("_drop_id").mapInArrow(keep, f"{schema}, n_lines long, n_dropped long, kept string")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark)
    index.insert(docs)
    return index.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents of the same columns with the duplicate lines gone (n_chars follows the text); rows all stay."""
    index = LineIndex(docs.sparkSession)
    index.insert(docs.select("doc_id", "text"))
    cols = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in cols if c not in ("doc_id", "text")]).alias("_rest"))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept"))
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.when(F.col("text").isNull(), F.col("_rest.n_chars")).otherwise(F.length("kept").cast("long")) if "n_chars" in cols else None}
    return index.deduplicated(packed).select(*[(new[c] if c in new else F.col(f"_rest.{c}")).alias(c) for c in cols])


ORACLE_SQL = {
    "op4_line_dedup": """
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
s AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT doc_id, i, line, first_doc IS NULL OR first_doc = doc_id AS stays FROM l LEFT JOIN s USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM f GROUP BY doc_id"""
}
