"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily by rounds of joins.

Nearness is the inner product. Equal vectors are one node (told by their MD5; members are expanded at the end, nearest first
and by id). The graph's rows hold vectors as signed bytes with a scale. So that inner products obey a metric, nodes are
banded by halvings of the greatest norm, and within a band one more component makes all norms 1; graphs are built within
bands, so that a vector of any norm flattens no others. A query's whole list is scored on the original vectors in double.

Nodes are dealt into blocks of about ``BLOCK`` by their digests. Joins are co-groups by block: what one block has to tell another
(edges, offers, vectors, frontier nodes) travels as one row of packed arrays beside the block's own row, and a vector is sent
once from block to block, not once an edge.

Build: ``TABLES`` random projections order the nodes by sign code and a further projection; runs of ``LEAF`` nodes in that
order give each node its first neighbours. Then rounds of NN-descent: every node meets its neighbours and its best ``k``
reverse neighbours (a join by block, then one that brings their vectors), compares those pairs among them of which one is
new, and offers each of the two what is better than its worst; offers are merged into the lists (a third join). Rounds go
on until less than ``SETTLED`` of the lists' entries are new (lists only improve, so that comes). Lists are bounded, so
nothing grows with a node's popularity: reverse neighbours beyond k are left to their own lists, which hold the edge.

Search: a node's adjacency is its list and its reverse list, with their vectors. Each query keeps the ``WIDTH`` best nodes
met; the first ``STEP`` of them not expanded yet are expanded per round: the query goes to their blocks, is scored there
against all adjacent nodes, and what beats the query's worst comes back. A query that is a node begins at that node, in bands
other than its own (any other query in all bands) at the best ``STARTS`` of ``ENTRIES`` nodes drawn from each band. Rounds go
on until no query has anything left to expand. All rows are indexed; no query's list is cut before the width.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have another length than most, take no
part, as queries or candidates; repeated vec_ids count once (the vector of least digest); ties go to the smaller vec_id;
extra columns are left alone; an empty table gives an empty result; a product that overflows is what IEEE doubles make of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graph_blocks as G
from .common import Scratch, partitions, read

TOP = 20
K = 24
LEAF = 2048
TABLES = 3
SETTLED = 0.05
WIDTH = 320
STEP = 320
ENTRIES = 1024
STARTS = 16
#: Nodes a block is meant to have at most, and those below which more blocks than that don't pay.
BLOCK, LEAST = 16384, 2048
SALTS = 8

_ROW = "part int, src int, a binary, b binary, c binary, d binary, e binary"
_BLOBS = ("a", "b", "c", "d", "e")


def _rows(parts, src: int, *columns) -> pa.RecordBatch:
    """What one block tells others: for each of the parts (by name) a row of arrays."""
    blob = lambda xs: pa.array([None] * len(parts) if xs is None else [np.ascontiguousarray(x).tobytes() for x in xs], pa.binary())
    blobs = [blob(columns[i] if i < len(columns) else None) for i in range(len(_BLOBS))]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([src] * len(parts), pa.int32()), *blobs], names=["part", "src", *_BLOBS])


def _dealt(names: list[int], part: np.ndarray, src: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns of one row an entry, dealt by the entries' parts."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    cuts = np.flatnonzero(np.diff(p)) + 1
    to = [names[i] for i in p[np.concatenate(([0], cuts))].tolist()] if len(p) else []
    return _rows(to, src, *[np.split(c[order], cuts) if to else [] for c in columns])


def _row(part: int, src: int, blobs, **more) -> pa.RecordBatch:
    """A block's own row."""
    cols = [pa.array([part], pa.int32()), pa.array([src], pa.int32())]
    cols += [pa.array([None if x is None else x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()], pa.binary()) for x in [*blobs, *[None] * (len(_BLOBS) - len(blobs))]]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array([v], pa.int64()) for v in more.values())], names=["part", "src", *_BLOBS, *more])


def part_names(spark: SparkSession, parts: int) -> list[int]:
    """A number for each part that Spark's hash deals to a partition of its own, where there are as many of these as parts."""
    if parts > 4096:  # even enough by chance
        return list(range(parts))
    n = 40 * parts
    found: dict[int, int] = {}
    for i, at in spark.range(n).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))).collect():
        found.setdefault(at, i)
    rest = iter(i for i in range(n, n + parts))
    return [found.get(k, None) if k in found else next(rest) for k in range(parts)]


def usable(vectors: DataFrame, name: str = "vec_id") -> DataFrame:
    """id, key (digest of the vector), vec (its bytes, float or double), log (of its norm, base 2) and dim, of the vectors that
    take part so far."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64

    def run(batches):
        for b in batches:
            ids, keys, out, logs, dims = [], [], [], [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("embedding"), strict=True):
                x = v.values if v.is_valid else None
                if i is None or x is None or not len(x) or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zero
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.tobytes())
                    keys.append(hashlib.md5(out[-1], usedforsecurity=False).digest())
                    logs.append(float(G.exponents(x[None].astype(np.float64))[1][0]))
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.binary()), pa.array(logs, pa.float64()), pa.array(dims, pa.int32())], names=["id", "key", "vec", "log", "dim"])

    return vectors.select(F.col(name).cast("long").alias("id"), "embedding").mapInArrow(run, "id long, key binary, vec binary, log double, dim int"), kind


def _block_of(keys: list[bytes], blocks: int) -> np.ndarray:
    return (np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)[:, :8].copy().view(np.uint64)[:, 0] % np.uint64(blocks)).astype(np.int32)


def _once(blocks: int, names: list[int]):
    """Rows of (part, key, vec), a key once a batch: copies mostly meet before the shuffle."""

    def run(batches):
        for b in batches:
            if len(b):
                keys = b.column("key").to_pylist()
                first = np.array(sorted({k: i for i, k in reversed(list(enumerate(keys)))}.values()))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int32)[_block_of([keys[i] for i in first], blocks)]), b.column("key").take(pa.array(first)), b.column("vec").take(pa.array(first))], names=["part", "key", "vec"])

    return run


def _built(greatest: float, dim: int, kind):
    """Reads (part, key, vec) by part and key; yields a row a block."""

    def block(part, keys, vecs):
        x = np.frombuffer(b"".join(vecs), kind).reshape(len(keys), dim)
        q = G.quantised(x.astype(np.float64), greatest)
        return _row(part, len(keys), (b"".join(keys), b"".join(vecs), q))

    def run(batches):
        was, keys, vecs = None, [], []
        for b in batches:
            for p, k, v in zip(*(b.column(c).to_pylist() for c in ("part", "key", "vec")), strict=True):
                if p != was:
                    if keys:
                        yield block(was, keys, vecs)
                    was, keys, vecs = p, [], []
                if not keys or keys[-1] != k:
                    keys.append(k)
                    vecs.append(v)
        if keys:
            yield block(was, keys, vecs)

    return run


def _each(function, *names):
    """A mapInArrow function of one row at a time: columns as Python values."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                yield from function(*(row.column(n)[0].as_py() for n in names))

    return run


def _grouped(function, tables: int, at: dict[int, int]):
    """A mapInArrow function over rows (part, kind, src, blobs) sorted by part and kind: calls function with a part's place and
    the rows of each of the tables."""

    def run(batches):
        was, held = None, [[] for _ in range(tables)]
        for b in batches:
            for part, kind, *row in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "src", *_BLOBS)), strict=True):
                if part != was:
                    if was is not None:
                        yield from function(at[was], *held)
                    was, held = part, [[] for _ in range(tables)]
                held[kind].append(row)
        if was is not None:
            yield from function(at[was], *held)

    return run


def _together(function, schema: str, names: list[int], *tables: DataFrame) -> DataFrame:
    """Co-groups tables of rows by part: one task a part, as many as there are names."""
    rows = None
    for k, t in enumerate(tables):
        one = t.select("part", F.lit(k).alias("kind"), "src", *_BLOBS)
        rows = one if rows is None else rows.unionByName(one)
    dealt = rows.repartition(len(names), "part").coalesce(len(names)).sortWithinPartitions("part", "kind", "src")
    return dealt.mapInArrow(_grouped(function, len(tables), {n: i for i, n in enumerate(names)}), schema)


def _arrays(blob: bytes | None, kind, width: int | None = None) -> np.ndarray:
    a = np.frombuffer(blob or b"", kind)
    return a if width is None else a.reshape(-1, width)


def _joined(messages, kinds: tuple) -> list[np.ndarray]:
    """The messages' arrays of one row an entry, end to end."""
    return [np.concatenate([_arrays(m[1 + i], k) for m in messages] or [np.zeros(0, k)]) for i, k in enumerate(kinds)]


_LISTS = f"{_ROW}, fresh long, held long"


def _lists_row(part, n, lists, s, new) -> pa.RecordBatch:
    return _row(part, n, (lists, s, new), fresh=int(new.sum()), held=int((lists >= 0).sum()))


class Index:
    """blocks(part, src: nodes, a: keys, b: original vectors, c: quantised ones), lists by block, ids(vec_id, key), and
    codes(key, code). ``close`` gives back the memory that adjacency takes."""

    def __init__(self, vectors: DataFrame, k: int = K):
        spark = vectors.sparkSession
        self.spark, self.scratch, self.k = spark, Scratch(spark, "neighbours"), k
        made, self.kind = usable(vectors)
        all_ = self.scratch.keep(made)
        most = all_.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("log").alias("log")).orderBy(F.desc("n"), "dim").first()
        self.dim, self.greatest = (most["dim"], most["log"]) if most else (1, 0.0)
        rows = all_.filter(F.col("dim") == self.dim)
        self.ids = self.scratch.keep(rows.groupBy("id").agg(F.min("key").alias("key")).withColumnRenamed("id", "vec_id"))
        if most and self.ids.count() < most["n"]:  # only ids that are repeated can hold vectors that don't count
            rows = rows.join(self.ids.withColumnRenamed("vec_id", "id"), ["id", "key"], "left_semi")
        self.n = self.ids.select("key").distinct().count()
        self.p = max(1, min(spark.sparkContext.defaultParallelism, self.n // LEAST), -(-self.n // BLOCK))
        self.names = part_names(spark, self.p)
        dealt = rows.select("key", "vec").mapInArrow(_once(self.p, self.names), "part int, key binary, vec binary").repartition(self.p, "part").coalesce(self.p)
        self.blocks = self.scratch.keep(dealt.sortWithinPartitions("part", "key").mapInArrow(_built(self.greatest, self.dim, self.kind), _ROW))
        self.scratch.drop(all_)
        most_n = self.blocks.agg(F.coalesce(F.max("src"), F.lit(0))).first()[0]
        self.code = np.int32 if self.p * (most_n + 1) < 1 << 31 else np.int64
        self.width = G.HEAD + self.dim + 1
        self.lists = self._descend(self._start())
        self.adjacency = self._adjacency()

    def close(self) -> None:
        self.adjacency.unpersist()

    @property
    def vectors(self) -> DataFrame:
        """Quantised vectors, as a."""
        none = F.lit(None).cast("binary")
        return self.blocks.select("part", "src", F.col("c").alias("a"), *[none.alias(x) for x in _BLOBS[1:]])

    @property
    def sizes(self) -> DataFrame:
        return self.blocks.select("part", "src", *[F.lit(None).cast("binary").alias(x) for x in _BLOBS])

    def _together(self, function, schema: str, *tables: DataFrame) -> DataFrame:
        return _together(function, schema, self.names, *tables)

    # --- building

    @property
    def codes(self) -> DataFrame:
        p, at = self.p, {n: i for i, n in enumerate(self.names)}

        def spread(part, n, keys):
            yield pa.RecordBatch.from_arrays([pa.array([keys[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), pa.array(np.arange(n, dtype=np.int64) * p + at[part])], names=["key", "code"])

        return self.blocks.select("part", "src", "a").mapInArrow(_each(spread, "part", "src", "a"), "key binary, code long")

    def _start(self) -> DataFrame:
        p, k, width, code, names, tables = self.p, self.k, self.width, self.code, self.names, TABLES
        at = {n: i for i, n in enumerate(names)}
        bits = max(0, int(np.ceil(np.log2(max(1, self.n / LEAF)))))
        planes = np.random.default_rng(7).standard_normal((tables, bits + 1, self.dim + 1)).astype(np.float32)

        def project(part, n, q):
            rows = _arrays(q, np.uint8, width)
            scale, band, x = G.parts_of(rows)
            blobs = pa.array([r.tobytes() for r in rows], pa.binary())
            for t in range(tables):
                h = (x * scale[:, None]) @ planes[t].T
                key = ((h[:, :bits] > 0) << np.arange(bits)).sum(1) + 0.999 / (1 + np.exp(-np.clip(4.0 * h[:, bits], -30, 30)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(band), pa.array(key), pa.array(np.arange(n, dtype=np.int64) * p + at[part]), blobs], names=["t", "band", "key", "code", "q"])

        def leaves(batches):
            held_codes, blobs, was = [], [], None
            done: list = []

            def leaf():
                c = np.array(held_codes, np.int64)
                done.append(G.leaf_lists(c, _arrays(b"".join(blobs), np.uint8, width), k))

            def send():
                target, cand, s = (np.concatenate(z) for z in zip(*done, strict=True))
                order = np.argsort(target, kind="stable")
                target, cand, s = target[order], cand[order], s[order]
                return _dealt(names, target % p, 0, (target // p).astype(np.int32), cand.astype(code), s)

            for b in batches:
                for t, c, q in zip(*(b.column(x).to_pylist() for x in ("t", "code", "q")), strict=True):
                    if held_codes and (t != was or len(held_codes) == LEAF):
                        leaf()
                        held_codes, blobs = [], []
                        if len(done) == 32:
                            yield send()
                            done = []
                    was = t
                    held_codes.append(c)
                    blobs.append(q)
            if held_codes:
                leaf()
            if done:
                yield send()

        def first(part, own, offers):
            n = own[0][0]
            yield _lists_row(names[part], n, *G.merged(n, k, np.full((n, k), -1, code), np.zeros((n, k), np.float32), *_joined(offers, (np.int32, code, np.float32))))

        rows = self.vectors.mapInArrow(_each(project, "part", "src", "a"), "t int, band int, key double, code long, q binary")
        parts = max(1, min(partitions(self.spark), self.n * tables // (2 * LEAF)))
        dealt = rows.repartitionByRange(parts, "t", "band", "key", "code").coalesce(parts).sortWithinPartitions("t", "band", "key", "code")
        return self.scratch.keep(self._together(first, _LISTS, self.sizes, dealt.mapInArrow(leaves, _ROW)))

    def _edges(self, lists: DataFrame) -> DataFrame:
        """The lists' edges, told to the blocks that they lead to."""
        p, k, code, names = self.p, self.k, self.code, self.names
        at = {n: i for i, n in enumerate(names)}

        def edges(part, lists_, s, f):
            lists_, s, f = _arrays(lists_, code, k), _arrays(s, np.float32, k), _arrays(f, np.int8, k)
            have = lists_ >= 0
            target = lists_[have]
            order = np.argsort(target, kind="stable")
            target, v = target[order], (np.nonzero(have)[0][order] * p + at[part]).astype(code)
            yield _dealt(names, target % p, at[part], (target // p).astype(np.int32), v, s[have][order], f[have][order])

        return lists.select("part", "a", "b", "c").mapInArrow(_each(edges, "part", "a", "b", "c"), _ROW)

    def _met(self, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """By block: reverse lists (and their marks of what is new), and the vectors (with what beats the worst of their lists) of
        all nodes that an edge of the block begins or ends at."""
        p, k, width, code, names = self.p, self.k, self.width, self.code, self.names

        def answer(part, own, mine, came):
            n, rows = own[0][0], _arrays(own[0][1], np.uint8, width)
            lists_, s = _arrays(mine[0][1], code, k), _arrays(mine[0][2], np.float32, k)
            low = np.where((lists_ >= 0).all(1), s[:, -1], np.float32(-9)).astype(np.float32)
            have = lists_ >= 0
            want = np.nonzero(have)[0] * p + lists_[have] % p  # (own node, block that it has an edge to)
            target, source, v, f = _joined(came, (np.int32, code, np.float32, np.int8))
            pairs = np.unique(np.concatenate((want, target.astype(np.int64) * p + source % p)))
            node = pairs // p
            yield _dealt(names, pairs % p, part, (node * p + part).astype(code), low[node], rows[node])
            # to itself, marked by src -1: the k best reverse neighbours of each node
            i = G.best_of(target, source, v, k)
            yield _row(names[part], -1, G.listed(n, k, target[i], (source[i], -1), (f[i], 0)))

        self._told = told = self.scratch.keep(self._together(answer, _ROW, self.vectors, lists, self._edges(lists)))
        return told.filter("src = -1"), told.filter("src >= 0")

    def _table(self):
        width, code = self.width, self.code

        def run(brought):
            codes = np.concatenate([_arrays(m[1], code) for m in brought] or [np.zeros(0, code)])
            low = np.concatenate([_arrays(m[2], np.float32) for m in brought] or [np.zeros(0, np.float32)])
            rows = np.concatenate([_arrays(m[3], np.uint8, width) for m in brought] or [np.zeros((0, width), np.uint8)])
            order = np.argsort(codes)
            return codes[order], low[order], rows[order]

        return run

    def _descend(self, lists: DataFrame) -> DataFrame:
        p, k, code, names, table = self.p, self.k, self.code, self.names, self._table()

        def compare(part, mine, turned, brought):
            codes, low, rows = table(brought)
            if len(codes):
                rev, rev_new = _arrays(turned[0][1], code, k), _arrays(turned[0][2], np.int8, k)
                for target, cand, s in G.local_join(_arrays(mine[0][1], code, k), _arrays(mine[0][3], np.int8, k), rev, rev_new, codes, rows, low, k):
                    yield _dealt(names, target % p, part, (target // p).astype(np.int32), cand.astype(code), s)

        def merge(part, mine, offers):
            lists_, s = _arrays(mine[0][1], code, k), _arrays(mine[0][2], np.float32, k)
            yield _lists_row(names[part], len(lists_), *G.merged(len(lists_), k, lists_, s, *_joined(offers, (np.int32, code, np.float32))))

        while True:
            turned, brought = self._met(lists)
            offers = self._together(compare, _ROW, lists, turned, brought)
            nxt = self.scratch.keep(self._together(merge, _LISTS, lists, offers))
            fresh, held = nxt.agg(F.sum("fresh"), F.sum("held")).first()
            self.scratch.drop(lists, self._told)
            self.scratch.tidy()
            lists = nxt
            if not fresh or fresh / held < SETTLED:
                return lists

    def _adjacency(self) -> DataFrame:
        k, code, names, table = self.k, self.code, self.names, self._table()

        def adjacent(part, mine, turned, brought):
            codes, _, rows = table(brought)
            both = np.concatenate((_arrays(mine[0][1], code, k), _arrays(turned[0][1], code, k)), axis=1)
            both.sort(axis=1)
            ok = both >= 0
            ok[:, 1:] &= both[:, 1:] != both[:, :-1]
            start = np.concatenate(([0], np.cumsum(ok.sum(1)))).astype(np.int32)
            at = np.searchsorted(codes, both[ok]).astype(np.int32)
            yield _row(names[part], 0, (start, at, codes, rows))

        turned, brought = self._met(self.lists)
        out = self.scratch.keep(self._together(adjacent, _ROW, self.lists, turned, brought))
        # searches come back to it round by round: it stays where its blocks are dealt to, computed, so that joins know that
        held = out.select("part", *[F.col(c).alias(f"_{c}") for c in "abcd"]).repartition(self.p, "part").persist()
        held.count()
        return held

    # --- search

    def _entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and quantised rows of some ENTRIES nodes of each band (all, where it has fewer)."""
        width, p = self.width, self.p
        place = {n: i for i, n in enumerate(self.names)}

        def bands(q):
            b, c = np.unique(G.parts_of(_arrays(q, np.uint8, width))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(c.astype(np.int64))], names=["band", "n"])

        sizes = {r[0]: r[1] for r in self.vectors.mapInArrow(_each(bands, "a"), "band int, n long").groupBy("band").agg(F.sum("n")).collect()}

        def drawn(part, keys, q):
            rows = _arrays(q, np.uint8, width)
            band = G.parts_of(rows)[1]
            u = _arrays(keys, np.uint8, 16)[:, 8:].copy().view(np.uint64)[:, 0] / 2.0**64
            i = np.flatnonzero(u * np.array([sizes[x] for x in band.tolist()]) < ENTRIES)
            yield pa.RecordBatch.from_arrays([pa.array(i * p + place[part]), pa.array([r.tobytes() for r in rows[i]], pa.binary())], names=["code", "q"])

        got = self.blocks.mapInArrow(_each(drawn, "part", "a", "c"), "code long, q binary").orderBy("code").collect()
        return np.array([r[0] for r in got], np.int64), _arrays(b"".join(bytes(r[1]) for r in got), np.uint8, width)

    def search(self, queries: DataFrame, top: int = TOP, width: int = WIDTH) -> DataFrame:
        """queries(query_id, embedding): query_id, rank, vec_id, score. The query's own id is left out. Equal queries are
        searched once."""
        made, kind = usable(queries, "query_id")
        asked = self.scratch.keep(made.filter(F.col("dim") == self.dim).select("id", "key", "vec"))
        per_id = asked.groupBy("id").agg(F.min("key").alias("key"))
        keys = per_id.select("key").distinct()
        m = keys.count()
        parts = max(1, min(self.spark.sparkContext.defaultParallelism, m // 64), -(-m // 4096))
        names = part_names(self.spark, parts)
        known = keys.join(self.codes, "key").select("key", "code")
        state = self.scratch.keep(self._begun(asked, known, names, kind, width))
        while state.agg(F.sum("open")).first()[0]:
            nxt = self.scratch.keep(self._round(state, names, kind, width))
            self.scratch.drop(state)
            self.scratch.tidy()
            state = nxt
        return self._expanded(self._exact(state, names, kind, top, width), per_id, top)

    def _begun(self, asked: DataFrame, known: DataFrame, names: list[int], kind, width: int) -> DataFrame:
        dim, code, greatest, parts = self.dim, self.code, self.greatest, len(names)
        entry_codes, entry_rows = self._entries()

        def place(batches):
            for b in batches:
                if len(b):
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int32)[_block_of(b.column("key").to_pylist(), parts)]), *b.columns], names=["part", *b.schema.names])

        def blocks(batches):
            scale, band, x = G.parts_of(entry_rows)
            near = x[:, :dim] * (scale * np.exp2(-band.astype(np.float32)))[:, None]

            def block(part, keys, vecs, own):
                n = len(keys)
                unit = G.exponents(_arrays(b"".join(vecs), kind, dim).astype(np.float64))[0].astype(np.float32)
                lists, s = np.full((n, width), -1, code), np.full((n, width), -9, np.float32)
                for i in range(n):
                    got = near @ unit[i] if len(near) else np.zeros(0, np.float32)
                    picks = []
                    for b_ in np.unique(band).tolist():
                        at = np.flatnonzero(band == b_)
                        picks.append(at[np.argsort(-got[at], kind="stable")[:STARTS]])
                    pick = np.concatenate(picks) if picks else np.zeros(0, int)
                    c, unit_s = entry_codes[pick], got[pick]
                    if own[i] is not None:  # begins at itself, before all others; other bands by their entries
                        mine = band[pick] != own_band(vecs[i])
                        c, unit_s = np.concatenate(([own[i]], c[mine])), np.concatenate((np.float32([4]), unit_s[mine]))
                    o = np.lexsort((c, -unit_s))[:width]
                    _, u = np.unique(c[o], return_index=True)
                    o = o[np.sort(u)]
                    lists[i, : len(o)], s[i, : len(o)] = c[o], unit_s[o]
                return _state_row(part, b"".join(keys), b"".join(vecs), lists, s, np.zeros((n, width), np.int8))

            def own_band(vec):
                return int(np.floor(max(0.0, greatest - G.exponents(_arrays(vec, kind)[None].astype(np.float64))[1][0]) + 1e-9))

            was, keys, vecs, own = None, [], [], []
            for b in batches:
                for part, key, vec, c in zip(*(b.column(z).to_pylist() for z in ("part", "key", "vec", "code")), strict=True):
                    if part != was:
                        if keys:
                            yield block(was, keys, vecs, own)
                        was, keys, vecs, own = part, [], [], []
                    if not keys or keys[-1] != key:
                        keys.append(key)
                        vecs.append(vec)
                        own.append(c)
                    elif vec is not None:
                        vecs[-1] = vec
                    if c is not None:
                        own[-1] = c
            if keys:
                yield block(was, keys, vecs, own)

        once = asked.select("key", "vec").mapInArrow(_once(parts, names), "part int, key binary, vec binary").withColumn("code", F.lit(None).cast("long"))
        placed = known.mapInArrow(place, "part int, key binary, code long").select("part", "key", F.lit(None).cast("binary").alias("vec"), "code")
        return once.unionByName(placed).repartition(parts, "part").coalesce(parts).sortWithinPartitions("part", "key").mapInArrow(blocks, _STATE)

    def _asks(self, state: DataFrame, function) -> DataFrame:
        """What function tells of each block of queries, gathered by the block of nodes that it goes to, where adjacency lies."""
        told = state.select("part", *_BLOBS).mapInArrow(_each(function, "part", *_BLOBS), _ROW)
        return told.repartition(self.p, "part").groupBy("part").agg(F.collect_list(F.struct("src", "a", "b", "c", "d")).alias("m")).hint("merge")

    def _round(self, state: DataFrame, names: list[int], kind, width: int) -> DataFrame:
        dim, code, p, row_width, nodes = self.dim, self.code, self.p, self.width, self.names

        def ask(part, keys, vecs, lists, s, done):
            lists, s = _arrays(lists, code, width), _arrays(s, np.float32, width)
            q, at = _open(lists, _arrays(done, np.int8, width))
            if len(q):
                low = np.where((lists >= 0).all(1), s[:, -1], np.float32(-9)).astype(np.float32)
                unit = G.exponents(_arrays(vecs, kind, dim).astype(np.float64))[0].astype(np.float32)
                yield _asked(nodes, part, p, q, lists[q, at], low, unit)

        def expand(start, at, codes, rows, m):
            start, at, codes = _arrays(start, np.int32), _arrays(at, np.int32), _arrays(codes, code)
            scale, band, x = G.parts_of(_arrays(rows, np.uint8, row_width))
            x = x[:, :dim] * (scale * np.exp2(-band.astype(np.float32)))[:, None]
            for one in m:
                q, pos = _arrays(one["a"], np.int32), _arrays(one["b"], np.int32)
                asked = np.unique(q)
                low, unit = _arrays(one["c"], np.float32), _arrays(one["d"], np.float32, dim)
                cut = np.append(np.searchsorted(q, asked), len(q))
                out = []
                for i, name in enumerate(asked.tolist()):
                    near = np.unique(np.concatenate([at[start[j] : start[j + 1]] for j in pos[cut[i] : cut[i + 1]].tolist()]))
                    got = x[near] @ unit[i]
                    ok = np.flatnonzero(got > low[i])
                    if len(ok) > width:
                        ok = ok[np.lexsort((codes[near[ok]], -got[ok]))[:width]]
                    out.append((np.full(len(ok), name, np.int32), codes[near[ok]], got[ok].astype(np.float32)))
                if out:
                    yield _rows([one["src"]], 0, *[[np.concatenate(z)] for z in zip(*out, strict=True)])

        def gather(part, own, back):
            _, keys, vecs, lists, s, done = own[0]
            lists, s, done = _arrays(lists, code, width), _arrays(s, np.float32, width), _arrays(done, np.int8, width).copy()
            n = len(lists)
            q, at = _open(lists, done)
            done[q, at] = 1
            have = lists >= 0
            target, cand, score = _joined(back, (np.int32, code, np.float32))
            t, c, v = np.concatenate((np.nonzero(have)[0], target)), np.concatenate((lists[have], cand)), np.concatenate((s[have], score))
            d = np.concatenate((done[have], np.zeros(len(cand), np.int8)))
            met = np.concatenate((np.zeros(int(have.sum()), np.int8), np.ones(len(cand), np.int8)))  # what is listed stays as it is
            i = G.best_of(t, c, v, width, met)
            yield _state_row(names[part], keys, vecs, *G.listed(n, width, t[i], (c[i], -1), (v[i], np.float32(-9)), (d[i], 0)))

        met = self.adjacency.join(self._asks(state, ask), "part").mapInArrow(_each(expand, "_a", "_b", "_c", "_d", "m"), _ROW)
        return _together(gather, _STATE, names, state, met)

    def _exact(self, state: DataFrame, names: list[int], kind, top: int, width: int) -> DataFrame:
        """key, code and score of the nodes of the queries' lists, scored on the original vectors: the top + 1 best of each query
        and their ties, which hold all members that it can return."""
        dim, code, p, own_kind, nodes = self.dim, self.code, self.p, self.kind, self.names

        def ask(part, keys, vecs, lists, s, done):
            lists = _arrays(lists, code, width)
            q, at = np.nonzero(lists >= 0)
            if len(q):
                yield _asked(nodes, part, p, q, lists[q, at], np.zeros(len(lists), np.float32), _arrays(vecs, kind, dim))

        def score(part, own, asked):
            x = _arrays(own[0][2], own_kind, dim) if own else None
            for src, a, b, _, d, _e in asked:
                q, pos = _arrays(a, np.int32), _arrays(b, np.int32)
                y = _arrays(d, kind, dim)
                y_at = np.searchsorted(np.unique(q), q)
                for i in range(0, len(q), 4096):
                    u, v = x[pos[i : i + 4096]].astype(np.float64), y[y_at[i : i + 4096]].astype(np.float64)
                    with np.errstate(all="ignore"):
                        got = (u * v).sum(1)
                    yield _rows([src], 0, [q[i : i + 4096]], [(pos[i : i + 4096].astype(np.int64) * p + part).astype(code)], [got])

        def best(part, own, back):
            keys = own[0][1]
            q, c, v = _joined(back, (np.int32, code, np.float64))
            order = np.lexsort((c, -v, q))
            q, c, v = q[order], c[order], v[order]
            start = np.searchsorted(q, np.arange(len(keys) // 16 + 1))
            last = v[np.minimum(start[q] + top, np.maximum(start[q + 1] - 1, 0))] if len(q) else v
            ok = ~(v < last)
            yield pa.RecordBatch.from_arrays([pa.array([keys[16 * i : 16 * i + 16] for i in q[ok].tolist()], pa.binary()), pa.array(c[ok].astype(np.int64)), pa.array(v[ok])], names=["key", "code", "score"])

        told = state.select("part", *_BLOBS).mapInArrow(_each(ask, "part", *_BLOBS), _ROW)
        none = F.lit(None).cast("binary")
        originals = self.blocks.select("part", "src", none.alias("a"), "b", *[none.alias(x) for x in "cde"])
        return _together(best, "key binary, code long, score double", names, state, self._together(score, _ROW, originals, told))

    def _expanded(self, found: DataFrame, per_id: DataFrame, top: int) -> DataFrame:
        # top + 1 members of a node are as many as a query can return of it, itself left out
        least = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
        few = self.ids.withColumn("_r", least).filter(F.col("_r") <= top + 1).select("key", "vec_id").join(self.codes, "key").select("code", "vec_id")
        by = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
        ranked = found.join(few, "code").withColumn("_r", by).filter(F.col("_r") <= top + 1)
        lists = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("x"))
        # one vector may be asked for by any number of ids: these are dealt over salts
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = per_id.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        others = F.slice(F.filter("x", lambda y: y["vec_id"] != F.col("id")), 1, top)
        out = asked.join(salted, ["key", "salt"]).select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "y"))
        return out.select("query_id", (F.col("pos") + 1).alias("rank"), "y.vec_id", "y.score")


_STATE = f"{_ROW}, open long"


def _state_row(part, keys, vecs, lists, s, done) -> pa.RecordBatch:
    return _row(part, 0, (keys, vecs, lists, s, done), open=int(((lists >= 0) & (done == 0)).sum()))


def _open(lists: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first STEP nodes of each list not expanded yet."""
    free = (lists >= 0) & (done == 0)
    return np.nonzero(free & (np.cumsum(free, axis=1) <= STEP))


def _asked(names: list[int], part: int, p: int, q: np.ndarray, codes: np.ndarray, low: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
    """Frontier nodes dealt by their blocks; a query goes to a block once, with its worst score and its vector. src is the name of
    the queries' own block."""
    to = codes % p
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    pieces = np.split(order, cuts)
    once = [np.unique(q[i]) for i in pieces]
    return _rows([names[int(to[i[0]])] for i in pieces], part, [q[i].astype(np.int32) for i in pieces], [(codes[i] // p).astype(np.int32) for i in pieces], [low[x] for x in once], [vecs[x] for x in once])


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = Index(vectors)
    out = index.search(vectors.filter(F.pmod("vec_id", F.lit(20)) == 0).withColumnRenamed("vec_id", "query_id"))
    index.close()  # the rounds are over; what is left to compute reads written tables
    return out
