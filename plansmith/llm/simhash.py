"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints of 64 bits over word shingles link at ``RADIUS`` or fewer differing bits. Two fingerprints within a radius
share a variant within half of it of both, so every fingerprint emits all its variants within half the radius, a shuffle
brings equal variants together, and colliding pairs are deduplicated and verified.

Over whole fingerprints that is 2,081 variants each. By the pigeonhole principle one of the two 32-bit words of linked
fingerprints differs in at most half the radius, so here the balls are laid round each word: 33 variants a word, 66 a
fingerprint, and every pair within the radius still meets. Pairs are verified on all 64 bits. This is the cheaper form up
to some billion distinct fingerprints; beyond that ``words=1`` lays the balls round whole fingerprints.

A variant that more than ``CROWD`` fingerprints share is not paired up: its members emit the full ball instead, where all
who share a variant are within the radius of each other, so that linking each to the first of them is exact, needs no
verification and stays linear in their number. Copies meet before that: only distinct fingerprints are hashed.

Links are joined into components by alternating star contraction over DataFrames.

Defined results: null texts and texts without words have fingerprint zero and are linked like any others; fewer words than
a shingle make one shingle; component_id ignores null doc_ids (null only where a component has no other); rows that repeat
a doc_id each get their own fingerprint; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, partitions, pieces, read, salted

SHINGLE = 4
RADIUS = 4
SEED = 42
CROWD = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    ws = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    n = max(1, len(ws) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[min(shingle, len(ws)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, hash (of the text) and fp, the fingerprint as a signed long."""

    def run(batches):
        for b in pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(fps.view(np.int64))], names=["doc_id", "hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(bits: int, radius: int) -> list[int]:
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << i for i in c) for c in _subsets(bits, r)]
    return masks


def _subsets(n: int, r: int):
    from itertools import combinations

    return combinations(range(n), r)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _pairs(radius: int, crowd: int):
    """Reads (variant, fp) sorted by both; yields verified links, and members of crowded variants as (fp, null)."""

    def run(batches):
        key_was, held, crowded = None, np.zeros(0, np.int64), False

        def close(fps: np.ndarray, out: list) -> None:
            if 1 < len(fps) <= crowd:
                i, j = np.triu_indices(len(fps), 1)
                near = _popcount((fps[i] ^ fps[j]).view(np.uint64)) <= radius
                if near.any():
                    out.append((fps[i][near], fps[j][near]))
            elif len(fps) > crowd:
                out.append((fps, None))

        for b in batches:
            keys, fps = b.column("variant").to_numpy(), b.column("fp").to_numpy()
            out: list = []
            if len(keys):
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
                sizes = np.diff(cuts)
                last = len(sizes) - 1
                for k in sorted({0, last, *np.flatnonzero(sizes > 1).tolist()}):
                    part, key = fps[cuts[k] : cuts[k + 1]], keys[cuts[k]]
                    if key != key_was:
                        if key_was is not None and not crowded:
                            close(held, out)
                        key_was, held, crowded = key, np.zeros(0, np.int64), False
                    if crowded:
                        out.append((part, None))
                    else:
                        held = np.concatenate((held, part))
                        if len(held) > crowd:
                            out.append((held, None))
                            held, crowded = np.zeros(0, np.int64), True
            if out:
                yield _links(out)
        out = []
        if key_was is not None and not crowded:
            close(held, out)
        if out:
            yield _links(out)

    return run


def _links(out: list) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in out])
    b = np.concatenate([np.zeros(len(x), np.int64) if y is None else y for x, y in out])
    crowd = np.concatenate([np.full(len(x), y is None) for x, y in out])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(crowd)], names=["a", "b", "crowded"])


def _stars(batches):
    """Reads (variant, fp) sorted by both; links each fp to the first of its variant."""
    key_was, first = None, 0
    for b in batches:
        keys, fps = b.column("variant").to_numpy(), b.column("fp").to_numpy()
        if not len(keys):
            continue
        head = np.concatenate(([keys[0] != key_was], np.diff(keys) != 0))
        at = np.maximum.accumulate(np.where(head, np.arange(len(keys)), -1))
        center = np.where(at >= 0, fps[np.maximum(at, 0)], first)
        key_was, first = keys[-1], center[-1]
        links = np.unique(np.stack((center[~head], fps[~head]), 1), axis=0)
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def _full_ball(radius: int):
    masks = np.array(_ball(64, radius // 2), np.uint64).view(np.int64)

    def run(batches):
        for b in batches:
            fps = b.column("fp").to_numpy()
            for i in range(0, len(fps), 64):
                part = fps[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel()), pa.array(np.repeat(part, len(masks)))], names=["variant", "fp"])

    return run


def _met(variants: DataFrame) -> DataFrame:
    return variants.repartition(partitions(variants.sparkSession), "variant").sortWithinPartitions("variant", "fp")


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, words: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints within the radius: all of them, or a star for each crowded variant."""
    if words == 1:
        return _met(distinct.select("fp").mapInArrow(_full_ball(radius), "variant long, fp long")).mapInArrow(_stars, "a long, b long").distinct()
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(32, radius // 4)])
    word = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("k"), low.alias("w")), F.struct(F.lit(1 << 32).alias("k"), high.alias("w"))))
    variants = distinct.select("fp", word.alias("x")).select("fp", "x", F.explode(masks).alias("m")).select((F.col("x.k") + F.col("x.w").bitwiseXOR(F.col("m"))).alias("variant"), "fp")
    met = scratch.keep(_met(variants).mapInArrow(_pairs(radius, crowd), "a long, b long, crowded boolean"))
    few = met.filter("NOT crowded").select("a", "b")
    dense = met.filter("crowded").select(F.col("a").alias("fp")).distinct()
    return few.unionByName(_met(dense.mapInArrow(_full_ball(radius), "variant long, fp long")).mapInArrow(_stars, "a long, b long")).distinct()


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an edge the smallest node that it reaches. Alternating large and small stars until
    nothing changes; each half step is a grouped minimum, partly summed before the shuffle, and a join."""
    cur = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), few=True)
    was = None
    while True:
        # large star: every neighbour above a node goes to the least of its neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted(both, low, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node's lower neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.keep(small, few=True)
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(cur)
        scratch.tidy()
        cur = nxt
        if now == was:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def cluster(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, words: int = 2, crowd: int = CROWD) -> DataFrame:
    """doc_id, hash (of the text), fp, root (a fingerprint that names the component) and component_id (the smallest doc_id
    reachable)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, shingle), few=True)
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, scratch, radius, words, crowd), scratch)
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(labelled.join(ids, "root").select("fp", "root", "component_id"))
    return salted(prints, named, "fp", "doc_id").select("doc_id", "hash", "fp", "root", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that with its smallest doc_id, of several that bear it (or of those without an id,
    where no other has one) that with the least hash of its text, and one of rows alike in both."""
    scratch = Scratch(docs.sparkSession, "near")
    found = cluster(docs.select("doc_id", "text"))
    least = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("hash").alias("h"))
    # rows alike are counted on the way
    rows = found.groupBy("root", "doc_id", "hash").agg(F.count(F.lit(1)).alias("copies")).groupBy("root").agg(F.min(F.struct(least.alias("k"), "copies")).alias("m"))
    kept = scratch.keep(rows.select(F.col("m.k.id").alias("_kept_id"), F.col("m.k.h").alias("_kept_hash"), "m.copies"), few=True)
    _id, _hash = F.col("doc_id").cast("long"), F.xxhash64("text")
    one = kept.filter("copies = 1")
    out = docs.join(one, _id.eqNullSafe(F.col("_kept_id")) & (_hash == F.col("_kept_hash")), "left_semi")
    more = kept.filter("copies > 1")
    if more.isEmpty():
        return out
    packed = docs.select(F.struct(*docs.columns).alias("_doc")).join(more, F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64("_doc.text") == F.col("_kept_hash")))
    single = packed.groupBy("_kept_id", "_kept_hash").agg(F.any_value("_doc").alias("_doc"))
    return out.unionByName(single.select("_doc.*"))
