"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Every document's word shingles become one signature from two permutations: the
first scatters the shingle, the second, circularly shifted by k places, gives
coordinate k. Documents with equal shingle sets are one node from here on, so a
group of thousands of copies costs one signature. Bands of the signature are
bucketed. Links are found in two steps, so that no bucket lists its pairs:

1. every member of a bucket is compared with the bucket's smallest node;
2. only in buckets that still hold several components, members of different
   components are compared by bit maps of their sets, in blocks of bounded
   size, and pairs that can reach the threshold are confirmed.

Every link is confirmed on the two full sets.

Defined results: null or word-free texts have an empty set, link with nothing
and are kept. A null id takes part; it is never the smallest id of a group that
has another, and a group of null ids only has a null component and is kept.
Repeated rows get one output row each. Other input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlift.llm.common import components, map_rows, mix, shingle_set, small_batches, word_hashes, written

COORDINATES = 128
ROWS = 4                # coordinates of a band: 32 bands; a pair at 0.8 shares none with probability 5e-8
UNIVERSE = 1 << 20      # places of the two permutations
SKETCH_SIGMAS = 5       # a pair goes to the exact check unless its sketch is this far below the threshold
BLOCK = 512             # members compared at a time


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    scatter, order = rng.permutation(UNIVERSE).astype(np.int32), rng.permutation(UNIVERSE).astype(np.int32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate((order, order[:COORDINATES])), COORDINATES)


def _signature(shingles: np.ndarray, scatter: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """Coordinate k is the smallest value of the second permutation, shifted by k, over the scattered shingles."""
    out = np.full(COORDINATES, UNIVERSE, dtype=np.int32)
    places = scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    for i in range(0, len(places), 2048):
        np.minimum(out, shifted[places[i:i + 2048]].min(axis=0), out=out)
    return out


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def _signer(size: int):
    def make():
        scatter, shifted = _tables()
        band = np.arange(COORDINATES // ROWS, dtype=np.uint64)

        def work(rows: dict) -> dict:
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n": [], "node": [], "bands": [], "sketch": []}
            if "digest" in rows:
                out["digest"] = rows["digest"]
            for text in rows["text"]:
                shingles = shingle_set(word_hashes((text or "").encode().lower()), size)
                out["n"].append(len(shingles))
                if not len(shingles):
                    for k in ("node", "bands", "sketch"):
                        out[k].append(None)
                    continue
                sig = _signature(shingles, scatter, shifted).astype(np.uint64).reshape(-1, ROWS)
                key = band + np.uint64(1)
                for i in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, i])
                out["node"].append(_node(shingles))
                out["bands"].append(key.view(np.int64).tolist())
                out["sketch"].append((sig.ravel() & np.uint64(255)).astype(np.uint8).tobytes())
            return out
        return work
    return make


def _setter(size: int):
    def make():
        def work(rows: dict) -> dict:
            sets = [shingle_set(word_hashes((t or "").encode().lower()), size) for t in rows["text"]]
            return {"node": [_node(s) for s in sets], "shingles": [s.tobytes() for s in sets],
                    "n": [len(s) for s in sets], "bits": [_bits(s) for s in sets]}
        return work
    return make


def _least_matches(percent: int) -> int:
    p = percent / 100
    p += (1 - p) / 256
    return max(1, int(COORDINATES * p - SKETCH_SIGMAS * (COORDINATES * p * (1 - p)) ** 0.5))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    def make():
        def work(rows: dict) -> dict:
            a, b = [], []
            for x, y, s, t in zip(rows["a"], rows["b"], rows["s"], rows["t"], strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    a.append(x)
                    b.append(y)
            return {"a": a, "b": b}
        return work

    full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b"))
    return map_rows(full.select("a", "b", "s", "t"), "a binary, b binary", make)


def _bits(shingles: np.ndarray) -> bytes:
    """The set as a bit map of 8 to 16 bits a shingle."""
    size = 1 << max(6, (8 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _near(percent: int):
    """Members of different components in one block pair whose sets can reach the threshold.

    Every common shingle sets the same bit in both maps, so the common bits plus
    the shingles that share a bit bound the size of the intersection from above.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def work(table: pa.Table) -> pa.Table:
        node, root, side, n, raw = (table.column(c).to_pylist() for c in ("node", "root", "side", "n", "bits"))
        code = {r: i for i, r in enumerate(dict.fromkeys(root))}
        comp, side, n = np.array([code[r] for r in root]), np.array(side), np.array(n)
        size = np.array([len(x) // 8 for x in raw])
        maps = {k: np.frombuffer(b"".join(raw[i] for i in np.flatnonzero(size == k)), np.uint64).reshape(-1, k)
                for k in set(size.tolist())}
        a, b = [], []
        for k, own in maps.items():
            rows = np.flatnonzero(size == k)
            other, maps_to = rows, own
            if 2 * k in maps:
                wide = maps[2 * k]
                other = np.concatenate((rows, np.flatnonzero(size == 2 * k)))
                maps_to = np.concatenate((own, wide[:, :k] | wide[:, k:]))
            spare = n[other] - np.bitwise_count(maps_to).sum(axis=1)
            step = max(1, (1 << 18) // k)
            for at, i in enumerate(rows):
                fits = (comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))
                fits &= (side[other] != side[i]) | (side[i] == 2)
                fits[:at + 1] = False
                fits = np.flatnonzero(fits)
                for lo in range(0, len(fits), step):
                    part = fits[lo:lo + step]
                    most = np.bitwise_count(maps_to[part] & own[at]).sum(axis=1) + np.minimum(spare[part], spare[at])
                    for j in other[part[100 * most >= percent * (n[other[part]] + n[i] - most)]]:
                        a.append(min(node[i], node[j]))
                        b.append(max(node[i], node[j]))
        return pa.table([a, b], schema=schema)
    return work


def minhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                   percent: int = 80, by_text: bool = False) -> DataFrame:
    """Group documents whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` / 100.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id
    reachable by links, itself included), kept (doc_id = component_id). ``by_text``
    adds digest (md5 of the text) and root, which tells components apart where ids
    are null or shared; it is null without shingles.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = docs.withColumn("digest", text_digest(F.col("text"))) if by_text else docs
    signed = written(map_rows(signed, "doc_id long, n long, node binary, bands array<long>, sketch binary" + ", digest binary" * by_text,
                              _signer(words)), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")

    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1")
    buckets = written(members.join(shared, "key"), "buckets")
    stars = buckets.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    sketches = nodes.select("node", "sketch")
    stars = (stars.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("s")), "a")
             .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("t")), "b"))
    matches = _least_matches(percent)

    def alike():
        def work(rows: dict) -> dict:
            if not rows["a"]:
                return {"a": [], "b": []}
            s, t = (np.frombuffer(b"".join(rows[c]), np.uint8).reshape(-1, COORDINATES) for c in "st")
            near = np.flatnonzero((s == t).sum(axis=1) >= matches)
            return {c: [rows[c][i] for i in near] for c in "ab"}
        return work

    stars = written(map_rows(stars.select("a", "b", "s", "t"), "a binary, b binary", alike), "stars")

    # full sets of the documents that any bucket shares, one text a node
    wanted = buckets.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    ids = wanted.select(F.col("first_id").alias("doc_id")).distinct()
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi")
    sets = map_rows(texts, "node binary, shingles binary, n int, bits binary", _setter(words))
    sets = written(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")

    links = written(_confirmed(stars, sets, percent), "links")
    roots = components(links, "components")

    # buckets that still hold several components
    placed = buckets.join(roots, "node", "left").select("key", "m", "node", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    at = F.pmod(F.hash("node"), parts)
    cells = placed.join(open_, "key").join(sets.select("node", "n", "bits"), "node").select(
        "key", "node", "root", "n", "bits", at.alias("at"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"))
    cells = cells.select("key", "node", "root", "n", "bits", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"),
                         F.when(F.col("at") == F.col("with"), 2).when(F.col("at") < F.col("with"), 0).otherwise(1).alias("side"))
    late = cells.groupBy("key", "i", "j").applyInArrow(_near(percent), "a binary, b binary").distinct()
    links = links.union(_confirmed(written(late, "late"), sets, percent))
    roots = components(links, "components")

    whole = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    lowest = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = whole.join(lowest, "root").select("node", "component_id", "root")
    out = signed.join(named, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), *(["digest", "root"] if by_text else []))
