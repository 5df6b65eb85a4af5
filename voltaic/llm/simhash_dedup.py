"""SimHash near-duplicate groups by a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of the hashes of its word shingles (repeats included) have it. Distinct
fingerprints within ``radius`` differing bits are linked, and documents are grouped by the components of these links.

The index is cut over the cluster first: the bits fall into ``radius + 2`` blocks, and two fingerprints within the radius agree in two of
them at least, so the values of each pair of blocks are a partition in which all links of its members can be found (15 partitions of 21 bits each for a radius of 4).
In a partition, fingerprints are sorted by Gray rank; each upper node stands for a run of them and keeps the bits that they share. A pair of nodes whose shared
bits differ in more than ``radius`` places is dropped with all that lies below; otherwise its children are paired. Only links that join two groups are returned, less than
one for each fingerprint and partition, whatever the number of pairs. A partition with more than ``CHUNK`` fingerprints is dealt into chunks, and
each pair of chunks is searched by a task of its own.

Null and blank texts have no shingles and the fingerprint zero, and are linked like any others. Repeated rows each get a row. Only the
key and the text are read; the result has the key, ``fingerprint`` (long) and the component. Null keys count as larger than all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import checkpoint, small_batches, sorted_groups, texts, tidied
from .components import connected_components

#: Fingerprints of a partition that one task searches at once.
CHUNK = 8_192
#: Children of an upper node of the index.
FAN = 8
#: Node pairs looked at together.
PAIRS = 1 << 18

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``k`` lower-cased words (A-Z only), joined by single spaces; of all words if they are fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[: len(ends) - k])]
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, as an unsigned integer."""
    n = len(hashes)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = hashes[i : i + 4096]
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """Key and ``fingerprint`` (the 64 bits as a signed long) of each document."""
    schema = T.StructType([df.schema[key], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                values = np.array([simhash(shingle_hashes(t, k)) for t in texts(b.column(text))], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(values.view(np.int64))], names=schema.names)

    return small_batches(df).select(key, text).mapInArrow(tidied(run), schema)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Places of the values in the order of the binary-reflected Gray code."""
    r = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _levels(group: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From leaves to roots: shared pattern, shared mask and the first child of each node (with the end); a node lies within one group."""
    levels = [(values, np.full(len(values), ~np.uint64(0)), np.arange(len(values) + 1))]
    both, either = values, values
    while True:
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        if len(edge) == len(group):
            return levels
        within = np.arange(len(group)) - np.repeat(edge, np.diff(np.append(edge, len(group))))
        first = np.flatnonzero(within % FAN == 0)
        both, either, group = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first), group[first]
        levels.append((both, ~(both ^ either), np.append(first, len(within))))


def local_links(
    group: np.ndarray,
    values: np.ndarray,
    radius: int,
    side: np.ndarray | None = None,
    check: np.ndarray | None = None,
    check_radius: int = 64,
    joined: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> np.ndarray:
    """For values sorted by (group, Gray rank): the index of the first of each one's component among the links of its own group.

    ``side``: only pairs of different sides are looked for, where a group has both. ``check``: further fingerprints, which must be near as well.
    ``joined`` gets the near pairs that join two groups, which are a forest: of those that a value could be joined by, the nearest in order.
    """
    label = np.arange(len(values))
    levels = _levels(group, values)
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    todo = [(top, roots, roots)]

    while todo:
        level, a, b = todo.pop()
        most = PAIRS if level == 0 else max(1, PAIRS // (FAN * FAN))
        if len(a) > most:  # depth first: the rest waits, so that few pairs are held at a time
            todo.append((level, a[most:], b[most:]))
            a, b = a[:most], b[:most]
        if level == 0:
            keep = a < b
            if side is not None:
                keep &= side[a] != side[b]
            if check is not None:
                keep &= np.bitwise_count(check[a] ^ check[b]) <= check_radius
            a, b = a[keep], b[keep]
            while len(a):
                x, y = label[a], label[b]
                apart = x != y
                a, b = a[apart], b[apart]
                high, low = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
                if not len(a):
                    break
                order = np.lexsort((-low, high))
                new = order[np.append(True, high[order][1:] != high[order][:-1])]
                label[high[new]] = low[new]
                if joined is not None:
                    joined.append((a[new], b[new]))
                while ((up := label[label]) != label).any():
                    label = up
            continue
        # Children of each pair of nodes, the pairs of a node with itself once.
        first = levels[level][2]
        pattern, mask, _ = levels[level - 1]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        n = na * nb
        which = np.repeat(np.arange(len(a)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = first[a[which]] + place // nb[which], first[b[which]] + place % nb[which]
        keep = (np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= radius) & (x <= y)
        if keep.any():
            todo.append((level - 1, x[keep], y[keep]))
    return label


def least_of(root: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The least node of each one's component."""
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    return least[root]


def keyed_links(rows: DataFrame, radius: int, check_radius: int | None = None) -> DataFrame:
    """Links ``u``, ``v`` between nodes that share a key, whose components are those of all pairs within ``radius`` differing bits.

    ``rows``: ``k`` (long), ``node`` (long), ``f`` (long); with ``check_radius`` also ``check`` (long), which must lie within that radius as well, and the links are near
    pairs themselves. Without it, they lead to the least node of a component, so that most partitions of a large one give the same.
    """
    also = ["check"] if check_radius is not None else []
    hot = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("k", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = (
        rows.join(hot, "k", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .select("k", "node", "f", *also, "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("k", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "node", "f", *also, (F.col("c") > F.col("other")).alias("s"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, offsets in sorted_groups(batches, ["k", "i", "j"], 50_000):
            sizes = np.diff(offsets)
            group = np.repeat(np.arange(len(sizes)), sizes)
            many = np.repeat(sizes > 1, sizes)
            cross = t.column("i").to_numpy() != t.column("j").to_numpy()
            for mixed in (False, True):
                at = np.flatnonzero(many & (cross == mixed))
                if not len(at):
                    continue
                value = t.column("f").to_numpy()[at].view(np.uint64)
                at = at[np.lexsort((gray_rank(value), group[at]))]
                value, node = t.column("f").to_numpy()[at].view(np.uint64), t.column("node").to_numpy()[at]
                side = t.column("s").to_numpy(zero_copy_only=False)[at] if mixed else None
                check = t.column("check").to_numpy()[at].view(np.uint64) if also else None
                joined: list[tuple[np.ndarray, np.ndarray]] | None = [] if also else None
                root = local_links(group[at], value, radius, side, check, check_radius or 64, joined)
                if joined is None:
                    least = least_of(root, node)
                    far = node != least
                    u, v = node[far], least[far]
                else:
                    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*joined, strict=True) if joined else ((), ())))
                    u, v = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(tidied(run), "u long, v long")


def hamming_links(nodes: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """Links ``u``, ``v`` between nodes (``node``, long) whose components are those of all pairs of fingerprints (``f``, long) within ``radius`` differing bits."""
    cuts = [bits * i // (radius + 2) for i in range(radius + 3)]
    value = [F.shiftrightunsigned("f", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    wide = max(hi - lo for lo, hi in zip(cuts, cuts[1:], strict=False))
    pairs = [F.lit(n).cast("long") * (1 << 2 * wide) + value[a] * (1 << wide) + value[b] for n, (a, b) in enumerate(combinations(range(radius + 2), 2))]
    return keyed_links(nodes.select(F.explode(F.array(*pairs)).alias("k"), "node", "f"), radius)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """Key, ``fingerprint`` (long) and ``component_id`` (the least key of its component) of each document."""
    prints = checkpoint(fingerprints(df, key, text, k))
    distinct = checkpoint(prints.groupBy("fingerprint").agg(F.min(key).alias("least")))
    roots = connected_components(hamming_links(distinct.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("f")), radius))
    grouped = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(grouped.join(least, "root").select("fingerprint", "component_id"), "fingerprint").select(key, "fingerprint", "component_id")
