"""One document of each group of near-duplicates, for shingle similarities beyond the reach of a single fingerprint.

Two documents are linked if the sets of their five-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or more; groups are the
components of these links, and the document with the least key stays. At 0.8 about 15 of 100 SimHash bits differ, so blocks of equal bits can't both
find such pairs and select: a block of b bits agrees with a probability of 0.85**b. So it isn't blocks of bits that cut the index over the cluster here, but ``BANDS`` pairs
of least shingle hashes: similar texts agree in one pair at least with a probability of 0.998 at 0.8, and texts without common shingles never meet,
so that the rows of the index grow with the texts. Within a cut, 64-bit fingerprints are searched by the Gray-order hierarchical index of ``simhash_dedup`` within
``RADIUS`` bits, three deviations above what a similarity of 0.8 leads one to expect, and a second fingerprint must be as near.

The index gives near pairs, less than one for each text and cut, that make a forest of each dense group. Each is compared by its shingle sets
before groups are formed. Where a pair falls short, its two sides may still be linked through other members: such groups are compared once more, all members against
those outside of the largest part, in chunks of ``CHUNK``. So no link between candidates is lost.

Equal texts (after lower-casing A-Z, words joined by single spaces; known by 128-bit digests) are one text throughout. Null, empty and blank texts are nobody's
duplicates and stay, repeated or not. Texts of fewer than five words have one shingle. Of rows that are repeated with key and text one stays. Null keys count as larger than
all others. All columns are kept as they are, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import bloom_filter, bloom_test, few, mix, small_batches, sorted_groups, stored, texts, tidied
from .components import connected_components
from .simhash_dedup import _LOWER, keyed_links, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Cuts of the index, and least hashes that make one.
BANDS, LEAST = 6, 2
#: Differing bits of 64: three deviations above what the least similarity leads one to expect.
RADIUS = 19
#: Texts of a group that one task holds.
CHUNK = 1_000

_U = np.uint64
_SALTS = mix(np.arange(1, BANDS * LEAST + 3, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _digest(text: bytes) -> tuple[int, int]:
    """A digest of the lower-cased words; zeros for none."""
    line = b" ".join(text.translate(_LOWER).split())
    if not line:
        return 0, 0
    d = hashlib.blake2b(line, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prints(hashes: np.ndarray) -> list[int]:
    """Of a text's distinct shingles: the hash of each band's least values, then two fingerprints of 64 bits (all as signed)."""
    count = np.zeros((2, 64), np.int64)
    least = np.full(BANDS * LEAST, np.iinfo(np.uint64).max, _U)
    for i in range(0, len(hashes), 1024):
        part = mix(hashes[i : i + 1024, None] ^ _SALTS)
        np.minimum(least, part[:, 2:].min(axis=0), out=least)
        bits = np.unpackbits(np.ascontiguousarray(part[:, :2]).view(np.uint8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64).reshape(2, 64)
    bands = np.arange(1, BANDS + 1, dtype=_U)
    for j in range(LEAST):
        bands = mix(bands * _U(0xD6E8FEB86659FD93) + least[j::LEAST])
    marks = np.packbits(count * 2 > len(hashes), axis=1, bitorder="little").view(np.int64).ravel()
    return [*bands.view(np.int64).tolist(), *marks.tolist()]


def _scan(docs: DataFrame) -> DataFrame:
    """Key, hashes of the raw text and the digest of each document; the prints of each text once in a task."""
    kind = docs.schema["key"].dataType.simpleString()
    names = ["key", "h1", "h2", "d1", "d2", "prints"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {(0, 0)}
        for whole in batches:
            for b in slices(whole):
                ids, found = [], []
                for t in texts(b.column("text")):
                    ids.append(_digest(t))
                    found.append(None)
                    if ids[-1] not in seen:
                        seen.add(ids[-1])
                        found[-1] = prints(np.unique(shingle_hashes(t, SHINGLE)))
                one, two = zip(*ids, strict=True)
                columns = [b.column("key"), b.column("h1"), b.column("h2"), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(docs).mapInArrow(tidied(run), f"key {kind}, h1 long, h2 long, d1 long, d2 long, prints array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and the sorted ``shingles`` of the wanted texts (``node``, ``d1``, ``d2``). Texts that a filter of their digests rules out aren't sent."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom_filter(wanted.select("d1").distinct()))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pack = {(0, 0)}, zstandard.ZstdCompressor(3).compress
        for whole in batches:
            for b in slices(whole):
                found = [(_digest(t), t) for t in texts(b.column("text"))]
                maybe = bloom_test(filter_.value, np.array([d[0] for d, _ in found], np.int64))
                rows = []
                for (d, t), yes in zip(found, maybe.tolist(), strict=True):
                    if yes and d not in seen:
                        seen.add(d)
                        rows.append((*d, pack(t)))
                columns = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["d1", "d2", "body"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor().decompress, None
        for whole in batches:
            for b in slices(whole):
                once = []
                for i, n in enumerate(b.column("node").to_pylist()):
                    if n != last:  # copies from several tasks stand side by side
                        once.append(i)
                    last = n
                kept = b.take(pa.array(once, pa.int64()))
                blobs = [np.unique(shingle_hashes(unpack(x), SHINGLE)).tobytes() for x in kept.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([kept.column("node"), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    sent = small_batches(docs).select("text").mapInArrow(tidied(bodies), "d1 long, d2 long, body binary")
    return sent.join(wanted, ["d1", "d2"]).select("node", "body").repartition("node").sortWithinPartitions("node").mapInArrow(tidied(sets), "node long, shingles binary")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= SIMILARITY * (len(a) + len(b) - shared) - 1e-9


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u``, ``v`` and whether their shingle sets are ``similar``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(n).to_pylist() for n in ("a", "b"))
            same = [_similar(np.frombuffer(x, _U), np.frombuffer(y, _U)) for x, y in zip(a, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(same, pa.bool_())], names=["u", "v", "similar"])

    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return small_batches(pairs.join(one, "u").join(two, "v")).mapInArrow(tidied(run), "u long, v long, similar boolean")


def _across(sets: list[np.ndarray], part: np.ndarray, probe: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places that link two parts, each probe against all others; parts linked before aren't compared again."""
    names, root = np.unique(part, return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = []
    for i in np.flatnonzero(probe).tolist():
        todo = np.flatnonzero((root != root[i]) & (np.minimum(sizes, sizes[i]) >= SIMILARITY * np.maximum(sizes, sizes[i])))
        while len(todo := todo[root[todo] != root[i]]):
            j, todo = int(todo[0]), todo[1:]
            if _similar(sets[i], sets[j]):
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def _second(failed: DataFrame, parts: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` between parts whose compared pair fell short: all members of a group against those outside of its largest part.

    ``failed``: ``u``, ``v``; ``parts``: ``node``, ``root`` of texts in a part of two or more.
    """
    part_of = lambda c: F.coalesce(F.col(f"r{c}"), F.col(c)).alias(c)
    left, right = (parts.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
    between = failed.join(left, "u", "left").join(right, "v", "left").select(part_of("u"), part_of("v")).where("u <> v")
    comp = stored(connected_components(between)).select(F.col("node").alias("part"), F.col("root").alias("comp"))
    every = nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part")).join(comp, "part")
    size = every.groupBy("comp", "part").agg(F.count("*").alias("n"))
    total = size.groupBy("comp").agg(F.sum("n").alias("all"), F.max(F.struct("n", "part")).alias("most"))
    # A group of two is its one pair.
    total = total.where("all > 2").select("comp", F.col("most.part").alias("largest"), F.ceil(F.col("all") / CHUNK).cast("int").alias("js"), F.ceil((F.col("all") - F.col("most.n")) / CHUNK).cast("int").alias("is"))
    member = every.join(total, "comp").select("*", (F.col("part") != F.col("largest")).alias("minor"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    as_member = member.select("comp", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), place("js").alias("j"), "node", "part", F.lit(False).alias("probe"))
    as_probe = member.where("minor").select("comp", place("is").alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), "node", "part", F.lit(True).alias("probe"))
    whole = as_member.union(as_probe).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, offsets in sorted_groups(batches, ["comp", "i", "j"], 500):
            node, part, probe = (t.column(n).to_numpy(zero_copy_only=False) for n in ("node", "part", "probe"))
            blobs = t.column("shingles").to_pylist()
            u, v = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for i, j in _across([np.frombuffer(x, _U) for x in blobs[a:b]], part[a:b], probe[a:b]):
                    u.append(int(part[a + i]))
                    v.append(int(part[a + j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return small_batches(whole).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(tidied(run), "u long, v long")


def _groups(docs: DataFrame) -> DataFrame:
    """``key``, ``h1``, ``h2`` (of the raw text), ``d1``, ``d2``, ``node`` and ``group`` of each document with words: ``node`` is null for texts without candidates."""
    scan = stored(_scan(docs))
    once = scan.where("prints is not null").groupBy("d1", "d2").agg(F.min("prints").alias("prints"))
    nodes = stored(once.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "prints"))
    bands = F.posexplode(F.slice("prints", 1, BANDS)).alias("band", "k")
    rows = nodes.select(bands, "node", F.get("prints", F.lit(BANDS)).alias("f"), F.get("prints", F.lit(BANDS + 1)).alias("check"))
    pairs = stored(keyed_links(rows.drop("band"), RADIUS, RADIUS).distinct())
    met = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = stored(nodes.select("node", "d1", "d2").join(met, "node", "left_semi"))
    sets = stored(_sets(docs, wanted), compression="zstd")
    checked = stored(_checked(pairs, sets))
    parts = stored(connected_components(checked.where("similar")))
    failed = checked.where("not similar").select("u", "v")
    more = stored(_second(failed, parts, wanted, sets))
    again = stored(connected_components(more)).select(F.col("node").alias("root"), F.col("root").alias("group"))
    known = wanted.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")).join(again, "root", "left")
    known = known.select("d1", "d2", "node", F.coalesce("group", "root").alias("group"))
    return scan.where("d1 <> 0 or d2 <> 0").drop("prints").join(known, ["d1", "d2"], "left")


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``group`` of each document with words: a string, the same for near-duplicates."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    return _groups(own).select(F.col("key").alias(key), F.coalesce(F.col("group").cast("string"), F.concat_ws("/", "d1", "d2")).alias("group"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates of a document that stays."""
    raw = [F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]
    groups = stored(_groups(docs.select(F.col(text).alias("text"), *raw)))
    # Rows of a text are put together before any shuffle, and only texts of more than one row, or with candidates, go further.
    row = F.struct(F.col("key").isNull().alias("none"), "key", "h1", "h2")
    of_text = groups.groupBy("d1", "d2", "group").agg(F.min(row).alias("first"), F.count("*").alias("rows"))
    name = F.when(F.col("group").isNull(), F.struct("d1", "d2")).otherwise(F.struct(F.col("group").alias("d1"), F.lit(None).cast("long").alias("d2")))
    first = of_text.groupBy(name.alias("g")).agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).where("rows > 1")
    member = groups.withColumn("g", name).join(first, "g")
    stays = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
    counted = stored(member.groupBy("key", "h1", "h2", stays.alias("stays")).agg(F.count("*").alias("n")).where("not stays or n > 1"))
    named = lambda t: few(t.select(F.col("key").alias("k"), F.col("h1").alias("x1"), F.col("h2").alias("x2")))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))
    rows = docs.select(F.struct("*").alias("row"), *raw)
    left = rows.join(named(counted.where("not stays")), same, "left_anti")
    twice = stored(counted.where("stays"))
    if twice.isEmpty():
        return left.select("row.*")
    # Rows that are repeated with key and text: one of each stays. Only their texts go through a shuffle.
    one = left.join(named(twice), same, "left_semi").dropDuplicates(["key", "h1", "h2"])
    return left.join(named(twice), same, "left_anti").union(one).select("row.*")
