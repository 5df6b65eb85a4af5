"""Removal of word sequences that repeat anywhere, by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document. Every word that lies in a window whose word sequence starts a second time anywhere,
in the same document or another, is removed; windows are judged on the input.

Suffixes of the texts (from a word on) are put into groups by a prefix, each small enough for memory, and each group's suffixes make a tree of words, cut at the depth of a window, as nothing
below that matters. A node at that depth with two suffixes or more is a repeat, its path are the window's words; runs of such suffixes, merged, are the maximal repeats.

1. Suffixes that begin windows are named by a prefix further on: the anchor of a window is its run of ``GRAM`` words with the least hash, the first of equals. Equal windows have
   equal anchors at equal places, so all suffixes that begin equal windows meet in the group of the prefix that follows the anchor, and only one suffix in about fifteen is a row.
   Anchors that occur once in all texts have no repeat below them; a count over all texts finds these, and none of their suffixes go further. No repeat is lost.
2. A row of a group holds the words from the first to the last window of an anchor's occurrence. Nodes are made level by level: those of depth 1 are the words themselves, a node of
   depth 2h is a pair of nodes of depth h, and the last level takes two that overlap. So suffixes have one node if their words are the same, not just their hashes.
3. A group that wouldn't fit in memory (an anchor that occurs more than ``GROUP`` times) gets longer prefixes, up to the depth of a window at once: lengths between would
   send each suffix as a row of its own with its words, and those under a hot passage all have the same. At that length a group is one node and needs no tree, only the
   count of its suffixes, which is combined before the shuffle, under 128 bits of its words.

Equal texts (by 128-bit digests) are one text throughout, with a copy count, so that copies never meet in one task.

Null, empty and blank texts have no words. Texts shorter than a window keep all their words. Repeated rows count as occurrences of their own.
Null keys and further columns are carried along; see ``repeated_spans`` and ``dedup_texts`` for the columns that are set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices, with_columns
from .common import bloom_filter, bloom_has, few, gram_hashes, mix, small_batches, sorted_groups, stored, texts, tidied, word_hashes

#: Words of an anchor.
GRAM = 8
#: Occurrences of an anchor up to which its group is held in memory.
GROUP = 4_000

_U = np.uint64
_STEP = 0xA0761D6478BD642F
_SECOND = _U(0x5851F42D4C957F2D)
_BACK = pow(_STEP, -1, 1 << 64)
_tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse; the tables grow with the longest text met."""
    global _tables
    if len(_tables[0]) < n:
        _tables = tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(2 * n, x, np.uint64))) for x in (_STEP, _BACK))
    return _tables[0][:n], _tables[1][:n]


def window_keys(hashes: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window, in time linear in the text: differences of running sums, scaled back by the window's place."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, back = _powers(len(hashes))
    run = np.append(np.zeros(1, np.uint64), np.cumsum(hashes * up))
    return (run[window:] - run[:n]) * back[:n]


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes of a text, and for each window the place of its anchor."""
    grams = gram_hashes(hashes, gram)
    n = len(hashes) - window + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    return grams, view.argmin(axis=1) + np.arange(n)


def window_nodes(lines: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree node at the depth of a window that each window of each line of words ends in, and how many windows a line has; a node is a number, the same for the same words."""
    code: dict[bytes, int] = {}
    words = [x.split(b" ") for x in lines]
    count = np.fromiter(map(len, words), np.int64, len(words))
    node = np.fromiter((code.setdefault(w, len(code)) for x in words for w in x), np.int64, int(count.sum()))
    # A path over the end of a line leads to no window, so lines needn't be kept apart.
    depth = 1
    while 2 * depth <= window:
        node = _paired(node, node, depth)
        depth *= 2
    if depth < window:
        node = _paired(node, node, window - depth)
    sizes = np.maximum(count - window + 1, 0)
    begin = np.repeat(np.cumsum(count) - count, sizes)
    return node[begin + np.arange(len(begin)) - np.repeat(np.cumsum(sizes) - sizes, sizes)], sizes


def _paired(first: np.ndarray, second: np.ndarray, apart: int) -> np.ndarray:
    """Numbers of the pairs of a node and the one so many words on."""
    if len(first) <= apart:
        return first[:0]
    return pa.array(first[:-apart] * (int(second.max()) + 1) + second[apart:]).dictionary_encode().indices.to_numpy().astype(np.int64)


def _digest(line: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(line, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _scan(docs: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """A row per document: its other columns, digest, words, hash of its words; and once per text and task its anchors, with how often they
    occur in it. Texts too short for a window are carried along."""
    kept = [f for f in docs.schema.fields if f.name != text]
    new = T.StructType.fromDDL("d1 long, d2 long, n_words long, whole_sha256 string, short string, anchor array<long>, times array<int>").fields
    schema = T.StructType([*kept, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for b in slices(whole):
                rows = []
                for t in texts(b.column(text)):
                    words, d = t.split(), _digest(t)
                    keys, times = [], []
                    if len(words) >= window and d not in seen:
                        seen.add(d)
                        grams, at = anchors(word_hashes(words), window, gram)
                        places = at[np.append(True, at[1:] != at[:-1])]  # places never go back
                        values, counts = np.unique(grams[places], return_counts=True)
                        keys, times = values.view(np.int64).tolist(), counts.tolist()
                    short = t.decode("utf-8", "replace") if len(words) < window else None
                    rows.append((*d, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), short, keys, times))
                cols = [pa.array(c, _arrow(f)) for c, f in zip(zip(*rows, strict=True), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *cols], names=schema.names)

    return small_batches(docs).mapInArrow(tidied(run), schema)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def _bodies(docs: DataFrame, text: str, window: int) -> DataFrame:
    """Digest and compressed text of each text long enough to have a window, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        pack = zstandard.ZstdCompressor(3).compress
        for whole in batches:
            for b in slices(whole):
                rows = []
                for t in texts(b.column(text)):
                    if len(t) >= 2 * window - 1 and len(t.split()) >= window and (d := _digest(t)) not in seen:
                        seen.add(d)
                        rows.append((*d, pack(t)))
                one, two, body = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(body, pa.binary())], names=["d1", "d2", "body"])

    return small_batches(docs).select(text).mapInArrow(tidied(run), "d1 long, d2 long, body binary")


def _once(batch: pa.RecordBatch, names: tuple[str, ...], last: set[tuple[int, int]]) -> Iterator[tuple]:
    """Rows of a partition sorted by digest, each text once: its copies from several tasks stand side by side."""
    for row in zip(*(batch.column(n).to_pylist() for n in ("d1", "d2", *names)), strict=True):
        if last and next(iter(last))[0] != row[0]:
            last.clear()
        if row[:2] not in last:
            last.add(row[:2])
            yield row


def repeated_spans(
    docs: DataFrame, text: str = "text", window: int = 35, gram: int = GRAM, group: int = GROUP, texts_too: bool = False
) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_words``, ``n_removed`` (long), ``spans`` (array of first word and end of each removed run)
    and ``kept_sha256`` (of the kept words joined by single spaces); with ``texts_too`` also ``kept``, that text, or null where no word is removed."""
    gram = min(gram, window)
    docs = docs.drop("n_words", "n_removed", "spans", "kept_sha256", *(["kept"] if texts_too else []))
    others = [c for c in docs.columns if c != text]
    docs = docs.select(F.struct(*others).alias("others"), text)  # names of other columns can't clash below
    scan = stored(_scan(docs, text, window, gram), compression="zstd")

    # Texts that occur more than once: all their windows repeat. A copy in another task counts, hence the sum.
    copies = scan.where(F.col("n_words") >= window).groupBy("d1", "d2").agg(F.count("*").alias("copies"))

    # Anchors of two texts, or twice in one.
    pairs = scan.where(F.size("anchor") > 0).select("d1", F.explode(F.arrays_zip("anchor", "times")).alias("a")).select("d1", F.col("a.anchor").alias("anchor"), F.col("a.times").alias("times"))
    counted = (
        pairs.groupBy("anchor")
        .agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.max("times").alias("most"), F.sum("times").alias("n"))
        .where("lo <> hi or most > 1")
        .select("anchor", (F.col("n") > group).alias("large"))
    )
    wanted = stored(pairs.join(counted, "anchor").select("d1", "anchor", "large"))

    bodies = stored(_bodies(docs, text, window), compression="none")  # read several times

    packed = T.StructType.fromDDL("anchor long, d1 long, d2 long, starts binary, place int, words binary")
    counted_ = T.StructType.fromDDL("k1 long, k2 long, d1 long, d2 long, starts binary, offset int, times long")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Batches of rows: anchor, digests, starts, place of the anchor in the first window, the words of all its windows and their hashes. A text's equal rows are one, with all starts."""
        unpack = zstandard.ZstdDecompressor().decompress
        last: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for one, two, body, found in _once(b, ("body", "wanted"), last):
                words = unpack(body).split()
                hashes = word_hashes(words)
                grams, at = anchors(hashes, window, gram)
                want = np.sort(np.array(found, np.int64).view(np.uint64))
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                ends = np.append(first[1:], len(at))
                value = grams[at[first]]
                pos = np.minimum(np.searchsorted(want, value), len(want) - 1)
                rows: dict[tuple, list[int]] = {}
                for i in np.flatnonzero(want[pos] == value).tolist():
                    s, e = int(first[i]), int(ends[i])
                    rows.setdefault((int(value[i].view(np.int64)), int(at[s]) - s, b" ".join(words[s : e + window - 1])), []).append(s)
                out += [(anchor, one, two, np.array(starts, np.int32).tobytes(), place, line, hashes[starts[0] : starts[0] + line.count(b" ") + 1]) for (anchor, place, line), starts in rows.items()]
            yield out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in occurrences(batches):
            columns = zip(*(r[:6] for r in rows), strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, _arrow(f)) for c, f in zip(columns, packed.fields, strict=True)], names=packed.names)

    def made(some: DataFrame, run, schema: T.StructType) -> DataFrame:
        """Rows of the texts with some of the wanted anchors; a filter of their digests keeps most others out of the shuffle."""
        sets = some.groupBy("d1").agg(F.collect_set("anchor").alias("wanted"))
        may = bloom_has(bloom_filter(some.select("d1").distinct()))
        return bodies.where(may(F.col("d1"))).join(sets, "d1").sortWithinPartitions("d1", "d2").mapInArrow(tidied(run), schema)

    hits_type = "d1 long, d2 long, starts binary, flags binary"

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The trees of groups of one anchor, several at a time: which windows of each row begin a path that another begins."""
        for t, _ in sorted_groups(batches, ["anchor"], 5_000):
            lines = t.column("words").to_pylist()
            node, sizes = window_nodes(lines, window)
            row = np.repeat(np.arange(len(sizes)), sizes)
            again = np.bincount(node)[node] > 1 if len(node) else np.zeros(0, bool)
            again |= (np.fromiter((len(x) > 4 for x in t.column("starts").to_pylist()), bool, len(lines)))[row]
            flags, begin = again.astype(np.uint8).tobytes(), np.cumsum(sizes) - sizes
            some = np.flatnonzero(np.add.reduceat(again, begin) > 0) if len(again) else np.zeros(0, np.int64)
            picked = t.select(["d1", "d2", "starts"]).take(pa.array(some)).combine_chunks()
            bits = pa.array([flags[begin[i] : begin[i] + sizes[i]] for i in some.tolist()], pa.binary())
            yield from pa.table([*picked.columns, bits], names=["d1", "d2", "starts", "flags"]).to_batches()

    small = made(wanted.where("not large"), windows, packed).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidied(repeats), hits_type)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of large groups, one per window."""
        for rows in occurrences(batches):
            for i in range(0, len(rows), 2_000):
                part = rows[i : i + 2_000]
                keys = [(window_keys(r[6], window), window_keys(mix(r[6] ^ _SECOND), window)) for r in part]
                at = np.repeat(np.arange(len(part)), [len(k) for k, _ in keys])
                offset = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(k), dtype=np.int32) for k, _ in keys]])
                both = [np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in zip(*keys, strict=True)]
                take = lambda n, kind: pa.array([r[n] for r in part], kind).take(pa.array(at))  # noqa: E731,B023
                times = np.array([len(r[3]) // 4 for r in part], np.int64)[at]
                columns = [*map(pa.array, both), take(1, pa.int64()), take(2, pa.int64()), take(3, pa.binary()), pa.array(offset), pa.array(times)]
                yield pa.RecordBatch.from_arrays(columns, names=counted_.names)

    long_ = made(wanted.where("large"), single, counted_)
    deep = stored(long_.groupBy("k1", "k2").agg(F.sum("times").alias("n")).where("n > 1").select("k1", "k2"))
    large = long_.join(few(deep), ["k1", "k2"]).select("d1", "d2", "starts", F.concat(F.repeat(F.lit("\0"), F.col("offset")), F.lit("\1")).cast("binary").alias("flags"))

    hits = small.union(large).groupBy("d1").agg(F.collect_list(F.struct("d2", "starts", "flags")).alias("hits"))
    again = copies.where("copies > 1").groupBy("d1").agg(F.collect_list("d2").alias("copied"))
    found = hits.join(again, "d1", "full")

    result = T.StructType.fromDDL("d1 long, d2 long, n_removed long, spans array<array<int>>, kept_sha256 string, kept binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(3).compress
        last: set[tuple[int, int]] = set()
        for b in batches:
            out: list[list] = [[] for _ in result.names]
            for one, two, body, hit, copied in _once(b, ("body", "hits", "copied"), last):
                words = unpack(body).split() if hit or copied else []
                step = np.zeros(len(words) + 1, np.int64)
                if two in (copied or []):
                    step[0], step[-1] = 1, -1
                for h in hit or []:
                    if h["d2"] == two:
                        starts = np.frombuffer(h["starts"], np.int32)[:, None] + np.flatnonzero(np.frombuffer(h["flags"], np.uint8))
                        np.add.at(step, starts.ravel(), 1)
                        np.add.at(step, starts.ravel() + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                if not gone.any():
                    row = (one, two, 0, [], None, body if texts_too else None)
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    line = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                    row = (one, two, int(gone.sum()), edge.reshape(-1, 2).tolist(), hashlib.sha256(line).hexdigest(), pack(line) if texts_too else None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, _arrow(f)) for c, f in zip(out, result.fields, strict=True)], names=result.names)

    removed = bodies.join(found, "d1", "left" if texts_too else "inner").sortWithinPartitions("d1", "d2").mapInArrow(tidied(cut), result)
    joined = scan.join(removed, ["d1", "d2"], "left").select(
        "others",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        *(["short", "kept"] if texts_too else []),
    )
    if not texts_too:
        return joined.select("others.*", *(c for c in joined.columns if c != "others"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for b in slices(whole):
                kept = [s if s is not None else unpack(k).decode("utf-8", "replace") for s, k in zip(b.column("short").to_pylist(), b.column("kept").to_pylist(), strict=True)]
                yield with_columns(b.select([n for n in b.schema.names if n != "short"]), {"kept": pa.array(kept, pa.string())})

    text_type = T.StructField("kept", T.StringType())
    full = T.StructType([f for f in joined.schema.fields if f.name not in ("short", "kept")] + [text_type])
    out = joined.mapInArrow(tidied(unpacked), full)
    return out.select("others.*", *(c for c in out.columns if c != "others"))


def dedup_texts(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """``docs`` with repeated passages cut from the text: words that stay are joined by single spaces. A text that loses no word stays as it is, a null one null."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != text}
    known = f"_{len(docs.columns)}"
    out = repeated_spans(docs.withColumnsRenamed(names).withColumn(known, F.col(text).isNotNull()), text, window, texts_too=True)
    return out.select(*names.values(), F.when(F.col(known), F.col("kept")).alias(text)).withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)
