"""An interpolated modified Kneser-Ney model of word trigrams, and the perplexity of texts under it. Neither the model nor the words are ever gathered.

Every word has a 64-bit hash of its own, whatever its script; a text is its words between two starts and an end. ``tokenized`` reads each text once and
stores its words by their places in the dictionary of a block of texts. All trigrams with one middle word go to one shard, which then has all counts of
their contexts (the first two words), of their last two words and of the middle word; so it needs from elsewhere only the discounts and the unigrams.
Shards are dealt into slices, which run one after another, so that only a slice's trigrams are on disk at a time. A first round counts those of trusted texts;
a second sends those of all texts, whose shards return a sum for each text. Middle words with more trigrams than a shard should have are
dealt out by the first word too; their counts of last two words, which then lie in several shards, are summed in the first round and sent to each in the second.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import delete, mix, new_folder, small_batches, tidied, word_hashes

#: Words whose counts are broadcast, the commonest by what they follow; trigrams that end in others are joined with the table of words.
HOT = 100_000
#: Words, and texts, of a block.
BLOCK, TEXTS = 2_000_000, 1 << 16
#: Trigrams of a shard and, at least, of a slice; and slices at most.
SHARD, SLICE, SLICES = 750_000, 4_000_000, 12
#: A middle word is dealt out further only if it makes up more than one in so many of the words.
COMMON = 1_000
#: Scripts without spaces between words (Thai to Myanmar, Khmer, Han with its radicals, kana): each character is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+|[^\w\s{UNSPACED}]+")
_ENDS = word_hashes([b" start", b" end"])  # no word has a space
_U = np.uint64
_ODD = _U(0xD6E8FEB86659FD93)

Batches = Iterator[pa.RecordBatch]


def words(text: str) -> list[bytes]:
    return [w.encode("utf-8", "replace") for w in _WORD.findall(text.lower())]


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 a space, 1 in words, 2 in runs of other signs, 3 a word of its own."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), 2, np.uint8)
    for kind, pattern in ((1, r"\w+"), (0, r"\s+"), (3, f"[{UNSPACED}]+")):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the ``words`` of all texts, and how many each text has; without a string for each word."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    new = np.append(True, kinds[1:] != kinds[:-1]) | (kinds == 3)
    at = np.flatnonzero(kinds > 0)
    begins = np.flatnonzero(new[at])  # in ``at``; each word's first place is where its kind begins
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = at[begins]
    sizes = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, sizes)
    powers = np.cumprod(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
    hashes = mix(np.add.reduceat((points[at] + np.uint32(1)) * powers[place], begins))
    ends = np.cumsum([len(t) + 1 for t in lower])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    """The table as stored in the shared folder, and its path. What it shuffled is deleted at once, not when the driver's garbage is collected."""
    spark = df.sparkSession
    path = new_folder(spark)
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path), path


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, each the bytes of a run of ``values`` between two of ``ends``."""
    offsets = (np.asarray(ends, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: list[bytes], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many come from each row."""
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(column), dtype), np.fromiter((len(b) // size for b in column), np.int64, len(column))


def _rows(batches: Batches, *names: str) -> list[list]:
    """The columns of all batches as lists."""
    out: list[list] = [[] for _ in names]
    for b in batches:
        for o, name in zip(out, names, strict=True):
            o += b.column(name).to_pylist()
    return out


def _width(words: int) -> int:
    """Bytes of a place in a dictionary."""
    return max(1, (max(words - 1, 1).bit_length() + 7) // 8)


def _encoded(words: np.ndarray, sizes: np.ndarray, flags: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A block in bytes, and its common words and how often each occurs."""
    hashes, _, ids = _distinct(words)
    often = np.bincount(ids, minlength=len(hashes))
    # The commonest words first, and places byte by byte, the lowest first: so they compress.
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    places = rank[ids].view(np.uint8).reshape(-1, 4).T[: _width(len(order))]
    hashes, often = hashes[order], often[order]
    common = np.flatnonzero(often * COMMON > len(ids))
    data = pa.Codec("zstd").compress(hashes.tobytes() + places.tobytes() + sizes.astype(np.uint32).tobytes() + flags.astype(np.uint8).tobytes())
    return np.array([len(hashes), len(ids), len(sizes)]).tobytes() + data.to_pybytes(), hashes[common], often[common]


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, their places text by text, and the sizes and flags of its texts."""
    n, places, texts = np.frombuffer(data, np.int64, 3).tolist()
    width = _width(n)
    raw = pa.Codec("zstd").decompress(memoryview(data)[24:], 8 * n + width * places + 5 * texts)
    ids = np.zeros((places, 4), np.uint8)
    for i in range(width):
        ids[:, i] = np.frombuffer(raw, np.uint8, places, 8 * n + i * places)
    end = 8 * n + width * places
    return np.frombuffer(raw, _U, n), ids.view(np.uint32)[:, 0], np.frombuffer(raw, np.uint32, texts, end).astype(np.int64), np.frombuffer(raw, np.uint8, texts, end + 4 * texts)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, a place of each, and which of them each value is; by a plain sort, as ``numpy.unique`` takes a slower one for this."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.append(np.ones(min(len(x), 1), bool), ranked[1:] != ranked[:-1])
    where = np.empty(len(x), np.int64)
    where[order] = np.cumsum(new) - 1
    return ranked[new], order[new], where


def tokenized(df: DataFrame, key: str, text: str, lang: str, trusted: str, held: str) -> DataFrame:
    """A row for each text, with ``_row``, key, ``lang``, ``n_scored`` (words and the end; null and empty texts have 0) and ``flag`` (1: trusted, 2: trusted and held out); and one for
    each block of trusted texts or of others, with ``block`` and ``flag`` (1: of trusted ones)."""
    kind = df.schema[key].dataType.simpleString()
    names = ["_row", key, "lang", "n_scored", "flag", "block", "data", "common", "often"]

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 24
        # Of others and of trusted texts: the number of the block, its words, sizes and flags, and how many texts and words it has.
        open_ = [[number, [], [], [], 0, 0], [number + 1, [], [], [], 0, 0]]
        number += 2

        def written(block: list) -> pa.RecordBatch:
            data, common, often = _encoded(*map(np.concatenate, block[1:4]))
            own = [pa.array([x]) for x in (data, common.tobytes(), often.tobytes())]
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, key_type), pa.nulls(1, lang_type), pa.nulls(1, pa.int64()), pa.array([int(block[3][0][0] > 0)], pa.int32()), pa.array([block[0]]), *own], names=names)

        for whole in batches:
            key_type, lang_type = whole.column(key).type, whole.column(lang).type
            for b in slices(whole, 64):
                flags = np.array([int(t) + int(t and h) for t, h in zip(b.column(trusted).to_pylist(), b.column(held).to_pylist(), strict=True)], np.int64)
                texts = b.column(text).to_pylist()
                hashes, many = _hashed(texts)
                some = np.array([bool(t) for t in texts])
                # Each text with characters between two starts and an end.
                sizes = np.where(some, many + 3, 0)
                ends = np.cumsum(sizes)
                words = np.full(ends[-1], _ENDS[0])
                words[(ends - 1)[some]] = _ENDS[1]
                words[np.arange(len(hashes)) + np.repeat(ends - sizes - (np.cumsum(many) - many) + 2, many)] = hashes
                rows = np.zeros(b.num_rows, np.int64)
                for i, own in ((0, flags == 0), (1, flags > 0)):
                    if not own.any():
                        continue
                    block = open_[i]
                    rows[own] = block[0] * TEXTS + block[4] + np.arange(own.sum())
                    for values, x in zip(block[1:4], (words[np.repeat(own, sizes)], sizes[own], flags[own]), strict=True):
                        values.append(x)
                    block[4] += int(own.sum())
                    block[5] += int(sizes[own].sum())
                    if block[4] > TEXTS - 64 or block[5] > BLOCK:
                        yield written(block)
                        open_[i] = [number, [], [], [], 0, 0]
                        number += 1
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(key), b.column(lang), pa.array(np.where(some, many + 1, 0)), pa.array(flags.astype(np.int32)), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 3], names=names)
        for block in open_:
            if block[4]:
                yield written(block)

    picked = small_batches(df).select(key, text, F.col(lang).cast("string").alias(lang), trusted, held)
    return picked.mapInArrow(tidied(run), f"_row long, `{key}` {kind}, lang string, n_scored long, flag int, block long, data binary, common binary, often binary")


class Deal:
    """Which slice and shard a trigram goes to, by its middle word; common ones are dealt evenly, and may go to several shards, by the first word."""

    def __init__(self, positions: int, common: list[tuple[int, int]]) -> None:
        self.slices = max(1, min(SLICES, -(-positions // SLICE)))
        self.shards = max(1, -(-positions // (self.slices * SHARD)))
        each = positions / (self.slices * self.shards)
        load, of = [0.0] * self.slices, {}
        #: Slices of the other words, by a part of their hashes.
        self.others = np.zeros(1 << 10, np.int64)
        rest = max(0, positions - sum(n for _, n in common)) / len(self.others)
        for h, n in sorted(common, key=lambda x: (-x[1], x[0])):
            k = load.index(min(load))
            load[k] += n
            of[int(np.int64(h).view(_U))] = k, min(self.shards, -int(-n // each)) if n > 1.5 * each else 1
        for i in range(len(self.others)):
            self.others[i] = load.index(min(load))
            load[self.others[i]] += rest or 1
        some = sorted(of)
        self.common = np.array(some, _U)
        self.slice_of, self.ways = (np.array([of[h][i] for h in some], np.int64) for i in (0, 1))
        self.wide = bool((self.ways > 1).any())

    def _of(self, mid: np.ndarray, own: np.ndarray, others: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return others
        at = np.minimum(np.searchsorted(self.common, mid), len(self.common) - 1)
        return np.where(self.common[at] == mid, own[at], others)

    def slice(self, mid: np.ndarray) -> np.ndarray:
        return self._of(mid, self.slice_of, self.others[(mix(mid) % _U(len(self.others))).astype(np.int64)])

    def spread(self, mid: np.ndarray) -> np.ndarray:
        """Over how many shards."""
        return self._of(mid, self.ways, np.ones(len(mid), np.int64))

    def shard(self, word: np.ndarray) -> np.ndarray:
        """The first of them; and the shard of a word, or a pair, itself."""
        return ((mix(word) >> _U(20)) % _U(self.shards)).astype(np.int64)


def _sent(blocks: DataFrame, deal: Deal, ks: list[int]) -> DataFrame:
    """The trigrams of the slices ``ks`` by shard and block: the middle words, how many trigrams each has, and of each the other words, the text and its flag."""
    names = ["shard", "block", "mids", "many", "firsts", "lasts", "texts", "flags"]

    def run(batches: Batches) -> Batches:
        for b in batches:
            for number, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
                hashes, ids, sizes, flags = _decoded(data)
                here = np.isin(deal.slice(hashes), ks).take(ids)  # by middle word
                starts = np.cumsum(sizes) - sizes
                here[starts[sizes > 0]] = False  # the first start and the end are in the middle of none
                here[(starts + sizes - 1)[sizes > 0]] = False
                at = np.flatnonzero(here)
                if not len(at):
                    continue
                mid, spread = ids[at], deal.spread(hashes)
                mid, shard = mid.astype(np.int64), deal.shard(hashes)[mid]
                if (wide := spread[mid] > 1).any():
                    sub = (mix(hashes[ids[at[wide] - 1]] ^ _ODD) % spread[mid[wide]].astype(_U)).astype(np.int64)
                    shard[wide] = (shard[wide] + sub) % deal.shards
                group = shard * len(hashes) + mid
                bits = max(1, len(at).bit_length())
                ranked = np.sort(group << bits | np.arange(len(at)))  # faster than their order
                at, group = at[ranked & ((1 << bits) - 1)], ranked >> bits
                new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                owner, n = group[new] // len(hashes), np.diff(np.append(new, len(at)))
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                ends, wholes = np.append(first, len(owner)), np.append(new[first], len(at))
                doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[at]
                cols = [_packed(hashes[ids[at[new]]], ends), _packed(n.astype(np.uint32), ends), *[_packed(x, wholes) for x in (hashes[ids[at - 1]], hashes[ids[at + 1]], doc, flags[doc])]]
                yield pa.RecordBatch.from_arrays([pa.array(owner[first].astype(np.int32)), pa.array(np.full(len(first), number)), *cols], names=names)

    return blocks.select("block", "data").mapInArrow(tidied(run), "shard int, block long, mids binary, many binary, firsts binary, lasts binary, texts binary, flags binary")


def _hashes(first: np.ndarray, mid: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each trigram, its first two words, and its last two."""
    two = first * _ODD + mid
    return mix(two * _ODD + last), mix(two), mix(mid * _ODD + last)


_COUNTS = "kind int, shard int, a binary, b binary, n binary, rest binary"


def _counts(kind: int, shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each shard, with 64-bit values."""
    order = np.argsort(shard, kind="stable")
    own, first = np.unique(shard[order], return_index=True)
    ends = np.append(first, len(order))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.astype(np.int32)), *[_packed(c.astype(np.int64)[order], ends) for c in columns]], names=["kind", "shard", "a", "b", "n", "rest"])


def _of_counts(order: int, n: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """How many of an order have counts of 1 to 4."""
    one = [np.bincount(np.minimum(c, 5), minlength=5)[1:5] for c in (n, rest)]
    return _counts(0, np.zeros(4, np.int64), np.full(4, order), np.arange(1, 5), *one)


def _counted(deal: Deal) -> Callable[[Batches], Batches]:
    """Of a shard, packed rows of counts, ``n`` and ``rest`` (without texts held out), by ``kind``. 0: how many of order ``a`` have a count of ``b`` (1 to 4); 1: how many
    words precede word ``a``; 2: how many precede the two words ``a`` and ``b``, for words ``a`` that several shards have."""

    def run(batches: Batches) -> Batches:
        mids, many, firsts, lasts, flags = _rows(batches, "mids", "many", "firsts", "lasts", "flags")
        if not mids:
            return
        mid = np.repeat(_unpacked(mids, _U)[0], _unpacked(many, np.uint32)[0])
        last, flag = _unpacked(lasts, _U)[0], _unpacked(flags, np.uint8)[0]
        h, _, low = _hashes(_unpacked(firsts, _U)[0], mid, last)
        _, at, where = _distinct(h)
        counts = np.bincount(where), np.bincount(where[flag == 1], minlength=len(at))
        yield _of_counts(3, *counts)
        low, two, where = _distinct(low[at])
        mid, last = mid[at][two], last[at][two]
        pairs = [np.bincount(where[c > 0], minlength=len(two)) for c in counts]
        wide = deal.spread(mid) > 1
        yield _counts(2, deal.shard(low[wide]), mid[wide], last[wide], *[x[wide] for x in pairs])
        yield from _of_pairs(deal, last[~wide], *[x[~wide] for x in pairs])

    return run


def _of_pairs(deal: Deal, last: np.ndarray, *pairs: np.ndarray) -> Batches:
    """From whole counts of pairs, those of their counts and of their last words."""
    yield _of_counts(2, *pairs)
    one, _, where = _distinct(last)
    ones = [np.bincount(where[x > 0], minlength=len(one)) for x in pairs]
    yield _counts(1, deal.shard(one), one, np.zeros(len(one)), *ones)


def _merged(deal: Deal) -> Callable[[Batches], Batches]:
    """Sums over equal words and equal pairs; the pairs, now whole, get 3 and their slice as their kind. Others pass."""

    def run(batches: Batches) -> Batches:
        held: dict[int, list[list[bytes]]] = {1: [[], [], [], []], 2: [[], [], [], []]}
        for b in batches:
            kind = np.asarray(b.column("kind"))
            if (other := (kind == 0) | (kind > 2)).any():
                yield b.filter(pa.array(other))
            for i, one in held.items():
                for values, c in zip(one, ("a", "b", "n", "rest"), strict=True):
                    values += b.column(c).filter(pa.array(kind == i)).to_pylist()
        if held[1][0]:
            a, _, n, rest = (_unpacked(x, np.int64)[0] for x in held[1])
            one, _, where = _distinct(a)
            yield _counts(1, deal.shard(one.view(_U)), one, np.zeros(len(one)), *[np.bincount(where, x, len(one)) for x in (n, rest)])
        if held[2][0]:
            a, b, n, rest = (_unpacked(x, np.int64)[0] for x in held[2])
            low, at, where = _distinct(mix(a.view(_U) * _ODD + b.view(_U)))
            pairs = [np.bincount(where, x, len(at)).astype(np.int64) for x in (n, rest)]
            own = deal.slice(a[at].view(_U))
            for k in np.unique(own):
                j = own == k
                yield _counts(3 + int(k), deal.shard(low[j]), a[at][j], b[at][j], *[x[j] for x in pairs])
            yield from _of_pairs(deal, b[at].view(_U), *pairs)

    return run


def _discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and 3 or more."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    # Where the counts of counts can't give a discount, the usual absolute one stands in; none is 0, as each context must leave something.
    d = [min(float(i), i - (i + 1) * y * n[i] / n[i - 1]) if n[i - 1] else 0.5 for i in (1, 2, 3)]
    return np.array([0.0, *[x if x > 0 else 0.5 for x in d]])


class Model:
    """What a shard needs besides its own counts: discounts by order, and the unigrams."""

    def __init__(self, three: list[int], two: list[int], one: dict[int, int]) -> None:
        """Counts of the counts 1 to 4 of trigrams and pairs, and of all counts of words."""
        self.three, self.two, self.one = _discounts(three), _discounts(two), _discounts([one.get(i, 0) for i in (1, 2, 3, 4)])
        self.total = sum(n * many for n, many in one.items())
        taken = sum(many * self.one[min(n, 3)] for n, many in one.items())
        self.unknown = float(taken / self.total if self.total else 1.0) / (sum(one.values()) + 1)

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return self.unknown + (n - self.one[np.minimum(n, 3)]) / max(self.total, 1)


def _shares(n: np.ndarray, group: np.ndarray, discounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each count its discounted share in its group, and of each group the share left (1 without any)."""
    taken = discounts[np.minimum(n, 3)]
    total = np.bincount(group, n)
    left = np.divide(np.bincount(group, taken), total, out=np.ones(len(total)), where=total > 0)
    return (n - taken) / np.maximum(total, 1)[group], left


def _scored(deal: Deal, models: list[Model], shared: Broadcast, complete: bool) -> Callable[[Batches], Batches]:
    """The sums of logarithms by text of a shard, under both models; and the trigrams whose last word is to be looked up."""

    def run(batches: Batches) -> Batches:
        block, mids, many, firsts, lasts, texts, flags = _rows(batches, "block", "mids", "many", "firsts", "lasts", "texts", "flags")
        own = [i for i, b in enumerate(block) if b >= 0]
        if not own:
            return
        of = lambda column, dtype, rows: _unpacked([column[i] for i in rows], dtype)[0]
        mid = np.repeat(of(mids, _U, own), of(many, np.uint32, own))
        last, flag = of(lasts, _U, own), of(flags, np.uint8, own)
        doc, sizes = _unpacked([texts[i] for i in own], np.uint16)
        h, ctx, low = _hashes(of(firsts, _U, own), mid, last)
        # Distinct trigrams, their first two and last two words, and the middle words of the latter.
        _, at, where = _distinct(h)
        ctx = _distinct(ctx[at])[2]
        far = [i for i, b in enumerate(block) if b < 0]  # pairs counted over several shards: middle and last word, and counts
        far_mid, far_last = of(mids, _U, far), of(lasts, _U, far)
        _, two, lows = _distinct(np.concatenate([low[at], mix(far_mid * _ODD + far_last)]))
        far_at, lows = lows[len(at) :], lows[: len(at)]
        two_last = np.concatenate([last[at], far_last])[two]
        two_mid = _distinct(np.concatenate([mid[at], far_mid])[two])[2]
        hashes, *known = shared.value
        place = np.minimum(np.searchsorted(hashes, two_last), max(len(hashes) - 1, 0))
        here = hashes[place] == two_last if len(hashes) else np.zeros(len(two), bool)
        logs, parts = [], []
        for m, model in enumerate(models):
            c = np.bincount(where[flag > 0 if m == 0 else flag == 1], minlength=len(at))
            n = np.bincount(lows[c > 0], minlength=len(two))
            n[far_at] = of(firsts if m == 0 else texts, np.int64, far)
            own3, left3 = _shares(c, ctx, model.three)
            own2, left2 = _shares(n, two_mid, model.two)
            x, y = own3 + left3[ctx] * own2[lows], left3[ctx] * left2[two_mid][lows]
            p = model.unigram(np.where(here, known[m][place] if len(hashes) else 0, 0))
            logs.append(np.log(x + y * p[lows]))
            parts += [x, y]
        wait = np.zeros(len(at), bool) if complete else ~here[lows]
        blocks = np.array(block)[own]
        row = np.repeat(blocks, sizes) * TEXTS + doc
        done = ~wait[where]
        yield _sums(row[done], logs[0][where[done]], np.where(flag[done] == 2, logs[1][where[done]], 0.0))
        late = np.flatnonzero(~done)
        shard = deal.shard(last[late])
        order = np.argsort(shard, kind="stable")
        late, shard = late[order], shard[order]
        own_shard, first = np.unique(shard, return_index=True)
        ends, u, held = np.append(first, len(late)), where[late], flag[late] == 2
        values = [row[late], last[late].view(np.int64), parts[0][u], parts[1][u], np.where(held, parts[2][u], 1.0), np.where(held, parts[3][u], 0.0)]
        nothing = pa.nulls(len(own_shard), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(own_shard.astype(np.int32)), pa.nulls(len(own_shard), pa.int64()), nothing, nothing, nothing, *[_packed(v, ends) for v in values]], names=_FOUND)

    return run


#: Sums by text of a block, or trigrams to look up the last words of: their texts, last words, and x + y p for both models.
_FOUND = ["shard", "block", "texts", "sums", "rests", "rows", "lasts", "x0", "y0", "x1", "y1"]
_FOUND_SCHEMA = "shard int, block long, " + ", ".join(f"{c} binary" for c in _FOUND[2:])


def _sums(row: np.ndarray, *logs: np.ndarray) -> pa.RecordBatch:
    """The sums of each text, packed by block."""
    row, _, where = _distinct(row)
    own = np.unique(row // TEXTS)
    ends = np.searchsorted(row, np.append(own, own[-1:] + 1) * TEXTS) if len(own) else np.zeros(1, np.int64)
    cols = [_packed((row % TEXTS).astype(np.uint16), ends), *[_packed(np.bincount(where, x, len(row)), ends) for x in logs]]
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int32)), pa.array(own), *cols, *[pa.nulls(len(own), pa.binary())] * 6], names=_FOUND)


def _looked_up(models: list[Model]) -> Callable[[Batches], Batches]:
    """The trigrams that wait, with their last words' counts, which come as rows of the shard without texts. Sums pass."""

    def run(batches: Batches) -> Batches:
        held: list[list[bytes]] = [[] for _ in _FOUND[5:]]
        known: list[list[bytes]] = [[], [], []]
        for b in batches:
            if (sums := np.asarray(b.column("block").is_valid())).any():
                yield b.filter(pa.array(sums))
            words = np.asarray(b.column("rows").is_null()) & ~sums
            for values, c in zip(known, ("lasts", "x0", "x1"), strict=True):
                values += b.column(c).filter(pa.array(words)).to_pylist()
            for values, c in zip(held, _FOUND[5:], strict=True):
                values += b.column(c).filter(pa.array(~sums & ~words)).to_pylist()
        if not held[0]:
            return
        hashes, *counts = (_unpacked(x, np.int64)[0] for x in known)
        row, last = (_unpacked(x, np.int64)[0] for x in held[:2])
        parts = [_unpacked(x, float)[0] for x in held[2:]]
        order = np.argsort(hashes)
        hashes = hashes[order]
        at = np.minimum(np.searchsorted(hashes, last), max(len(hashes) - 1, 0))
        here = hashes[at] == last if len(hashes) else np.zeros(len(last), bool)
        n = [np.where(here, c[order][at], 0) if len(hashes) else np.zeros(len(last), np.int64) for c in counts]
        yield _sums(row, *[np.log(parts[2 * m] + parts[2 * m + 1] * models[m].unigram(n[m])) for m in (0, 1)])

    return run


def _summed(batches: Batches) -> Batches:
    """The sums of a block's texts over all rows of the block, packed again."""
    block, texts, sums, rests = _rows(batches, "block", "texts", "sums", "rests")
    if block:
        doc, sizes = _unpacked(texts, np.uint16)
        yield _sums(np.repeat(np.array(block), sizes) * TEXTS + doc, _unpacked(sums, float)[0], _unpacked(rests, float)[0])


def _learnt(trusted: DataFrame, deal: Deal, share: float) -> tuple[list[Model], DataFrame, tuple, bool, str]:
    """Both models (of all trusted texts, and of those not held out); the counts of words (kind 1) and of pairs by slice (3 and more), as packed rows; the commonest
    words with theirs; whether these are all; and the path of the counts."""
    counts, path = None, ""
    # So many slices together that there are about as many trigrams as in one slice of all texts.
    step = max(1, int(1 / max(share, 1e-9))) if share else deal.slices
    for k in [*range(0, deal.slices, step), deal.slices]:
        # The last time, words of the pairs before are added.
        found = counts
        if k < deal.slices:
            found = _sent(trusted, deal, list(range(k, min(k + step, deal.slices)))).repartitionById(deal.shards, F.col("shard")).mapInArrow(tidied(_counted(deal)), _COUNTS)
            found = found if counts is None else found.union(counts)
        before = path
        counts, path = _kept(found.repartitionById(deal.shards, F.col("shard")).mapInArrow(tidied(_merged(deal)), _COUNTS))
        if before:
            delete(counts.sparkSession, before)

    def often(batches: Batches) -> Batches:
        for b in batches:
            for i, c in enumerate(("n", "rest")):
                n, many = np.unique(_unpacked(b.column(c).to_pylist(), np.int64)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), pa.array(n), pa.array(many)], names=["model", "n", "many"])

    def levels(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(b.column(c).to_pylist(), np.int64)[0]) for c in ("a", "b", "n", "rest")], names=["a", "b", "n", "rest"])

    words_of = counts.where("kind = 1")
    spectrum = words_of.mapInArrow(often, "model int, n long, many long").groupBy("model", "n").agg(F.sum("many").alias("many")).where("n > 0").collect()
    level = {(r.a, r.b): r for r in counts.where("kind = 0").mapInArrow(levels, "a long, b long, n long, rest long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest")).collect()}
    models = []
    for m, c in enumerate(("n", "rest")):
        one = {r.n: r.many for r in spectrum if r.model == m}
        three, two = ([level[a, i][c] if (a, i) in level else 0 for i in (1, 2, 3, 4)] for a in (3, 2))
        models.append(Model(three, two, one))
    # As many of the commonest words as may be broadcast.
    least, size = 0, 0
    for r in sorted((r for r in spectrum if r.model == 0), key=lambda r: -r.n):
        if (size := size + r.many) > HOT:
            break
        least = r.n

    def commonest(batches: Batches) -> Batches:
        for b in batches:
            a, n, rest = (_unpacked(b.column(c).to_pylist(), np.int64)[0] for c in ("a", "n", "rest"))
            yield pa.RecordBatch.from_arrays([pa.array(x[n >= least]) for x in (a, n, rest)], names=["a", "n", "rest"])

    near = words_of.mapInArrow(commonest, "a long, n long, rest long").toArrow() if least else None
    cols = [near.column(c).to_numpy() if least else np.zeros(0, np.int64) for c in ("a", "n", "rest")]
    order = np.argsort(cols[0].view(_U))
    return models, counts, (cols[0].view(_U)[order], cols[1][order], cols[2][order]), size <= HOT, path


def _pairs_sent(pairs: DataFrame, deal: Deal) -> DataFrame:
    """Counts of pairs of words to all shards that have their middle word, in the columns of ``_sent``: ``firsts`` and ``texts`` have the counts."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, b, n, rest = (_unpacked(batch.column(x).to_pylist(), np.int64)[0] for x in ("a", "b", "n", "rest"))
            spread, shard = deal.spread(a.view(_U)), deal.shard(a.view(_U))
            for i in range(int(spread.max(initial=0))):
                to = (shard + i) % deal.shards
                for s in np.unique(to[spread > i]):
                    j = (spread > i) & (to == s)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([-1]), *[pa.array([x.tobytes()]) for x in (a[j], np.ones(j.sum(), np.uint32), n[j], b[j], rest[j], np.zeros(0))]], names=["shard", "block", "mids", "many", "firsts", "lasts", "texts", "flags"])

    return pairs.select("a", "b", "n", "rest").mapInArrow(run, "shard int, block long, mids binary, many binary, firsts binary, lasts binary, texts binary, flags binary")


def perplexities(df: DataFrame, key: str, text: str, lang: str, trusted: str, held: str) -> DataFrame:
    """Key, ``lang``, ``n_scored``, ``flag`` and ``perplexity`` of each text under the model of all trusted texts; and, of those held out, ``rest``, under one of the others (null without any)."""
    spark = df.sparkSession
    tokens, _ = _kept(tokenized(df, key, text, lang, trusted, held))
    blocks = tokens.where("block is not null")
    docs = tokens.where("block is null").select("_row", key, "lang", "n_scored", "flag")
    positions, learnt = docs.agg(F.coalesce(F.sum("n_scored"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("flag") > 0, F.col("n_scored"))), F.lit(0))).first()

    def common(batches: Batches) -> Batches:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], np.int64)) for c in ("common", "often")], names=["h", "n"])

    often = blocks.select("common", "often").mapInArrow(common, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * COMMON > positions)
    deal = Deal(positions, [(r.h, r.n) for r in often.collect()])
    models, counts, near, complete, path = _learnt(blocks.where("flag > 0"), deal, learnt / max(positions, 1))
    shared = spark.sparkContext.broadcast(near)
    binary = F.lit(None).cast("binary")
    known = counts.where("kind = 1").select("shard", F.lit(None).cast("long").alias("block"), *[{"lasts": F.col("a"), "x0": F.col("n"), "x1": F.col("rest")}.get(c, binary).alias(c) for c in _FOUND[2:]])
    total, total_path = None, None
    for k in range(deal.slices):
        sent = _sent(blocks, deal, [k])
        if deal.wide:
            sent = sent.union(_pairs_sent(counts.where(F.col("kind") == 3 + k), deal))
        found = sent.repartitionById(deal.shards, F.col("shard")).mapInArrow(tidied(_scored(deal, models, shared, complete)), _FOUND_SCHEMA)
        if not complete:
            found = found.union(known).repartitionById(deal.shards, F.col("shard")).mapInArrow(tidied(_looked_up(models)), _FOUND_SCHEMA)
        if total is not None:
            found = found.union(total)
        before = total_path
        total, total_path = _kept(found.repartition(deal.shards, "block").mapInArrow(tidied(_summed), _FOUND_SCHEMA))
        if before:
            delete(spark, before)
    delete(spark, path)

    def unpack(batches: Batches) -> Batches:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(r["block"] * TEXTS + np.frombuffer(r["texts"], np.uint16).astype(np.int64)), *[pa.array(np.frombuffer(r[c], float)) for c in ("sums", "rests")]], names=["_row", "_sum", "_rest"])

    sums = total.mapInArrow(unpack, "_row long, _sum double, _rest double")
    per = lambda c: F.exp(-F.col(c) / F.col("n_scored"))
    rest = F.when((F.col("flag") == 2) & F.lit(models[1].total > 0), per("_rest"))
    return docs.join(sums, "_row", "left").select(key, "lang", "n_scored", "flag", F.when(F.col("n_scored") > 0, per("_sum")).alias("perplexity"), F.when(F.col("n_scored") > 0, rest).alias("rest"))
