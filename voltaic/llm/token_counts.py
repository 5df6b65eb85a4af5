"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links and the number of tokens popped on the way: when a byte has no edge, the longest matches of what was
read so far are popped, and matching goes on at the node that spells the rest. So each word is read once and no piece is ever built. Nodes,
links and popped counts lie in flat arrays (a double-array trie), and a batch's distinct words step through them together.

A word (a run of bytes other than space and 09 to 0D) is read as its ``prefix`` (a space for vocabularies that mark the start of a word so)
and its bytes. A word that no sequence of tokens spells counts as one unknown token. A null text has no words and no tokens. Texts of any
length are read whole; rows, repeated ones included, stay as they are, and an output column replaces an input column of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import read_ranks, slices, with_columns
from .common import small_batches, texts, tidied


class Automaton:
    """Counts greedy longest-match tokens of words over a vocabulary of byte strings."""

    #: Words up to which each is walked on its own.
    FEW = 16

    def __init__(self, vocabulary: list[bytes]):
        self._plain = None
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in sorted(set(vocabulary) - {b""}):
            node = 0
            for byte in token:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][byte]
            final[node] = True
        n = len(children)
        # Failure links, nearest nodes first. A final node pops itself; another pops what its parent's link can't carry on.
        fail, popped = [-1] * n, [0] * n
        row = [0]
        for node in row:
            for byte, child in children[node].items():
                row.append(child)
                if final[child]:
                    fail[child], popped[child] = 0, 1
                    continue
                at, count = fail[node], popped[node]
                while at >= 0 and byte not in children[at]:
                    at, count = fail[at], count + popped[at]
                if at >= 0:
                    fail[child], popped[child] = children[at][byte], count
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        self._pack(children)

    def _pack(self, children: list[dict[int, int]]) -> None:
        """The edges as a double array: the edge of node s by byte b is at base[s] + b, if check there is s."""
        n = len(children)
        size = 2 * n + 1024
        base, used = np.zeros(n, np.int64), np.zeros(size, bool)
        check, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        low = 0
        for node in sorted(range(n), key=lambda s: -len(children[s])):
            if not children[node]:
                break
            keys = np.array(sorted(children[node]), np.int64)
            at, found = low, -1
            while found < 0:
                if at + 512 >= size:
                    used, check, target = (np.concatenate([a, np.full(size, v, a.dtype)]) for a, v in ((used, False), (check, -1), (target, 0)))
                    size *= 2
                if len(keys) == 1:
                    free = np.flatnonzero(~used[at : at + 512])[:1] + at
                else:
                    free = np.flatnonzero(~used[at : at + 512]) + at
                    free = free[free + 256 < size]
                    free = free[~used[free[:, None] + (keys - keys[0])].any(axis=1)]
                found = int(free[0]) if len(free) else -1
                at += 512
            start = found - int(keys[0])
            base[node] = start
            used[start + keys] = True
            check[start + keys] = node
            target[start + keys] = [children[node][k] for k in keys.tolist()]
            if used[low]:
                low += int(np.argmin(used[low:]))
        # Bases may be negative by up to 255 for the earliest slots: shift the arrays instead.
        shift = int(max(0, -base.min()))
        pad = np.full(shift, -1, np.int32)
        tail = np.full(256, -1, np.int32)
        self.base = base + shift
        self.check, self.target = np.concatenate([pad, check, tail]), np.concatenate([pad * 0, target, tail * 0])

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; a word that can't be spelt counts as one."""
        total = np.zeros(len(words), np.int64)
        if not words:
            return total
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")  # long words last to end: the front part is always the active one
        state, lost = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        active = int((sizes > 0).sum())
        step = 0
        while active > self.FEW:
            who = order[:active]
            byte = flat[starts[who] + step].astype(np.int64)
            self._advance(state, total, lost, who, byte)
            step += 1
            active = int(np.searchsorted(-sizes[order], -step, side="left"))
        for i in order[:active].tolist():  # few long words: stepping through them together would cost more than it saves
            self._walk(i, flat[starts[i] + step : starts[i] + sizes[i]].tobytes(), state, total, lost)
        who = np.arange(len(words))
        while len(who := who[(state[who] > 0) & ~lost[who]]):  # what is left at the end is popped alike
            at = state[who]
            total[who] += self.popped[at]
            state[who] = self.fail[at]
            lost[who[state[who] < 0]] = True
        return np.where(lost, 1, total)

    def _walk(self, i: int, rest: bytes, state: np.ndarray, total: np.ndarray, lost: np.ndarray) -> None:
        """The rest of one word, byte by byte."""
        if lost[i]:
            return
        if self._plain is None:
            self._plain = [memoryview(a) for a in (self.base, self.check, self.target, self.fail, self.popped)]
        base, check, target, fail, popped = self._plain
        at, n = int(state[i]), 0
        for byte in rest:
            while check[slot := base[at] + byte] != at:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    lost[i] = True
                    return
            at = target[slot]
        state[i] = at
        total[i] += n

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_plain": None}

    def _advance(self, state: np.ndarray, total: np.ndarray, lost: np.ndarray, who: np.ndarray, byte: np.ndarray) -> None:
        while len(who):
            at = state[who]
            slot = self.base[at] + byte
            hit = self.check[slot] == at
            state[who[hit]] = self.target[slot[hit]]
            who, byte, at = who[~hit], byte[~hit], at[~hit]
            total[who] += self.popped[at]
            state[who] = self.fail[at]
            dead = state[who] < 0
            lost[who[dead]] = True
            state[who[dead]] = 0
            live = ~dead & ~lost[who]
            who, byte = who[live], byte[live]


@lru_cache(maxsize=2)
def _of_ranks(path: str) -> Automaton:
    return Automaton(list(read_ranks(path)))


class Counter:
    """Counts by word, with a bounded memory of words met before."""

    REMEMBERED = 400_000
    #: Bytes of a word that is remembered at most.
    LONGEST = 256

    def __init__(self, automaton: Automaton, prefix: bytes):
        self.automaton, self.prefix, self.known = automaton, prefix, {}

    def count(self, batch: list[bytes]) -> tuple[list[int], list[int]]:
        split = [t.split() for t in batch]
        known = self.known
        new = list({w for ws in split for w in ws if w not in known})
        extra = dict(zip(new, self.automaton.count([self.prefix + w for w in new]).tolist(), strict=True))
        short = {w: n for w, n in extra.items() if len(w) <= self.LONGEST} if len(known) < self.REMEMBERED else {}
        known.update(short)
        get = known.__getitem__ if len(short) == len(extra) else lambda w: known[w] if w in known else extra[w]
        return [len(ws) for ws in split], [sum(map(get, ws)) for ws in split]


@lru_cache(maxsize=2)
def counter(path: str, prefix: bytes) -> Counter:
    return Counter(_of_ranks(path), prefix)


def token_counts(df: DataFrame, ranks: str, text: str = "text", prefix: bytes = b" ") -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` (long) of each text by greedy longest match over the tokens of a rank file."""
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("n_words", "n_tokens")] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks, prefix)
        for whole in batches:
            for b in slices(whole):
                words, tokens = own.count(texts(b.column(text)))
                yield with_columns(b, {"n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    return small_batches(df).mapInArrow(tidied(run), schema)
