"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, the same for everyone. A run of three letters is bound into one vector: the letters' vectors,
rotated by their place, are multiplied. A text is the bundle (sum) of its runs' vectors; a language is the bundle of its texts, each with unit
norm. A text gets the language whose prototype has the greatest cosine with it, ties by name.

Letters are Unicode letters in lower case; all else is one space between words, which counts as a letter. Null texts and texts without a letter
get ``und`` and the score 0. Rows with a null language are not learned from; with none to learn from, every text gets ``und``.
Whole texts of any length are read; repeated rows get equal rows. Prototypes are summed in whole numbers, so their order doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import small_batches, tidied

DIMENSIONS = 1_024
#: Runs of letters remembered by each Python worker; vectors of later new ones are made again each time.
REMEMBERED = 40_000
#: Languages that may be learned; prototypes are broadcast.
MOST_LANGUAGES = 10_000
_SCALE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, or a space."""
    table = np.full(0x110000, 32, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


@lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    return np.where(np.random.default_rng([20_24, code]).integers(0, 2, DIMENSIONS, np.int8) > 0, 1, -1).astype(np.int8)


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of three letters (21 bits each) and their counts."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.int64)
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def run_vector(key: int) -> np.ndarray:
    a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


class Memory:
    """Vectors of runs met before, in a matrix of bounded size."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.rows = np.zeros((256, DIMENSIONS), np.int8)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        place = self.place
        at = [place.get(k, -1) for k in keys.tolist()]
        if -1 not in at:
            return self.rows[at]
        for i, k in enumerate(keys.tolist()):
            if at[i] < 0 and len(place) < REMEMBERED:
                if len(place) == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                at[i] = place[k] = len(place)
                self.rows[at[i]] = run_vector(k)
        out = self.rows[np.maximum(at, 0)]
        for i, p in enumerate(at):
            if p < 0:
                out[i] = run_vector(int(keys[i]))
        return out


@lru_cache(maxsize=1)
def _memory() -> Memory:
    return Memory()


def text_vector(text: str | None) -> np.ndarray | None:
    """The unit bundle of a text, or None if it has no letter."""
    keys, counts = runs(text or "")
    if not len(keys):
        return None
    v = np.zeros(DIMENSIONS, np.float32)
    for i in range(0, len(keys), 4_096):
        v += counts[i : i + 4_096].astype(np.float32) @ _memory().vectors(keys[i : i + 4_096]).astype(np.float32)
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, over all texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole):
                for t, name in zip(b.column(text).to_pylist(), b.column(lang).to_pylist(), strict=True):
                    if name is not None and (v := text_vector(t)) is not None:
                        s = sums.setdefault(name, np.zeros(DIMENSIONS, np.int64))
                        s += np.rint(v * _SCALE).astype(np.int64)
        for name, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(s)], names=["lang", "place", "total"])

    part = small_batches(df).where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(tidied(run), "lang string, place int, total long")
    whole = part.groupBy("lang", "place").agg(F.sum("total").alias("total")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("v"))
    rows = whole.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for r in sorted(rows, key=lambda r: r.lang):
        v = np.array([x.total for x in r.v], np.float64)
        out[r.lang] = v / (np.linalg.norm(v) or 1.0)
    return out


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred`` and ``score``, the cosine with its prototype (0 to 1)."""
    names = list(prototypes)
    shared = df.sparkSession.sparkContext.broadcast(np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIMENSIONS))
    schema = T.StructType([df.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for b in slices(whole):
                found, scores = [], []
                for t in b.column(text).to_pylist():
                    v = text_vector(t) if names else None
                    if v is None:
                        found.append("und")
                        scores.append(0.0)
                        continue
                    cosine = table @ v
                    best = int(cosine.argmax())
                    found.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosine[best]))))
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return small_batches(df).select(key, text).mapInArrow(tidied(run), schema)
