"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``encode`` adds the token ids of each text and the span of characters that each token touches; ``decode`` turns ids back into bytes by the
reversed byte table. A null text counts as an empty one and gives no ids. Rows keep all their columns, repeated rows included; an output
column replaces an input column of the same name.

A text is cut before it reaches the library, so that a word that was met before costs one look-up. The cuts lie only where the pattern of
the vocabulary cuts as well: before a single space and around a single line break between two visible characters, and between a letter and a
comma or full stop. Texts with other white space, or with the string of an added token, go to the library whole. Either way the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches, texts, tidied


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: visible Latin-1 ones for themselves, the rest from U+0100 on."""
    own = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pairs whose merge makes a ranked token, in order of rank: every split of the token into two ranked parts."""
    pairs = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        pairs += [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return pairs


@lru_cache(maxsize=4)
def load(path: str, literal: bool = False):
    """A tokenizer of the tokenizers library from its own JSON file or from a rank file (.tiktoken, which has no special tokens).

    A special token's string in a text is that token, as the library has it; with ``literal`` it is ordinary text.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    if not path.endswith(".tiktoken"):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = literal
        return t
    ranks, letters = read_ranks(path), byte_characters()
    spell = lambda token: "".join(letters[b] for b in token)
    bpe = models.BPE(
        vocab={spell(t): r for t, r in ranks.items()},
        merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)],
        ignore_merges=True,
    )
    t = Tokenizer(bpe)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return t


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; ids that no token has give no bytes."""
    t = load(path, False)  # as an encoder asks for it, so that both share one
    byte_of = {c: i for i, c in enumerate(byte_characters())}
    out = [b""] * t.get_vocab_size(with_added_tokens=True)
    vocab = t.get_vocab(with_added_tokens=True)
    out += [b""] * (max(vocab.values(), default=-1) + 1 - len(out))
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


#: White space that isn't a single space or line break between two other characters, and characters that readers of Unicode differ about.
_IRREGULAR = (
    "[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{2064}\\x{3000}\\x{feff}]"
    "|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|\\A\\z"
)


#: Letters on which all readers of Unicode agree, for use inside of brackets.
_LETTERS = "A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}"


class Encoder:
    """Encodes texts into ids, with a bounded memory of words it has met.

    A unit is a word with the space before it, a line break, or what follows a word from a comma or full stop on. Equal units of a batch are looked up
    once. A new unit of letters is one piece of the pattern and goes to the library's BPE model at once; other new units go through its whole encoder.
    """

    #: Units remembered by each Python worker; beyond that, only those of the latest batch stay, first those met before.
    REMEMBERED = 150_000
    #: Characters of a unit that is remembered at most.
    LONGEST = 256

    def __init__(self, path: str, literal: bool = False):
        self.tokenizer = load(path, literal)
        added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.irregular = "|".join([_IRREGULAR, *map(re.escape, added)])
        self.model = self.tokenizer.model
        self.spelling = {i: c for i, c in enumerate(byte_characters()) if i != 10}
        self.known: dict[str, bytes] = {}
        self.line_break = self._whole(["\n"])[0]
        units = ["a", ",", " a", ".b", "\n", "b", "."]
        if len(self.line_break) != 4 or self._whole(["".join(units)])[0] != b"".join(self._whole(units)):
            self.line_break = b""  # a vocabulary whose line break isn't a token of its own, or with another pattern

    def _whole(self, batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """The ids of words that are one piece of the pattern each."""
        out: list[bytes] = []
        tokenize = self.model.tokenize
        for k in range(0, len(words), 10_000):  # so that few numbers are Python objects at a time
            spelt = "\n".join(words[k : k + 10_000]).encode().decode("latin-1").translate(self.spelling).split("\n")
            ids: list[int] = []
            ends = [0]
            for w in spelt:
                ids += [t.id for t in tokenize(w)]
                ends.append(4 * len(ids))
            raw = np.array(ids, "<u4").tobytes()
            out += [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        return out

    def _others(self, units: list[str]) -> list[bytes]:
        """The ids of units without line breaks, through the whole encoder."""
        out: list[bytes] = []
        for i in range(0, len(units), 20_000):
            part = units[i : i + 20_000]
            ids = np.frombuffer(self._whole(["\n".join(part)])[0], "<u4")
            ends = np.append(np.flatnonzero(ids == int.from_bytes(self.line_break, "little")), len(ids))
            assert len(ends) == len(part)
            raw, start = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                out.append(raw[start:end])
                start = end + 4
        return out

    def _found(self, distinct: pa.Array) -> list[bytes]:
        """The ids of distinct units, which are remembered."""
        units = distinct.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        known["\n"] = self.line_break
        found = list(map(known.get, units))
        new = [i for i, ids in enumerate(found) if ids is None]
        if not new:
            return found
        letters = pc.match_substring_regex(distinct.take(pa.array(new)), f"\\A ?[{_LETTERS}]+\\z").to_pylist()
        for chosen, coder in ((True, self._pieces), (False, self._others)):
            at = [i for i, x in zip(new, letters, strict=True) if x is chosen]
            for i, ids in zip(at, coder([units[i] for i in at]), strict=True):
                found[i] = ids
        room = self.REMEMBERED - len(known)
        if len(new) > room:
            fresh = set(new)
            held = {units[i]: found[i] for i in range(len(units)) if i not in fresh and len(units[i]) <= self.LONGEST}
            known.clear()
            known.update(held)
            room = self.REMEMBERED - len(known)
        known.update((units[i], found[i]) for i in new[: max(room, 0)] if len(units[i]) <= self.LONGEST)
        return found

    def encode(self, batch: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        odd = pc.match_substring_regex(batch, self.irregular).to_numpy(zero_copy_only=False)
        if not self.line_break or odd.all():
            return self._whole(batch.to_pylist())
        cut = pc.replace_substring(pc.replace_substring(batch.filter(pa.array(~odd)), "\n", "\0\n\0"), " ", "\0 ")
        lists = pc.split_pattern(pc.replace_substring_regex(cut, f"([{_LETTERS}])([,.])", "\\1\0\\2"), "\0")
        coded = lists.flatten().dictionary_encode()
        # Every distinct unit's ids stand in one list; the ids of the texts are taken from these.
        found = self._found(coded.dictionary)
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2, out=ends[1:])
        table = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4")))
        taken = table.take(coded.indices)
        raw = memoryview(taken.flatten().to_numpy()).cast("B")
        starts = taken.offsets.to_numpy().astype(np.int64) - taken.offsets[0].as_py()
        at = (4 * starts[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        parts = iter([bytes(raw[i:j]) for i, j in zip(at, at[1:], strict=False)])
        if not odd.any():
            return list(parts)
        whole = iter(self._whole(batch.filter(pa.array(odd)).to_pylist()))
        return [next(whole) if x else next(parts) for x in odd.tolist()]


@lru_cache(maxsize=2)
def encoder(path: str, literal: bool) -> Encoder:
    return Encoder(path, literal)


def encode_bytes(column: pa.Array, path: str, literal: bool = False) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, null as empty."""
    return encoder(path, literal).encode(pc.fill_null(column, "")) if len(column) else []


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of a sequence of ids; a character split over tokens comes together again here."""
    return b"".join(map(token_bytes(path).__getitem__, ids.tolist()))


def character_spans(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character that each token touches; tokens that share a split character share its position."""
    table = token_bytes(path)
    raw = b"".join(map(table.__getitem__, ids.tolist()))
    sizes = np.fromiter((len(table[i]) for i in ids.tolist()), np.int64, len(ids))
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # bytes that begin a character
    before = np.concatenate([[0], np.cumsum(heads)])  # characters begun before each byte
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = before[np.minimum(starts + 1, len(raw))] - 1
    return np.maximum(first, 0), before[ends]


def ids_array(parts: list[bytes]) -> pa.ListArray:
    """A list column of ids from their bytes."""
    sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def gathered(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes: small ones are put together, so that equal words are looked up less often, and rows of large ones are dealt out."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        step = max(1, whole.num_rows * most // max(1, whole.nbytes))
        for i in range(0, whole.num_rows, step):
            b = whole.slice(i, step)
            held.append(b)
            size += b.nbytes
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new}
    return pa.RecordBatch.from_arrays([*kept.values(), *new.values()], names=[*kept, *new])


def _extended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + fields)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", spans: bool = True, checked: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) and, with ``spans``, ``char_starts`` and ``char_ends`` (array<int>) of each token's characters; ``checked`` names a
    boolean column that tells whether decoding the ids gives the text's bytes again."""
    ints = T.ArrayType(T.IntegerType(), False)
    names = [ids, *(["char_starts", "char_ends"] if spans else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 1 << 20):  # with all columns held, memory matters more than common words
            parts = encode_bytes(b.column(text), path)
            new = {ids: ids_array(parts)}
            if spans:
                pairs = [character_spans(np.frombuffer(p, "<u4"), path) for p in parts]
                for k, name in enumerate(("char_starts", "char_ends")):
                    new[name] = ids_array([p[k].astype("<u4").tobytes() for p in pairs])
            if checked:
                same = [decode_ids(np.frombuffer(p, "<u4"), path) == t for p, t in zip(parts, texts(b.column(text)), strict=True)]
                new[checked] = pa.array(same, pa.bool_())
            yield with_columns(b, new)

    fields = [T.StructField(n, ints) for n in names] + ([T.StructField(checked, T.BooleanType())] if checked else [])
    return small_batches(df).mapInArrow(tidied(run), _extended(df, fields))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded bytes (binary) of ``ids``; null ids give no bytes. Cast to string where the ids end on a character's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            lists = b.column(ids)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            raw = [decode_ids(flat[i:j], path) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield with_columns(b, {out: pa.array(raw, pa.binary())})

    return df.mapInArrow(tidied(run), _extended(df, [T.StructField(out, T.BinaryType())]))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass over Arrow batches: key, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    from hashlib import sha256

    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            parts = encode_bytes(b.column(text), path)
            columns = [
                b.column(key),
                pa.array([len(p) // 4 for p in parts], pa.int64()),
                pa.array([sha256(p).hexdigest() for p in parts], pa.string()),
                pa.array([sha256(decode_ids(np.frombuffer(p, "<u4"), path)).hexdigest() for p in parts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return small_batches(df).select(key, text).mapInArrow(tidied(run), schema)
