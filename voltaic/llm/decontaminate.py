"""Benchmark passages in documents, in DataFrame functions only.

Windows of a document as long as a benchmark item (in words) get a SimHash fingerprint of their five-word shingles. A window and an item meet where
one of ``radius + 1`` blocks of their 64 bits agrees, so no pair within ``radius`` differing bits is missed; such pairs are
then compared by the weighted (multiset) Jaccard similarity of their shingles, and those of ``similarity`` or more are returned.

A window is built only for items that it can reach: two multisets of m shingles with a similarity of s share 2ms/(1+s) of them at least. So it shares one of the item's
rarest m - 2ms/(1+s) + 1 shingles (repeats counted, rarest among the items); such a shingle in a document names a candidate pair of document and item, and only windows with enough of that
item's shingles go on, one row each. A passage that very many items have in common names none of them but those that consist of such passages.

Documents are read twice. Each position's shingle is tested in place against a Bloom filter of the benchmark's (sized by their number), and the few that pass by an exact join. The second time
only texts that a filter of documents with such windows lets pass are split into words, for the windows' fingerprints. No text or array of a document without a candidate goes through a shuffle.

Words are runs of bytes other than space and 09 to 0D, lower-cased, without the punctuation in ``PUNCTUATION``. Items of fewer than five words
are matched by all their words as one shingle; null, empty and blank items match nothing. Null and blank texts have no windows. Very long texts
are searched whole. Repeated documents or items each give rows of their own keys; fully repeated rows give one. Null keys are kept as keys.
An empty table on either side gives an empty result. Only keys and texts are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, bloom_filter, bloom_has, few, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which a window is compared with an item: 3.5 deviations above what a similarity of 0.8 leads one to expect.
RADIUS = 20

PUNCTUATION = ".,;:!?\"'()[]{}"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), PUNCTUATION, ""), SEPARATORS), "")


def _shingle(words: str, at: Column, k: int) -> Column:
    """The hash of ``k`` words from a place on; null beyond the end."""
    run = F.xxhash64(*[F.get(F.col(words), at + j) for j in range(k)])
    return F.when(at + k <= F.size(words), run)


def _counts(h: str, times: Column) -> list[Column]:
    """Sums over the hashes of a group: how often each bit is set, and all."""
    return [*[F.sum(F.call_function("getbit", F.col(h), F.lit(b)) * times).alias(f"b{b}") for b in range(64)], F.sum(times).alias("all")]


def _fingerprint() -> Column:
    """The 64 bits of a SimHash as a long, from these sums: those set in over half of the hashes, repeats counted."""
    bit = [F.when(F.col(f"b{b}") * 2 > F.col("all"), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    while len(bit) > 1:
        bit = [x.bitwiseOR(y) for x, y in zip(bit[::2], bit[1::2], strict=True)]
    return bit[0]


def _blocks(fingerprint: str, radius: int) -> Column:
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fingerprint), lo).bitwiseAND((1 << (hi - lo)) - 1).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    )


def _least_shared(m: Column, similarity: float) -> Column:
    return F.greatest(F.ceil(m * 2 * similarity / (1 + similarity) - F.lit(1e-9)).cast("int"), F.lit(1))


def _identity(key: str, text: str) -> list[Column]:
    """128 bits that stand for a document's key and text."""
    return [F.xxhash64(key, text).alias("r1"), F.xxhash64(F.lit(7), text, key).alias("r2")]


def _items(items: DataFrame, item_key: str, text: str, similarity: float) -> DataFrame:
    """A row for each distinct item and shingle: ``id`` (long), ``item``, ``n`` words, ``k`` words a shingle, ``m`` shingles, ``least`` to share, and of each shingle ``h``
    the count ``c`` and whether it is ``rare``."""
    item = items.select(F.col(item_key).alias("item"), _words(text).alias("w")).where(F.size("w") > 0)
    item = item.select(F.xxhash64("item", F.size("w"), "w").alias("id"), "item", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
    at = F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("at")
    hashed = F.coalesce(*[F.when(F.col("k") == k, _shingle("w", F.col("at"), k)) for k in range(1, SHINGLE + 1)])
    # Fully repeated items are one: their rows have equal ids and places.
    each = item.select("id", "item", "n", "k", "w", at).select("id", "item", "n", "k", "at", hashed.alias("h")).distinct()
    counted = each.groupBy("id", "item", "n", "k", "h").agg(F.count("*").cast("int").alias("c"))
    m = F.col("n") - F.col("k") + 1
    spread = counted.join(counted.groupBy("h", "k").agg(F.count("*").alias("df")), ["h", "k"])
    before = F.sum("c").over(Window.partitionBy("id").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1))
    rare = F.coalesce(before, F.lit(0)) <= F.col("m") - F.col("least")
    return spread.withColumn("m", m).withColumn("least", _least_shared(F.col("m"), similarity)).withColumn("rare", rare).drop("df")


def _matches(docs: DataFrame, items: DataFrame, key: str, item_key: str, text: str, similarity: float, radius: int) -> DataFrame | None:
    """``r1``, ``r2``, ``doc``, ``item``, ``start`` and ``score`` of each window that matches; None without any item."""
    item = stored(_items(items, item_key, text, similarity))
    # Of bounded size: the lengths of shingles in use, five at most.
    sizes = sorted(r.k for r in item.select("k").distinct().collect())
    if not sizes:
        return None
    widest = item.agg(F.max("m")).first()[0]
    has = bloom_has(bloom_filter(item.select("h").distinct()))

    # Each position's shingles, tested where they are made: the generated loop carries the words by reference.
    texts = docs.select(*_identity(key, text), _words(text).alias("w"))
    at = texts.select("r1", "r2", "w", F.explode(F.when(F.size("w") >= sizes[0], F.sequence(F.lit(0), F.size("w") - sizes[0]))).alias("p"))
    hashed = at.select("r1", "r2", F.size("w").alias("words"), "p", *[_shingle("w", F.col("p"), k).alias(f"h{k}") for k in sizes])
    some = hashed.where(F.array_contains(F.array(*[F.coalesce(has(F.col(f"h{k}")), F.lit(False)) for k in sizes]), True))
    seeds = some.select("r1", "r2", "words", "p", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in sizes]))).where("h is not null")
    seeds = stored(seeds.join(few(item.select("k", "h").distinct()), ["k", "h"]).distinct())

    rare = item.where("rare").select("h", "k", "id", "n", "m", "least")
    first = seeds.join(few(rare), ["h", "k"]).select("r1", "r2", "words", "k", "id", "n", "m", "least", F.col("p").alias("p0")).where("n <= words")
    # All shingles of the candidate item near its rare one: those of a document meet by stretches as long as the longest item.
    stretch = lambda c: F.floor(F.col(c) / widest).cast("int")
    first = first.select("*", F.explode(F.array(stretch("p0") - 1, stretch("p0"), stretch("p0") + 1)).alias("stretch"))
    near = first.join(seeds.select("r1", "r2", "k", "p", "h", stretch("p").alias("stretch")), ["r1", "r2", "k", "stretch"]).where(F.abs(F.col("p") - F.col("p0")) < F.col("m"))
    own = near.join(few(item.select("id", "h", "c")), ["id", "h"])
    hits = stored(own.select("r1", "r2", "words", "id", "n", "k", "m", "least", "p", "h", "c").distinct())

    # Windows with enough of them, by the first.
    place = Window.partitionBy("r1", "r2", "id").orderBy("p")
    runs = hits.withColumn("i", F.row_number().over(place)).withColumn("before", F.lag("p").over(place))
    ends = runs.select("r1", "r2", "id", F.col("i").alias("j"), F.col("p").alias("end"))
    runs = runs.withColumn("j", F.col("i") + F.col("least") - 1).join(ends, ["r1", "r2", "id", "j"])
    lo = F.greatest(F.lit(0), F.coalesce(F.col("before") + 1, F.lit(0)), F.col("p") - F.col("m") + F.col("least"), F.col("end") - F.col("m") + 1)
    hi = F.least(F.col("p"), F.col("words") - F.col("n"))
    window = stored(runs.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").select("r1", "r2", "id", "n", "k", "m", F.explode(F.sequence("lo", "hi")).alias("start")))

    # The windows' fingerprints, from the texts of documents that have any.
    found = stored(window.select("r1", "r2").distinct())
    seen = bloom_has(bloom_filter(found.select("r1").distinct()))
    again = docs.select(F.col(key).alias("doc"), F.col(text).alias("t"), *_identity(key, text)).where(seen(F.col("r1")))
    again = again.join(few(found), ["r1", "r2"]).distinct().select("doc", "r1", "r2", _words("t").alias("w"))
    starts = window.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "m", "k")).alias("starts"))
    of = again.join(starts, ["r1", "r2"]).select("doc", "r1", "r2", "w", F.inline("starts"))
    made = of.select("doc", "r1", "r2", "start", "m", "k", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("p"), "w")
    shingle = F.coalesce(*[F.when(F.col("k") == k, _shingle("w", F.col("p"), k)) for k in sizes])
    bits = made.select("doc", "r1", "r2", "start", "m", "k", shingle.alias("h")).groupBy("doc", "r1", "r2", "start", "m", "k").agg(*_counts("h", F.lit(1)))
    printed = stored(bits.select("doc", "r1", "r2", "start", "m", "k", _fingerprint().alias("print")))
    weighed = item.select("id", "item", "n", "k", "m", "h", "c").groupBy("id", "item", "n", "k", "m").agg(*_counts("h", F.col("c")))
    item_print = weighed.select("id", "item", "n", "k", "m", _fingerprint().alias("item_print"))

    left = window.join(printed, ["r1", "r2", "start", "m", "k"]).select("doc", "r1", "r2", "id", "start", "m", "print", F.inline(_blocks("print", radius)))
    right = item_print.select("id", "item", "item_print", F.inline(_blocks("item_print", radius)))
    near = left.join(few(right), ["id", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    # Pairs meet in every block that agrees.
    near = near.select("doc", "r1", "r2", "id", "item", "start", "m").distinct()
    inside = near.join(hits.select("r1", "r2", "id", "p", "h", "c"), ["r1", "r2", "id"]).where((F.col("p") >= F.col("start")) & (F.col("p") < F.col("start") + F.col("m")))
    each = inside.groupBy("doc", "r1", "r2", "id", "item", "start", "m", "h", "c").agg(F.count("*").alias("times"))
    shared = each.groupBy("doc", "r1", "r2", "item", "id", "start", "m").agg(F.sum(F.least("times", "c")).alias("shared"))
    return shared.withColumn("score", F.col("shared") / (2 * F.col("m") - F.col("shared"))).where(F.col("score") >= similarity)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """Pairs of document and item: both keys, ``similarity`` of the best window and ``first_word``, the least place of such a window."""
    found = _matches(docs, items, key, item_key, text, similarity, radius)
    if found is None:
        return docs.select(F.col(key), F.lit(None).cast(items.schema[item_key].dataType).alias(item_key), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("first_word")).where("false")
    best = F.min(F.struct((-F.col("score")).alias("s"), "start"))["start"].cast("long")
    return found.groupBy(F.col("doc").alias(key), F.col("item").alias(item_key)).agg(F.max("score").alias("similarity"), best.alias("first_word"))


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they are. A document is known by its key and text, so others with the same key, or none, stay."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = _matches(own, items.select(F.col(item_key).alias("item_key"), F.col(item_text).alias("text")), "key", "item_key", "text", SIMILARITY, RADIUS)
    if found is None:
        return docs
    gone = stored(found.select("r1", "r2").distinct())
    return docs.select(F.struct("*").alias("row"), *_identity(key, text)).join(few(gone), ["r1", "r2"], "left_anti").select("row.*")


#: The same for DuckDB by brute force over windows that share a shingle with an item of five words or more.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '.,;:!?"''()[]{}', ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '.,;:!?"''()[]{}', ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), bs AS (
  SELECT item_id, n, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)
), c AS (
  SELECT DISTINCT doc_id, item_id, n, unnest(range(i - n + 5, i + 1)) AS a FROM ds JOIN bs USING (s)
), v AS (
  SELECT c.* FROM c JOIN d USING (doc_id) WHERE a >= 1 AND a + n - 1 <= len(w)
), x AS (
  SELECT v.doc_id, v.item_id, v.n, v.a, ds.s, count(*) AS k FROM v JOIN ds ON ds.doc_id = v.doc_id AND ds.i BETWEEN v.a AND v.a + v.n - 5 GROUP BY ALL
), y AS (
  SELECT item_id, s, count(*) AS k FROM bs GROUP BY ALL
), z AS (
  SELECT doc_id, x.item_id, n, a, sum(least(x.k, y.k)) AS shared FROM x JOIN y ON x.item_id = y.item_id AND x.s = y.s GROUP BY ALL
), q AS (
  SELECT doc_id, item_id, a, shared::DOUBLE / (2 * (n - 4) - shared)::DOUBLE AS score FROM z
)
SELECT doc_id, item_id, max(score) AS similarity, arg_min(a - 1, (-score, a))::BIGINT AS first_word
FROM q WHERE score >= 0.8 GROUP BY doc_id, item_id
"""
