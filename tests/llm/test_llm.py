"""Operators on small tables against brute force, with nulls, empty, blank, long and repeated rows and columns of clashing names."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voltaic.llm import bpe, components, decontaminate, kneser_ney, language_id, near_dedup, quality_rules, queries, simhash_dedup, substring_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
MULTI, JSON, RANKS = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def rows():
    """Documents with every awkward case."""
    rng = random.Random(5)
    words = ["the", "of", "Alpha,", "beta", "gamma.", "é", "naïve", "漢字", "x1", "don't"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long_ = text(60), text(3_000)
    out = [(i, text(rng.randrange(1, 120))) for i in range(30)]
    out += [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, long_), (35, long_), (36, long_ + " tail"), (None, text(50)), (None, None)]
    out += [(40, text(20) + " " + passage + " " + text(20)), (41, passage), (42, text(5) + "\n" + passage), (43, "a b " * 200), (44, "same"), (44, "same")]
    out += [(45, "Is it  two   spaces?\n\n 'tis \t 😀 ok\x00."), (46, text(100)), (47, "word " * 40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_words string, kept string, d1 string, node string, h string"
    full = [(i, t, ["en", "fr", None][k % 3], "s", len(t or ""), *["x"] * 6) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema).repartition(4)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def words(t):
    return (t or "").encode().split()


def key(r):
    return tuple((x is None, x) for x in r)


def tik(path):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_that_of_tiktoken_and_round_trips(docs, rows):
    enc = tik(MULTI)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    got = [tuple(r) for r in bpe.round_trip(docs, MULTI).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_bpe_spans_and_decoding(docs, rows):
    out = bpe.decode(bpe.encode(docs, MULTI, checked="same"), MULTI).collect()
    assert all(r.same for r in out) and len(out) == len(rows)
    for r in out:
        t = r.text or ""
        assert bytes(r.decoded) == t.encode()
        assert all(0 <= a <= b <= len(t) for a, b in zip(r.char_starts, r.char_ends))
        assert not t or (r.char_starts[0] == 0 and r.char_ends[-1] == len(t))


def test_cut_words_equal_whole_texts():
    import pyarrow as pa

    rng = random.Random(1)
    letters = "ab C1é漢'st \n\t 　😀-.,  \r\x1c ᠎́​٣"
    fuzz = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4_000)]
    for path, literal in ((MULTI, False), (JSON, False), (JSON, True)):
        e = bpe.Encoder(path, literal)
        e.REMEMBERED = 500
        got = [x for i in range(0, 4_000, 100) for x in e.encode(pa.array(fuzz[i : i + 100]))]
        assert got == e._whole(fuzz)
        if path == JSON:
            t = Tokenizer.from_file(JSON)
            t.encode_special_tokens = literal
            assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in fuzz]
    assert np.frombuffer(bpe.Encoder(JSON).encode(pa.array(["hello <|endoftext|> world"]))[0], "<u4").tolist() == [31373, 220, 50256, 995]


def test_token_output(spark, docs, rows, tmp_path):
    from voltaic.llm import token_output

    path = f"file://{tmp_path}/tokens"
    token_output.write_tokens(docs, path, JSON, 2, meta=("lang",))
    t = Tokenizer.from_file(JSON)
    start, expected = 0, []
    got = sorted(token_output.token_digest(spark, path).collect(), key=lambda r: r.start)
    by_id = collections.defaultdict(list)
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        by_id[i].append((len(ids), crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in by_id[r.doc_id]
        start += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x)) and len(got) == len(rows)
    with pytest.raises(ValueError):
        token_output.write_tokens(docs, path + "2", JSON, 2, meta=("ids",))
    expected = token_output.read_tokens(spark, path, ("doc_id", "lang")).count()
    assert expected == len(rows)


def test_token_counts(docs, rows):
    vocab = set(bpe.read_ranks(RANKS))
    most = max(map(len, vocab))

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next(j for j in range(min(len(w), i + most), i, -1) if w[i:j] in vocab)
            i, n = j, n + 1
        return n

    expected = [(i, len(words(t)), sum(greedy(b" " + w) for w in words(t))) for i, t in rows]
    got = [tuple(r) for r in token_counts.token_counts(docs, RANKS).select("doc_id", "n_words", "n_tokens").collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    a = token_counts.Automaton([b"ab", b"abcd", b"c"])
    assert a.count([b"abc", b"abcd", b"abx", b"", b"d"]).tolist() == [2, 1, 1, 0, 1]


def fingerprint(t, k=4):
    w = [x.translate(simhash_dedup._LOWER) for x in words(t)]
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def test_simhash_components(docs, rows, monkeypatch):
    f = [fingerprint(t) for _, t in rows]
    root = groups(len(f), lambda a, b: (f[a] ^ f[b]).bit_count() <= 4)
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expected = [(i, x - (x >> 63 << 64), least.get(r)) for (i, _), x, r in zip(rows, f, root)]
    for chunk in (simhash_dedup.CHUNK, 3):
        monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
        got = [tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)


def test_index_on_dense_groups():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(2, 150))
        v = rng.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)[rng.integers(0, max(1, n // 8), n)]
        for _ in range(4):
            v = v ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        g = np.sort(rng.integers(0, 3, n))
        o = np.lexsort((simhash_dedup.gray_rank(v), g))
        v, g = v[o], g[o]
        assert groups(n, lambda a, b: g[a] == g[b] and int(v[a] ^ v[b]).bit_count() <= 4) == simhash_dedup.local_links(g, v, 4).tolist()  # noqa: B023


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.connected_components(edges.where("false")).count() == 0


def shingles(t, k=5):
    w = [x.translate(simhash_dedup._LOWER) for x in words(t)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def brute_near(rows):
    """Keys that stay: the least of each component of similar texts; blank texts all stay, repeated others once."""
    sets = [shingles(t) for _, t in rows]
    found = groups(len(rows), lambda a, b: similar(sets[a], sets[b]))
    least = {}
    for (i, _), s, g in zip(rows, sets, found):
        if s:
            least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    return sorted([(i is None, i or 0) for (i, _), s in zip(rows, sets) if not s] + list(least.values()))


def test_near_duplicates_stage(spark, monkeypatch):
    rng = random.Random(2)
    base = [[f"v{rng.randrange(5000)}" for _ in range(200)] for _ in range(12)]
    table = []
    for b in base:
        for e in range(4):
            w = list(b)
            for _ in range(e):
                w[rng.randrange(len(w))] = "zz"
            table.append(" ".join(w))
    # A chain whose ends aren't similar, and texts that share half of their words.
    line = [f"c{i}" for i in range(400)]
    table += [" ".join(line[8 * i : 8 * i + 150]) for i in range(12)] + [" ".join(line[:100] + [f"u{i}x{j}" for j in range(80)]) for i in range(12)]
    rows = list(enumerate(table)) + [(900, ""), (901, None), (902, "a"), (903, "a"), (903, "a"), (904, "\n"), (904, "\n"), (None, "some lonely words here now"), (None, None), (905, table[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("key", "h1", "k", "h", "_key", "row", "group", "node")])
    for chunk in (near_dedup.CHUNK, 2):
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        out = near_dedup.drop_near_duplicates(df)
        assert out.columns == df.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == brute_near(rows)


def test_pairs_that_fall_short_are_linked_through_others():
    a, b = np.arange(0, 100, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64)
    middle = np.arange(8, 110, dtype=np.uint64)
    sets = [a, middle, b, np.arange(1000, 1100, dtype=np.uint64)]
    assert [near_dedup._similar(sets[i], sets[j]) for i, j in ((0, 1), (1, 2), (0, 2))] == [True, True, False]
    assert near_dedup._across(sets, np.array([0, 0, 2, 3]), np.array([False, False, True, True])) == [(2, 1)]


def test_recall_of_near_duplicates(spark):
    """Pairs of a similarity just above the least."""
    rng = random.Random(8)
    rows, n = [], 300
    for i in range(n):
        w = [f"w{rng.randrange(100_000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((2 * i, " ".join(w)))
        while True:
            v = list(w)
            for _ in range(max(1, round(len(w) * rng.uniform(0.01, 0.024)))):
                v[rng.randrange(len(v))] = "other"
            x, y = shingles(" ".join(w)), shingles(" ".join(v))
            if 0.8 <= len(x & y) / len(x | y) <= 0.85:
                break
        rows.append((2 * i + 1, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(df).select("doc_id").collect()}
    assert {2 * i for i in range(n)} <= kept and len(kept) <= n + 0.03 * n


def brute_substrings(rows, window=35):
    seen = collections.Counter(tuple(words(t)[j : j + window]) for _, t in rows for j in range(len(words(t)) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4_000, 1])
def test_substrings(docs, rows, group):
    got = [tuple(r) for r in substring_dedup.repeated_spans(docs, group=group).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=key) == sorted(brute_substrings(rows), key=key)
    assert any(r[2] for r in got)


def test_tree_nodes_are_words():
    rng = random.Random(3)
    for window in (1, 2, 3, 7, 8, 35):
        lines = [b" ".join(rng.choice([b"a", b"b", b"ab"]) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
        node, sizes = substring_dedup.window_nodes(lines, window)
        paths = [tuple(x.split()[i : i + window]) for x in lines for i in range(len(x.split()) - window + 1)]
        assert len(paths) == len(node) == sizes.sum()
        assert len(set(zip(paths, node.tolist()))) == len(set(paths)) == len(set(node.tolist()))
    assert substring_dedup.window_nodes([], 35)[0].tolist() == []


def test_substrings_of_a_hot_prefix(spark):
    """Ten words that begin very many passages, a few of which repeat."""
    rng = random.Random(7)
    head = " ".join(f"h{i}" for i in range(10))
    tails = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    rows = [(i, " ".join([f"b{rng.randrange(10**6)}" for _ in range(5)] + [head] + ([tails[i % 6]] if i % 50 == 0 else [f"r{rng.randrange(10**6)}" for _ in range(30)]))) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for group in (4_000, 100):
        got = [tuple(r) for r in substring_dedup.repeated_spans(d, group=group).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert sorted(got) == sorted(brute_substrings(rows))


def test_substring_texts(docs, rows):
    out = substring_dedup.dedup_texts(docs)
    assert out.schema == docs.schema
    n = collections.Counter((i, h) for i, _, _, h in brute_substrings(rows))
    got = out.collect()
    assert collections.Counter((r.doc_id, hashlib.sha256(b" ".join(words(r.text))).hexdigest()) for r in got) == n
    assert sum(r.text is None for r in got) == sum(t is None for _, t in rows)


def test_quality_rules_match_sql(docs, rows):
    duck = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    expected = duck.sql(quality_rules.ORACLE_SQL).fetchall()
    out = quality_rules.assess(docs.select("doc_id", "text", "kept")).drop("text")
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(expected, key=key)
    one, two = (quality_rules.keep_good(docs, order=o).count() for o in (None, ["symbols", "repeats", "few_words", "long_words", "duplicate_lines", "capitals"]))
    assert one == two == sum(r[-1] for r in expected)


def test_quality_rules_under_any_names(docs, rows):
    odd = docs.withColumns({c: F.lit(1) for c in ("_text", "_words", "_row", "_hashes", "_places", "_kept", "_runs", "_file", "n_symbols")})
    assert quality_rules.keep_good(odd).columns == odd.columns
    out = quality_rules.assess(odd).collect()
    assert len(out) == len(rows) and all(r._text == 1 and r._hashes == 1 and r._row == 1 for r in out)
    assert any(r.n_symbols != 1 for r in out)


def test_the_order_follows_rejections_and_costs(spark, tmp_path):
    text = ["# " * 20 + "x", "several words of a plain text that no rule has anything against at all"]
    for k in range(12):
        rows = [(i, text[k % 2]) for i in range(40)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    assert len(quality_rules._spread(df.select("text"))) == 8
    order = quality_rules.plan_cascade(df, sample_rows=80)
    assert sorted(order) == [r.name for r in quality_rules.rules()] and order[0] in ("symbols", "repeats")
    assert quality_rules.keep_good(df, order=order).count() == 240


def test_decontamination(spark, docs):
    rng = random.Random(3)
    item = lambda n: " ".join(f"q{rng.randrange(9999)}" for _ in range(n))
    items = [(i, item(30)) for i in range(5)] + [(7, None), (8, " "), (9, "tiny item"), (10, items0 := item(25)), (11, items0)]
    cut = items[1][1].split()
    cut[12] = "changed"
    table = [(0, item(40) + " " + items[0][1] + " end"), (1, " ".join(cut)), (2, item(80)), (3, None), (4, ""), (5, "some Tiny, item here"), (6, items0), (6, items0), (None, items[2][1]), (8, " ".join(items[3][1].split()[:20]))]
    d, b = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == {(0, 0), (5, 9), (6, 10), (6, 11), (None, 2)}  # (1, 1) shares 21 of 31 shingles only
    assert all(s == 1.0 for s in got.values())
    left = decontaminate.clean_documents(d, b)
    assert sorted(left.toPandas().doc_id.dropna()) == [1, 2, 3, 4, 8] and left.columns == d.columns
    assert decontaminate.contaminated(d, b.where("false")).count() == 0 and decontaminate.contaminated(d.where("false"), b).count() == 0
    # Others with a null key stay, under any names of columns; other names for key and text.
    more = d.union(spark.createDataFrame([(None, "quite another text of some more words"), (None, None)], d.schema))
    odd = more.withColumnsRenamed({"doc_id": "item", "text": "r1"}).withColumns({c: F.lit(1) for c in ("row", "h", "w", "doc", "p", "start", "key", "text")})
    left = decontaminate.clean_documents(odd, b, key="item", text="r1")
    assert left.columns == odd.columns and sum(r.item is None for r in left.collect()) == 2 and left.count() == 7
    assert decontaminate.clean_documents(d, b.where("false")).count() == d.count() and decontaminate.clean_documents(d.where("false"), b).count() == 0


def test_decontamination_of_many_items_of_one_size(spark):
    """Brute force over windows and items; many items share a long beginning, which names none of them."""
    rng = random.Random(4)
    common = " ".join(f"c{i}" for i in range(14))
    items = [(i, common + " " + " ".join(f"q{rng.randrange(99999)}" for _ in range(26))) for i in range(10_000)]
    docs = []
    for i in range(60):
        x = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            x[rng.randrange(len(x))] = "odd"
        docs.append((i, " ".join([*(f"z{rng.randrange(99)}" for _ in range(rng.randrange(30))), *x, "tail", common])))
    docs += [(100 + i, f"{common} and no more of it {i}") for i in range(200)] + [(300, (items[7][1] + " ") * 30)]

    def grams(t):
        w = t.split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    by_gram = collections.defaultdict(set)
    own = {i: collections.Counter(grams(t)) for i, t in items}
    for i, c in own.items():
        for g in c:
            by_gram[g].add(i)
    expected = {}
    for d, t in docs:
        g = grams(t)
        some = collections.Counter(i for x in set(g) if len(by_gram.get(x, ())) < 5 for i in by_gram[x])
        for i in some:
            m = 36
            best = max(((sum((collections.Counter(g[a : a + m]) & own[i]).values()), -a) for a in range(len(g) - m + 1)), default=(0, 0))
            if best[0] / (2 * m - best[0]) >= 0.8:
                expected[d, i] = (best[0] / (2 * m - best[0]), -best[1])
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.contaminated(d, b).collect()}
    near = lambda x: {k: (round(s, 9), w) for k, (s, w) in x.items()}
    assert near(got) == near(expected) and len(got) > 30
    # Only texts with a passage of an item of their own name pairs.
    pairs = decontaminate._matches(d, b, "doc_id", "item_id", "text", 0.8, 20).select("doc", "item").distinct().count()
    assert pairs == len(got)


def test_language_model(spark, docs, empty):
    docs = docs.withColumns({c: F.lit(1) for c in ("_trusted", "_held", "_row", "_text", "own", "n")})
    out = kneser_ney.classify(docs, docs.where("doc_id < 20").select("doc_id"))
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.count() == docs.count() and got[30].perplexity is None and not got[30].kept and got[5].kept
    assert kneser_ney.classify(empty, docs.select("doc_id")).count() == 0
    assert kneser_ney.classify(docs, docs.where("false").select("doc_id")).where("kept").count() == docs.where("length(text) > 0").count()


def test_language_profiles_letter_by_letter(spark):
    """Binding, bundling and cosines in plain loops."""
    rows = [(0, "abc ab", "x"), (1, "Bca!", "x"), (2, "ééa b", "y"), (3, "a", None), (4, "cab abé", None), (5, "ab", "y")]

    def runs(t):
        plain = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        return [plain[i : i + 3] for i in range(len(plain) - 2)]

    def vector(t):
        total = [0.0] * language_id.DIMENSIONS
        for run in runs(t):
            a, b, c = (language_id.letter_vector(ord(x)).tolist() for x in run)
            for i in range(len(total)):
                total[i] += a[i - 2] * b[i - 1] * c[i]
        return np.array(total) / np.linalg.norm(total)

    sums = {}
    for _, t, name in rows:
        if name:
            sums[name] = sums.get(name, 0) + vector(t)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(d, language_id.learn(d)).collect()}
    for i, t, _ in rows:
        cosine = {n: float(vector(t) @ v / np.linalg.norm(v)) for n, v in sums.items()}
        best = max(sorted(cosine), key=lambda n: cosine[n])
        assert got[i].lang_pred == best and got[i].score == pytest.approx(max(0, cosine[best]), abs=1e-4)
    tied = language_id.predict(d, dict.fromkeys(["b", "a"], next(iter(sums.values()))))
    assert {r.lang_pred for r in tied.collect()} == {"b"}  # the first of the given order, which learn() makes that of names


def test_language_id(spark, docs, empty):
    table = [(i, ["the house of the king and the queen", "la maison du roi et de la reine est là", "das haus der königin und des königs"][i % 3] + f" x{i}", ["en", "fr", "de"][i % 3]) for i in range(60)]
    d = spark.createDataFrame([*table, (90, "123 !?", None), (91, None, "en"), (92, "", "fr"), (93, "the " * 30_000, None)], "doc_id long, text string, lang string")
    protos = language_id.learn(d.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in language_id.predict(d, protos).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in table) and got[93].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (90, 91, 92))
    assert language_id.predict(empty, protos).count() == 0 and set(language_id.predict(docs, {}).toPandas().lang_pred) == {"und"}


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    table, labels = [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        w = [f"wo{rng.choice('abcdefgh')}d{rng.choice('xyz')}" for _ in range(50)] + (["dreadful", "insult"] if toxic else [])
        table.append((i, " ".join(w)))
        labels.append((i, toxic))
    d, lab = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([*labels, (999, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.learn(d, lab, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in toxicity.toxicity(d, m).collect()}
    assert all((got[i].score >= 0.3) == bool(t) for i, t in labels) and all(0 <= r.score <= 1 for r in got.values())
    x = m.vector("an insult, dreadful")
    place, cosine = m.nearest(x)
    full = sorted(((sum(x.get(i, 0) * m._block(p // toxicity.BLOCK)[i, p % toxicity.BLOCK] for i in x), -p) for p in range(len(m.labels))), reverse=True)[: toxicity.NEIGHBOURS]
    assert np.allclose([s for s, _ in full], cosine, atol=1e-6)
    assert toxicity.toxicity(docs, m).count() == docs.count() and toxicity.toxicity(empty, m).count() == 0
    none = toxicity.learn(d, lab.where("false"), F.lit(True))
    assert set(toxicity.toxicity(d, none).toPandas().score) == {0.0}


def test_curve_is_the_best_monotone_fit():
    rng = np.random.default_rng(2)
    x, w = np.sort(rng.random(60)), rng.integers(1, 5, 60).astype(float)
    y = (rng.random(60) < x).astype(float)
    at, value = toxicity._monotone(x, y, w)
    mean = lambda a, b: (y[a : b + 1] @ w[a : b + 1]) / w[a : b + 1].sum()
    best = [max(min(mean(a, b) for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.interp(x, at, value) == pytest.approx(best)
    at, value = toxicity._monotone(np.array([0.5, 0.2, 0.5, 0.2]), np.array([0.0, 0.0, 1.0, 0.0]), np.array([1.0, 1.0, 3.0, 1.0]))
    assert at.tolist() == [0.2, 0.5] and value.tolist() == [0.0, 0.75]  # ties get one score


def test_toxicity_learns_from_one_text_of_a_key(spark):
    rows = [(i, " ".join(["plain words here", "vile"][: 1 + i % 2])) for i in range(60)]
    d = spark.createDataFrame([*rows, *rows, (1, "zzz later text")], "doc_id long, text string")
    m = toxicity.learn(d, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"), F.lit(True))
    assert len(m.keys) == len(set(m.keys)) == 30 and set(m.labels) == {1.0}
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(rows, d.schema), m).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(60))


def test_votes_and_scores_in_plain_loops():
    rng = random.Random(5)
    rows = [(i, " ".join([rng.choice("red green blue grey".split()) for _ in range(20)] + (["vile"] * rng.randrange(1, 3) if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(120)]
    m = toxicity.fit(rows, {0: 160, 1: 40})  # each row of label 0 stands for two
    texts_ = {str(k): t for k, t, _ in rows}

    def vector(t):
        plain = toxicity._plain(t)
        raw = {}
        for i, term in enumerate(m.terms):
            n = sum(plain.startswith(term, j) for j in range(len(plain)))
            if n:
                raw[i] = (1 + np.log(n)) * m.idf[i]
        norm = np.sqrt(sum(v * v for v in raw.values()))
        return {i: v / norm for i, v in raw.items()}

    own = [vector(texts_[str(k)]) for k in m.keys]
    for t in ("vile words", "red vile vile", "nothing"):
        v = vector(t)
        cosine = [sum(v.get(i, 0) * x for i, x in e.items()) for e in own]
        near = sorted((p for p in range(len(own)) if cosine[p] > 0), key=lambda p: (-round(cosine[p], 6), p))[: toxicity.NEIGHBOURS]
        weight = [cosine[p] ** 2 * (2.0 if m.labels[p] == 0 else 1.0) for p in near]
        vote = (sum(x * m.labels[p] for x, p in zip(weight, near)) + toxicity.PRIOR_WEIGHT * m.prior) / (sum(weight) + toxicity.PRIOR_WEIGHT)
        place, found = m.nearest(m.vector(t))
        assert sorted(np.round(found, 5)) == sorted(np.round([cosine[p] for p in near], 5))
        assert m.vote(place, found) == pytest.approx(vote, abs=1e-4)


def test_token_files_allow_selective_reads(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    from voltaic.llm import token_output

    path = tmp_path / "tokens"
    token_output.write_tokens(docs.where("doc_id is not null"), f"file://{path}", JSON, 2, meta=("lang",))
    total = 0
    for f in path.glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings + columns["n_tokens"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            total += group.num_rows
    assert total == docs.where("doc_id is not null").count()
    plan = token_output.read_tokens(spark, f"file://{path}", ("doc_id", "n_tokens")).where("doc_id = 34")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "EqualTo(doc_id,34)" in plan


def test_intermediates_are_deleted(spark, docs):
    from voltaic.llm import common

    with common.intermediates(spark):
        table = common.stored(docs)
        path = table.inputFiles()[0]
        assert table.count() == docs.count()
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_queries_cover_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, f in queries.queries().items():
        found = f(spark, SF).count()
        assert found == n or name.startswith("op3")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < docs.count() and out.where("not round_trip").count() == 0
    assert set(docs.columns) < set(out.columns)


def test_empty_tables(empty):
    for df in (
        bpe.round_trip(empty, MULTI), token_counts.token_counts(empty, RANKS), simhash_dedup.near_duplicates(empty), near_dedup.drop_near_duplicates(empty),
        substring_dedup.repeated_spans(empty), substring_dedup.dedup_texts(empty), quality_rules.assess(empty), quality_rules.keep_good(empty),
    ):
        assert df.count() == 0


def brute_trigrams(trusted, text):
    """Perplexity of a text under interpolated modified Kneser-Ney word trigrams, straight from the formula."""
    from voltaic.llm.word_model import words as tokens

    seq = lambda t: ["<s>", "<s>", *tokens(t), "</s>"]
    three = collections.Counter(tuple(s[i : i + 3]) for t in trusted for s in [seq(t)] for i in range(len(s) - 2))
    two = collections.Counter(g[1:] for g in three)
    levels = [collections.Counter(g[1:] for g in two), two, three]
    unseen = 1 / (len(levels[0]) + 1)

    def p(g):
        if not g:
            return unseen
        c = levels[len(g) - 1]
        n = [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0
        d = [min(float(i), i - (i + 1) * y * n[i] / n[i - 1]) if n[i - 1] else 0.5 for i in (1, 2, 3)]
        d = [x if x > 0 else 0.5 for x in d]
        same = [x for k, x in c.items() if k[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        own = c[g] - d[min(c[g], 3) - 1] if c[g] else 0
        return own / sum(same) + sum(d[min(x, 3) - 1] for x in same) / sum(same) * p(g[1:])

    s = seq(text)
    return np.exp(-np.mean([np.log(p(tuple(s[i : i + 3]))) for i in range(len(s) - 2)]))


@pytest.mark.parametrize("hot", [100_000, 1])
def test_quality_is_of_word_trigrams(spark, monkeypatch, hot):
    from voltaic.llm import word_model

    monkeypatch.setattr(word_model, "HOT", hot)
    rng = random.Random(9)
    trusted = [" ".join(rng.choice(["The", "cat", "sat", "on", "a", "mat", "and", "left."]) for _ in range(rng.randrange(3, 25))) for _ in range(25)]
    other = ["the cat sat on a zebra", "mat mat mat mat", " \n ", "left.", trusted[3]]
    d = spark.createDataFrame([*enumerate(trusted + other), (3, trusted[3]), (None, "a cat"), (90, ""), (91, None)], "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    got = kneser_ney.classify(d, spark.range(25).withColumnRenamed("id", "doc_id")).collect()
    assert len(got) == 34 and all(r.perplexity is None and not r.kept for r in got if r.doc_id in (90, 91))
    learnt = [*trusted, trusted[3]]
    for r in got:
        if r.doc_id in (*range(0, 25, 6), *range(25, 30), None):
            assert r.perplexity == pytest.approx(brute_trigrams(learnt, "a cat" if r.doc_id is None else (trusted + other)[r.doc_id]), rel=1e-6)


@pytest.mark.parametrize("hot", [100_000, 2])
def test_quality_is_of_word_trigrams_in_slices(spark, monkeypatch, hot):
    """Many slices and shards, blocks of few texts, and middle words that go to several shards."""
    from voltaic.llm import word_model

    for name, value in (("HOT", hot), ("SHARD", 40), ("SLICE", 300), ("SLICES", 3), ("BLOCK", 60), ("COMMON", 20)):
        monkeypatch.setattr(word_model, name, value)
    rng = random.Random(11)
    some = ["the", "the", "the", "of", *(f"w{i}" for i in range(12))]
    rows = [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", None, " ", "the the zebra the"]
    d = spark.createDataFrame(list(enumerate(rows)), "block long, text string").withColumn("words", F.lit("en")).repartition(3)
    deals = []
    monkeypatch.setattr(word_model, "Deal", lambda *x, make=word_model.Deal: deals.append(make(*x)) or deals[-1])
    got = {r.block: r for r in kneser_ney.classify(d, spark.range(40).withColumnRenamed("id", "block"), "block", "text", "words").collect()}
    assert deals[0].slices == 3 and deals[0].shards > 3 and deals[0].wide
    assert len(got) == 64 and got[60].perplexity is None and got[61].perplexity is None and got[60].n_scored == 0
    for i in (*range(0, 60, 5), 62, 63):
        assert got[i].perplexity == pytest.approx(brute_trigrams(rows[:40], rows[i]), rel=1e-9)
    rest = [t for i, t in enumerate(rows[:40]) if crc32(str(i).encode()) % kneser_ney.HELD_OUT]
    held = [brute_trigrams(rest, t) for t in rows[:40] if t not in rest]
    assert min(held) * kneser_ney.MARGIN < got[0].threshold <= max(held) * kneser_ney.MARGIN * 1.001


def test_hashes_of_words_without_strings():
    """Equal to the words by pattern, in number and in which are equal."""
    from voltaic.llm import word_model

    rng = random.Random(1)
    some = [*map(chr, range(0x20, 0x250)), *"漢字かなไทย한국\u3000\u00a0\n\t_İßǅ²½Ⅷ\U0001f600\U00020001\u0663é", *(chr(rng.randrange(0x250, 0xD800)) for _ in range(3_000))]
    known = {}
    for _ in range(300):
        texts = [rng.choice([None, "", "".join(rng.choice(some if rng.random() < 0.5 else "ab c.") for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(1, 9))]
        hashes, many = word_model._hashed(texts)
        found = [word_model.words(t or "") for t in texts]
        assert many.tolist() == [len(w) for w in found]
        for w, h in zip([w for x in found for w in x], hashes.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 1_000


def test_order_of_words_counts_for_quality(spark):
    text = lambda k: " ".join(f"word{(k + i) % 40} then" for i in range(60))
    shuffled = text(0).split()
    random.Random(1).shuffle(shuffled)
    rows = [(i, text(i), "en") for i in range(60)] + [(100, " ".join(shuffled), "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in kneser_ney.classify(d, spark.range(50).withColumnRenamed("id", "doc_id")).collect()}
    assert all(got[i] for i in range(60)) and not got[100]


def test_quality_tells_words_of_every_script_apart(spark):
    # Over 64 characters, each its own letter; Latin texts hold the commonest places of any short alphabet.
    han = [chr(0x4E00 + i) for i in range(200)]
    greek = ["".join(chr(0x3B1 + (i * j) % 24) for j in range(1, 7)) for i in range(1, 40)]
    latin = [f"{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxyz0123456789" for b in "aeiou" for c in "xyz,.;:!?"]
    rng = random.Random(3)
    good = lambda units, gap: gap.join(units[(k + i) % len(units)] for k in [rng.randrange(len(units))] for i in range(80))
    rows = [(i, *[(good(han, ""), "zh"), (good(greek, " "), "el"), (" ".join(rng.sample(latin, 400)), "en")][i % 3]) for i in range(150)]
    junk = lambda units, gap: gap.join(rng.choice(units) for _ in range(80))
    rows += [(200, junk(han, ""), "zh"), (201, junk(greek, " "), "el"), (300, good(han, ""), "zh"), (301, good(greek, " "), "el")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in kneser_ney.classify(d, spark.range(150).withColumnRenamed("id", "doc_id")).collect()}
    assert not got[200].kept and not got[201].kept and got[300].kept and got[301].kept
    assert got[200].n_scored == 81


def test_limits_of_any_number_of_languages(spark):
    n = 100_500
    scored = spark.range(n).select(F.concat(F.lit("l"), "id").alias("lang"), F.lit(10.0).alias("perplexity"))
    by_lang, every = kneser_ney.limits(scored)
    assert by_lang.count() == n and every == pytest.approx(12.5, rel=1e-3)
    assert kneser_ney.limits(scored.where("false"))[1] is None


def test_toxicity_of_short_and_mixed_words(spark):
    rng = random.Random(6)
    table, marks = [], ["zq", "b4d", "x9", "毒物"]
    for i in range(800):
        toxic = int(i % 4 == 0)
        w = [f"wo{rng.choice('abcdefgh')}d{rng.choice('xyz')}" for _ in range(30)]
        mark = marks[i // 4 % 4]
        table.append((i, " ".join([*w, f"水{mark}火" if mark == "毒物" else mark, *w[:3]] if toxic else w), toxic))
    d = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string")
    m = toxicity.learn(d, spark.createDataFrame([(i, t) for i, _, t in table], "doc_id long, toxic int"), F.col("doc_id") % 3 != 2)
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, m).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in table)


def test_every_tied_term_is_kept():
    rows = [(i, " ".join(f"{'bad' if i % 2 else 'good'}{j}" for j in range(4_000)), i % 2) for i in range(40)]
    terms = set(toxicity.fit(rows, {0: 20, 1: 20}).terms)
    assert {f" {w}{j} " for w in ("bad", "good") for j in range(4_000)} <= terms


def test_repeats_are_sought_only_in_documents_that_are_left(docs):
    order = ["few_words", "symbols", "repeats", "long_words", "duplicate_lines", "capitals"]
    plan = quality_rules.keep_good(docs, order=order)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = max(i for i, line in enumerate(plan) if "xxhash64" in line)
    assert any("Filter" in line for line in plan[last + 1 :])
