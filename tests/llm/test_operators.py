"""Every operator against a brute-force version on a small table with odd rows."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismlake.llm import byte_bpe, exact_dedup, html_text, jaccard_join, language_model, mixing, quality_model, quality_rules, sharding, sstable
from prismlake.llm.components import connected_components
from prismlake.llm.storage import fresh_path, written
from prismlake.llm.textkernel import mix64

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
STORY = " ".join(f"w{i % 37}x{i % 11}" for i in range(120))


def _rows():
    rows = [
        (1, "Plain text here", "a"), (2, None, "a"), (3, "", None), (4, "  \n\t ", "b"), (5, "plain TEXT here", "b"),
        (6, STORY, "a"), (7, STORY.upper(), "c"), (8, STORY + " tail", "a"), (9, "z " + STORY + " tail end", None),
        (10, "é É ß x   y", "b"), (11, "one two three four five", "a"), (12, "ONE two three four five", "a"),
        (13, "a b c a b c a b c", "b"), (14, "x" * 3000 + " y", "c"), (15, " lead  double   triple \n\n lines \n", "c"),
        (16, " ".join(f"t{i}" for i in range(3000)), "a"), (17, "\x1c odd \x1f controls \x85 here", "b"), (18, "#$% |<>| &&& ***" * 30, "c"),
        (19, "line one\nline two\nline one\n\nline two", "a"), (20, "don't we'll THEY'RE 12345 🙂🙂", None), (21, "Plain text here", "a"),
    ]
    return rows + [(21, "Plain text here", "a"), (22, "ß" * 80 + " <|endoftext|> end", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with the operators' results ride along."""
    rows = [(i, t, s, 7, "clash", 1.0, i) for i, t, s in _rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, ids string, score double, start long").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_sharding(docs, none):
    narrow = docs.select("doc_id", "text")
    placed = sharding.number_slots(sharding.assign(narrow, "doc_id", sharding.topology(40), sharding.topology(41)), "shard", "doc_id", buckets=3)
    rows = placed.collect()
    assert len(rows) == len(_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.number_slots(sharding.assign(none.select("doc_id"), "doc_id", sharding.topology(40)), "shard", "doc_id").count() == 0


def test_sharding_moves_and_weights(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    out = sharding.assign(keys, "k", sharding.topology(40), sharding.topology(41))
    assert out.filter("shard <> grown_shard AND grown_shard <> 40").count() == 0
    assert 300 < out.filter("grown_shard = 40").count() < 700
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 1.4 * min(sizes)
    base = sharding.topology(40)
    heavy = tuple(sharding.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 7 else 1.0) for s in base)
    moved = sharding.assign(keys, "k", base, heavy).filter("shard <> grown_shard")
    # A heavier leaf draws keys into its own region, rack and leaf; no others trade keys.
    region = {s.shard: s.region for s in base}
    assert {region[r["grown_shard"]] for r in moved.select("grown_shard").distinct().collect()} == {region[7]}


def test_sharding_query_on_odd_rows(spark, docs, tmp_path):
    """Sizes, checksums, law and slots of null, empty, long and repeated texts, and of null identifiers."""
    long = "é🙂 word " * 60_000
    odd = [(i, t) for i, t, _ in _rows()] + [(None, "no identifier"), (None, None), (99, long), (98, long), (21, "Plain text here")]
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "size": F.lit(1)})
    extra.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op1_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key") for i, t in odd)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in rows) == want
    home, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        home[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    assert all(len(v) == 1 for v in home.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.op1_sharding(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_exact_dedup_repeated_owners_and_hot_groups(spark):
    """Exactly one row a group stays, whatever repeats, in tries of all sizes."""
    rows = [(k % 7 if k % 5 else None, "hot Copy") for k in range(400)] + [(5, "twice"), (5, "TWICE"), (None, "none"), (None, "none"), (3, ""), (3, None)]
    rows += [(k, f"text {k}") for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    for budget in (300, 1 << 20):
        out = exact_dedup.deduplicate(table, local_budget=budget).cache()
        largest = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
        want = [(i, largest[k], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i in v]
        assert collected(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
        kept = Counter((r["text_sha256"], r["doc_id"]) for r in out.filter("kept").collect())
        assert kept == Counter((hashlib.sha256(k.encode()).hexdigest(), largest[k]) for k in groups)


def test_exact_dedup(docs, none):
    out = exact_dedup.deduplicate(docs)
    groups = defaultdict(list)
    for i, t, _ in _rows():
        groups[(t or "").translate(LOWER)].append(i)
    want = [(i, max(v), len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i in v]
    assert collected(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = [(r["text_sha256"], r["doc_id"]) for r in out.filter("kept").collect()]
    assert len(kept) == len(groups) and len(set(kept)) == len(kept)
    assert exact_dedup.deduplicate(none).count() == 0


def test_exact_dedup_small_budgets_and_smallest(docs):
    own = exact_dedup.owners(docs, keep="smallest", budget=900, local_budget=500)
    groups = defaultdict(list)
    for i, t, _ in _rows():
        groups[(t or "").translate(LOWER)].append(i)
    assert collected(own, "keep_id", "group_size") == sorted(((min(v), len(v)) for v in groups.values()), key=repr)


def test_patricia_trie_spills():
    keys = [hashlib.sha256(str(i % 300).encode()).digest() * (1 + i % 3) for i in range(900)] + [b"", b"\0", b"\0\0"]
    trie = exact_dedup.PatriciaTrie(lambda a, b: a + b, budget=20_000)
    for k in keys:
        trie.insert(k, 1)
    assert trie.spilled
    assert dict(trie.items()) == Counter(keys)


def _shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


def _linked(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    find = _components(links)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=repr)


def test_jaccard_join(docs, none):
    got = collected(jaccard_join.link(docs), "doc_id", "n_shingles", "component_id")
    assert got == _linked([(i, t) for i, t, _ in _rows()])
    assert jaccard_join.link(none).count() == 0


def test_jaccard_join_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for size in (5, 6, 7, 8, 9, 12, 17, 24, 33, 60, 130, 400):
        base = [f"b{size}_{k}" for k in range(size + 4)]
        for _ in range(14):
            w = list(base)
            for k in rng.choice(len(w), int(rng.integers(0, max(2, size // 18))), replace=False):
                w[k] = f"n{rng.integers(1 << 30)}"
            cut = int(rng.integers(0, size // 6 + 1))
            rows.append((i, " ".join(w[cut:])))
            i += 1
    got = collected(jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == _linked(rows)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """Runs of equal signatures cut into parts of two, hot groups of copies, and links that only further candidates find."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    rng = np.random.default_rng(9)
    rows = [(k, "c one two three four five six") for k in range(40)]
    for group in range(6):
        base = [f"g{group}_{k}" for k in range(44)]
        for k in range(9):
            w = list(base)
            w[int(rng.integers(0, 44))] = f"n{rng.integers(1 << 30)}"
            w[(7 * k) % 44] = f"m{k % 4}"
            rows.append((1000 + 10 * group + k, " ".join(w)))
    got = collected(jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "doc_id", "n_shingles", "component_id")
    assert got == _linked(rows)


def test_part_enum_signatures_meet():
    rng = np.random.default_rng(3)
    for size in (1, 3, 4, 7, 8, 13, 21, 30, 47, 90, 250, 900):
        for _ in range(12):
            pool = np.sort(mix64(rng.integers(1, 1 << 62, 3 * size, dtype=np.uint64)))
            a = rng.choice(pool, size, replace=False)
            b = np.setdiff1d(pool, a)
            drop = int(rng.integers(0, size // 9 + 1))
            other = np.concatenate([a[drop:], b[:drop]])
            x, y = np.sort(a), np.sort(other)
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (2 * size - common):
                sx, sy = np.concatenate(jaccard_join.signatures(x)), np.concatenate(jaccard_join.signatures(y))
                assert len(np.intersect1d(sx, sy))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 560)]
    find = _components([e for e in edges if e[0] != e[1]])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}


def test_language_model(docs, none):
    low = lambda t: [*words(t), "</s>"]
    rows = _rows()
    learnt = [low(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for x in learnt for w in x)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for x in learnt for p in zip(["<s>", *x], x, strict=False))
    after, before = defaultdict(list), Counter(w for _, w in pairs)
    for (a, _), k in pairs.items():
        after[a].append(k)

    def discounts(counts):
        m = [sum(k == j for k in counts) for j in (1, 2, 3, 4)]
        if not all(m):
            return 0.5, 0.75, 0.9
        y = m[0] / (m[0] + 2 * m[1])
        return tuple(min(max(j - (j + 1) * y * m[j] / m[j - 1], 0.05), j - 0.05) for j in (1, 2, 3))

    d2, d1, total = discounts(pairs.values()), discounts(before.values()), sum(before.values())
    mass = sum(d1[min(k, 3) - 1] for k in before.values()) / total

    def p(a, w):
        lower = mass / (v + 1) + (max(before[w] - d1[min(before[w], 3) - 1], 0) / total if before[w] else 0)
        if a not in after:
            return lower
        k, s = pairs.get((a, w), 0), sum(after[a])
        return (max(k - d2[min(k, 3) - 1], 0) / s if k else 0) + sum(d2[min(j, 3) - 1] for j in after[a]) / s * lower

    # The model is a distribution: over its words and one unknown the probabilities sum to 1.
    for context in ("<s>", "plain", "never seen"):
        assert math.isclose(sum(p(context, w) for w in c) + p(context, "unknown word"), 1, rel_tol=1e-9)
    training = docs.filter(~language_model.held_out(F.col("doc_id")))
    # However many contexts are spread over all buckets, the model is the same.
    for share, spread in ((1.0, 1), (0.002, 20), (0.0, 60)):
        model = language_model.train(training, chunk=50, share=share, sample=1.0)
        assert (model.train_tokens, model.vocabulary) == (n, v) and len(model.hot[0]) >= spread
        got = {(r["doc_id"], r["n_tokens"], r["n_known"]): r for r in language_model.score(docs, model).collect()}
        for i, t, _ in rows:
            x = low(t)
            r = got[(i, len(x), sum(c[w] > 0 for w in x))]
            assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
            assert math.isclose(r["score"], sum(math.log10(p(a, w)) for a, w in zip(["<s>", *x], x, strict=False)), rel_tol=1e-9)
    empty = language_model.train(none)
    assert empty.train_tokens == 0 and language_model.score(none, empty).count() == 0
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in language_model.score(docs, empty).collect())


def test_packed_arrays_hold_large_counts():
    given = [np.array(x, dtype=np.uint64) for x in ([], [0, 255], [256], [1 << 16, 3], [(1 << 32) - 1], [1 << 32], [(1 << 64) - 1, 0])]
    back = language_model._unpack(language_model._pack(*given), len(given))
    assert [x.tolist() for x in back] == [x.tolist() for x in given] and [x.itemsize for x in back] == [1, 1, 2, 4, 4, 8, 8]


def test_model_files_read_where_they_cannot_be_mapped(tmp_path, monkeypatch):
    for k in range(5):
        language_model._store(str(tmp_path), f"words-{k:05d}", np.arange(100, dtype=np.uint64) + k, np.full(100, k + 1))
    from pyarrow import fs

    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(language_model, "filesystem", lambda path: (store, "."))
    held = language_model.Arrays("elsewhere", 8, most=700)
    for k in (0, 1, 2, 3, 4, 0, 7, 4):
        got = held.get(f"words-{k:05d}", 2)
        assert (got is None) == (k == 7) and (got is None or (got[0][0], got[1][0]) == (k, k + 1))
        assert held.held <= 700


def test_mixing(docs, none):
    rows = _rows()
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    out = mixing.taken(sized, block=16, buckets=4)
    got = out.collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    size, used, goal = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        used[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert r["source_size"] >= r["size"] and 0 <= r["taken"] <= 2 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, want = 1.5 * sum(size.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        for s in over or list(open_):
            want[s] = 2.0 * size[s] if over else share[s]
            left -= want[s]
            open_.discard(s)
    for s in order:
        assert math.isclose(goal[s], want[s]) and used[s] == math.floor(want[s] + 1e-9)
    assert collected(out, *out.columns) == collected(mixing.taken(sized.repartition(5), block=16, buckets=4), *out.columns)
    assert mixing.taken(none, block=16).count() == 0

    mixed = mixing.mixed_documents(docs, block=16, buckets=4)
    assert mixed.columns == docs.columns
    counts = Counter()
    texts = {i: t for i, t, _ in rows}
    for r in mixed.collect():
        counts[r["source"]] += len(WORD.findall(r["text"]))
        assert r["text"] in texts[r["doc_id"]] and r["size"] == 7
    assert counts == +used
    assert mixing.mixed_documents(none).count() == 0


def test_mixing_deals_every_pass(spark):
    """Capped sources are dealt in slots as well, and shards account for every word taken."""
    rows = [(i, f"s{i % 3}", 5 + 7 * i % 40) for i in range(60)]
    out = mixing.taken(spark.createDataFrame(rows, "doc_id long, source string, size long"), block=16, shards=5, buckets=4).cache()
    tgt = out.select("source", "source_size", "target").distinct()
    dealt = mixing.slots(tgt, 16, 5, 7).collect()
    for t in tgt.collect():
        mine = [r for r in dealt if r["__s"]["v"] == t["source"]]
        goal, n = math.floor(t["target"]), -(-t["source_size"] // 16)
        assert sum(r["words"] for r in mine) == goal
        for k in range(goal // t["source_size"]):
            assert sorted(r["block"] for r in mine if r["pass"] == k) == list(range(n))
        if goal == 2 * t["source_size"]:
            assert [[r["block"] for r in mine if r["pass"] == k] for k in (0, 1)] != [list(range(n))] * 2
    assert any(r["target"] == 2 * r["source_size"] for r in tgt.collect())
    words = Counter()
    for r in out.collect():
        assert sum(s["words"] for s in r["shards"]) == r["taken"]
        for s in r["shards"]:
            words[s["shard"], r["source"]] += s["words"]
    counts = {(r["shard"], r["source"]): (r["slots"], r["words"]) for r in mixing.draw_counts(tgt, 16, 5, 7).collect()}
    assert {k: w for k, (_, w) in counts.items()} == words and sum(n for n, _ in counts.values()) == len(dealt)

    texts = spark.createDataFrame([(i, s, " ".join(f"d{i}w{k}" for k in range(n))) for i, s, n in rows], "doc_id long, source string, text string")
    mixed = mixing.mixed_documents(texts, block=16, shards=5, buckets=4, shard="shard")
    got = Counter()
    for r in mixed.collect():
        got[r["shard"], r["source"]] += len(r["text"].split())
    assert mixed.columns == [*texts.columns, "shard"] and got == words


def test_mixing_permutation(spark):
    for n in (1, 2, 3, 7, 10, 97, 1000):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(12345).cast("long")).alias("p")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n))


def test_token_shards(spark, docs, none):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = fresh_path(spark, "test-shards")
    manifest, _ = written(sstable.write_shards(docs, path, P.path("word_bpe_49k.json"), shard_bytes=300), "manifest")
    assert manifest.count() > 1
    got = sorted(sstable.read_shards(manifest, path).collect(), key=lambda r: r["start"])
    ids = {(i, t): np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t, _ in _rows()}
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted(i for i, _, _ in _rows())
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got) == sorted((i, ids[i, t]) for i, t, _ in _rows())
    manifest, _ = written(sstable.write_shards(none, path + "-none", P.path("word_bpe_49k.json")), "manifest")
    assert sstable.read_shards(manifest, path + "-none").count() == 0


def test_token_shards_null_and_repeated_ids(spark):
    """Every row is found under its identifier, whichever file and task wrote it, and no key repeats."""
    rows = [(None, f"null {k}") for k in range(40)] + [(7, f"seven {k % 9}") for k in range(90)] + [(k, f"own {k}") for k in range(-20, 60, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = fresh_path(spark, "test-shards")
    manifest, _ = written(sstable.write_shards(table, path, P.path("word_bpe_49k.json"), shard_bytes=200), "manifest")
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((i, np.array([*lib.encode(t).ids, 1], "<u2").tobytes()) for i, t in rows)
    keys, found = [], Counter()
    for r in manifest.collect():
        name = f"{path}/{r['shard']}"
        with open(name, "rb") as f:
            reader = sstable.ShardReader(f, os.path.getsize(name))
            keys += [k for k, _ in reader.scan()]
            found.update((i, v) for i in {i for i, _ in rows} for v in reader.find(i))
    assert len(set(keys)) == len(keys) == len(rows) and found == want
    back = sorted(sstable.read_shards(manifest, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))


def test_word_tokenizer_fuzz():
    from hypothesis import given, settings
    from hypothesis import strategies as s

    name = P.path("word_bpe_49k.json")
    lib, coder, whole = Tokenizer.from_file(name), sstable.WordTokenizer(name, memo=60), sstable.WordTokenizer(P.path("byte_bpe_50k.json"))
    assert coder.by_word and not whole.by_word  # another splitter: the library does it all
    odd = list(" \n\t\r\x0b\x1c\x85\xa0\u1680\u2028\u3000abZ'Éß×÷ÅåŁİΣ1²!<|>🙂\u0301\u0308K\ufb01") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL"]

    @settings(max_examples=200, deadline=None)
    @given(s.lists(s.none() | s.lists(s.sampled_from(odd), max_size=14).map("".join) | s.text(alphabet=s.characters(blacklist_categories=("Cs",)), max_size=20), max_size=6))
    def check(texts):
        for c, own in ((coder, lib), (whole, whole.lib)):
            ids, at = c.encode(pa.array(texts, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]

    check()


def test_shard_file_lookup(tmp_path):
    from hypothesis import given, settings
    from hypothesis import strategies as s

    @settings(max_examples=40, deadline=None)
    @given(s.dictionaries(s.none() | s.integers(-(1 << 63), (1 << 63) - 1), s.binary(max_size=60).map(lambda b: b[: len(b) // 2 * 2]), max_size=80))
    def check(table):
        name = tmp_path / "x.sst"
        order = sorted(table, key=lambda k: (k is not None, k))
        writer = sstable.ShardWriter(open(name, "wb"), 2, block_bytes=200)
        for k in order:
            writer.add(sstable.key_bytes(k), table[k])
        writer.close()
        with open(name, "rb") as f:
            reader = sstable.ShardReader(f, name.stat().st_size)
            assert [(sstable.key_id(k), v) for k, v in reader.scan()] == [(k, table[k]) for k in order]
            assert all(list(reader.find(k)) == [table[k]] for k in table)
            assert all(list(reader.find(k)) == [] for k in (None, -5, 0, 12345) if k not in table)

    check()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body class="page">
<header><h1>Site name</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies to make this long enough to look like text.</div>
<main><div class=ad>Buy things now, a long advert text that goes on and on for a while.</div>
<article><h1>The  title</h1><p>First &amp; <b>best<br>text <p>Second &lt;p&gt; &#233;&nbsp;x &am</p><ul><li>one<li>two</ul>loose text<form>mail <input></form>
<section id="comments"><p>Reader: nice.</p></section></article><aside>side</aside></main><div id="sidebar"><p>Side text that is rather long, too, and dense, and without links.</p></div><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    want = "The title\nFirst & best text\nSecond <p> é x &am\none\ntwo\nloose text"
    assert html_text.extract(PAGE) == want
    rows = [(1, PAGE, "old"), (2, None, "old"), (3, "", None), (4, "<p>", "x"), (5, "bare text", "x"), (6, "<div><p>" + "long text " * 50000, "x"), (1, PAGE, "old"), (7, "<" * 50 + "a < b", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract_text(df).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    by = {r["page_id"]: r for r in got}
    assert by[2]["text"] == by[3]["text"] == by[4]["text"] == "" and by[5]["text"] == "bare text"
    assert by[6]["n_chars"] == 500000 - 1 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_density_decides(monkeypatch):
    """Marked furniture goes by its density alone; with any constant density it would stay."""
    assert "Reader: nice." not in html_text.extract(PAGE)
    plain = "<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><p>" + "Words of the text. " * 9 + "</p><p>" + "And more of them here. " * 6 + "</p></div></body>"
    kept = html_text.extract(plain)
    assert "Words" in kept and "Three" not in kept
    for value in (0.0, 1.0):
        monkeypatch.setattr(html_text, "_density", lambda n, body, v=value: v)
        assert "Reader: nice." in html_text.extract(PAGE) and "Buy things" in html_text.extract(PAGE)
    monkeypatch.setattr(html_text, "_density", lambda n, body: 1.0)
    assert "Three" in html_text.extract(plain)


def test_html_several_articles_and_parts():
    p = lambda k, n=8: f"<p>{('Part %d has words. ' % k) * n}</p>"
    many = "<body><nav><a href=1>menu</a></nav>" + "".join(f"<article><h2>T{k}</h2>{p(k)}{p(k)}</article>" for k in range(3)) + "</body>"
    assert [f"T{k}" in html_text.extract(many) for k in range(3)] == [True] * 3
    nested = "<body><ul><li><a href=1>menu</a><li><a href=2>menu</a></ul><div><h1>Head</h1><p>Yes.</p><section>" + p(1) * 6 + "</section><section>" + p(2) + "</section></div></body>"
    assert html_text.extract(nested).split("\n")[:2] == ["Head", "Yes."] and "Part 2" in html_text.extract(nested) and "menu" not in html_text.extract(nested)


def test_html_composite_density_brute_force():
    """Densities, core and threshold against a plain recursive reading of the formula on random trees."""
    rng = np.random.default_rng(8)

    def grow(depth):
        if depth == 0 or rng.random() < 0.25:
            return "x" * int(rng.integers(0, 30))
        tag = str(rng.choice(["div", "p", "a", "b", "section", "nav"]))
        if tag in ("p", "a"):
            depth = 1  # they close when nested
        return f"<{tag}>" + " ".join(grow(depth - 1) for _ in range(int(rng.integers(1, 4)))) + f"</{tag}>"

    def count(n):
        """(chars, tags, link chars, link tags) of a node."""
        c = t = lc = lt = 0
        for k in n.kids:
            if isinstance(k, str):
                c += len("".join(k.split()))
            else:
                x = count(k)
                c, t, lc, lt = c + x[0], t + 1 + x[1], lc + x[2], lt + x[3] + (k.tag in ("a", "nav"))
        return c, t, c if n.tag in ("a", "nav") else lc, t if n.tag == "nav" else lt

    def density(n, body):
        c, t, lc, lt = count(n)
        if not c:
            return 0.0
        bc, _, blc, _ = count(body)
        base = math.log(c / max(1, c - lc) * lc + blc / max(1, bc) * c + math.e)
        if n.tag == "nav":
            lc *= 2
        return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / (math.log(base) if base > 1 else 1)

    for _ in range(150):
        root = html_text.parse("<body>" + "".join(grow(4) for _ in range(4)) + "</body>")
        order = html_text._measure(root)
        body = next(n for n in order if n.tag == "body")
        core, path, threshold = html_text.select(order, body)
        for n in order:
            assert math.isclose(n.density, density(n, body), rel_tol=1e-9, abs_tol=1e-12)

        def inside_furniture(n):
            return n is not None and (n.density < 0 or inside_furniture(n.parent))

        sums = {}
        for n in order:
            if count(n)[0] and n.tag in html_text.BLOCK and not inside_furniture(n):
                sums[n] = sum(max(0.0, density(k, body)) for k in n.kids if not isinstance(k, str) and k.tag in html_text.BLOCK) or density(n, body)
        if core is None:
            assert not sums
        elif sums:
            assert math.isclose(sums.get(core, 0.0), max(sums.values()), rel_tol=1e-9, abs_tol=1e-12)
            assert threshold == min(n.density for n in path) and path[0] is core and path[-1] is body


def test_html_without_article_marks():
    page = "<body><div class=menu><a href=1>One</a><a href=2>Two</a></div><div><h2>Head</h2><p>" + "Some words of the text. " * 8 + "</p><p>" + "And more of them here. " * 6 + "</p></div><div><a href=3>a</a> <a href=4>b</a></div></body>"
    assert html_text.extract(page).split("\n") == ["Head", ("Some words of the text. " * 8).strip(), ("And more of them here. " * 6).strip()]


def test_quality_classifier(spark, docs, none):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["the", "of", "sand", "river", "it", "was", "old", "stone"], 60)) for _ in range(300)]
    bad = [" ".join(w + "###" for w in t.split()) if k % 2 else (t[:30] + "\n") * 12 for k, t in enumerate(good)]
    rows = [(i, t, int(i < 300)) for i, t in enumerate(good + bad)] + [(None, "the river", 1), (900, None, 0), (901, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    weights = quality_model.fit_on_labels(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = quality_model.score(df.withColumn("score", F.lit("clash")), weights).filter(quality_model.held_out(F.col("doc_id")) & (F.col("doc_id") < 600)).collect()
    assert len(got) > 100 and sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in quality_model.score(docs, weights).collect())
    flat = quality_model.fit_on_labels(none.select("doc_id", "text"), df.select("doc_id", "quality").limit(0))
    assert {r["score"] for r in quality_model.score(docs, flat).collect()} == {0.5}
    assert quality_model.score(none, weights).count() == 0
    assert {r["predicted"] for r in quality_model.score(docs, flat).collect()} == {0}


def test_ftrl_against_plain_updates():
    """The fitted weights equal those of the published update rule, one coordinate at a time."""
    rng = np.random.default_rng(12)
    setting = quality_model.Ftrl(alpha=0.3, beta=0.7, l1=0.01, l2=0.02, epochs=2)
    rows = []
    for _ in range(120):
        place = rng.choice(40, int(rng.integers(1, 9)), replace=False)
        rows.append((place, rng.normal(0, 1, len(place)), float(rng.integers(0, 2))))
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= setting.l1:
            return 0.0
        return -(z[i] - math.copysign(setting.l1, z[i])) / ((setting.beta + math.sqrt(n[i])) / setting.alpha + setting.l2)

    for _ in range(setting.epochs):
        for place, value, y in rows:
            w = {int(i): weight(int(i)) for i in place}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * v for i, v in zip(place, value, strict=True))))
            for i, v in zip(map(int, place), value, strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / setting.alpha * w[i]
                n[i] += g * g
    assert np.allclose(quality_model.fit_ftrl(rows, 40, setting), [weight(i) for i in range(40)], rtol=1e-5, atol=1e-7)


def test_classifier_features_brute_force():
    """Shares of n-grams by how often they occur, and the number of different 1- and 2-grams, of odd texts."""
    texts = [t for _, t, _ in _rows()]
    token = re.compile("[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+")
    size = 1 << 18
    for t, (places, values) in zip(texts, quality_model.features(pa.array(texts), 18), strict=True):
        w = token.findall((t or "").translate(LOWER))
        got = dict(zip(places.tolist(), values.tolist(), strict=True))
        assert got.pop(size) == 1.0
        different = 0
        for n in (1, 2, 3):
            grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            share = [0.0] * 6
            for c in grams.values():
                share[min(5, math.ceil(math.log2(c)))] += c / sum(grams.values())
            assert np.allclose([got.pop(size + 1 + 6 * (n - 1) + k, 0.0) for k in range(6)], share)
            different += len(grams) * (n < 3)
        # Few places collide among so many; each has the same value and all together length 1.
        assert different - 10 - different**2 / size <= len(got) <= different and (not got or math.isclose(sum(v * v for v in got.values()), 1))


def test_byte_bpe(docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(docs, path, P.PATTERN)
    want = sorted(((i, np.array(lib.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, _ in _rows()), key=repr)
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got.collect()), key=repr) == want
    back = byte_bpe.decode(got, path, P.PATTERN).filter(F.col("decoded") != F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    assert back.count() == 0 and byte_bpe.encode(none, path, P.PATTERN, decoded=True).count() == 0


def test_byte_bpe_fuzz():
    from hypothesis import given, settings
    from hypothesis import strategies as s

    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.tokenizer(path, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    assert sorted(bpe.mph.at) == list(range(bpe.mph.n)) and all(bpe.mph.slot(k) == i for i, k in enumerate(bpe.slot_key))

    @settings(max_examples=300, deadline=None)
    @given(s.text(alphabet=s.sampled_from(list(" \n\t\r\x0b\x1c\x85 　ab'stXé1²!?🙂ń")), max_size=40) | s.text(alphabet=s.characters(blacklist_categories=("Cs",)), max_size=30))
    def check(text):
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()

    check()


def _measures(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), t.count("!"))


def test_quality_rules(spark, docs, none):
    extra = spark.createDataFrame([(100 + k, " ".join(np.random.default_rng(k).choice(list("abc"), 5 + 9 * k)), "a") for k in range(12)], "doc_id long, text string, source string")
    table = docs.select("doc_id", "text", "source").unionByName(extra).withColumn("n_words", F.lit("clash"))
    texts = [(r["doc_id"], r["text"]) for r in table.collect()]
    led = quality_rules.ledger(table)
    assert collected(led, "doc_id", *quality_rules.MEASURES) == sorted(((i, *_measures(t)) for i, t in texts), key=repr)
    base = quality_rules.apply_policy(led, "base")
    fails = lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0]
    assert collected(base, "doc_id", "kept") == sorted(((i, not fails(_measures(t))) for i, t in texts), key=repr)
    words_ = ["w%d" % (k % 5000) for k in range(30_000)] + ["x%d" % k for k in range(40_000)] + ["w1", "w2", "w3"]
    lengthy = spark.createDataFrame([(1, " ".join(words_)), (2, "r s t " * 30_000)], "doc_id long, text string")
    assert [r["n_repeat_words"] for r in quality_rules.ledger(lengthy).orderBy("doc_id").collect()] == [_measures(" ".join(words_))[4], 90_000]
    rows = {r["rule"]: r for r in quality_rules.ablation(led, "v1").collect()}
    bits = [r["fail_bits"] for r in led.collect()]
    for rule in quality_rules.RULES:
        b = 1 << rule.bit
        assert rows[rule.name]["n_failed"] == sum(bool(x & b) for x in bits)
        assert rows[rule.name]["n_failed_alone"] == sum(x == b for x in bits)
        assert rows[rule.name]["n_kept_without"] == sum(not x & ~b for x in bits)
    assert quality_rules.ledger(none).count() == 0
