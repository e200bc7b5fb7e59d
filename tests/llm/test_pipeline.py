"""Every stage of the pipeline against brute force on a small table with odd rows."""

import base64
import os
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline

DATA = os.environ.get("PRISMLAKE_TESTDATA", "/root/testdata/sf0.001")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"ids": F.lit("clash"), "size": F.lit(1)})
    odd = [(None, "no identifier", None, None, 13), (-1, None, "en", "src0", 0), (-2, "", None, "src1", 0), (-3, "said twice " * 9, "en", "odd", 99), (-3, "said twice " * 9, "en", "odd", 99), (-4, "SAID twice " * 9, None, None, None)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"ids": F.lit("clash"), "size": F.lit(1)})
    return table.unionByName(more).cache()


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_stages_are_named_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "tokens"]


def test_quality(spark, docs):
    out = corpus_pipeline.quality(spark, docs, DATA)
    assert out.columns == docs.columns
    kept = Counter(r[0] for r in rows(out))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good, bad = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert sum(kept[i] > 0 for i in good) >= 0.98 * len(good) and sum(kept[i] == 0 for i in bad) >= 0.5 * len(bad)


def test_exact(spark, docs):
    out = corpus_pipeline.exact(spark, docs, DATA)
    assert out.columns == docs.columns
    best = {}
    for i, t, _ in rows(docs):
        k = (t or "").translate(LOWER)
        best[k] = i if best.get(k) is None else best[k] if i is None else max(best[k], i)
    assert sorted(((t or "").translate(LOWER), i) for i, t, _ in rows(out)) == sorted(best.items())


def _sets(rs):
    for i, t, _ in rs:
        w = words(t)
        yield i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near(spark, docs):
    single = docs.dropDuplicates(["doc_id"])
    out = corpus_pipeline.near(spark, single, DATA)
    assert out.columns == docs.columns
    sets, parent = list(_sets(rows(single))), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a2, b2 = sorted((find(a), find(b)), key=lambda v: (v is None, v))
                if a2 != b2:
                    parent[b2] = a2
    assert sorted(map(repr, (i for i, _, _ in rows(out)))) == sorted(repr(i) for i, _ in sets if find(i) == i)


def test_near_under_null_and_repeated_ids(spark):
    """Texts under one identifier go or stay each by its own links; rows without words stay."""
    text = lambda k, n=60, cut=0: " ".join(f"w{k}x{i}" for i in range(cut, n))
    given = [
        (5, text(1)), (None, text(1, cut=1)), (None, text(2)), (None, text(3)), (None, text(3, cut=2)), (None, text(3).replace(" ", "  ")),
        (7, text(4)), (7, text(5)), (6, text(4, cut=2)), (9, text(5, cut=1)), (8, text(6)), (8, text(6, cut=1)), (8, text(7)),
        (None, ""), (None, None), (5, ""), (2, " "), (10, text(8)), (11, text(8, cut=3)), (12, text(3, cut=1)),
    ]
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sets = [s for _, s in _sets((i, t, None) for i, t in given)]
    group = list(range(len(given)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((given[k][0] for k in range(len(given)) if group[k] == g), key=lambda v: (v is None, v or 0)) for g in group}
    linked = corpus_pipeline.jaccard_join.link(table)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in linked.collect()) == Counter((i, len(sets[k]), least[group[k]]) for k, (i, _) in enumerate(given))
    out = rows(corpus_pipeline.near(spark, table, DATA))
    place = {}
    for k, (_, t) in enumerate(given):
        place.setdefault(t, group[k])
    assert Counter(place[t] for _, t, _ in out if words(t)) == Counter({g: 1 for k, g in enumerate(group) if sets[k]})
    assert all(i == least[place[t]] for i, t, _ in out if words(t))
    assert Counter((i, t) for i, t, _ in out if not words(t)) == Counter((i, t) for i, t in given if not words(t))


def test_mix(spark, docs):
    out = corpus_pipeline.mix(spark, docs, DATA)
    assert out.columns == docs.columns
    size, got, most = Counter(), Counter(), defaultdict(int)
    for i, t, s in rows(docs):
        size[s] += len(WORD.findall(t or ""))
        most[i] += 2 * len(WORD.findall(t or ""))
    for i, t, s in rows(out):
        got[s] += len(WORD.findall(t))
        most[i] -= len(WORD.findall(t))
    assert min(most.values()) >= 0
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, goal = 1.5 * sum(size.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        for s in over or list(free):
            goal[s] = 2.0 * size[s] if over else share[s]
            left -= goal[s]
            free.discard(s)
    assert all(abs(got[s] - goal[s]) <= 1 for s in order)


def test_tokens(spark, docs):
    out = corpus_pipeline.tokens(spark, docs, DATA)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, np.array(lib.encode_ordinary(t or ""), "<u4").tobytes(), t or "") for i, t, _ in rows(docs))
    assert Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in out.collect()) == want


def test_whole_run_and_empty_tables(spark, docs, tmp_path):
    plain = docs.drop("ids", "size")
    plain.filter("doc_id IS NULL OR doc_id % 3 = 0").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), DATA).count() == 0
