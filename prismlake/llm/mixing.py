"""Mixing sources to target weights over fixed-length blocks of words.

Each source's documents form one stream of words, packed into blocks of
``block`` words; the words left over form a last, shorter block.  A source's
target is dealt in slots, pass after pass over its blocks, the last pass being
cut to the words that remain.  In each pass, slot ``i`` takes the full block
``p(i)`` of the pass's pseudorandom permutation ``p`` of the source's block
numbers (a mixed-radix Feistel network with cycle walking); the shorter block
comes last.  Every slot falls into an output shard by a uniform hash draw, so
the source counts per shard are multinomial while each source's total stays at
its target.  Slots and blocks meet in a join on the block number.

Only DataFrame functions are used.  Prefix sums run in two levels (buckets of a
source, then inside a bucket), so that a hot source never sits in one task.

Defined results for odd input: null texts have no words and are taken 0 times; a
null source is a source of its own, last in order.  Sources without words get
target 0.  Repeated rows are separate documents, so equal rows may be taken
differently but each at most twice its size.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources in code-point order, null last, get the weights in turn.  Targets
    share ``share`` times all sizes by weight; no target exceeds ``most`` times
    its source's size, and the excess goes by weight to the sources below theirs.
    Capping in order of ``most * size / weight`` reaches that fixed point in one
    pass: a source is capped when its share of what the sources before it left is
    above its cap.  This table has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    up = by.rowsBetween(Window.unboundedPreceding, -1)
    down = by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(down))
    s = s.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.min(F.struct(F.when(F.col("free"), F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))).alias("o"), F.col("level").alias("l"))).over(whole)
    return s.withColumn("target", F.when(F.col("free"), level["l"] * F.col("weight")).otherwise(F.col("cap"))).select("source", "source_size", "target")


def _feistel_once(x: Column, a: Column, b: Column, key: Column, rounds: int = 4) -> Column:
    """A permutation of 0..a*b-1 by alternating additions modulo ``a`` and ``b``."""
    hi, lo = F.floor(x / b).cast("long"), F.pmod(x, b)
    for r in range(rounds):
        if r % 2:
            lo = F.pmod(lo + F.pmod(F.xxhash64(hi, key, F.lit(r)), b), b)
        else:
            hi = F.pmod(hi + F.pmod(F.xxhash64(lo, key, F.lit(r)), a), a)
    return hi * b + lo


def permuted(i: Column, n: Column, key: Column, walks: int = 48) -> Column:
    """Place of slot ``i`` under the key's permutation of 0..n-1.

    Values at or above n walk on; fewer than sqrt(n) + 1 of the a*b values are,
    so ``walks`` steps leave a chance below n ** (-walks / 2) for n > 2.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    first = F.struct(i.cast("long").alias("x"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        y = _feistel_once(s["x"], a, b, key)
        return F.when(s["done"], s).otherwise(F.struct(y.alias("x"), (y < n).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, step)["x"]


def _source_key() -> Column:
    """Groups like the source, null being a value of its own that joins find."""
    return F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("v"))


def _plan(df: DataFrame, weights: tuple[float, ...], share: float, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(documents with source_size, target and start; targets per source).

    ``start`` counts the words of the source's stream before the document.
    """
    d = df.withColumn("__b", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int")).withColumn("__s", _source_key())
    sums = d.groupBy("__s", "__b").agg(F.sum("size").alias("__z"))
    sizes = sums.groupBy("__s").agg(F.sum("__z").alias("source_size"))
    tgt = targets(sizes.select(F.when(~F.col("__s.n"), F.col("__s.v")).alias("source"), "source_size"), weights, share)
    known = tgt.select(_source_key().alias("__s"), "source_size", "target")
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("__s", "__b", F.coalesce(F.sum("__z").over(before), F.lit(0)).alias("__first")).join(known, "__s")
    rest = sorted(c for c in df.columns if c not in ("source", "doc_id", "size"))
    inside = Window.partitionBy("__s", "__b").orderBy("doc_id", "size", *rest).rowsBetween(Window.unboundedPreceding, -1)
    docs = d.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(first, ["__s", "__b"])
    return docs.withColumn("start", F.col("__first") + F.col("__in")).drop("__b", "__first", "__in"), tgt


def slots(tgt: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """One row per slot of all passes: source, pass, block number, words taken from it, output shard."""
    full, goal = F.floor(F.col("source_size") / block).cast("long"), F.floor("target").cast("long")
    plan = tgt.filter("source_size > 0").withColumns({"__goal": goal, "__full": full, "__each": F.ceil(F.col("source_size") / block).cast("long")})
    passes = F.floor(F.col("__goal") / F.col("source_size")).cast("long")
    n = passes * F.col("__each") + F.ceil((F.col("__goal") - passes * F.col("source_size")) / block).cast("long")
    # Long sources are dealt in runs of slots so that no task expands a whole source.
    run = 4096
    runs = plan.withColumn("__n", n).filter("__n > 0").withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / run).cast("long"))))
    # A fixed number of partitions: runs are tiny before they are expanded and would be put together.
    runs = runs.repartition(int(tgt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "__r")
    each = runs.withColumn("slot", F.explode(F.sequence(F.col("__r") * run, F.least(F.col("__n"), (F.col("__r") + 1) * run) - 1)))
    each = each.withColumns({"pass": F.floor(F.col("slot") / F.col("__each")).cast("long"), "__i": F.pmod("slot", "__each")})
    key = F.xxhash64("source", F.lit(seed), "pass")
    place = F.when(F.col("__i") < F.col("__full"), permuted(F.col("__i"), F.greatest(F.col("__full"), F.lit(1)), key)).otherwise(F.col("__full"))
    left = F.least(F.col("source_size"), F.col("__goal") - F.col("pass") * F.col("source_size")) - F.col("__i") * block
    return each.select(
        F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("v")).alias("__s"),
        "pass",
        place.alias("block"),
        F.least(F.lit(block).cast("long"), left).alias("words"),
        F.pmod(F.xxhash64("source", "slot", F.lit(seed + 1)), F.lit(shards)).cast("int").alias("shard"),
    )


def draw_counts(tgt: DataFrame, block: int = 256, shards: int = 64, seed: int = 7) -> DataFrame:
    """The multinomial draw: slots and words per output shard and source."""
    source = F.when(~F.col("__s.n"), F.col("__s.v")).alias("source")
    return slots(tgt, block, shards, seed).groupBy("shard", source).agg(F.count("*").alias("slots"), F.sum("words").alias("words"))


def _spans(docs: DataFrame, tgt: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """A row per document, block it touches and slot of that block, with the range of its words that the slot takes (lo >= hi: none)."""
    nowhere = -1 - F.pmod(F.xxhash64("doc_id"), F.lit(1024))
    touched = F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long"))
    spans = docs.withColumn("block", F.explode(F.when(F.col("size") > 0, touched).otherwise(F.array(nowhere))))
    # Slots grow with the input: never broadcast.
    drawn = spans.join(slots(tgt, block, shards, seed).hint("merge"), ["__s", "block"], "left")
    at = F.col("block") * block
    lo = F.greatest(F.col("start"), at) - F.col("start")
    hi = F.least(F.col("start") + F.col("size"), at + F.coalesce("words", F.lit(0))) - F.col("start")
    return drawn.withColumns({"lo": lo, "hi": F.greatest(lo, hi)})


def taken(df: DataFrame, block: int = 256, shards: int = 64, seed: int = 7, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, buckets: int = 1024) -> DataFrame:
    """Rows of doc_id, source, size (words) with source_size, target, ``taken`` (words the mix takes, repeats counted)
    and ``shards`` (output shards that get words of the document, each with their number)."""
    docs, tgt = _plan(df.select("doc_id", "source", "size"), weights, share, buckets)
    got = F.col("hi") - F.col("lo")
    part = F.when(got > 0, F.struct("shard", got.alias("words")))
    spans = _spans(docs, tgt, block, shards, seed).groupBy("__s", "doc_id", "start", "size", "source_size", "target")
    found = spans.agg(F.sum(got).alias("taken"), F.collect_list(part).alias("__parts"), F.count_if(F.col("block") < 0).alias("empties"))
    # Repeated rows without words share a place in the stream and are told apart by their number alone.
    rows = found.withColumn("__r", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("empties", F.lit(1).cast("long")))))
    source = F.when(~F.col("__s.n"), F.col("__s.v")).alias("source")
    words = lambda k: F.aggregate(F.filter("__parts", lambda p: p["shard"] == k), F.lit(0).cast("long"), lambda t, p: t + p["words"])
    each = F.transform(F.array_sort(F.array_distinct(F.transform("__parts", lambda p: p["shard"]))), lambda k: F.struct(k.alias("shard"), words(k).alias("words")))
    return rows.select("doc_id", source, "size", "source_size", "target", "taken", each.alias("shards"))


def mixed_documents(df: DataFrame, text: str = "text", block: int = 256, shards: int = 64, seed: int = 7, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, buckets: int = 1024, shard: str | None = None) -> DataFrame:
    """The mix itself: a row per run of a document's words that a pass takes, the whole document in a whole pass.

    Rows keep the input's columns; a row of a whole document keeps its text as it
    is, a row of a run has the text from the run's first word to its last.
    Documents without words have nothing to take and give no row.  ``shard`` names
    a column to add for the output shard; runs then end where the shard changes.
    """
    keep = df.columns
    sized = df.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.struct(*[F.col(c) for c in keep]).alias("__row"))
    docs, tgt = _plan(sized, weights, share, buckets)
    docs = docs.filter("size > 0")
    narrow = docs.drop("__row")
    drawn = _spans(narrow, tgt, block, shards, seed).filter("hi > lo").groupBy("__s", "start").agg(F.sort_array(F.collect_list(F.struct("pass", "lo", "hi", "shard"))).alias("__parts"))
    # Documents with words have each their own start; a doc_id may be null.
    joined = docs.join(drawn, ["__s", "start"])
    run = "struct<pass:bigint,lo:bigint,hi:bigint,shard:int>"

    def extend(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        glued = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["pass"].alias("pass"), last["lo"].alias("lo"), x["hi"].alias("hi"), last["shard"].alias("shard"))))
        meets = (last["pass"] == x["pass"]) & (last["hi"] == x["lo"])
        if shard:
            meets &= last["shard"] == x["shard"]
        return F.when(F.size(runs) == 0, F.array(x)).when(meets, glued).otherwise(F.concat(runs, F.array(x)))

    every = joined.withColumn("__run", F.explode(F.aggregate("__parts", F.array().cast(f"array<{run}>"), extend)))
    words = F.regexp_extract_all(F.col(f"__row.{text}"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.rtrim(F.array_join(F.slice(words, (F.col("__run.lo") + 1).cast("int"), (F.col("__run.hi") - F.col("__run.lo")).cast("int")), ""))
    out = every.withColumn("__text", F.when((F.col("__run.lo") == 0) & (F.col("__run.hi") == F.col("size")), F.col(f"__row.{text}")).otherwise(part))
    columns = {c: F.col(f"__row.{c}") for c in keep} | {text: F.col("__text")}
    if "n_chars" in keep:
        columns["n_chars"] = F.length("__text").cast("long")
    if shard:
        columns |= {shard: F.col("__run.shard")}
    return out.select(*[columns[c].alias(c) for c in dict.fromkeys([*keep, *([shard] if shard else [])])])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return taken(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")
