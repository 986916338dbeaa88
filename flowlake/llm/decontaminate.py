"""Benchmark decontamination, with DataFrame functions only.

Windows of an item's own number of words are laid wherever a document shares a shingle of five words with it (a window
without one has similarity 0, so none is lost). Windows and items get 64-bit SimHash fingerprints of their words. A
multi-index over four blocks of sixteen bits finds every window within the radius of an item of that size: of four blocks
one at least differs in a quarter of the radius or less, and an item stands in the index under all such neighbours of its
blocks. The weighted Jaccard similarity of the shingles, by number of occurrences, verifies what is found. A window with a
rewritten end can be similar and far, so windows beyond the radius are verified too, against the items that they share a
shingle with; no pair is lost by its fingerprint. Words and shingles are compared by 64-bit hashes.

Words are lower-cased. Items of fewer than five words are one shingle. Null and blank texts or items match nothing; null ids
are compared as ids; repeated rows give one result; equal similarities take the first window. Texts of any length are read
whole; windows are rows of their own. Empty tables give an empty result. find_leaks carries no other columns, decontaminate
carries all, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, packed, shingle_hashes, small, stored, table, words

WIDTH, RADIUS, SIMILARITY = 5, 11, 0.8
_BLOCKS, _BITS = 4, 16


def _own(w: Column) -> Column:
    """Shingles of a window or item, numbered by occurrence, so that common elements count as often as both have them."""
    plain = F.coalesce(*[F.when(F.size(w) == k, shingle_hashes(w, k)) for k in range(1, WIDTH)], shingle_hashes(w, WIDTH))
    numbered = lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x)))
    return let(F.sort_array(plain), numbered)


def _fingerprint(w: Column) -> Column:
    """Majority of each bit over the words' hashes, each occurrence one vote."""
    one = F.lit(1).cast("long")
    ones = lambda h, b: F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.call_function("shiftright", x, b).bitwiseAND(one))
    vote = lambda h, b: F.when(ones(h, b) * 2 > F.size(h), F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(vote(h, b))))


def _block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, _BITS * i).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def _blocks(fingerprint: Column) -> Column:
    """(number, bits) of the blocks."""
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(fingerprint, i).alias("bits")) for i in range(_BLOCKS)])


def _neighbours(fingerprint: Column, radius: int) -> Column:
    """(number, bits) of all that differ from a block in radius / 4 bits or less."""
    masks = [sum(1 << b for b in c) for k in range(radius // _BLOCKS + 1) for c in combinations(range(_BITS), k)]
    every = F.array(*[F.lit(m) for m in masks])
    one = lambda i: F.transform(every, lambda m: F.struct(F.lit(i).alias("block"), _block(fingerprint, i).bitwiseXOR(m).alias("bits")))
    return F.flatten(F.array(*[one(i) for i in range(_BLOCKS)]))


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of numbered shingles."""
    return let(F.size(F.array_intersect(a, b)), lambda s: s / F.greatest(F.lit(1), F.size(a) + F.size(b) - s))


def _matches(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, radius: int, similarity: float) -> DataFrame:
    """doc_id, key (the text's hash), item_id, similarity, hamming, start of the windows at or above the similarity."""
    items = benchmark.select("item_id", words(F.lower(F.col(item_text))).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", "w", F.size("w").alias("n"), F.least(F.lit(WIDTH), F.size("w")).alias("width"))
    items = stored(items.select("*", _own(F.col("w")).alias("shingles"), _fingerprint(F.col("w")).alias("fp")))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # five at most
    words_of = docs.select("doc_id", F.xxhash64(text).alias("key"), words(F.lower(F.col(text))).alias("w"))
    hits = None
    for k in widths:  # items of five words and more are one pass; shorter ones, if any, have one for each length
        anchors = items.where(F.col("width") == k).select("n", F.posexplode(shingle_hashes(F.col("w"), k)).alias("offset", "h")).distinct()
        spots = words_of.where(F.size("w") >= k).select("doc_id", "key", F.size("w").alias("words"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("at", "h"))
        first = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("words") - F.col("n")))
        found = spots.join(small(anchors), "h").select("doc_id", "key", "n", first.alias("start")).distinct()
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], "doc_id long, key long, n int, start int")
    hits = stored(hits)
    per_doc = stored(hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("n", "start")).alias("windows")))
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.key") == F.col("p.key"))
    picked = docs.select("doc_id", F.xxhash64(text).alias("key"), F.col(text).alias("t")).alias("d").join(small(per_doc).alias("p"), same).select("d.doc_id", "d.key", "t", "windows").dropDuplicates(["doc_id", "key"])
    windows = picked.select("doc_id", "key", words(F.lower("t")).alias("w"), "windows").select("doc_id", "key", "w", F.explode("windows").alias("x"))
    windows = stored(windows.select("doc_id", "key", "x.n", "x.start", F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("w")))
    # A passage that many documents share is fingerprinted once.
    texts = stored(windows.select("n", "w").distinct().select("n", "w", _own(F.col("w")).alias("shingles"), _fingerprint(F.col("w")).alias("fp")))
    of_item = ["item_id", "n", F.col("shingles").alias("item_shingles"), F.col("fp").alias("item_fp")]
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    index = items.select(*of_item, F.explode(_neighbours(F.col("fp"), radius)).alias("b")).select("item_id", "n", "item_shingles", "item_fp", "b.block", "b.bits")
    near = texts.select("*", F.explode(_blocks(F.col("fp"))).alias("b")).select("n", "w", "shingles", "fp", "b.block", "b.bits").join(index, ["n", "block", "bits"])
    near = near.withColumn("hamming", hamming).where(F.col("hamming") <= radius).drop("block", "bits")
    far = texts.select("*", F.explode("shingles").alias("h")).join(small(items.select(*of_item, F.explode("shingles").alias("h"))), ["n", "h"])
    far = far.withColumn("hamming", hamming).where(F.col("hamming") > radius).drop("h")
    pairs = near.unionByName(far).dropDuplicates(["n", "w", "item_id"])
    pairs = pairs.withColumn("similarity", _similarity(F.col("shingles"), F.col("item_shingles"))).where(F.col("similarity") >= similarity)
    return windows.join(pairs.select("n", "w", "item_id", "similarity", "hamming"), ["n", "w"]).select("doc_id", "key", "item_id", "similarity", "hamming", "start")


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start_word of the best window of each pair at or above the similarity."""
    found = _matches(docs, benchmark, text, item_text, radius, similarity)
    best = F.max_by(F.struct("similarity", "hamming", "start"), F.struct("similarity", -F.col("hamming"), -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", F.col("b.hamming").cast("int").alias("hamming"), F.col("b.start").alias("start_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows, known by id and text, that leak an item."""
    flagged = stored(_matches(docs, benchmark, text, item_text, radius, similarity).select("doc_id", "key").distinct())
    rows = packed(docs, doc_id=F.col("doc_id"), key=F.xxhash64(text)).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key"))
    return rows.join(small(flagged).alias("f"), same, "left_anti").select("row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
SQL: dict[str, str] = {}
