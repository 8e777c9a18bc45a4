"""Benchmark decontamination with DataFrame functions only.

Texts become words (runs of letters and digits, in lower case). A window of a document has the size of a
benchmark item and slides over every word; at the end of a text it is shorter. A window can be similar enough
only if it holds enough shingles of items of its size: shared shingles over all shingles must reach the
threshold, which bounds the shared ones from below. And of the most similar windows one starts at a shingle of
an item, since one that starts elsewhere is no less similar when it starts a word later. So fingerprints are
made of the windows that start at such a shingle and hold that many; no other can be the best one, whatever was
moved, split or padded in the document.

Each window gets a 64-bit SimHash of its shingles, a shingle voting as often as it occurs. Fingerprints are cut
into ``BLOCKS`` blocks; two within the radius differ in one of the blocks by at most radius / BLOCKS bits, so items are
indexed by every value that near each of their blocks, and windows meet the items of their size by equal blocks. This
finds all pairs within the radius. Bit counts leave those, and the exact weighted-shingle similarity (the
sum of the smaller weights over the sum of the larger ones) decides.

The one step that isn't certain is the radius: a pair at the threshold differs in 9.7 of 64 bits on average with a
deviation of 2.9, and is beyond the radius of 23 with a chance below 1 in 100,000 (normal approximation).

The benchmark is broadcast up to ``BROADCAST_ROWS`` rows of its index, a checked count; a larger one takes part in
ordinary joins.

Defined results: items of fewer than five words have no shingle, identify nothing and are never found; null texts
and ids of items are ignored; a null or empty text of a document has no window; texts of any length are read whole;
of equally similar windows the last is told; repeated items or rows don't repeat a result; an empty table
gives an empty result; further columns, also with clashing names, are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import light, pick, saved

WORDS, THRESHOLD = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 8, 23
#: Rows up to which the benchmark's index, or the texts that matter to it, are broadcast.
BROADCAST_ROWS, BROADCAST_TEXTS = 1_000_000, 100_000
#: A bit and the one 32 places on, so that a sum counts both at once, for up to four billion shingles.
LANES = 0x0000000100000001


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: behind a generator no expression takes their place, above all not inside lambdas."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def shingles_of(words: str, size: int = WORDS) -> Column:
    """The hash of the shingle at each place; empty if there are fewer words."""
    w = F.col(words)
    at = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))


def simhash(shingles: str) -> Column:
    """64 votes over the shingles, each occurrence a vote."""
    s, half = F.col(shingles), BITS // 2
    votes = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: F.aggregate(s, F.lit(0).cast("bigint"), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(LANES))))

    def bit(count: Column, place: Column) -> Column:
        return F.when(count * 2 > F.size(s), F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint"))

    won = F.transform(votes, lambda v, k: bit(v.bitwiseAND(F.lit((1 << half) - 1)), k).bitwiseOR(bit(F.shiftrightunsigned(v, half), k + half)))
    return F.aggregate(won, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))


def counted(shingles: str) -> Column:
    """The shingles as a set: the k-th occurrence of one is a member of its own, so weights add up in plain intersections."""
    s = F.array_sort(shingles)
    apart = F.transform(s, lambda h, i: F.xxhash64(h, i - F.array_position(s, h)))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda h: F.xxhash64(h, F.lit(-1).cast("bigint")))).otherwise(apart)


def blocks_of(fingerprint: str, near: int = 0) -> Column:
    """(number, value) of each block of a fingerprint, and of every value that differs by at most ``near`` bits."""
    width, f = BITS // BLOCKS, F.col(fingerprint)
    masks = F.array(*(F.lit(sum(1 << b for b in bits)).cast("bigint") for k in range(near + 1) for bits in combinations(range(width), k)))

    def near_values(i: int) -> Column:
        own = F.shiftrightunsigned(f, i * width).bitwiseAND(F.lit((1 << width) - 1))
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*(near_values(i) for i in range(BLOCKS))))


def with_blocks(df: DataFrame, near: int = 0) -> DataFrame:
    return df.withColumn("x", F.explode(blocks_of("fingerprint", near))).select("*", "x.block", "x.value").drop("x")


def starts_of(threshold: float) -> Column:
    """Places from which a window of n_words words holds enough of ``held``, the sorted places of shingles of items.

    Of the window's w shingles and the item's m, c must be shared with c >= threshold (m + w - c).
    """
    whole = F.col("n_words") - (WORDS - 1)

    def enough(p: Column, i: Column) -> Column:
        own = F.least(whole, F.col("n_shingles") - p)
        need = F.ceil((whole + own) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6)).cast("int")
        return F.coalesce(F.get("held", i + F.greatest(need, F.lit(1)) - 1) < p + own, F.lit(False))

    return F.filter("held", enough)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """Per document and item that it holds: doc_id, text_key, item_id, start, n_words and similarity of the best window.

    text_key: the hash of the document's text. start: the number of the window's first word, from 0. Equal texts, and
    equal items, are looked at once.
    """
    told = pick(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    told = computed(told, words=words_of("text"))
    told = computed(told.where(F.size("words") >= WORDS), shingles=shingles_of("words")).select("item_id", F.size("words").alias("n_words"), "shingles", F.xxhash64("shingles").alias("item"))
    told = saved(told, "told")
    items = told.groupBy("item").agg(F.first("n_words").alias("n_words"), F.first("shingles").alias("shingles"))
    items = saved(items.select("item", "n_words", "shingles", simhash("shingles").alias("fingerprint"), counted("shingles").alias("members")), "items")
    places = saved(items.select("n_words", F.explode("shingles").alias("hash")).distinct(), "places")

    keyed = pick(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    # the size is a column before the generator, so that the words aren't carried along with each shingle
    cut = computed(keyed.select("text_key", "text"), words=words_of("text")).select("text_key", "words", (F.size("words") - (WORDS - 1)).alias("n_shingles"))
    shingles = cut.select("text_key", "n_shingles", F.posexplode_outer(shingles_of("words")).alias("p", "hash"))
    hits = shingles.join(light(places, BROADCAST_ROWS), "hash").groupBy("text_key", "n_words").agg(F.max("n_shingles").alias("n_shingles"), F.array_sort(F.collect_set("p")).alias("held"))
    starts = saved(hits.select("text_key", "n_words", starts_of(threshold).alias("starts")).where(F.size("starts") > 0).groupBy("text_key").agg(F.collect_list(F.struct("n_words", "starts")).alias("starts")), "starts")
    texts = keyed.join(light(starts, BROADCAST_TEXTS), "text_key").groupBy("text_key").agg(F.first("text").alias("text"), F.first("starts").alias("starts"))
    texts = computed(computed(texts, words=words_of("text")), all=shingles_of("words")).select("text_key", "all", F.explode("starts").alias("of"))
    windows = texts.select("text_key", "of.n_words", "all", F.explode("of.starts").alias("start"))
    windows = computed(windows, shingles=F.slice("all", F.col("start") + 1, F.col("n_words") - (WORDS - 1)))
    windows = saved(windows.select("text_key", "n_words", "start", simhash("shingles").alias("fingerprint"), counted("shingles").alias("members")), "windows")

    sought = saved(with_blocks(items.select("item", "n_words", F.col("fingerprint")), radius // BLOCKS).withColumnRenamed("fingerprint", "item_fingerprint"), "blocks")
    met = with_blocks(windows.select("text_key", "n_words", "start", "fingerprint")).join(light(sought, BROADCAST_ROWS), ["n_words", "block", "value"])
    pairs = met.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius).select("text_key", "n_words", "start", "item").distinct()
    both = pairs.join(windows.select("text_key", "n_words", "start", "members"), ["text_key", "n_words", "start"]).join(light(items.select("item", F.col("members").alias("item_members")), BROADCAST_ROWS // 100), "item")
    shared = F.size(F.array_intersect("members", "item_members"))
    alike = both.withColumn("similarity", shared / (F.size("members") + F.size("item_members") - shared)).where(F.col("similarity") >= threshold)
    best = alike.groupBy("text_key", "item", "n_words").agg(F.max(F.struct("similarity", "start")).alias("best"))
    best = saved(best.join(told.select("item", "item_id").distinct(), "item").select("text_key", "item_id", "best.start", "n_words", "best.similarity"), "leaks")
    return keyed.select("doc_id", "text_key").join(light(best, BROADCAST_TEXTS), "text_key").select("doc_id", "text_key", "item_id", "start", "n_words", "similarity").distinct()
