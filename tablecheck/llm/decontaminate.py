"""Benchmark decontamination with DataFrame functions only.

Windows of a document as long as a benchmark item are compared with the items of that length. A similar window shares word
shingles with its item, and moved right to the first of them it loses none, so only windows that begin at a shingle of some
item of that length (or end with the document) can be the best. Each has a 64-bit SimHash of its shingles, and a multi-index
over the items finds its candidates: the bits are cut into ``BLOCKS`` blocks, of which one differs in
at most RADIUS // BLOCKS = 1 bit, and the index holds every value of every block of an item within that one bit, so no item within ``RADIUS``
bits is missed. What is found is verified by the exact weighted Jaccard similarity of shingle counts.

Positions carry lengths, not items: what a document has at a place is bounded by the number of different item
lengths, however many items share a beginning.

At similarity 0.8 two fingerprints differ in 9.2 bits on average (standard deviation 2.8); 22 bits are more than
4.5 deviations above, so fewer than one such pair in 100,000 is beyond the radius.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.session import cut_lineage

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 22, 12
#: Start bit and width of the blocks: four of six bits, eight of five.
LAYOUT = tuple((6 * k, 6) for k in range(4)) + tuple((24 + 5 * k, 5) for k in range(8))
SEPARATOR = "[^\\p{L}\\p{M}\\p{N}]+"
LOW = 0x0000000100000001


def word_list(text: Column) -> Column:
    """A text's words: runs of letters, marks and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def shingles(words: Column, size: int) -> Column:
    """Hash of every window of ``size`` words, in order."""
    starts = F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - (size - 1)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]))


def simhash(window: Column) -> Column:
    """A bit is set in over half of the shingle hashes. 32 running sums hold two bit counts each."""
    n = F.size(window)

    def counts(k: int) -> Column:
        return F.aggregate(window, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LOW)))

    bits = []
    for k in range(32):
        both = counts(k)
        for count, bit in ((both.bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(both, 32), k + 32)):
            bits.append(F.shiftleft((2 * count > n).cast("long"), bit))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def block(fingerprint: str, k: int) -> Column:
    start, width = LAYOUT[k]
    return F.shiftrightunsigned(fingerprint, start).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def items_of(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item_id, k (words in a shingle), shingles, n, fingerprint of every item with a word. Items of fewer than ``shingle`` words are one shingle."""
    rows = benchmark.select("item_id", word_list(F.col("text")).alias("words")).filter(F.size("words") > 0)
    fits = lambda k: F.size("words") >= k if k == shingle else F.size("words") == k
    by_size = [rows.filter(fits(k)).select("item_id", F.lit(k).alias("k"), shingles(F.col("words"), k).alias("shingles")) for k in range(1, shingle + 1)]
    rows = reduce(DataFrame.unionByName, by_size).distinct()
    return rows.withColumn("n", F.size("shingles")).withColumn("fingerprint", simhash(F.col("shingles")))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id, similarity: documents with a window of an item's length that is at least that similar, and the best such window's value.

    Null and empty texts, texts and items without a word are in no result; repeated documents and items give one row. A
    text shorter than an item has one window, itself. Null ids are ids like any other.
    """
    if radius // BLOCKS > 1:
        raise ValueError("the index holds neighbours at one bit only")
    items = items_of(benchmark, shingle)
    items = cut_lineage(items.withColumn("item", F.xxhash64("item_id", "shingles")), "items")  # never null, unlike the id
    sizes = [r.k for r in items.select("k").distinct().collect()]  # five values at most
    index = items.select("k", "n", F.explode("shingles").alias("shingle")).distinct()
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_list(F.col("text")).alias("words"))
    hits = []
    for k in sizes:
        placed = base.select("doc_id", "text_hash", F.posexplode(shingles(F.col("words"), k)).alias("pos", "shingle"))
        hits.append(placed.join(index.filter(F.col("k") == k), "shingle").select("doc_id", "text_hash", "pos", "k", "n"))
    schema = "doc_id bigint, text_hash bigint, pos int, k int, n int"
    hits = reduce(DataFrame.unionByName, hits) if hits else docs.sparkSession.createDataFrame([], schema)
    # bounded by one document's own words and the number of item lengths
    anchors = cut_lineage(hits.groupBy("doc_id", "text_hash", "k").agg(F.collect_set(F.struct("pos", "n")).alias("hits")), "item-hits")
    anchors = anchors.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")
    near = []
    for k in sizes:
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        # one plan at every size: whether the list of hits could be broadcast depends on the data
        rows = texts.join(anchors.filter(F.col("k") == k).hint("merge"), same).withColumn("words", word_list(F.col("text"))).select("doc_id", "text_hash", "k", "hits", shingles(F.col("words"), k).alias("all"))
        start = lambda h: F.least(h["pos"], F.greatest(F.lit(0), F.size("all") - h["n"]))
        starts = F.array_distinct(F.transform("hits", lambda h: F.struct(start(h).alias("start"), h["n"].alias("n"))))
        rows = rows.select("doc_id", "text_hash", "k", "all", F.explode(starts).alias("w"))
        near.append(rows.select("doc_id", "text_hash", "k", "w.n", "w.start", F.slice("all", F.col("w.start") + 1, F.col("w.n")).alias("window")))
    if not near:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, text_hash bigint, item_id bigint, similarity double")
    windows = cut_lineage(reduce(DataFrame.unionByName, near).withColumn("fingerprint", simhash(F.col("window"))), "item-windows")
    values = F.array(*[F.struct(F.lit(j).alias("block"), block("fingerprint", j).alias("value")) for j in range(BLOCKS)])

    def around(j: int) -> Column:
        flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(LAYOUT[j][1])])
        return F.transform(flips, lambda m: F.struct(F.lit(j).alias("block"), block("fingerprint", j).bitwiseXOR(m).alias("value")))

    neighbours = F.flatten(F.array(*[around(j) for j in range(BLOCKS)]))
    table = items.select("item", "k", "n", F.col("fingerprint").alias("item_mark"), F.explode(neighbours).alias("b")).select("item", "k", "n", "item_mark", "b.block", "b.value")
    window = ["doc_id", "text_hash", "k", "n", "start"]
    probes = windows.select(*window, "fingerprint", F.explode(values).alias("b")).select(*window, "fingerprint", "b.block", "b.value")
    within = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_mark"))) <= radius
    found = probes.join(table, ["k", "n", "block", "value"]).filter(within).select(*window, "item").distinct()
    found = found.select(*[F.col(c).alias(f"found_{c}") for c in window], "item")
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"found_{c}")) for c in window])
    candidates = windows.join(found, equal)
    key = ["doc_id", "text_hash", "item", "start"]
    counted = candidates.select(*key, F.size("window").alias("size"), F.explode("window").alias("shingle")).groupBy(*key, "size", "shingle").agg(F.count(F.lit(1)).alias("uses"))
    wanted = items.select("item", "item_id", "n", F.explode("shingles").alias("shingle")).groupBy("item", "item_id", "n", "shingle").agg(F.count(F.lit(1)).alias("has"))
    common = counted.join(wanted, ["item", "shingle"]).groupBy(*key, "item_id", "size", "n").agg(F.sum(F.least("uses", "has")).alias("common"))
    scored = common.withColumn("similarity", F.col("common") / (F.col("size") + F.col("n") - F.col("common")))
    return scored.filter(F.col("similarity") >= similarity).groupBy("doc_id", "text_hash", "item_id").agg(F.max("similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window similar to an item.

    Null and empty texts stay; repeated rows stay or go together; rows with equal ids and different texts are judged apart. An empty benchmark keeps everything.
    """
    found = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("row.text") == F.col("hit_hash"))
    return rows.join(cut_lineage(found, "contaminated"), same, "left_anti").select("row.*")
