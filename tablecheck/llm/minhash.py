"""MinHash near-duplicates with tensored banding; every link is confirmed on full sets of word shingles.

Texts with equal sets are one node. A node has two collections of ``HALVES`` half keys, each made of ``ROWS`` minhashes; a
table's key is a pair of half keys, one from either collection, so HALVES ** 2 tables of 2 * ROWS minhashes each need
2 * HALVES * ROWS minhash computations instead of 2 * HALVES ** 2 * ROWS. Two sets of similarity s share a table unless all half keys
of one collection differ: with 16 halves of three rows that happens to about one in 50,000 pairs at s = 0.8, and to fewer above (1 - (1 - (1 - s ** 3) ** 16) ** 2).

Nodes meet in a table only if others have the same half keys, so half keys are counted first and pairs of them formed only
from what is left. Keys with the same members are one key. Under a key of few members all pairs are compared; members of a larger one are compared with one representative per
round (the member with the most keys, then others by hash), each under eight of its keys at most, so a crowd that shares most of 256 tables is not
joined 256 times. Members that are linked to each other already need no comparison. What
stays open under large keys is settled exactly: those nodes get as keys the first n - ceil(0.8 n) + 1 of their shingles,
rarest first, of which two sets of similarity 0.8 must share one. The first shingle that two sets share in that order tells how much
they can share at most: nothing before it. Members of a key too far behind in their sets for any other member are left out, and after
the same rounds all pairs left under a key are compared that are in different components and can still reach the similarity by their sizes
and places. No key and no pair that could be a link is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.components import components
from tablecheck.session import cut_lineage, ship_by_value

ship_by_value(__name__)

SHINGLE, PERCENT, HALVES, ROWS = 5, 80, 16, 3
#: Rounds with representatives, open pairs per member of a key up to which all of the key are compared at once, and keys whose representatives a node
#: meets in a round.
ROUNDS, PAIRS, ASKED = 3, 4, 8
#: Shingles hashed at once, and words whose hashes a task remembers.
CHUNK, MEMO = 1 << 19, 1 << 20
#: Bits of the filter of rows whose texts are fetched again.
FILTER = 1 << 26
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words of a text, ascending; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    made = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        made = (made ^ word[k : k + len(made)]) * np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(32)
    return np.unique(made)


def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the minhash functions, fixed for all tasks."""
    drawn = [xxhash.xxh64_intdigest(f"minhash {k}".encode()) for k in range(2 * count)]
    return np.array(drawn[:count], np.uint64), np.array(drawn[count:], np.uint64) | np.uint64(1)


def half_keys(shingles: np.ndarray, starts: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """2 * ``halves`` half keys for each of the sets that begin at ``starts`` (none is empty): an array (sets, keys). Keys of the first collection are
    even, those of the second odd; which half a key is of goes into it.
    """
    mask, factor = functions(2 * halves * rows)
    made = np.zeros((2 * halves, len(starts)), np.uint64)
    for k in range(2 * halves):
        made[k] = k
        for r in range(rows):
            least = np.minimum.reduceat((shingles ^ mask[k * rows + r]) * factor[k * rows + r], starts)
            made[k] = (made[k] ^ least) * np.uint64(0x9E3779B97F4A7C15)
            made[k] ^= made[k] >> np.uint64(32)
        made[k] = made[k] & ~np.uint64(1) | np.uint64(k >= halves)
    return made.T


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def keyed(docs: DataFrame, shingle: int, halves: int, rows: int) -> DataFrame:
    """doc_id, text_hash, node (hash of the set), n (its size), halves (half keys; none for an empty set) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()

        def flush(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = np.zeros((0, 2 * halves), np.uint64)
            if len(full):
                keys = half_keys(np.concatenate([sets[k] for k in full]), np.r_[0, np.cumsum(sizes[full])[:-1]], halves, rows)
            ends = np.cumsum(np.r_[0, np.where(sizes > 0, 2 * halves, 0)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(keys.reshape(-1))))
            nodes = pa.array(signed(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), nodes, pa.array(sizes), lists], ["doc_id", "text_hash", "node", "n", "halves"])

        for batch in batches:
            start, sets, held = 0, [], 0
            for k, cell in enumerate(batch.column("text")):
                sets.append(shingle_set(cell.as_py(), shingle, hashes))
                held += len(sets[-1])
                if held >= CHUNK or k == batch.num_rows - 1:
                    yield flush(batch.slice(start, k + 1 - start), sets)
                    start, sets, held = k + 1, [], 0

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, n bigint, halves array<bigint>")


def tables(nodes: DataFrame) -> DataFrame:
    """key, node: members of all tables (pairs of half keys) that more than one node is in."""
    each = nodes.select("node", F.explode("halves").alias("half"))
    common = each.groupBy("half").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").select("half")
    left = each.join(common, "half", "left_semi")
    held = left.groupBy("node").agg(F.collect_list("half").alias("held"))  # 2 * halves at most
    side = lambda odd: F.filter("held", lambda h: h.bitwiseAND(F.lit(1)) == odd)
    pairs = held.select("node", F.explode(side(0)).alias("a"), side(1).alias("second")).select("node", "a", F.explode("second").alias("b"))
    return several(pairs.select(F.xxhash64("a", "b").alias("key"), "node")).withColumn("before", F.lit(0))


def several(members: DataFrame, *order: str) -> DataFrame:
    """Members of keys that more than one node has; of keys with the same members the first in ``order`` (columns of the key; then the key itself).

    Same members are told by number and a mark of 64 bits.
    """
    mark = F.bit_xor(F.xxhash64("node"))
    many = members.groupBy("key", *order).agg(F.count(F.lit(1)).alias("n"), mark.alias("mark")).filter("n > 1")
    kept = many.groupBy("n", "mark").agg(F.min(F.struct(*order, "key")).alias("first")).select("first.key")
    return members.join(kept, "key", "left_semi").drop(*order)


def near_size(percent: int) -> Column:
    return 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")


def near_place(percent: int) -> Column:
    """Whether two members can reach the similarity if they share none of the ``before`` shingles that each has before the key; by size alone where these are 0."""
    most = F.least(F.col("n") - F.col("before"), F.col("other_n") - F.col("other_before"))
    return 100 * most >= percent * (F.col("n") + F.col("other_n") - most)


def pair() -> list[Column]:
    return [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]


def asking(labelled: DataFrame, salt: int) -> DataFrame:
    """Members under at most ``ASKED`` keys of each node, others in every round: keys of a crowd mostly have the same representatives, and keys that stay open
    are settled exactly later.
    """
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key", F.lit(salt)), "key"))
    return labelled.withColumn("place", place).filter(F.col("place") <= ASKED).drop("place")


def star_pairs(labelled: DataFrame, percent: int, salt: int) -> DataFrame:
    """a, b: members of a key with its representative, where their components differ, for the keys that each node asks in this round."""
    by = F.struct((F.lit(0) if salt else -F.col("keys")).alias("by"), F.xxhash64("node", F.lit(salt)).alias("at"), F.col("node").alias("other"), F.col("label").alias("other_label"), F.col("n").alias("other_n"))
    heads = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(by).alias("head")).filter("low < high").select("key", "head.other", "head.other_label", "head.other_n")
    return asking(labelled, salt).join(heads, "key").filter(F.col("label") != F.col("other_label")).filter(near_size(percent)).select(*pair()).distinct()


def open_keys(labelled: DataFrame) -> DataFrame:
    """key, few: keys under which pairs are in different components, and whether these are few for the key's members."""
    held = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    left = (F.col("n") * F.col("n") - F.col("q")) / 2
    return held.filter(left > 0).select("key", (left <= PAIRS * F.col("n")).alias("few"))


def cross_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs under a key whose components differ and that can reach the similarity, were it the first key that they share."""
    others = labelled.select("key", F.col("node").alias("other"), F.col("label").alias("other_label"), F.col("n").alias("other_n"), F.col("before").alias("other_before"))
    ahead = (F.col("label") != F.col("other_label")) & (F.col("node") < F.col("other"))
    return labelled.join(others, "key").filter(ahead & near_place(percent)).select(*pair()).distinct()


class _Links:
    """Pairs tested so far and the components that the confirmed links make."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        spark = sets.sparkSession
        self.tested = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
        self.roots = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))

    def test(self, pairs: DataFrame) -> None:
        pairs = cut_lineage(pairs.join(self.tested, ["a", "b"], "left_anti"), "minhash-pairs")
        self.tested = self.tested.union(pairs)
        first = pairs.join(self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        both = first.join(self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")  # a member's set travels once per round
        shared = both.select("a", "b", F.size(F.array_intersect("left", "right")).alias("shared"), (F.size("left") + F.size("right")).alias("sizes"))
        found = cut_lineage(shared.filter(100 * F.col("shared") >= self.percent * (F.col("sizes") - F.col("shared"))).select("a", "b"), "minhash-links")
        if not found.isEmpty():
            self.join(found)

    def join(self, found: DataFrame) -> None:
        """Components after more links: only those that links connect are looked at again."""
        fresh = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
        every = self.roots.union(fresh.join(self.roots, "node", "left_anti").select("node", F.col("node").alias("root")))
        every = cut_lineage(every, "minhash-nodes-linked")
        of = lambda c: every.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        edges = found.join(of("a"), "a").join(of("b"), "b").filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
        merged = components(edges).select(F.col("node").alias("root"), F.col("root").alias("new_root"))
        self.roots = cut_lineage(every.join(merged, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")), "minhash-components")

    def labelled(self, members: DataFrame) -> DataFrame:
        """``members`` (key, node, before, n, keys) with the component of each node."""
        return members.join(self.roots, "node", "left").select("key", "node", "before", "n", "keys", F.coalesce("root", "node").alias("label"))

    def settle(self, members: DataFrame, rounds: int) -> DataFrame:
        """Tests pairs under the keys of ``members``: all under keys with few open ones, a representative per round under others. Returns labelled
        members of keys still open after ``rounds``."""
        members = cut_lineage(self.labelled(members), "minhash-labelled")
        for salt in range(rounds):
            left = cut_lineage(members.join(open_keys(members), "key"), "minhash-open")
            if left.isEmpty():
                return left.drop("few")
            few, many = left.filter("few").drop("few"), left.filter(~F.col("few")).drop("few")
            self.test(cross_pairs(few, self.percent).union(star_pairs(many, self.percent, salt)).distinct())
            members = cut_lineage(self.labelled(many.drop("label")), "minhash-labelled")
        return members.join(open_keys(members).select("key"), "key", "left_semi")


def with_counts(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``members`` (key, node, before) with the size of each node's set and the number of its keys."""
    keys = members.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
    return members.join(keys.join(nodes.select("node", "n"), "node"), "node").select("key", "node", "before", "n", "keys")


def prefixes(sets: DataFrame, open_nodes: DataFrame, percent: int) -> DataFrame:
    """key, node, before: of every open node the n - ceil(percent n / 100) + 1 shingles that the fewest open nodes have, where several have them, and how many
    of its shingles come before each.

    Two sets of that similarity share one of these, and of the first that they share neither has any before it in common with the other. Members that cannot
    reach the similarity with another one of the key (by the least ``before`` there) are left out.
    """
    each = sets.join(open_nodes, "node", "left_semi").select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key"))
    uses = each.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    before = F.row_number().over(Window.partitionBy("node").orderBy("uses", "key")) - 1
    ranked = each.join(uses, "key").withColumn("before", before).filter(100 * F.col("before") <= (100 - percent) * F.col("n"))
    ranked = cut_lineage(ranked.filter("uses > 1"), "minhash-ranked")
    low = ranked.groupBy("key").agg(F.min("before").alias("low"))
    inside = 100 * (F.col("n") - F.col("before")) >= percent * (F.col("n") + F.col("low"))  # all the rest of it is shared
    larger = 100 * (100 - percent) * F.col("n") >= percent * (100 * F.col("low") + percent * F.col("before"))  # all the rest of a larger one is
    return several(ranked.join(low, "key").filter(inside | larger).select("key", "node", "before", "uses"), "uses")


def full_sets(docs: DataFrame, heads: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of the rows of ``docs`` that ``heads`` (head: last, doc_id, text_hash; a written table) name.

    A filter of ``FILTER`` bits, the same size whatever the corpus, keeps most other texts from being moved; the join decides.
    """
    known = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    key = ["key_last", "key_id", "key_hash"]
    bit = F.pmod(F.xxhash64(*key), F.lit(FILTER)).cast("int")
    wanted = heads.select(F.col("head.last").alias("key_last"), known(F.col("head.doc_id")).alias("key_id"), F.col("head.text_hash").alias("key_hash"))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("bits")).toArrow()
    table = np.zeros(FILTER // 32, np.uint32)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            places = np.flatnonzero((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1)
            if len(places):
                yield batch.take(pa.array(places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for cell in batch.column(0):
                found = shingle_set(cell.as_py(), shingle, hashes)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(found.tobytes())], pa.uint64()).view(pa.int64()), pa.array([signed(found)], pa.list_(pa.int64()))], ["node", "shingles"])

    number = F.col("doc_id").cast("long")
    rows = docs.select("text", number.isNull().alias("key_last"), known(number).alias("key_id"), F.xxhash64("text").alias("key_hash")).withColumn("bit", bit)
    rows = rows.mapInArrow(sift, rows.schema)
    found = rows.join(wanted, key, "left_semi").dropDuplicates(key).select("text")
    return found.mapInArrow(run, "node bigint, shingles array<bigint>")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_shingles, component_id, kept.

    Sets of shingles are linked where 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id reachable. A null or empty text, or one
    without words, has an empty set and is linked with nothing. A null doc_id takes part, but is a component_id only where there is no other, and is
    never kept; repeated rows give repeated rows. Candidates are lost at the rate given above for 80 percent (more below it: raise ``halves``).
    """
    marked = cut_lineage(keyed(docs, shingle, halves, rows), "minhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    nodes = marked.filter("n > 0").groupBy("node").agg(F.min(order).alias("head"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    nodes = cut_lineage(nodes, "minhash-nodes")
    members = cut_lineage(with_counts(cut_lineage(tables(nodes), "minhash-tables"), nodes), "minhash-members")
    in_tables = members.select("node").distinct()
    heads = cut_lineage(nodes.join(in_tables, "node", "left_semi").select("head"), "minhash-heads")
    sets = cut_lineage(full_sets(docs, heads, shingle), "minhash-sets")
    found = _Links(sets, percent)
    still = cut_lineage(found.settle(members, rounds), "minhash-still")
    if not still.isEmpty():
        rare = cut_lineage(prefixes(sets, still.select("node").distinct(), percent), "minhash-prefixes")
        found.test(cross_pairs(found.settle(with_counts(rare, nodes), rounds), percent))
    rooted = nodes.select("node", F.col("head.doc_id").alias("least")).join(found.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least_doc"))
    joined = marked.select("doc_id", "node", "n").join(rooted.join(least, "root").select("node", "least_doc"), "node", "left")
    component = F.when(F.col("n") > 0, F.col("least_doc")).otherwise(F.col("doc_id"))
    rows_out = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows_out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
