"""MinHash near-duplicate detection (operator 9).

Documents with equal shingle sets form a class; from there on, classes stand for documents.
One-permutation hashing puts a class's shingles into bins and keeps the least of each; empty
bins borrow from bins picked by a fixed random sequence (optimal densification). Bands of bins
give buckets. A bucket's candidates are a star, all members against one centre, so its pairs
number one less than its members. Candidates are confirmed on the full sets.

Stars alone could miss a link between two members that are both unlike the centre. So the members of
buckets that still hold several components are compared, across components, where their rarest
shingles (an exact prefix filter), their sizes and their bitmaps allow the similarity. Of each rare
shingle, the members outside its largest component meet the others, so that a large group of copies
is never compared with itself. No bucket is capped or dropped.

Null or wordless texts have an empty set and are linked with nothing. Rows with a null key are
not linked: component_id is null and kept is true. Repeated rows are copies of each other, and
different texts of one key are documents of their own; of rows with one key and text, all are
`kept` or none. Long texts are read whole, and an empty table gives an empty one. Extra columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_folder, words, written
from .components import components

#: A pair of similarity 0.8 shares no bucket with probability (1 - 0.8**ROWS)**BANDS = 2e-5.
BANDS, ROWS = 36, 6
BINS = BANDS * ROWS
#: Bits of the parity bitmap. Two sets differ in at least as many shingles as their bitmaps in bits.
PARITY = 1024
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 50_000

MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ORDER = np.random.default_rng(9)
#: The bins that an empty bin tries, in order.
BORROW = ORDER.integers(0, BINS, (256, BINS))
FACTORS = ORDER.integers(1, 1 << 62, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX2
    h = (h ^ (h >> np.uint64(32))) * MIX2
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, some 200 bytes each; starts anew at KNOWN_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


known = WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence, if it is shorter."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    size = min(size, len(w))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * MIX + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The least hash of each bin, empty bins densified."""
    bins = ((found >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = found[first], True
    empty = np.flatnonzero(~full)
    for tries in BORROW:
        if not len(empty):
            break
        ok = full[tries[empty]]
        out[empty[ok]] = out[tries[empty[ok]]]
        empty = empty[~ok]
    out[empty] = found[0]
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """A bucket number for each band."""
    rows = mixed(signature(found).reshape(BANDS, ROWS)) * FACTORS
    return mixed(rows.sum(1, dtype=np.uint64)).view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """A bitmap of `PARITY` bits: of how many shingles fall on a bit, whether the number is odd."""
    odd = np.bincount((found & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]).astype(np.int64, copy=False)))


def digest(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, t, n, digest of the set (null if empty), band numbers and parity bitmap of each row of (id, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            sets = [shingles(t.as_py(), size) for t in batch.column(2)]
            n = pa.array([len(s) for s in sets], pa.int64())
            found = lists([bands(s) if len(s) else np.empty(0, np.int64) for s in sets])
            bits = lists([parities(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(map(digest, sets), pa.binary()), found, bits], ["id", "t", "n", "digest", "bands", "bits"])

    return docs.select("id", "t", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, t bigint, n bigint, digest binary, bands array<bigint>, bits array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """digest and shingle hashes of each row of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            sets = [shingles(t.as_py(), size) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), lists([s.view(np.int64) for s in sets])], ["digest", "shingles"])

    return docs.select("text").mapInArrow(run, "digest binary, shingles array<bigint>")


def stars(buckets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b): the members of each bucket with its centre, the member of least hash.

    The hash is the same in all buckets, so that similar buckets have the same centre and pairs recur.
    """
    rank = F.struct(F.xxhash64("v").alias("h"), "v", "n", "bits")
    centres = buckets.groupBy("bucket").agg(F.min(rank).alias("c"))
    star = buckets.join(centres, "bucket").select(F.col("c.v").alias("a"), F.col("c.n").alias("an"), F.col("c.bits").alias("abits"), F.col("v").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits"))
    return star.where(F.col("a") != F.col("b")).where(plausible(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rare_pairs(members: DataFrame, sets: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (v, n, label) of different components that can have the similarity.

    Shingles are ranked by rarity among the members. Two sets that are similar enough have their
    first common shingle early in both, with enough places left behind it to make up the overlap.
    Members that owe their bucket to a frequent passage are told apart by their rare shingles.
    """
    each = members.join(sets, "v").select("v", "n", "label", F.explode("shingles").alias("h"))
    ranked = each.join(each.groupBy("h").count(), "h").groupBy("v", "n", "label").agg(F.array_sort(F.collect_list(F.struct("count", "h"))).alias("all"))
    early = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    posted = ranked.select("v", "n", "label", F.posexplode(early).alias("at", "s")).select("v", "n", "label", "at", "s.h").checkpoint()
    of_label = posted.groupBy("h", "label").count()
    shared = of_label.groupBy("h").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("count", "label")).alias("largest")).where("labels > 1").select("h", "largest")
    meeting = posted.join(shared, "h").join(bits, "v").checkpoint()
    left, right = (meeting.select("h", "largest", *[F.col(c).alias(f"{side}{name}") for c, name in (("v", ""), ("n", "n"), ("label", "l"), ("at", "i"), ("bits", "bits"))]) for side in "ab")
    once = (F.col("bl") == F.col("largest")) | (F.col("a") < F.col("b"))
    room = F.least(F.col("an") - F.col("ai"), F.col("bn") - F.col("bi")) * (100 + percent) >= (F.col("an") + F.col("bn")) * percent
    found = left.where("al <> largest").join(right.drop("largest"), "h").where((F.col("al") != F.col("bl")) & once & room & plausible(percent))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def plausible(percent: int) -> Column:
    """Whether a pair can have the similarity, by the sizes and bitmaps."""
    apart = F.aggregate(F.zip_with("abits", "bbits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda out, x: out + x)
    both = F.col("an") + F.col("bn")
    sizes = F.least("an", "bn") * (100 + percent) >= both * percent
    return sizes & ((100 + percent) * F.floor((both - apart) / 2) >= percent * both)


def confirmed(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    have_b = found.join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb")), "b")
    both = have_b.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id (least key reachable by links of `percent` or more), kept and text_hash, for each row."""
    shared_folder(docs.sparkSession)
    docs = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    rows = sketches(docs, size).checkpoint()
    classes = rows.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least")).checkpoint()
    classes = classes.withColumn("v", F.monotonically_increasing_id())  # of a checkpoint, which doesn't change
    reps = rows.join(classes, "digest").where("id = least").dropDuplicates(["v"]).select("v", "least", "n", "bands", "bits")
    posted = reps.select("v", F.posexplode("bands").alias("band", "value")).select("v", F.xxhash64("band", "value").alias("bucket")).repartition("bucket")
    crowded = posted.groupBy("bucket").count().where("count > 1").select("bucket")
    buckets = posted.join(crowded, "bucket").join(reps.select("v", "n", "bits"), "v").checkpoint()

    members = buckets.select("v").distinct().join(classes, "v")
    texts = docs.join(members.select(F.col("least").alias("id")).distinct(), "id", "left_semi")
    sets = full_sets(texts, size).join(members.select("digest", "v"), "digest").dropDuplicates(["v"]).select("v", "shingles").checkpoint()

    tested = stars(buckets, percent).checkpoint()
    links = confirmed(tested, sets, percent).checkpoint()
    labels = components(links)
    named = buckets.select("bucket", "v", "n").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    several = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    undecided = named.join(several, "bucket").select("v", "n", "label").distinct().checkpoint()
    found = rare_pairs(undecided, sets, reps.select("v", "bits"), percent)
    more = confirmed(found.join(tested, ["a", "b"], "left_anti"), sets, percent).checkpoint()
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    named = classes.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")))
    of_class = named.join(least, "label").select("digest", "component_id")
    out = rows.select("id", "t", "n", "digest").join(of_class, "digest", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("t").alias("text_hash"))
