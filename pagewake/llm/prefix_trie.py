"""Prefix trie of conversations (operator 11).

A node is a distinct sequence of first turns; the conversations that start with it are its members. Conversations
with a common beginning so keep its tokens once.

* Turns get a 64-bit hash. Turns of one hash are compared byte by byte with each other, and if they
  differ they are numbered: from then on hash and number stand for role and text, and text moves no more.
* Numpy scans over range partitions (`scans`) give every row the polynomial rolling fingerprint of its prefix, twice
  31 bits. Rows of one depth and fingerprint are a candidate group. Its representative is the member of least
  id; a group is right if all members have the representative's turn and parent fingerprint, depth by
  depth, which by induction proves whole prefixes equal. Members that differ are split off: the split's
  number joins their key from that depth on.
* Parents are rolled up without walking the tree. Summed over a subtree, (members - 1) * words is what each member
  conversation adds at depths where it isn't the representative; so every conversation takes running sums from
  its end, and a node adds those of its members. Leaves count alike, each by its representative.

A frequent prefix is reduced before the shuffle when it is counted; where its rows are joined with its node,
the node's side has one row, so AQE may split them. A long conversation lies in several range partitions.
Ids that end at a node are put in order in chunks before they meet, and their digest takes the
chunks as a stream.

Order is by turn, null first, then role and text, so ties have one result; repeated rows are turns of their own. Null role and
text count as empty. Rows without a conversation id are left out. An empty table gives no node. Further columns are
not read and can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import INDEX, Polynomial, scan

#: Two polynomials modulo primes below 2**31: base and modulus.
HASHES = ((1_103_515_245, 2_147_483_647), (1_664_525_117, 2_147_483_629))
#: Ids that end at a node are ordered in chunks: those of one chunk differ in so many low bits.
CHUNK_BITS = 10
#: A node is told by depth, fingerprint of its turns, and the numbers of the splits on its path.
KEY = ("d", "fp", "path")
TURN = ("h", "v")

Hash = Callable[[Column, Column], Column]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls but in turn."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *empty)


def numbered(turns: DataFrame, hashed: Hash = F.xxhash64) -> DataFrame:
    """Adds words, h and v: equal h and v mean equal role and text, compared as bytes."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    turns = turns.withColumns({"h": hashed(F.col("role"), F.col("text")), "words": words})
    alike = turns.select("h", "role", "text").distinct()
    several = alike.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h").checkpoint()
    if several.isEmpty():
        return turns.withColumn("v", F.lit(0))
    first = Window.partitionBy("h").orderBy("role", "text")
    split = alike.join(several, "h", "left_semi").withColumn("v", F.row_number().over(first) - 1).where("v > 0").checkpoint()
    return turns.join(split, ["h", "role", "text"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, p (from 1), h, v, words of numbered turns in their order."""
    found = scan(turns, "conv_id", ["turn", "role", "text"], ["conv_id", "h", "v", "words"], {})
    return found.select("conv_id", (F.col(INDEX) + 1).alias("p"), "h", "v", "words")


def rebuilt(placed: DataFrame, block: int, most: int) -> DataFrame:
    """Each conversation begins with the first k turns of the first one of its block, and goes on with its own after its first k.

    The block's first is id - id % block, where the remainder has the id's sign; k is the CRC-32 of the id modulo `most`. Returns conv_id, part, p, h, v, words, by part and p in order.
    """
    own_head = F.crc32(F.col("conv_id").cast("string")).cast("bigint") % most
    ids = placed.where("p = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), own_head.alias("k")).where("k > 0")
    heads = placed.where((F.col("p") < most) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "base")
    lent = ids.join(heads, "base").where("p <= k").select("conv_id", F.lit(0).alias("part"), "p", "h", "v", "words")
    return lent.unionByName(placed.where(F.col("p") > own_head).withColumn("part", F.lit(1)))


def fingerprints(sequence: DataFrame, order: list[str], hashes: tuple[tuple[int, int], ...] = HASHES) -> DataFrame:
    """conv_id, d (from 1), h, v, words, fp of the first d turns and fp0 of the first d - 1."""
    (b1, m1), (b2, m2) = hashes
    mixed = sequence.withColumns({"x": F.pmod("h", F.lit(m1)), "y": F.pmod(F.xxhash64("h", "v"), F.lit(m2))})
    folds = {"f": Polynomial("x", b1, m1), "g": Polynomial("y", b2, m2)}
    found = scan(mixed, "conv_id", order, ["conv_id", "h", "v", "words", "x", "y"], folds)
    return _with_parents(found, hashes)


def _with_parents(found: DataFrame, hashes: tuple[tuple[int, int], ...]) -> DataFrame:
    """The fingerprint before a row is the one up to it less the row's own term."""
    (b1, m1), (b2, m2) = hashes
    folds = Polynomial("x", b1, m1), Polynomial("y", b2, m2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, index, f, g = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("x", "y", INDEX, "f", "g"))
            before = [(total - fold.reduced(value * fold.powers(index))) % fold.modulus for fold, value, total in zip(folds, (x, y), (f, g), strict=True)]
            told = [index + 1, (f << 31) | g, (before[0] << 31) | before[1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "h", "v", "words")), *map(pa.array, told)], ["conv_id", "h", "v", "words", "d", "fp", "fp0"])

    return found.mapInArrow(run, "conv_id bigint, h bigint, v int, words bigint, d bigint, fp bigint, fp0 bigint")


def verified(rows: DataFrame) -> DataFrame:
    """Adds path and path0, the splits on the way to a row and to its parent: then d, fp and path tell prefixes exactly."""
    kinds = rows.groupBy("d", "fp", "fp0", *TURN).agg(F.min("conv_id").alias("least"))
    mixed = kinds.groupBy("d", "fp").agg(F.count("*").alias("n")).where("n > 1").select("d", "fp").checkpoint()
    if mixed.isEmpty():
        return rows.withColumns({"path": F.lit(""), "path0": F.lit("")})
    represented = Window.partitionBy("d", "fp").orderBy("least", "fp0", *TURN)
    split = kinds.join(mixed, ["d", "fp"], "left_semi").withColumn("nth", F.row_number().over(represented) - 1).where("nth > 0").drop("least")
    on_way = rows.join(split, ["d", "fp", "fp0", *TURN]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("d", "nth"))).alias("splits")).checkpoint()

    def told(within: Callable[[Column], Column]) -> Column:
        passed = F.transform(F.filter("splits", lambda s: within(s["d"])), lambda s: F.concat_ws(":", s["d"], s["nth"]))
        return F.coalesce(F.array_join(passed, ","), F.lit(""))

    marked = rows.join(on_way, "conv_id", "left")
    return marked.withColumns({"path": told(lambda d: d <= F.col("d")), "path0": told(lambda d: d < F.col("d"))}).drop("splits")


def ends_digests(ends: DataFrame) -> DataFrame:
    """d, fp, path, ends_sha256: the digest of the ids, ascending, joined by commas."""
    chunked = ends.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = chunked.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], [*KEY, "ends_sha256"])

        for batch in batches:
            done = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append(row())
                at, digest = key, hashlib.sha256(ids.encode())
            yield from done
        if at is not None:
            yield row()

    return ordered.select(*KEY, "ids").mapInArrow(run, "d bigint, fp bigint, path string, ends_sha256 string")


def trie(ids: DataFrame, sequence: DataFrame, order: list[str], hashes: tuple[tuple[int, int], ...] = HASHES) -> DataFrame:
    """The nodes of the conversations `ids` (conv_id, distinct), whose numbered turns `sequence` holds, in `order`.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = verified(fingerprints(sequence, order, hashes)).select("conv_id", *KEY, "fp0", "path0", "words").checkpoint()
    same = rows.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("fp0", "path0", "words"))).checkpoint()
    kids = same.groupBy((F.col("d") - 1).alias("d"), F.col("fp0").alias("fp"), F.col("path0").alias("path")).agg(F.count("*").alias("n_children"))
    nodes = same.join(kids, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).checkpoint()
    shared = nodes.where("n > 1").select(*KEY, "rep", "n_children")

    alone = F.col("conv_id") == F.col("rep")
    met = rows.join(shared, list(KEY)).select("conv_id", *KEY, F.when(alone, 0).otherwise(F.col("words")).alias("more"), (alone & (F.col("n_children") == 0)).cast("bigint").alias("leaf"))
    single_leaves = nodes.where("n = 1 AND n_children = 0").select(F.col("rep").alias("conv_id"), "d", F.lit(0).cast("bigint").alias("fp"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("bigint").alias("more"), F.lit(1).cast("bigint").alias("leaf"))
    from_end = scan(met.unionByName(single_leaves), "conv_id", [F.desc("d")], ["conv_id", *KEY, "more", "leaf"], {"saved": Polynomial("more"), "leaves": Polynomial("leaf")})
    rolled = from_end.where("path IS NOT NULL").groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = shared.select((F.col("d") + 1).alias("d"), F.col("fp").alias("fp0"), F.col("path").alias("path0"), F.col("rep").alias("parent"))
    start = ids.select("conv_id", F.struct(F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("fp"), F.lit("").alias("path")).alias("at"))
    lasts = start.unionByName(rows.select("conv_id", F.struct(*KEY).alias("at"))).groupBy("conv_id").agg(F.max("at").alias("at")).select("conv_id", "at.*")
    ends = ends_digests(lasts).checkpoint()
    found = nodes.join(parents, ["d", "fp0", "path0"], "left").join(rolled, list(KEY), "left")
    least = ids.select(F.min("conv_id")).scalar()
    below = found.select(
        *KEY,
        F.col("rep").alias("conv_id"),
        F.when(F.col("d") == 1, least).otherwise(F.coalesce("parent", "rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    ).checkpoint()
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    tops = below.where("d = 1").select(none.alias("conv_id"), F.lit(1).alias("kid"), "n_leaves", "saved_tokens")
    members = ids.select("conv_id", F.lit(0).alias("kid"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    sums = [F.sum(c).alias(c) for c in ("kid", "n_leaves", "saved_tokens")]
    root = tops.unionByName(members).agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs"), *sums).where("n_convs > 0")
    top = root.select(zero.alias("d"), zero.alias("fp"), F.lit("").alias("path"), "conv_id", none.alias("parent_conv_id"), "n_convs", F.col("kid").alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")
    every = below.unionByName(top)
    return every.join(ends, list(KEY), "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def plain(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = turns_of(conversations)
    placed = positions(numbered(turns))
    return trie(placed.where("p = 1").select("conv_id"), placed, ["p"])


def of_blocks(conversations: DataFrame, block: int = 20, most: int = 4, hashed: Hash = F.xxhash64, hashes: tuple[tuple[int, int], ...] = HASHES) -> DataFrame:
    """The trie of the conversations rebuilt on the first one of their block."""
    placed = positions(numbered(turns_of(conversations), hashed))
    return trie(placed.where("p = 1").select("conv_id"), rebuilt(placed, block, most), ["part", "p"], hashes)
