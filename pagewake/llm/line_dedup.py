"""Line deduplication by content-defined chunks (operator 8); DataFrame functions only.

Each line has a hash. Lines that stand once in all documents can't be repeated; the others are cut
into chunks. A chunk ends where a rolling hash over `WINDOW` line hashes is 0 modulo `MODULUS`, and
between lines that occur differently often: the lines of a passage occur equally often, and its
neighbours elsewhere do not. Boundaries depend on the lines alone, so a passage is cut alike wherever
it stands and whatever was inserted before it.

Of a chunk that occurs more than once, the first occurrence (least key, then text digest, then line)
stays; the others are compared with it byte by byte. Chunks that follow each other and equal their
first occurrences make a run, and a run is removed if it has several lines and `few` words, or `long`
words, with the single repeated lines that stand right beside its others. What stays by these parameters: repeats of a single line of fewer than `long` words
(headings, licence lines), and of several lines of fewer than `few` words together.

Hashes alone find the chunks; text moves only for documents that hold one, and once more to be
rewritten. A frequent line or chunk is reduced before the shuffle when it is counted; when lines are
joined with their counts and chunks are compared, AQE may split its partition, as the other side
has one row for it.

Null texts stay null, and an empty table gives an empty one. A document that is removed wholly keeps
its row, with an empty text. Rows of one key and text count as one document, other texts of the key as
others; rows with a null key are returned as they are. Texts are read whole, in time linear in
their lines. All columns are returned, in order, whatever their names; n_chars, where it is a column,
is that of the new text, and a column n_removed is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written

WINDOW, MODULUS = 2, 3
FACTOR = 31
#: Least words of a run of several lines, and of any run, that is removed.
FEW, LONG = 20, 50


def line_hash(line: Column) -> Column:
    """60 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("bigint")


def n_words(text: Column) -> Column:
    """Blanks and one: the words of a text whose words have single blanks between them."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a lambda over an array of one element names it."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks(found: Column) -> Column:
    """Array of (first, lines, words, h) of the chunks of a document's repeated lines, (i, n, h, w) by line number i."""

    def follows(a: Column, b: Column) -> Column:
        return (b["i"] == a["i"] + 1) & (b["n"] == a["n"])

    def ended(k: Column) -> Column:
        """Whether a chunk ends with the k-th repeated line, from 0."""
        past = [F.get(found, k - d) for d in range(WINDOW)]
        rolled = reduce(lambda a, d: a + past[d]["h"] % MODULUS * FACTOR**d, range(1, WINDOW), past[0]["h"] % MODULUS)
        whole = reduce(lambda a, d: a & follows(past[d], past[d - 1]), range(1, WINDOW), F.lit(True))
        cut = F.coalesce(whole & (rolled % MODULUS == 0), F.lit(False))
        return cut | ~F.coalesce(follows(past[0], F.get(found, k + 1)), F.lit(False))

    def one(ends: Column) -> Callable[[Column, Column], Column]:
        def chunk(end: Column, place: Column) -> Column:
            start = F.coalesce(F.get(ends, place - 1), F.lit(-1)) + 1
            part = F.slice(found, start + 1, end - start + 1)
            words = F.aggregate(part, F.lit(0), lambda out, x: out + x["w"])
            return F.struct(F.get(found, start)["i"].alias("first"), (end - start + 1).alias("lines"), words.alias("words"), F.xxhash64(F.transform(part, lambda x: x["h"])).alias("h"))

        return chunk

    return let(F.filter(F.sequence(F.lit(0), F.size(found) - 1), ended), lambda ends: F.transform(ends, one(ends)))


def runs(found: DataFrame, few: int, long: int) -> DataFrame:
    """The chunks (id, d, first, lines, words) that stand in a run to be removed."""
    before = F.sum("lines").over(Window.partitionBy("id", "d").orderBy("first"))
    island = Window.partitionBy("id", "d", "island")  # equal for chunks that follow each other
    told = found.withColumn("island", F.col("first") + F.col("lines") - before).withColumn("run_lines", F.sum("lines").over(island)).withColumn("run_words", F.sum("words").over(island))
    return told.where((F.col("run_words") >= long) | ((F.col("run_lines") > 1) & (F.col("run_words") >= few))).drop("island", "run_lines", "run_words")


def repeats(base: DataFrame, few: int, long: int) -> DataFrame:
    """Chunks (id, d, first, lines, words, h) of runs of repeats, and the first occurrences of such (is_first), by hashes."""
    line = lambda x, i: F.struct(i.alias("i"), F.when(F.trim(x) != "", line_hash(x)).alias("h"), n_words(x).alias("w"))
    hashed = written(base.select("id", "d", F.transform(lines(F.col("body")), line).alias("lines")))
    every = hashed.select("id", "d", F.explode("lines").alias("x")).select("id", "d", "x.*").where(F.col("h").isNotNull())
    often = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = every.join(often, "h").groupBy("id", "d").agg(F.array_sort(F.collect_set(F.struct("i", "n", "h", "w"))).alias("found"))
    chunked = written(found.select("id", "d", F.explode(chunks(F.col("found"))).alias("c")).select("id", "d", "c.*"))

    place = F.struct("id", "d", "first")
    firsts = chunked.groupBy("h").agg(F.min(place).alias("one"), F.max(place).alias("last")).where("one <> last").select("h", "one")
    gone = runs(chunked.join(firsts, "h").where(place != F.col("one")).drop("one"), few, long).withColumn("is_first", F.lit(False))
    kept = chunked.join(firsts.join(gone.select("h").distinct(), "h", "left_semi"), "h").where(place == F.col("one")).drop("one").withColumn("is_first", F.lit(True))
    return written(gone.unionByName(kept))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW, long: int = LONG) -> DataFrame:
    """The documents without repeated chunks."""
    shared_folder(docs.sparkSession)
    base = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("d"), F.col(text).alias("body"))
    wanted = repeats(base, few, long).groupBy("id", "d").agg(F.collect_set(F.struct("first", "lines", "words", "h", "is_first")).alias("wanted"))

    bodies = let(lines(F.col("body")), lambda each: F.transform("wanted", lambda c: F.struct(c.alias("c"), F.array_join(F.slice(each, c["first"] + 1, c["lines"]), "\n").cast("binary").alias("bytes"))))
    pieces = base.join(wanted, ["id", "d"]).select("id", "d", F.explode(bodies).alias("p")).select("id", "d", "p.c.*", "p.bytes")
    kept = pieces.where("is_first").select("h", F.col("bytes").alias("first_bytes")).dropDuplicates(["h"])
    equal = pieces.where("NOT is_first").join(kept, "h").where(F.col("bytes") == F.col("first_bytes")).select("id", "d", "first", "lines", "words").distinct()
    removed = runs(equal, few, long).groupBy("id", "d").agg(F.array_sort(F.collect_set(F.struct("first", "lines"))).alias("removed"))

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("id"), F.xxhash64(text).alias("d"))
    cut = F.col("removed")
    start = lambda k: F.coalesce(F.get(cut, k - 1)["first"] + F.get(cut, k - 1)["lines"], F.lit(0))
    end = lambda k: F.coalesce(F.get(cut, k)["first"], F.lit(1 << 30))
    left = let(lines(F.col("doc")[text]), lambda each: F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), lambda k: F.slice(each, start(k) + 1, end(k) - start(k)))))
    text_left = F.when(cut.isNull(), F.col("doc")[text]).otherwise(F.array_join(left, "\n"))
    out = packed.join(removed, ["id", "d"], "left").select("doc", "removed", text_left.alias("text_left"))
    new = {text: F.col("text_left"), "n_chars": F.coalesce(F.length("text_left").cast("bigint"), F.lit(0).cast("bigint"))}
    n_removed = F.coalesce(F.aggregate("removed", F.lit(0), lambda n, r: n + r["lines"]), F.lit(0)).cast("bigint")
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns if c != "n_removed"], n_removed.alias("n_removed"))
