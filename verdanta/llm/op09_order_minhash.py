"""Order MinHash fingerprints, with DataFrame functions only.

A text's symbols are its runs of at most ``RUN`` characters that aren't white space, and at every symbol a
k-mer of ``K`` symbols starts (the last ones are shorter). K-mers are numbered by occurrence: the second time
a k-mer stands in a text it is another element. Each element, k-mer and number together, is hashed to a rank of
its own. Sketch j has its own order of the elements: by rank, from the j-th of ``SKETCHES`` equal stretches of the
ranks on and around to its beginning, so one hash function and one sort do for all sketches, and texts of few
k-mers fill all of them too. A sketch is its two least elements, put back into text order and hashed as a
tuple. So it agrees only where both texts have the same minimal elements in the same order, which follows the
edit distance and not only the set of k-mers. The likeness of two fingerprints is the share of sketches that agree.

A text becomes one array of packed (k-mer hash, place), sorted once: the occurrences of a k-mer stand in a
row there, in text order. Numbered and ranked, it is sorted once more, and the two least elements of each
stretch are all that any sketch needs. Work and memory are in proportion to one text, and nothing is exploded.

The next document is found from the ids alone: they are range-partitioned and sorted, each partition's first
and last id close the gaps between partitions. A document's text moves to its predecessor's key cut to the
part that the edited text needs.

Cases: a null text is empty; texts without symbols have an empty fingerprint, and two of these are alike (1);
a text with one element has it in all sketches, alone. Places and hashes share 64 bits, of which 31 are the
place's, more than a string can have symbols. Rows with one doc_id
are one document for its predecessor, which sees the text of the smallest hash; every row gets its result.
A null doc_id comes before all others. A lone document is its own next. Extra columns are ignored. An empty
table gives an empty table.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, stored

RUN, K, SKETCHES = 8, 3, 64
PLACE_BITS = 31
PLACES = (1 << PLACE_BITS) - 1
BIN_SHIFT = 64 - SKETCHES.bit_length() + 1
#: set in every element, so that none is equal to the mark at which a stretch begins
ELEMENT = 1 << PLACE_BITS


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda's variable stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~PLACES))


def place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACES))


def bin_of(x: Column) -> Column:
    return F.shiftright(x, BIN_SHIFT)


def packed_kmers(text: Column) -> Column:
    """Ascending array of k-mer hashes with their places in the low bits."""
    symbols = F.regexp_extract_all(text, F.lit(rf"\S{{1,{RUN}}}"), F.lit(0))
    # the hashes of the symbols first: a k-mer is then hashed from numbers
    hashes = F.transform(symbols, lambda s: F.xxhash64(s))

    def packed(h: Column) -> Column:
        return F.transform(h, lambda x, i: hash_of(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)])).bitwiseOR(i.cast("long")))

    return F.sort_array(bound(hashes, packed))


def ranked_elements(kmers: Column) -> Column:
    """Ascending array of the ranks of (k-mer, occurrence), with their places in the low bits."""

    def ranked(run: Column) -> Column:
        return F.transform(run, lambda x, nth: hash_of(F.xxhash64(hash_of(x), nth)).bitwiseOR(F.lit(ELEMENT)).bitwiseOR(place_of(x)))

    def numbered(p: Column) -> Column:
        every = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(every, lambda i: (i == 0) | (hash_of(F.get(p, i)) != hash_of(F.get(p, i - 1))))
        runs = bound(begins, lambda b: F.transform(b, lambda at, j: F.slice(p, at + 1, F.coalesce(F.get(b, j + 1), F.size(p)) - at)))
        return F.flatten(F.transform(runs, ranked))

    return F.sort_array(bound(kmers, numbered))


def fingerprint(text: Column) -> Column:
    """Array of SKETCHES ints, one tuple hash each; 0 where a text has no elements."""
    half = SKETCHES // 2
    marks = F.sequence(F.lit(-half), F.lit(half - 1))

    def least_two(elements: Column) -> Column:
        return F.filter(elements, lambda x, i: (i < 2) | (bin_of(F.get(elements, i - 2)) != bin_of(x)))

    def sketches(least: Column) -> Column:
        # a stretch's mark stands before its elements and behind all earlier ones and their marks
        both = F.sort_array(F.concat(least, F.transform(marks, lambda m: F.shiftleft(m.cast("long"), BIN_SHIFT))))
        at = F.transform(F.filter(F.transform(both, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["x"].bitwiseAND(F.lit(ELEMENT)) == 0), lambda e, j: e["i"] - j)

        def sketch(i: Column) -> Column:
            x, y = F.get(least, i % F.size(least)), F.get(least, (i + 1) % F.size(least))
            one, two = hash_of(x), hash_of(y)
            code = F.when(F.size(least) == 1, F.xxhash64(one)).when(place_of(x) <= place_of(y), F.xxhash64(one, two)).otherwise(F.xxhash64(two, one))
            short = F.shiftright(code, 32).cast("int")
            return F.when(short == 0, 1).otherwise(short)

        return F.when(F.size(least) == 0, F.array_repeat(F.lit(0), SKETCHES)).otherwise(F.transform(at, sketch))

    return bound(bound(ranked_elements(packed_kmers(text)), least_two), sketches)


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, p: s + p) / F.lit(SKETCHES)


def as_text(codes: Column) -> Column:
    """A fingerprint as a string of 8 hexadecimal digits per sketch."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def successors(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``ids`` (distinct key) with prev, the key before it; the first one has the last one."""
    ranged = scratch.stored(ids.repartitionByRange(F.col("key").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    bounds = ranged.groupBy("part").agg(F.max("key").alias("high"))  # one row per partition
    overall = Window.orderBy("part")
    whole = overall.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = bounds.select("part", F.coalesce(F.lag("high").over(overall), F.last("high").over(whole)).alias("before"))
    inner = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first())
    return ranged.withColumn("prev", F.lag("key").over(inner)).withColumn("nr", F.row_number().over(inner)).join(F.broadcast(before), "part").withColumn("prev", F.when(F.col("nr") == 1, F.col("before")).otherwise(F.col("prev"))).drop("part", "nr", "before")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    # a null doc_id has the key below all others, so joins find it
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    scratch = Scratch()
    ids = scratch.stored(rows.groupBy("key").agg(F.max(F.char_length("text")).alias("n"), F.min(F.xxhash64("text")).alias("chosen")))
    links = stored(successors(ids.select("key"), scratch).join(ids.withColumnsRenamed({"key": "prev", "n": "prev_n"}).drop("chosen"), "prev").join(ids.drop("n"), "key"))
    scratch.clear()
    # both sides of the last join read the same three columns by the same key, so one shuffle of the texts serves both
    coded = rows.withColumn("codes", fingerprint(F.col("text")))
    # what each document gives its predecessor: as much of its text as half of the predecessor's, and its codes
    given = coded.join(links, "key").where(F.xxhash64("text").bitwiseXOR(F.col("chosen")) == 0)
    given = given.select(F.col("prev").alias("key"), F.left("text", F.floor(F.col("prev_n") / 2).cast("int")).alias("start"), F.col("codes").alias("next_codes")).dropDuplicates(["key"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = coded.join(given, "key").withColumn("edited", F.concat(F.left("text", F.char_length("text") - half), F.left("start", half)))
    out = edited.withColumn("edited_codes", fingerprint(F.col("edited")))
    digest = F.sha2(F.encode("edited", "UTF-8"), 256)
    return out.select(F.nullif("key", lowest).alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), digest.alias("edited_sha256"), as_text(F.col("codes")).alias("fingerprint"), as_text(F.col("edited_codes")).alias("edited_fingerprint"), likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
