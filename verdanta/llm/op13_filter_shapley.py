"""Audit of how filters interact: what each removes in every order, and its Shapley share of all removals.

A document's filters that fail are the bits of its mask, so a part of the corpus is told by 32 counts, however many
documents it has. With x_i = 1 where filter i is applied and 0 where it isn't, the documents removed are

    R(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i)),

a polynomial that is linear in each x_i. Multiplied out, the coefficient of the product of x_i over a set T is
(-1) ** (|T| + 1) times the documents whose mask holds T. Then

- a filter's Shapley value is the integral from 0 to 1 of dR/dx_i at x = (t, ..., t): the sum over sets T with i of
  coefficient / |T|. Denominators are at most 5, so 120 times the value is a whole number, which is what all 120
  orders together see the filter remove. Integers over the common denominator keep it exact;
- R at a corner (each x_i 0 or 1) is what a set of filters removes, in whatever order: an order's survivors are N
  less R at the corner of its prefixes, and a step removes the difference between two corners. The same polynomial of
  the good (or toxic) documents' masks gives those lost.

Filters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * capitals A-Z > 3 * code points; D holds any
of ``#$%&*|``; E identical to the text of a smaller doc_id anywhere in the table. Words are maximal runs of
characters other than space and 0x09-0x0D.

Work: the texts are read once; what goes on is a row of digest, mask and part per document. The smallest doc_id of each
text is aggregated before its shuffle and joined back by digest and doc_id together, so many copies of one text
meet in no task. The mask counts are at most 32 rows a part, and the 600 result rows of a part come from its one row.

Cases: a null text is empty, and equal to an empty text; a null part is the empty string; rows of one doc_id (repeated
rows too) count each and are never copies of each other; a null doc_id is nobody's original, and a copy if its text
has any doc_id, and has no label; a document without label is neither good nor toxic, and one with several labels is good (toxic) if
any says so; extra columns are ignored. An empty table gives no rows.
"""

from collections.abc import Callable
from itertools import permutations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SPACES = "\x09\x0a\x0b\x0c\x0d"
SCALE = prod(range(1, len(FILTERS) + 1))


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def mask_of_text(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D the text fails."""
    told = F.transform(F.array(words(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [told["n"] < MIN_WORDS, F.lit(100) * told["distinct"] < F.lit(MIN_DISTINCT) * told["n"], F.lit(100) * capitals > F.lit(MAX_CAPITALS) * F.char_length(text), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    rows = stored(rows.select("doc_id", "part", mask_of_text(F.col("text")).alias("mask"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("original", F.lit(True))
    judged = rows.where("doc_id IS NOT NULL").join(firsts, ["digest", "doc_id"], "left")
    lost_id = rows.where("doc_id IS NULL").join(firsts.select("digest", F.lit(True).alias("known")), "digest", "left")
    both = judged.select("doc_id", "part", "mask", F.col("original").isNull().alias("copy")).unionByName(lost_id.select("doc_id", "part", "mask", F.col("known").isNotNull().alias("copy")))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    whole = both.join(marks, "doc_id", "left")
    return whole.select("part", (F.col("mask") + F.col("copy").cast("int") * 16).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def mask_counts(masks: DataFrame) -> DataFrame:
    """Per part, arrays by mask (0 to 31) of all, of good and of toxic documents."""
    counts = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    each = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("by"))
    array = lambda name: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.try_element_at("by", m)[name], F.lit(0).cast("long")))
    return each.select("part", *[array(name).alias(name) for name in ("n", "good", "toxic")])


def over(sets: Callable[[Column], Column]) -> Column:
    """The sum of ``sets`` over the 32 sets of filters."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda total, t: total + sets(t))


def by_set(value: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), value)


def within(t: Column, s: Column) -> Column:
    return t.bitwiseAND(s) == t


def coefficients(counts: Column) -> Column:
    """Of the removal polynomial, by the set T of variables (0 to 31, bits as in masks)."""
    sign = lambda t: F.when(t == 0, 0).when(F.bit_count(t) % 2 == 1, 1).otherwise(-1)
    return by_set(lambda t: sign(t) * over(lambda m: F.when(within(t, m), F.get(counts, m)).otherwise(0)))


def corners(poly: Column) -> Column:
    """The polynomial's value where the variables of a set are 1 and the others 0, by set."""
    return by_set(lambda s: over(lambda t: F.when(within(t, s), F.get(poly, t)).otherwise(0)))


def shapley_scaled(poly: Column, i: int) -> Column:
    """SCALE times the integral of the polynomial's derivative by variable i along the diagonal."""
    share = lambda t: F.get(F.array(*[F.lit(SCALE // max(k, 1)).cast("long") for k in range(len(FILTERS) + 1)]), F.bit_count(t))
    return over(lambda t: F.when(t.bitwiseAND(F.lit(1 << i)) != 0, F.get(poly, t) * share(t)).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    counts = mask_counts(masked(docs, labels, part))
    polys = counts.withColumns({f"p_{c}": coefficients(F.col(c)) for c in ("n", "good", "toxic")})
    polys = polys.withColumns({f"r_{c}": corners(F.col(f"p_{c}")) for c in ("n", "good", "toxic")})
    each = lambda of: F.array(*[of(i) for i in range(len(FILTERS))])
    fails = each(lambda i: F.get("r_n", F.lit(1 << i)))
    alone = each(lambda i: F.get("n", F.lit(1 << i)))
    values = stored(polys.select("part", over(lambda m: F.get("n", m)).alias("all"), "r_n", "r_good", "r_toxic", fails.alias("fails"), alone.alias("alone"), each(lambda i: shapley_scaled(F.col("p_n"), i)).alias("shares")))

    steps = []  # the 600 (order, step, filter, filters before it): a fixed table
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            i = FILTERS.index(letter)
            steps.append((order, k + 1, i, before, before | 1 << i))
            before |= 1 << i
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, i int, before int, after int")
    rows = values.crossJoin(F.broadcast(table))
    lost = lambda name: F.get(name, F.col("after")) - F.get(name, F.col("before"))
    return rows.select("part", "filter_order", "step", (F.col("all") - F.get("r_n", "after")).alias("kept"), lost("r_n").alias("removed"), (F.get("fails", "i") - lost("r_n")).alias("redundant"), F.get("alone", "i").alias("unique_fails"), lost("r_good").alias("good_lost"), lost("r_toxic").alias("toxic_lost"), F.get("shares", "i").alias("shapley"))
