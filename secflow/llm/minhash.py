"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every five-word shingle is hashed once. The top bits of the hash name its bin, each bin keeps its least hash.
An empty bin takes the value of another bin, chosen by hashes of (bin, attempt) until one is not empty, so
two texts with the same filled bins choose alike and every empty bin chooses on its own (optimal
densification). After ATTEMPTS tries the filled bin with the least priority for this bin is taken, which is
what further tries would find on average. Of each bin only BITS low bits are stored, taken after the value was
mixed with the bin's number, so that a value which several bins borrow meets by chance in each bin separately.

Likeness of two fingerprints: the share of equal bins, freed from the share that equal by chance (2^-BITS).

All bins of a text come out of one sort: the hashes are sorted together with one end mark per bin, and the
first entry of each bin is its least hash, or its mark if the bin is empty. No row is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.llm.common import bucket_of

WORDS, BINS, BITS, ATTEMPTS = 5, 256, 4, 6
#: A hash is cut to this many bits; the upper ones name the bin.
KEPT = 56
SHIFT = KEPT - 8
DIGITS = "0123456789abcdef"


def _shingle_hashes(words: Column) -> Column:
    """Non-negative hashes of all five-word shingles from hashes of words; of all words if there are fewer."""
    def cut(h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - KEPT)

    n = F.size(words)
    spread = F.transform(F.sequence(F.lit(0), n - WORDS),
                         lambda i: cut(F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])))
    return (F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < WORDS, F.array(cut(F.xxhash64(words)))).otherwise(spread))


def _densified(least: Column, filled: Column) -> Column:
    """BINS values; empty bins take the value of a filled one. ``filled`` has at least one (value, bin)."""
    mark = (1 << SHIFT) - 1

    def tried(i: Column, attempt: int) -> Column:
        value = F.get(least, F.pmod(F.xxhash64(i, F.lit(attempt)), F.lit(BINS)).cast("int"))
        return F.when(value != mark, value)

    def last(i: Column) -> Column:
        ranked = F.transform(filled, lambda x: F.struct(F.xxhash64(i, x["i"]).alias("p"), x["v"].alias("v")))
        return F.when(F.size(filled) > 0, F.array_min(ranked)["v"])

    return F.transform(least, lambda v, i: F.when(v != mark, v).otherwise(
        F.coalesce(*[tried(i, a) for a in range(1, ATTEMPTS + 1)], last(i))))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name``: BINS hexadecimal digits, or all zeros for a text without words (null texts count as empty).

    Equal sequences of words have equal fingerprints. A column of that name is replaced. Each step is a column
    that the next one refers to several times, so that Spark evaluates it once per row and not once per entry.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # The mark of a bin is its largest value, so it is the bin's first entry only where nothing else is there.
    marks = F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda b: F.shiftleft(b.cast("long"), SHIFT) - 1)
    ranked = F.col("_ranked")
    firsts = F.filter(ranked, lambda h, i: (i == 0) | (
        F.shiftright(h, SHIFT) != F.shiftright(F.get(ranked, F.greatest(i - 1, F.lit(0))), SHIFT)))
    least = F.col("_least")
    filled = F.filter(F.transform(least, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
                      lambda x: x["v"] != (1 << SHIFT) - 1)

    def digit(v: Column, i: Column) -> Column:
        return F.substr(F.lit(DIGITS), F.pmod(F.xxhash64(v, i), F.lit(1 << BITS)).cast("int") + 1, F.lit(1))

    steps = {"_words": F.transform(words, lambda w: F.xxhash64(w)),
             "_hashes": _shingle_hashes(F.col("_words")),
             "_ranked": F.sort_array(F.concat(F.col("_hashes"), marks)),
             "_least": F.transform(firsts, lambda h: h.bitwiseAND((1 << SHIFT) - 1)),
             "_filled": filled,
             name: F.when(F.size("_filled") == 0, F.lit("0" * BINS)).otherwise(
                 F.array_join(F.transform(_densified(least, F.col("_filled")), digit), ""))}
    for column, step in steps.items():
        df = df.withColumn(column, step)
    return df.drop("_words", "_hashes", "_ranked", "_least", "_filled")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints; 1 for equal ones, 0 where just one text had no words."""
    empty = F.lit("0" * BINS)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0),
                       lambda n, i: n + F.when(F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)), 1).otherwise(0))
    chance = 1.0 / (1 << BITS)
    corrected = (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, 1.0)
            .when((a == empty) | (b == empty), 0.0).otherwise(F.greatest(F.lit(0.0), corrected)))


def with_next(rows: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """``rows`` and, as next_<column>, ``columns`` of the row that follows by ``key``; the first follows the last.

    Rows are cut into ranges of ``key`` at quantiles that are keys themselves; a row at a cut also goes to the
    range before it, as the row that follows its last one. One shuffle; a range is sorted and read forwards.
    Null keys come first; rows of equal keys follow each other by ``order``.
    """
    ranges = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("k"))
    cuts = keys.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    # Quantiles are rounded; the least key of each range is exact and bounds the same range.
    rough = bucket_of(F.col("k"), sorted({int(c) for c in cuts}), "bigint")
    least = sorted(r[1] for r in keys.groupBy(rough.alias("r")).agg(F.min("k")).collect())  # one row per range
    first, bounds = (least[0], least[1:]) if least else (None, [])
    keyed = rows.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))))
    place = bucket_of(F.col("_k"), bounds, "bigint")
    at_cut = F.array_contains(F.from_json(F.lit(str(bounds)), "array<bigint>"), F.col("_k"))

    def in_range(r: Column, late: int) -> Column:
        return F.struct(r.alias("r"), F.lit(late).alias("late"))

    copies = (F.when(F.col("_k") == F.lit(first), F.array(in_range(place, 0), in_range(F.lit(len(bounds)), 1)))
              .when(at_cut, F.array(in_range(place, 0), in_range(place - 1, 1)))
              .otherwise(F.array(in_range(place, 0))))
    dealt = keyed.withColumn("_copy", F.explode(copies)).select("*", F.col("_copy.r").alias("_r"),
                                                                F.col("_copy.late").alias("_late")).drop("_copy")
    window = Window.partitionBy("_r").orderBy("_late", "_k", *order)
    out = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return out.where("_late = 0").drop("_k", "_r", "_late")


def edited_twins(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    The edited text is the text with its last quarter of code points replaced by as many from the start of the
    next document by doc_id (the first after the last; rows of one id in the order of their text hash; null
    ids first). Null texts count as empty. A single document follows itself. An empty table gives an empty
    result; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_fingerprint(rows, F.col("text"), "fingerprint").withColumn("_order", F.xxhash64("text"))
    paired = with_next(rows, "doc_id", ["text", "fingerprint"], ["_order"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    paired = paired.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(
        F.substr(F.col("text"), F.lit(1), n - quarter), F.substr(F.col("next_text"), F.lit(1), quarter)))
    both = with_fingerprint(paired, F.col("_edited"), "edited_fingerprint")
    return both.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
