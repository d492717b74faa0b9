"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A text's shingles are its runs of five lower-cased words (a shorter text is one shingle); the sketch
retains every shingle hash below a fixed fraction of the hash range. Sketches of any two
texts are comparable: they merge by union, and containment and likeness of the texts
follow from the shared part, however unequal their lengths.

``edited_fingerprints`` compares each document with an edited copy of it and with the next
document (descending doc_id, the last followed by the first). Neighbours are found
without a global sort: ids fall into ranges of about as many rows (approximate quantiles,
at most ``MAX_RANGES``), each range is a window, and the few rows at range borders are
fetched through a table of one row per range. The borders only deal out the work.

Defined cases: null text is empty; an empty text has one shingle (of no words), so its
fingerprint is defined; where two sketches hold fewer than ``LEAST_UNION`` hashes together
(short texts), the likeness is that of all shingles of the two texts, so 1.0 only if these
are equal; a single document, and one without doc_id, is its own next; documents that share
a doc_id follow one another in the order of their texts; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: The retained part of the hash range: one in so many.
SCALE = 4
#: Hashes that two sketches hold together, below which they are too few for an estimate.
LEAST_UNION = 32
ROWS_PER_RANGE = 2_000
#: Ranges at most, whose borders are part of the plan; beyond it they hold more rows each.
MAX_RANGES = 1 << 16


def sketch(text: Column, n: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sorted retained shingle hashes (array<bigint>) of a text, case folded."""
    words = F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0B\f\r")), r"[ \t\n\x0B\f\r]+")
    limit = -(1 << 63) + (1 << 64) // scale if scale > 1 else (1 << 63) - 1

    def retained(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0)))
        return F.sort_array(F.array_distinct(F.filter(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])), lambda x: x < F.lit(limit))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.element_at(F.transform(F.array(hashes), retained), 1)  # the word hashes are bound once, not made again per shingle


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def text_likeness(a: Column, b: Column, text_a: Column, text_b: Column, n: int = SHINGLE_WORDS) -> Column:
    """``likeness`` of two texts' sketches; where these are small, that of all shingles of the texts."""
    few = F.size(F.array_union(a, b)) < LEAST_UNION
    return F.when(few, likeness(sketch(text_a, n, 1), sketch(text_b, n, 1))).otherwise(likeness(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null for an empty sketch."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the union of two texts' shingles."""
    return F.sort_array(F.array_union(a, b))


def show(s: Column) -> Column:
    """A sketch as text: hexadecimal hashes joined by dots."""
    return F.array_join(F.transform(s, lambda h: F.hex(h)), ".")


def _range_of(key: Column, borders: list[int]) -> Column:
    """How many of the ascending ``borders`` are not above ``key``, by binary search."""
    if not borders:
        return F.lit(0).cast("long")
    table, steps = F.array(*[F.lit(x) for x in borders]), len(borders).bit_length()
    sizes = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])

    def step(found: Column, size: Column) -> Column:
        at = found + size
        return F.when((at <= len(borders)) & (F.get(table, at - 1) <= key), at).otherwise(found)

    return F.aggregate(sizes, F.lit(0), step).cast("long")


def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, text and ``next_text``, the text of the following document (descending doc_id, cyclic)."""
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    count = min(MAX_RANGES, -(-known.count() // rows_per_range))
    shares = [k / count for k in range(1, count)]
    quantiles = known.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * count)).alias("q")).first()["q"] if shares else []
    cut = docs.withColumn("_range", F.when(F.col("doc_id").isNotNull(), _range_of(F.col("doc_id"), sorted(set(quantiles or [])))))
    # a range's first document is followed by the last one of the range below that has any
    filled = cut.where("_range is not null").select("_range").distinct()
    top = F.lit(filled.agg(F.max("_range")).first()[0]).cast("long")
    below = filled.select("_range", F.coalesce(F.lag("_range").over(W.orderBy("_range")), top).alias("_below"))  # numbers of ranges only
    lasts = cut.where("_range is not null").groupBy("_range").agg(F.max_by("text", F.struct("doc_id", "text")).alias("_border"))
    borders = below.join(lasts.withColumnRenamed("_range", "_below"), "_below").select(F.col("_range").alias("_window"), "_border")
    # rows without doc_id are dealt out, so that they do not meet in one window
    window = F.coalesce("_range", -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 16)))
    inside = F.lag(F.struct("text")).over(W.partitionBy("_window").orderBy("doc_id", "text"))
    found = cut.withColumn("_window", window).withColumn("_inside", inside).join(borders, "_window", "left")  # texts lie by window already
    return found.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.col("text")).when(F.col("_inside").isNull(), F.col("_border")).otherwise(F.col("_inside.text")).alias("next_text"))


def edited_fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(texts)
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    # sketches are made after the shuffle, which moves each text once and nothing else
    made = pairs.withColumn("edited", edited).withColumns({f"{c}sketch": sketch(F.col(t), n, scale) for c, t in (("", "text"), ("next_", "next_text"), ("edited_", "edited"))})
    return made.select(
        "doc_id",
        chars.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        show(F.col("sketch")).alias("fingerprint"),
        show(F.col("edited_sketch")).alias("edited_fingerprint"),
        text_likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text"), F.col("edited"), n).alias("near_edited"),
        text_likeness(F.col("sketch"), F.col("next_sketch"), F.col("text"), F.col("next_text"), n).alias("near_next"),
    )
