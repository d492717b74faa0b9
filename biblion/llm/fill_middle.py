"""Fill-in-middle transformation by relational units.

A text's units are its lines, newline included (``[^\\n]*\\n|[^\\n]+``). ``posexplode`` makes a
row of each match (ordinal and length, no text), a window sums the lengths up in order, and two cut
requests of a document, drawn from a hash of its doc_id, are joined with the sums by
(document, unit ordinal). The offsets found are aggregated per document and meet the text
once; prefix, middle and suffix are substrings of it, over code points. All steps are
DataFrame functions; only ordinals and lengths are sorted, and the text passes one exchange.
The join keeps the offsets of a partition in memory, some fifty bytes for each text that the
same partition streams past them, never the texts.

* psm: ``<P>``prefix``<S>``suffix``<M>``middle; spm: ``<S>``suffix``<P>``prefix``<M>``middle; plain: the text.
* The draws are the first four groups of eight hex digits of sha256("<seed>:<doc_id>"): two
  cuts modulo (units + 1), then whether to transform (``rate`` percent) and whether as spm.

Defined cases: null and empty texts give an empty plain output and n 0; a text that holds a
sentinel stays plain, so an output is always read back exactly (``restored``); a null doc_id
draws as the empty string; rows repeated whole give the same output each, and rows of one
doc_id with different texts are cut by their own units; empty tables give empty results;
other columns are ignored. The units of one text are summed in one task, as the text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50


def _draw(k: int, seed: int, doc_id: str = "doc_id") -> Column:
    """The k-th group (from 1) of eight hex digits of the document's hash, as a number."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(named, 256), 8 * k - 7, 8), 16, 10).cast("long")


def _offsets(rows: DataFrame, seed: int) -> DataFrame:
    """(row, n, prefix_chars, middle_chars) of every text with a unit.

    One exchange, by row, of unit lengths (one struct, so that both uses read the same); rows repeated whole meet before it. Sums and requests
    both lie by row then, and stay: the ordinals are compared within the join by row.
    """
    sizes = F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.char_length)
    units = rows.where(F.col("text") != "").select("row", F.struct("doc_id", sizes.alias("sizes")).alias("of_row")).groupBy("row").agg(F.first("of_row").alias("of_row"))
    so_far = Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # nothing stands before the first unit: a cut there finds the sum 0
    exploded = units.select("row", F.posexplode(F.concat(F.array(F.lit(0)), "of_row.sizes")).alias("ordinal", "size"))
    ends = exploded.select("row", "ordinal", F.sum("size").over(so_far).alias("end"))
    n = F.size("of_row.sizes").cast("long")
    cuts = [F.pmod(_draw(k, seed, "of_row.doc_id"), n + 1) for k in (1, 2)]
    requests = units.select(F.col("row").alias("of"), n.alias("n"), F.posexplode(F.array(F.least(*cuts), F.greatest(*cuts))).alias("cut", "upto"))
    met = requests.join(ends, (F.col("of") == F.col("row")) & (F.col("upto") - F.col("ordinal") == 0))
    found = met.groupBy("row").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("cut") == k, F.col("end"))).alias(f"at{k}") for k in (0, 1)])
    return found.select("row", "n", F.col("at0").alias("prefix_chars"), (F.col("at1") - F.col("at0")).alias("middle_chars"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Per row: doc_id, text (null as empty), n (units), form, prefix_chars, middle_chars (null if plain), output."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))))
    made = rows.join(_offsets(rows, seed).hint("shuffle_hash"), "row", "left")
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = F.col("n").isNull() | holds | (F.pmod(_draw(3, seed), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(_draw(4, seed), F.lit(100)) < spm, "spm").otherwise("psm")
    made = made.select("doc_id", "text", F.coalesce("n", F.lit(0)).alias("n"), form.alias("form"), "prefix_chars", "middle_chars")
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m)
    suffix = F.substring("text", p + m + 1, F.lit((1 << 31) - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return made.select("doc_id", "text", "n", "form", F.when(cut, F.col("prefix_chars")).alias("prefix_chars"), F.when(cut, F.col("middle_chars")).alias("middle_chars"), F.coalesce(output, "text").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output, from it and its form alone."""
    body = F.substring(output, F.lit(4), F.lit((1 << 31) - 1))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", 3), F.split(body, f"{PREFIX}|{MIDDLE}", 3)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The columns of op11 from the outputs."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(x, k, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT doc_id, t, u, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR r[3] % 100 >= {RATE} THEN 'plain' WHEN r[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
