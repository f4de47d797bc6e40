"""Document fingerprints by consistent weighted sampling (Ioffe 2010). DataFrame functions only.

A text's terms are its words between white space, weighted by how often they stand there. For each sample, hashes of
(term, sample) give r and c from Gamma(2, 1) and b from U(0, 1); with t = floor(ln w / r + b) the term's
value is ln c - r (t - b + 1), and the sample is the (term, t) with the least value. Two texts get the same
sample with a probability equal to the generalised Jaccard similarity of their weights.

Value and sample share one BIGINT, value first, so that a plain MIN over a text's terms takes the sample and Spark can
combine before it shuffles. Texts are shuffled once, by row; terms are counted where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outskirt.llm.shared import shared_folder, stored, text_or_empty, width

SAMPLES = 32
WHITE = " \t\n\x0b\x0c\r"
#: A SHA-256 travels as five numbers of at most 13 hexadecimal digits.
DIGITS, PIECES = 13, 5
SPLIT = r"[\x20\x09-\x0D]+"


def sample(term: Column, log_weight: Column, i: int) -> Column:
    """Value (47 bits, order kept) and name (16 bits) of ``term`` for sample ``i`` as one positive BIGINT."""
    h1, h2 = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))

    def uniform(h: Column, shift: int) -> Column:
        part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1))
        return (part + F.lit(0.5)) * F.lit(2.0**-21)

    r = -F.ln(uniform(h1, 43) * uniform(h1, 22))
    c = -F.ln(uniform(h1, 1) * uniform(h2, 43))
    b = uniform(h2, 22)
    t = F.floor(log_weight / r + b)
    value = F.ln(c) - r * (t - b + 1)
    # Values lie well within (-2048, 2048).
    place = ((value + F.lit(2048.0)) * F.lit(2.0**34)).cast("long")
    name = h2.bitwiseXOR(t * F.lit(40503)).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(place, 16).bitwiseOR(name)


def signatures(texts: DataFrame) -> DataFrame:
    """``texts`` (row, which, text): rows (row, which, signature, an array of 16-bit values, and number).

    A text without words has the empty word as its only term. Texts with ``which`` from 2 on are hexadecimal numbers;
    they pass through as ``number``, so that what belongs to a row is made in the same pass over its text."""
    words = texts.select("row", "which", F.explode(F.split(F.btrim("text", F.lit(WHITE)), SPLIT)).alias("word"))
    term = F.when(F.col("which") < 2, F.xxhash64("word")).otherwise(F.conv("word", 16, 10).cast("long"))
    counted = words.groupBy("row", "which", term.alias("term")).agg(F.count("*").alias("w"))
    counted = counted.select("row", "which", "term", F.ln(F.col("w").cast("double")).alias("lw"))
    least = [F.min(sample(F.col("term"), F.col("lw"), i)).alias(f"s{i}") for i in range(SAMPLES)]
    out = counted.groupBy("row", "which").agg(*least, F.min("term").alias("number"))
    short = [F.col(f"s{i}").bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(SAMPLES)]
    return out.select("row", "which", F.when(F.col("which") < 2, F.array(*short)).alias("signature"), "number")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(SAMPLES))


def as_text(signature: Column) -> Column:
    """Four hex digits for each sample."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def neighbours(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (row, doc_id, n): with next_row, prev_row and prev_n in descending order of doc_id, the ends joined to a ring."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("row")]
    ranged = rows.repartitionByRange(width(rows.sparkSession), *order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, folder, "ranged")
    inside = Window.partitionBy("part").orderBy(*order)
    inner = ranged.select(
        "row", "doc_id", "n", "part", F.lead("row").over(inside).alias("nx"), F.lag("row").over(inside).alias("pv"),
        F.lag("n").over(inside).alias("pn"),
    )
    inner = stored(inner, folder, "inner")
    # One row per range.
    first = inner.where("pv is null").select("part", F.col("row").alias("first_row"))
    last = inner.where("nx is null").select("part", F.col("row").alias("last_row"), F.col("n").alias("last_n"))
    across, all_parts = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = lambda step, c, end: F.coalesce(step(c).over(across), end(c).over(all_parts))
    ends = first.join(last, "part").select(
        "part",
        ring(F.lead, "first_row", F.first).alias("first_after"),
        ring(F.lag, "last_row", F.last).alias("last_before"),
        ring(F.lag, "last_n", F.last).alias("n_before"),
    )
    return inner.join(F.broadcast(ends), "part").select(
        "row", "doc_id", "n", F.coalesce("nx", "first_after").alias("next_row"), F.coalesce("pv", "last_before").alias("prev_row"),
        F.coalesce("pn", "n_before").alias("prev_n"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document, in descending order of doc_id (after the last comes the first; null ids last; repeated ids in
    the order of their rows). A single document is its own next one. A null text is empty; all texts without words have one
    fingerprint. Repeated rows are documents of their own. No rows give no rows; other columns are not read.

    ``docs`` is scanned twice and rows are known by place: give a table as read, or one that has been stored."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    ring = neighbours(texts.select("row", "doc_id", F.length("text").alias("n")), folder)
    ring = stored(ring, folder, "ring")
    known = texts.select("row", "text").join(ring.select("row", "n", "prev_row", "prev_n"), "row")
    heads = known.select(F.col("prev_row").alias("row"), F.expr("substring(text, 1, prev_n div 2)").alias("head"))
    edited = F.expr("concat(substring(text, 1, n - n div 2), head)")
    pairs = known.join(heads, "row").select("row", "text", edited.alias("edited"))
    pairs = pairs.withColumn("digest", F.sha2("edited", 256))
    part = lambda which, text: F.struct(F.lit(which).alias("which"), text.alias("text"))
    digits = [part(2 + j, F.substring("digest", DIGITS * j + 1, DIGITS)) for j in range(PIECES)]
    every = F.explode(F.array(part(0, F.col("text")), part(1, F.col("edited")), *digits)).alias("t")
    made = stored(signatures(pairs.select("row", every).select("row", "t.which", "t.text")), folder, "signatures")
    of = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    sizes = [min(DIGITS, 64 - DIGITS * j) for j in range(PIECES)]
    hexed = [F.lpad(F.lower(F.hex(of(2 + j, "number"))), n, "0") for j, n in enumerate(sizes)]
    rows = made.groupBy("row").agg(
        of(0, "signature").alias("own"), of(1, "signature").alias("edited"), F.concat(*hexed).alias("edited_sha256")
    )
    rows = stored(rows, folder, "rows")
    following = rows.select(F.col("row").alias("next_row"), F.col("own").alias("following"))
    return ring.select("row", "doc_id", "next_row", "n").join(rows, "row").join(following, "next_row").select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
