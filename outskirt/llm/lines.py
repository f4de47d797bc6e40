"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

Documents come in batches of descending id. Each batch reduces its lines to one row per key (a 128-bit
hash), merge-anti-joins the runs kept so far, and adds a run of its own: keys not seen before with
their keeper (the batch's largest document id), keys seen before as a further count only. A run is a
table bucketed and sorted by key, so that the joins with it do not shuffle it again. When a level holds ``fanout``
runs, they are merged into one run of the next level; so every key is rewritten once per level, a
logarithmic number of times in the number of batches.

Afterwards the runs say of each key in how many documents it stands and which of them keeps it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outskirt.llm.shared import ascii_lower, dropped, shared_folder, stored, text_or_empty, width

SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_keys(lines: Column) -> Column:
    """(h1, h2, position) of each line of an array."""
    # ``lines`` come lower-cased; the second hash is seeded with another value.
    return F.transform(
        lines,
        lambda line, i: F.struct(
            F.xxhash64(F.btrim(line, F.lit(SPACE))).alias("h1"),
            F.xxhash64(F.lit(7), F.btrim(line, F.lit(SPACE))).alias("h2"),
            i.alias("pos"),
            (F.length(F.btrim(line, F.lit(SPACE)))).alias("size"),
        ),
    )


class LineRuns:
    """The runs, as tables with rows (h1, h2, keeper or null, n): ``n`` documents more, kept by ``keeper``."""

    def __init__(self, spark, folder: str, fanout: int = 3):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[str]] = []
        self.buckets = width(spark)

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            run.repartition(self.buckets, *KEY)
            .write.option("path", f"{self.folder}/{name}")
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _plain(self, names: list[str]) -> DataFrame:
        """The rows of several runs, read as plain files: a group over a union must not take the buckets for its own."""
        return self.spark.read.schema("h1 long, h2 long, keeper long, n long").parquet(*[f"{self.folder}/{n}" for n in names])

    def rows(self) -> DataFrame:
        """All rows of all runs; a key may stand in several."""
        return self._plain([n for level in self.levels for n in level])

    def add(self, batch: DataFrame) -> None:
        """``batch``: rows (h1, h2, keeper, n), one per key, of documents with smaller ids than all before."""
        for name in (n for level in self.levels for n in level):
            # A key seen before has its keeper already.
            known = self.spark.table(name).where(F.col("keeper").isNotNull()).select(*KEY, F.lit(True).alias("known"))
            batch = batch.join(known, KEY, "left").select(
                *KEY, F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"), "n"
            )
        self._write(batch, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                self.levels[level] = []
                self._write(totals(self._plain(names)), level + 1)
                for name in names:
                    self._drop(name)
            level += 1

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        dropped(self.spark, f"{self.folder}/{name}")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n"))


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """At most ``batches - 1`` ids that cut the ids into batches of about equal size."""
    at = [i / batches for i in range(1, batches)]
    found = docs.select(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(1000)).alias("b")).first()["b"]
    return sorted(set(found or []))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, counts: bool = True
) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and with ``counts`` columns ``n_lines`` and ``n_dropped``.

    A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose their lines in
    all documents but the one with the largest id. Other lines stay, joined by ``\\n``.

    A null or empty text is one empty line and comes out as the empty string. Every row counts as a
    document: repeated rows of one id count as often as they stand there, and all rows of the largest
    id keep the line. A null id is smaller than all others. No rows give no rows. Other columns pass
    through whatever their names, save those that are added.

    ``batches`` only sets into how many pieces the ids are cut, it has no effect on the result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    doc_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    bounds = batch_bounds(docs, batches)
    batch = F.lit(0)
    for bound in bounds:  # batch 0 has the largest ids
        batch = batch + F.when(doc_id <= bound, 1).otherwise(0)
    lowered = F.split(ascii_lower(text_or_empty()), "\n", -1)
    keys = F.filter(line_keys(lowered), lambda k: k["size"] >= min_chars)
    lines = docs.select(
        doc_id.alias("doc"), F.xxhash64(text_or_empty()).alias("text_hash"), batch.alias("batch"), keys.alias("keys")
    ).where(F.size("keys") > 0)
    lines = stored(lines, folder, "lines")
    runs = LineRuns(spark, folder, fanout)
    for b in range(len(bounds) + 1):
        # A document counts once for a key, whichever of its lines have it.
        own = F.array_distinct(F.transform("keys", lambda k: F.struct(k["h1"].alias("h1"), k["h2"].alias("h2"))))
        once = lines.where(F.col("batch") == b).select("doc", F.explode(own).alias("k")).select("doc", "k.*")
        runs.add(once.groupBy(*KEY).agg(F.max("doc").alias("keeper"), F.count("*").alias("n")))
    # Stored, so that Spark can split the join at a line that very many documents have.
    repeated = stored(totals(runs.rows()).where(F.col("n") >= min_docs).drop("n"), folder, "repeated")
    drops = (
        lines.select("doc", "text_hash", F.explode("keys").alias("k"))
        .select("doc", "text_hash", "k.h1", "k.h2", "k.pos")
        .join(repeated, KEY)
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("pos").alias("__drop"))  # repeated rows add nothing
        .withColumnRenamed("doc", "__doc")
        .withColumnRenamed("text_hash", "__hash")
    )
    out = docs.withColumns({"__id": doc_id, "__text_hash": F.xxhash64(text_or_empty())}).join(
        drops, (F.col("__id") == F.col("__doc")) & (F.col("__text_hash") == F.col("__hash")), "left"
    )
    parts = F.split(text_or_empty(), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop"))
    kept = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col("__drop").isNull(), text_or_empty()).otherwise(kept)
    n_lines = F.size(parts).cast("long")
    n_dropped = F.coalesce(F.size(F.array_distinct("__drop")), F.lit(0)).cast("long")
    added = {"n_lines": n_lines, "n_dropped": n_dropped} if counts else {}
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in added]
    return out.select(*others, text.alias("text"), *[c.alias(name) for name, c in added.items()])
