"""Substring dedup on a compacted De Bruijn graph of token k-mers.

An edge of the graph is a window of ``window`` consecutive words. Rows per window would be rows per word, so windows
travel together: each belongs to the smallest hash among its ``seed``-word grams (equal windows agree
on it), and neighbouring windows of one document with the same smallest gram are one piece, on
average a dozen windows. Equal windows meet under the same gram hash.

1. One aggregate by gram hash says how often a gram's pieces occur, whether they are all equal, and
   whether the same piece always comes before and after. Grams that occur once are unique text.
2. A join takes that back to the pieces. Pieces of which every occurrence is followed by
   the same next one, which is always preceded by this one, are a nonbranching path; all
   its occurrences run through the whole path, so each document compacts its own pieces to it.
   Where different pieces share a gram (the ends of a repeat), their single windows are compared; of equal
   such pieces one document gives the windows for all.
3. Source coordinates verify: the words of each path occurrence and each such window are read again
   and digested (128 bits, BLAKE2b); a second aggregate and join keep spans whose words occur at least twice.

The text is shuffled once, into a table bucketed by row; steps 2 and 3 read it where it lies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outskirt.llm.shared import bucketed, rows_of, shared_folder, stored
from outskirt.llm.tokens import Spans, U, mix, word_bounds, word_hashes

#: Pieces of a text of so many bytes together are sent on as one batch.
FLUSH = 1 << 22


def pieces(words: np.ndarray, window: int, seed: int):
    """(first window, number of windows, gram hash, piece hash) of each piece of one document."""
    spans = Spans(words)
    grams = spans.grams(seed)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1)
    place = view.argmin(axis=1) + np.arange(len(view))
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    last = np.concatenate((first[1:], [len(view)]))
    gram_at = place[first]
    body = spans.of(first, last - 1 + window)
    return first, last - first, grams[gram_at], mix(body + (gram_at - first).astype(U))


def _extract(window: int, seed: int):
    schema = pa.schema(
        [(n, pa.int64()) for n in ("row", "gram", "piece")]
        + [(n, pa.int32()) for n in ("first", "n")]
        + [(n, pa.int64()) for n in ("before", "after")]
    )

    def run(batches):
        held, size = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            return rows_of(dict(zip(schema.names, cols, strict=True)), schema)

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                words = word_hashes(data)
                if len(words) < window:
                    continue
                first, n, gram, piece = pieces(words, window, seed)
                gram, piece = gram.view(np.int64), piece.view(np.int64)
                end = np.zeros(1, dtype=np.int64)
                held.append(
                    (np.full(len(n), row), gram, piece, first, n)
                    + (np.concatenate((end, gram[:-1])), np.concatenate((gram[1:], end)))
                )
                size += len(data)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run, "row long, gram long, piece long, first int, n int, before long, after long"


def _verify(window: int):
    schema = pa.schema([(n, pa.int64()) for n in ("d1", "d2", "row")] + [(n, pa.int32()) for n in ("first", "n")])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, text, marks = (batch.column(c)[i].as_py() for c in range(3))
                data = (text or "").encode()
                starts, ends = (x.tolist() for x in word_bounds(data))
                data = b" ".join(data.split())
                shift = np.cumsum(np.array([0, *(e - s + 1 for s, e in zip(starts, ends, strict=True))])).tolist()
                spans: list[tuple[int, int]] = []
                path = None  # (first, n, gram, after)
                for m in sorted(marks, key=lambda m: m["first"]):
                    if m["windows"]:
                        spans.extend((m["first"] + j, 1) for j in range(m["n"]))
                    if not m["repeated"]:
                        continue
                    joined = (
                        path is not None
                        and path[0] + path[1] == m["first"]
                        and path[3] == m["gram"]
                        and m["before"] == path[2]
                    )
                    if joined:
                        path = (path[0], path[1] + m["n"], m["gram"], m["after"])
                    else:
                        if path:
                            spans.append(path[:2])
                        path = (m["first"], m["n"], m["gram"], m["after"])
                if path:
                    spans.append(path[:2])
                d1, d2 = [], []
                for first, n in spans:
                    end = first + n - 1 + window
                    digest = hashlib.blake2b(data[shift[first] : shift[end] - 1], digest_size=16).digest()
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                if spans:
                    first, n = zip(*spans, strict=True)
                    yield rows_of({"d1": d1, "d2": d2, "row": [row] * len(n), "first": first, "n": n}, schema)

    return run, "d1 long, d2 long, row long, first int, n int"


def _remove(window: int, text_at: int):
    """The last column has the spans, column ``text_at`` the text; all others pass through."""

    def run(batches):
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column(text_at), batch.column(batch.num_columns - 1), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if spans.is_valid:
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    spans = spans.as_py()
                    np.add.at(step, [s["first"] for s in spans], 1)
                    np.add.at(step, [s["first"] + s["n"] - 1 + window for s in spans], -1)
                    removed = np.cumsum(step)[:-1] > 0
                    gone = int(removed.sum())
                    n_words.append(len(words))
                    words = [w for w, g in zip(words, removed.tolist(), strict=True) if not g]
                else:
                    n_words.append(len(words))
                texts.append(b" ".join(words).decode())
                n_removed.append(gone)
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(texts, type=pa.string())
            columns += [pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_words", "n_removed"])

    return run


def repeated_spans(base: DataFrame, folder: str, window: int, seed: int) -> DataFrame:
    """Rows (row, first, n): ``n`` windows of a document from word ``first`` on whose words occur elsewhere too.

    ``base`` has ``__row`` (unique) and ``text``."""
    fit = base.select("__row", "text")
    found = fit.mapInArrow(*_extract(window, seed))
    stats = (
        found.groupBy("gram")
        .agg(
            F.count("*").alias("n_rows"),
            (F.min("piece") == F.max("piece")).alias("pure"),
            F.min("before").alias("b1"),
            F.max("before").alias("b2"),
            F.min("after").alias("a1"),
            F.max("after").alias("a2"),
        )
        .where("n_rows >= 2")
    )
    only = lambda a, b: F.when(F.col("pure") & (F.col(a) == F.col(b)), F.col(a)).otherwise(F.lit(0))
    stats = stats.select("gram", "pure", only("b1", "b2").alias("before"), only("a1", "a2").alias("after"))
    stats = stored(stats, folder, "stats")
    marks = stored(found.drop("before", "after").join(stats, "gram"), folder, "marks")
    variants = (
        marks.where(~F.col("pure"))
        .groupBy("gram", "piece")
        .agg(F.count("*").alias("copies"), F.min("row").alias("chosen"))
    )
    variants = stored(variants, folder, "variants")
    shape = ["row", "gram", "first", "n", "before", "after"]
    whole = marks.where("pure").select(*shape, F.lit(True).alias("repeated"), F.lit(False).alias("windows"))
    mixed = marks.where(~F.col("pure")).join(variants, ["gram", "piece"])
    mixed = mixed.select(
        *shape,
        (F.col("copies") >= 2).alias("repeated"),
        ((F.col("copies") == 1) | (F.col("row") == F.col("chosen"))).alias("windows"),
    )
    mark = F.struct("gram", "first", "n", "before", "after", "repeated", "windows")
    by_row = whole.unionByName(mixed).groupBy("row").agg(F.collect_list(mark).alias("marks"))
    spans = fit.join(by_row.hint("shuffle_hash"), F.col("__row") == F.col("row")).select("__row", "text", "marks")
    spans = stored(spans.mapInArrow(*_verify(window)), folder, "spans")
    # Stored, as "stats" is: Spark can split a join at a hot key only where both sides are plain tables.
    twice = spans.groupBy("d1", "d2").agg(F.count("*").alias("c")).where("c >= 2").drop("c")
    twice = stored(twice, folder, "twice")
    return spans.join(twice, ["d1", "d2"], "left_semi").select("row", "first", "n")


def remove_repeated_spans(docs: DataFrame, window: int = 35, seed: int = 10) -> DataFrame:
    """``docs`` with ``text`` less every word covered by a window that also starts elsewhere.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged. A window is ``window`` consecutive words of one
    document; if its word sequence also starts at any other place, in the same or another document,
    all occurrences lose their words. Kept words are joined by one space. Adds ``n_words`` (before) and ``n_removed``.

    A null text has no words and comes out as the empty string, as does one without words; texts shorter than a
    window keep all. Repeated rows are different documents, so each loses what the other has. Null ids are
    kept. No rows give no rows. Other columns pass through whatever their names, save those named here.

    ``seed`` (words in the grams that bring windows together) has no effect on the result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    others = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    base = docs.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`") for c in others])
    base = bucketed(base, folder, "texts", "__row")
    spans = repeated_spans(base, folder, window, seed)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("__spans"))
    joined = base.join(by_row.hint("shuffle_hash"), F.col("__row") == by_row["row"], "left")
    schema = T.StructType([*base.drop("__row").schema])
    for name in ("n_words", "n_removed"):
        schema = schema.add(name, "long")
    return joined.select(*[base[f"`{c}`"] for c in others], "__spans").mapInArrow(
        _remove(window, others.index("text")), schema
    )
