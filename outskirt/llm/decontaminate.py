"""Benchmark decontamination by greedy string tiling.

1. Seeds: hashes of ``min_match`` consecutive words of the benchmark items. A Bloom filter of fixed size (1 MB)
   over them is what documents are read against; it only saves rows, and the joins below are exact
   however full it gets.
2. Documents with a seed in the filter are kept with their seeds; a join with the seed table gives
   (document, item) pairs. A pair whose seeds cannot cover the threshold is left out, which loses nothing.
3. Each pair's whole texts are tiled: Karp-Rabin hashes give all maximal matches, the longest one is marked, what is
   left of the others competes again. Tiles do not overlap in either text and may lie in any
   order, so passages that were taken apart and reordered count in full. Texts that share very many seeds are tiled
   length by length instead, which marks the same tiles without a list of all pairs.
4. The share of the item's words under tiles is its coverage; at ``threshold`` the document is contaminated.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.llm.shared import rows_of, shared_folder, stored, text_or_empty
from outskirt.llm.tokens import Spans, U, hashes_between

#: Pairs of seeds that are held at once; texts that share more are tiled length by length.
SEED_PAIRS = 1 << 20
#: Bits of the filter; a power of two.
FILTER_BITS = 1 << 23
_WORD = np.zeros(256, dtype=np.int8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


def text_words(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of ASCII letters and digits and of any other non-ASCII characters, lower-cased."""
    data = (text or "").lower().encode()
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[np.frombuffer(data, dtype=np.uint8)]
    step = np.diff(inside)
    return hashes_between(data, np.flatnonzero(step == 1), np.flatnonzero(step == -1))


def _common(item: Spans, doc: Spans, free: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Starts in the item and in the document of free stretches of ``size`` words that both have, and their hashes."""
    out, grams = [], []
    for spans, own in ((item, free[0]), (doc, free[1])):
        used = np.concatenate(([0], np.cumsum(~own)))
        out.append(np.flatnonzero(used[size:] == used[:-size]) if spans.n >= size else np.zeros(0, dtype=np.int64))
        grams.append(spans.grams(size)[out[-1]])
    for i in (0, 1):
        kept = np.isin(grams[i], grams[1 - i])
        out[i], grams[i] = out[i][kept], grams[i][kept]
    return [*out, *grams]


def _by_length(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """:func:`tiles` without pairs of seeds: the length of the longest match by bisection, then from left to right the first free
    place in the document for each of its places in the item. Linear memory, and time but for the number of lengths."""
    spans, out = (Spans(item), Spans(doc)), []
    free = [np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)]
    most = min(len(item), len(doc))
    while True:
        low, high = min_match - 1, most
        while low < high:  # the longest length that both have
            size = (low + high + 1) // 2
            low, high = (size, high) if len(_common(*spans, free, size)[0]) else (low, size - 1)
        if low < min_match:
            return out
        xs, ys, a, b = _common(*spans, free, low)
        order = np.argsort(b, kind="stable")
        ys, first, last = ys[order], *(np.searchsorted(b[order], a, side) for side in ("left", "right"))
        # Places of a stretch that turned out to be taken stay so: each is looked at once. A tile that overlaps one takes an end of it.
        at: dict[int, int] = {}
        for x, begin, end in zip(xs.tolist(), first.tolist(), last.tolist()):
            if not (free[0][x] and free[0][x + low - 1]):
                continue
            i = at.get(begin, begin)
            while i < end and not (free[1][ys[i]] and free[1][ys[i] + low - 1]):
                i += 1
            at[begin] = i
            if i < end and (item[x : x + low] == doc[ys[i] : ys[i] + low]).all():
                free[0][x : x + low] = free[1][ys[i] : ys[i] + low] = False
                out.append((x, int(ys[i]), low))
        most = low - 1


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(start in the item, start in the document, length): longest first, of equal ones the leftmost."""
    a, b = Spans(item).grams(min_match), Spans(doc).grams(min_match)
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = high - low
    if n.sum() > SEED_PAIRS:
        return _by_length(item, doc, min_match)
    j = np.repeat(np.arange(len(b)), n)
    i = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    if not len(i):
        return []
    new = np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(i) != 1)))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(i)]))) + min_match - 1
    heap = [(-int(s), int(i[f]), int(j[f])) for f, s in zip(first, size, strict=True)]
    heapq.heapify(heap)
    used_item, used_doc, out = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool), []
    while heap:
        length, x, y = heapq.heappop(heap)
        length = -length
        used = used_item[x : x + length] | used_doc[y : y + length] | (item[x : x + length] != doc[y : y + length])
        if not used.any():
            used_item[x : x + length] = used_doc[y : y + length] = True
            out.append((x, y, length))
            continue
        edge = np.diff(np.concatenate(([1], used.astype(np.int8), [1])))
        for s, e in zip(np.flatnonzero(edge == -1), np.flatnonzero(edge == 1), strict=True):
            if e - s >= min_match:
                heapq.heappush(heap, (-int(e - s), x + int(s), y + int(s)))
    return out


def _seeds(min_match: int):
    schema = pa.schema([("gram", pa.int64()), ("places", pa.int32()), ("n_words", pa.int32())])

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = text_words(text.as_py())
                grams, n = np.unique(Spans(words).grams(min_match), return_counts=True)
                if len(grams):
                    made = {"gram": grams.view(np.int64), "places": n, "n_words": [len(words)] * len(grams)}
                    made = rows_of(made, schema)
                    ids = pa.array([item.as_py()] * len(grams), type=batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *made.columns], names=["item", *schema.names])

    return run


def _filter(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter as 64-bit words; at most FILTER_BITS / 64 rows come to the driver."""
    at = seeds.select(F.pmod("gram", F.lit(FILTER_BITS)).alias("bit"))
    rows = at.select(F.shiftright("bit", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("m"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for w, m in rows.groupBy("w").agg(F.bit_or("m")).collect():
        out[w] = m
    return out.view(np.uint64)


def _candidates(bits, min_match: int):
    """Rows that have a gram in the filter, with those grams."""

    def run(batches):
        words_of_filter = bits.value
        for batch in batches:
            keep, grams = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                found = np.unique(Spans(text_words(text.as_py())).grams(min_match))
                at = found & U(FILTER_BITS - 1)
                hit = (words_of_filter[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)
                found = found[hit.astype(bool)]
                if len(found):
                    keep.append(i)
                    grams.append(found.view(np.int64))
            if keep:
                rows = batch.take(pa.array(keep))
                lists = pa.array(grams, type=pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*batch.schema.names, "grams"])

    return run


def _tile(min_match: int, threshold: float):
    extra = [("n_tiles", pa.int32()), ("covered", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64())]

    def run(batches):
        for batch in batches:
            keep, made = [], []
            texts, items = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                item = text_words(items[i].as_py())
                found = tiles(item, text_words(texts[i].as_py()), min_match)
                covered = sum(length for _, _, length in found)
                if covered and covered >= threshold * len(item):
                    keep.append(i)
                    made.append((len(found), covered, len(item), covered / len(item)))
            if keep:
                rows = batch.take(pa.array(keep))
                new = [pa.array(v, type=t) for v, (_, t) in zip(zip(*made, strict=True), extra, strict=True)]
                names = [*batch.schema.names[:-2], *(n for n, _ in extra)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-2], *new], names=names)

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5, unnamed: bool = False
) -> DataFrame:
    """Rows (doc_id, text_hash, item_id, n_tiles, covered, item_words, coverage), one per contaminated document and item.

    Words are lower-cased runs of letters and digits. Tiles have at least ``min_match`` words; ``coverage`` is the
    share of the item's words under tiles, at least ``threshold``. Null and empty texts and items shorter than
    ``min_match`` words match nothing. Repeated rows (same id, same text) give one row per item, ids may
    be null. Empty tables give no rows. ``text_hash`` (xxhash64) tells rows of one id with different texts apart.
    Each distinct text of an item_id is an item of its own, with rows of its own. Items with a null item_id take part
    only with ``unnamed``.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    items = benchmark.select("item_id", "text").distinct()
    if not unnamed:
        items = items.where("item_id is not null")
    # Stored, so that a number stands for the same item in both reads; item_id is only handed on.
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), folder, "items")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    seeds = items.select("item", "text").mapInArrow(_seeds(min_match), "item long, gram long, places int, n_words int")
    seeds = stored(seeds, folder, "seeds")
    bits = spark.sparkContext.broadcast(_filter(seeds))
    narrow = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, text string"
    found = narrow.mapInArrow(_candidates(bits, min_match), f"{shape}, grams array<long>")
    found = stored(found, folder, "candidates")
    # Repeated rows share id and hash; their seeds count once.
    hits = found.select("doc_id", "text_hash", "grams").dropDuplicates(["doc_id", "text_hash"])
    hits = hits.select("doc_id", "text_hash", F.explode("grams").alias("gram"))
    # Each item position that a shared gram starts at covers at most min_match words.
    pairs = (
        hits.join(seeds, "gram")
        .groupBy("doc_id", "text_hash", "item")
        .agg((F.sum("places") * min_match >= F.max("n_words") * threshold).alias("can"))
        .where("can")
        .drop("can")
    )
    pairs = stored(pairs, folder, "pairs").alias("p")
    same = F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.text_hash") == F.col("t.text_hash"))
    texts = found.select("doc_id", "text_hash", "text").alias("t")
    both = pairs.join(texts, same).select("p.*", "t.text")
    both = both.join(items.withColumnRenamed("text", "item_text"), "item")
    both = both.select("doc_id", "text_hash", "item_id", "text", "item_text")
    schema = f"{shape.rpartition(',')[0]}, item_id {kind}, n_tiles int, covered int, item_words int, coverage double"
    return both.mapInArrow(_tile(min_match, threshold), schema).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5) -> DataFrame:
    """``docs`` without the contaminated rows, whether or not the item has an id."""
    bad = contaminated(docs, benchmark, threshold, min_match, unnamed=True).select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")
    )
    bad = stored(bad.distinct(), shared_folder(docs.sparkSession), "contaminated")
    key = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_or_empty()) == F.col("__hash"))
    return docs.join(bad.hint("shuffle_hash"), key, "left_anti")
