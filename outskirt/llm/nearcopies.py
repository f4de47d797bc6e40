"""Near copies by SimHash, compared by the Jaccard similarity of their word shingles; an exact join finds what SimHash leaves.

1. Texts with the same set of shingles are one. SimHash of the shingles (:mod:`outskirt.llm.simhash`: grid of segments' bit
   counts, Manhattan bound, bits) proposes the sets of equal or linked fingerprints. Sketches rule pairs out: counts of a
   set's hashes by their low bits, of which the smaller ones sum to no less than what two sets share. Only the texts of
   what is left are fetched and compared, and links are joined to components.
2. Fingerprints tell a similarity by chance, so that SimHash alone would lose pairs near ``LIKE``. An exact join looks for
   links between the components that SimHash has found. Two sets with a Jaccard similarity of ``LIKE`` share a shingle
   among the first n - ceil(LIKE n) + 1 of each, in any order that all sets keep (prefix filter). So every pair meets in the
   cell of a shingle, and none is lost. The order takes rare shingles first: common ones (a bounded list, which only saves
   rows) would crowd their cells.
3. Small cells give all their pairs, larger ones neighbours in several orders; lengths and positions rule pairs out, then
   pairs of one component go, and what is left is compared as in 1.
4. Larger cells that still hold several components look at the pairs across them, by sketches in the task. Short sets travel
   in whole: they are compared in the task too, which gives a tree of links for each component that it finds. Of longer
   ones the pairs that sketches allow go on to be compared.

A table is dropped once all that was made of it is stored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.llm import simhash
from outskirt.llm.components import components
from outskirt.llm.shared import bucketed, dropped, rows_of, shared_folder, stored, width
from outskirt.llm.tokens import LOWER, Spans, U, mix, word_hashes

#: Words of a shingle, and the least similarity as a fraction.
WORDS, LIKE = 5, (4, 5)
#: Fingerprints link at so many bits; at a similarity of 0.8 some 9.7 of 64 differ on average, at 0.9 some 6.6.
BITS = 14
#: Cells up to this size give all pairs at once; of larger ones a block takes this many rows.
SMALL, BLOCK = 8, 1024
#: Shingles that are told to be common, at most, and how often one stands in a chunk of this many to be counted.
COMMON, OFTEN, CHUNK = 1 << 18, 4, 1 << 22
#: Sets of at most this many shingles travel in whole; a sketch has a count for each this many shingles, and this many at least.
SHORT, PER_COUNT, COUNTS = 64, 8, 64
#: A count of this or more is unknown.
FULL = 255


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words are one shingle, no words none."""
    words = word_hashes((text or "").encode().translate(LOWER))
    return np.unique(Spans(words).grams(min(WORDS, len(words)))) if len(words) else np.zeros(0, dtype=U)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return LIKE[1] * both >= LIKE[0] * (len(x) + len(y) - both)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Counts of the hashes by their low bits, as bytes; the number of counts is a power of two that grows with the set."""
    size = max(COUNTS, 1 << (max(len(grams) // PER_COUNT, 1) - 1).bit_length())
    return np.minimum(np.bincount((grams & U(size - 1)).astype(np.int64), minlength=size), FULL).astype(np.uint8)


def _folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Sketches (a row each) with ``size`` counts. Unknown counts stay so."""
    parts = counts.astype(np.uint32).reshape(len(counts), -1, size)
    return np.where((parts == FULL).any(axis=1), np.uint32(1 << 31), parts.sum(axis=1, dtype=np.uint32))


def may_be_alike(x: np.ndarray, y: np.ndarray, nx: int, ny: np.ndarray) -> np.ndarray:
    """Whether a set of nx shingles and sketch x can be alike sets of ny shingles and sketches y (a row each)."""
    size = min(len(x), y.shape[1])
    if len(x) == y.shape[1] and (y < FULL).all() and (x < FULL).all():
        both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    else:
        both = np.minimum(_folded(x[None], size), _folded(y, size)).sum(axis=1, dtype=np.int64)
    return (LIKE[0] + LIKE[1]) * both >= LIKE[0] * (nx + ny)


def _often(batches):
    """(gram, n) of shingles that stand often in a chunk."""
    schema, held, size = pa.schema([("gram", pa.int64()), ("n", pa.int64())]), [], 0

    def counted():
        found, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= OFTEN
        return rows_of({"gram": found[many].view(np.int64), "n": n[many]}, schema)

    for batch in batches:
        for text in batch.column(0):
            held.append(shingles(text.as_py()))
            size += len(held[-1])
            if size >= CHUNK:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and their counts: at most COMMON rows come to the driver."""
    counts = docs.select("text").mapInArrow(_often, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    grams = rows.column("gram").to_numpy().view(U)
    order = np.argsort(grams)
    return grams[order], rows.column("n").to_numpy()[order]


def _prefixes(common):
    def run(batches):
        known, counts = common.value
        for batch in batches:
            sigs, sizes, prefixes, sketches, whole, prints = [], [], [], [], [], []
            for text in batch.column(1):
                grams = shingles(text.as_py())
                n = len(grams)
                sigs.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                sizes.append(n)
                times = np.zeros(n, dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    times = np.where(known[at] == grams, counts[at], 0)
                length = n - -(-n * LIKE[0] // LIKE[1]) + 1 if n else 0
                prefixes.append(grams[np.lexsort((grams, times))[:length]].view(np.int64))
                sketches.append(sketch(grams).tobytes())
                whole.append(grams.tobytes() if n <= SHORT else None)
                prints.append(simhash.signed(simhash.simhash(text.as_py(), WORDS)))
            columns = [pa.array(sigs, type=pa.binary()), pa.array(sizes, type=pa.int32()), pa.array(prefixes, type=pa.list_(pa.int64()))]
            columns += [pa.array(sketches, type=pa.binary()), pa.array(whole, type=pa.binary()), pa.array(prints, type=pa.int64())]
            names = ["id", "sig", "n", "prefix", "sketch", "grams", "fp"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def _possible(n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sets of rows x and y can be alike, by what may stand before and after the shared shingle."""
    most = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])
    return (LIKE[0] + LIKE[1]) * most >= LIKE[0] * (n[x] + n[y])


def _grouped(t: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal (cell, i, j), the first three columns."""
    return np.cumsum(np.concatenate(([True], (t[1:, :3] != t[:-1, :3]).any(axis=1)))) - 1


def _whole_groups(batches):
    """Batches sorted by (cell, i, j) cut where a group ends: (the number columns as a matrix, the table)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        t = _numbers(rest)
        differs = (t[:, :3] != t[-1, :3]).any(axis=1)
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield np.ascontiguousarray(t[:cut]), rest.slice(0, cut)
        rest = rest.slice(cut)
    if rest is not None:
        yield _numbers(rest), rest


def _numbers(rows: pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("cell", "i", "j", "id", "n", "pos")], axis=1)


def _within(batches):
    """Rows sorted by (cell, i, j): all pairs of small cells, and neighbours in several orders of larger ones."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def made(x, y, ids):
        return rows_of({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])}, schema)

    for t, _ in _whole_groups(batches):
        ids, n, pos, group = t[:, 3], t[:, 4], t[:, 5], _grouped(t)
        large = np.bincount(group)[group] > SMALL
        few = np.flatnonzero(~large)
        for d in range(1, SMALL):
            x, y = few[d:], few[:-d]
            same = group[x] == group[y]
            x, y = x[same], y[same]
            can = _possible(n, pos, x, y)
            yield made(x[can], y[can], ids)
        many = np.flatnonzero(large)
        for order in range(4):
            key = mix(ids[many].view(U) + U(order)) if order else n[many].astype(U)
            along = many[np.lexsort((ids[many], key, group[many]))]
            x, y = along[1:], along[:-1]
            can = (group[x] == group[y]) & _possible(n, pos, x, y)
            yield made(x[can], y[can], ids)


def _across(batches):
    """Rows sorted by (cell, i, j): pairs across labels, ``sure`` if both sets were compared."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def made(found, ids):
        x, y, sure = (np.array(c) for c in zip(*found, strict=True))
        return rows_of({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "sure": sure}, schema)

    for t, rows in _whole_groups(batches):
        group = _grouped(t)
        for g in np.unique(group):
            lo, hi = np.searchsorted(group, [g, g + 1])
            found = []
            for pair in _group_pairs(t[lo:hi], rows.slice(lo, hi - lo)):
                found.append(pair)
                if len(found) >= 1 << 16:
                    yield made(found, t[lo:hi, 3])
                    found = []
            if found:
                yield made(found, t[lo:hi, 3])


def _group_pairs(t: np.ndarray, rows: pa.Table):
    """(x, y, sure) of one group. Links of short sets unite labels at once, so that no further pair of theirs is looked at."""
    n, pos, mixed = t[:, 4], t[:, 5], t[0, 1] != t[0, 2]
    label = rows.column("label").to_numpy().astype(np.int64)
    second = rows.column("second").to_numpy(zero_copy_only=False)
    whole = [None if g is None else np.frombuffer(g, dtype=U) for g in rows.column("grams").to_pylist()]
    sketches = [np.frombuffer(s, dtype=np.uint8) for s in rows.column("sketch").to_pylist()]
    size = np.array([len(s) for s in sketches])
    place, tables = np.zeros(len(t), dtype=np.int64), {}
    for k in np.unique(size):
        at = np.flatnonzero(size == k)
        place[at], tables[k] = np.arange(len(at)), np.stack([sketches[i] for i in at])
    for x in range(len(t) - 1):
        y = np.arange(x + 1, len(t))
        y = y[label[y] != label[x]]
        if mixed:  # pairs of one block are those of the block with itself
            y = y[second[y] != second[x]]
        y = y[_possible(n, pos, np.full(len(y), x), y)]
        for k in np.unique(size[y]):
            some = y[size[y] == k]
            some = some[may_be_alike(sketches[x], tables[k][place[some]], n[x], n[some])]
            for z in some:
                if whole[x] is None or whole[z] is None:
                    yield x, z, False
                elif label[z] != label[x] and alike(whole[x], whole[z]):
                    label[label == label[z]] = label[x]
                    yield x, z, True


def _allowed(batches):
    """(a, b) of the pairs that sketches allow."""
    for batch in batches:
        nx, ny = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        sketches = ([np.frombuffer(s.as_py(), dtype=np.uint8) for s in batch.column(c)] for c in (2, 4))
        keep = [
            bool(may_be_alike(x, y[None], nx[k], ny[k : k + 1])[0]) for k, (x, y) in enumerate(zip(*sketches, strict=True))
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))


def _verify(batches):
    """Rows (a, b, x, y) in the order of b: the pairs whose texts are alike."""
    last, set_y = None, None
    for batch in batches:
        keep = []
        for b, x, y in zip(*(batch.column(c) for c in (1, 2, 3)), strict=True):
            if b.as_py() != last:
                last, set_y = b.as_py(), shingles(y.as_py())
            keep.append(alike(shingles(x.as_py()), set_y))
        yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))


def _blocks(cells: DataFrame, *more: str) -> DataFrame:
    """``cells`` (cell, size, id, n, pos, ...): every pair of blocks of a cell together, ``second`` telling which block a row is of."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    met = cells.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("cell", "own", other, "id", "n", "pos", *more)
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    met = met.select("cell", i, j, (F.col("own") > F.col("other")).alias("second"), "id", "n", "pos", *more)
    return met.repartition(width(cells.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "id")


def _linked(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """``pairs`` (a, b), stored: those whose texts are alike."""
    left = base.select(F.col("__row").alias("a"), F.col("text").alias("x"))
    right = base.select(F.col("__row").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verify, "a long, b long")


def _compared(pairs: DataFrame, sketches: DataFrame, base: DataFrame, folder: str, name: str) -> DataFrame:
    """``pairs`` (a, b), stored: those that are alike, by ``sketches`` (id, n, sketch, label) and then by their texts. Pairs of one
    label are left out."""
    left, right = (
        sketches.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("sketch", "n", "label")]) for c in ("a", "b")
    )
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where("label_a <> label_b")
    both = both.select("a", "b", "sketch_a", "n_a", "sketch_b", "n_b")
    return _linked(stored(both.mapInArrow(_allowed, "a long, b long"), folder, name), base)


def simhash_links(sets: DataFrame, sketches: DataFrame, base: DataFrame, folder: str) -> DataFrame:
    """``sets`` (id, fp), stored: links (a, b) of the first set of a fingerprint with the others, and with the first ones of the
    fingerprints that link to it (``simhash.links``), where the sets are alike."""
    spark = sets.sparkSession
    held = stored(sets.groupBy("fp").agg(F.min("id").alias("least")), folder, "fingerprints")
    linked = stored(simhash.links(held, f"{folder}/simhash", BITS), folder, "fingerprint_links")
    for name in ("cells", "crowded"):
        dropped(spark, f"{folder}/simhash/{name}")
    same = sets.hint("merge").join(held, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    ends = (held.select(F.col("fp").alias(c), F.col("least").alias(f"id_{c}")).hint("merge") for c in ("a", "b"))
    across = linked.join(next(ends), "a").join(next(ends), "b")
    across = across.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    pairs = stored(same.unionByName(across), folder, "pairs_simhash")
    return stored(_compared(pairs, sketches, base, folder, "allowed_simhash"), folder, "links_simhash")


def _links_within(met: DataFrame, sketches: DataFrame, base: DataFrame, folder: str) -> DataFrame:
    """Links between labels in small cells, and some in larger ones."""
    pairs = stored(_blocks(met).mapInArrow(_within, "a long, b long").distinct(), folder, "pairs_within")
    return stored(_compared(pairs, sketches, base, folder, "allowed"), folder, "links_within")


def _links_across(many: DataFrame, prints: DataFrame, base: DataFrame, folder: str) -> DataFrame:
    """Links between labels in crowded cells, enough of them to join what is alike."""
    many = stored(many.join(prints.select("id", "sketch", "grams").hint("merge"), "id"), folder, "sketched")
    met = _blocks(many, "label", "sketch", "grams")
    pairs = stored(met.mapInArrow(_across, "a long, b long, sure boolean").distinct(), folder, "pairs_across")
    sure = pairs.where("sure").select("a", "b")
    return stored(_linked(pairs.where("not sure").select("a", "b"), base).unionByName(sure), folder, "links_across")


def groups(base: DataFrame, folder: str) -> DataFrame:
    """``base`` (__row, text), stored: rows (__row, component), the smallest row reachable over near copies."""
    spark = base.sparkSession
    common = spark.sparkContext.broadcast(_common(base))
    shape = "id long, sig binary, n int, prefix array<long>, sketch binary, grams binary, fp long"
    prints = stored(base.select("__row", "text").mapInArrow(_prefixes(common), shape), folder, "prefixes")
    first = stored(prints.groupBy("sig").agg(F.min("id").alias("first"), F.min_by("fp", "id").alias("fp")), folder, "sets")
    sets = first.select(F.col("first").alias("id"), "fp")
    near = simhash_links(sets, prints.withColumn("label", F.col("id")), base, folder)
    close = stored(components(near, f"{folder}/close"), folder, "stars_simhash")
    roots = close.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = sets.select("id").join(roots.hint("merge"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    # Stored, so that the joins below stand on plain tables and Spark can split a set of many pairs or a crowded cell.
    sketches = stored(prints.select("id", "n", "sketch").join(labels.hint("merge"), "id"), folder, "sketches")
    met = prints.select("id", "n", F.posexplode("prefix").alias("pos", "cell"))
    met = stored(met.join(sets.select("id").hint("merge"), "id", "left_semi"), folder, "cells")
    crowded = stored(met.groupBy("cell").agg(F.count("*").alias("size")).where("size >= 2"), folder, "crowded")
    met = stored(met.hint("merge").join(crowded, "cell"), folder, "met")
    for name in ("cells", "crowded"):
        dropped(spark, f"{folder}/{name}")
    near = _links_within(met, sketches, base, folder)
    stars = stored(components(close.unionByName(near), f"{folder}/first"), folder, "stars")
    roots = stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
    many = met.where(F.col("size") > SMALL)
    many = many.join(roots.hint("merge"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    many = stored(many, folder, "labelled")
    for name in ("met", "sketches", "pairs_within"):
        dropped(spark, f"{folder}/{name}")
    mixed = many.groupBy("cell").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("cell")
    many = many.hint("merge").join(stored(mixed, folder, "mixed"), "cell", "left_semi")
    further = _links_across(many, prints, base, folder)
    for name in ("labelled", "sketched"):
        dropped(spark, f"{folder}/{name}")
    roots = components(stars.unionByName(further), f"{folder}/second")
    roots = first.join(roots.select(F.col("a").alias("first"), F.col("b").alias("root")), "first", "left")
    roots = stored(roots.select("sig", F.coalesce("root", "first").alias("component")), folder, "roots")
    found = prints.select(F.col("id").alias("__row"), "sig").join(roots, "sig").select("__row", "component")
    found = stored(found, folder, "components")
    dropped(spark, f"{folder}/prefixes")
    return found


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id (null last), of such the first.

    Near copies have a Jaccard similarity of at least LIKE between their sets of WORDS-word shingles (words between white
    space, A-Z lower-cased, shingles told apart by 64-bit hashes); a group is what is reachable over such pairs. Fewer words are
    one shingle; null and wordless texts are copies of each other."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    base = bucketed(docs.select(F.monotonically_increasing_id().alias("__row"), *columns), folder, "texts", "__row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    found = groups(base, folder).join(base.select("__row", order.alias("rank")), "__row")
    best = found.groupBy("component").agg(F.min("rank").alias("rank"))
    kept = best.select(F.col("rank")["__row"].alias("__row"))
    return base.join(kept.hint("shuffle_hash"), "__row", "left_semi").select(*columns)
