"""Merkle manifest of a table, and proofs of all rows by octopus multiproofs.

A group's rows are the leaves of its tree, in order; each run of ``FAN`` neighbours gives a node, until one is left. The
groups' roots are the leaves of a tree of their own.

1. Leaves are digests of whole rows. They are range-sorted and numbered: a number within the task, plus the rows of the group in
   the ranges before. A group may fill many ranges; none is gathered.
2. Nodes: tasks take ``FAN ** STEP`` neighbours at a time and climb ``STEP`` levels, so a few rounds reach the roots.
3. Proofs: the leaves of a group that lie in one range, up to ``SET_ROWS``, are a set. A set names the fewest nodes that
   its proofs need beside what its own leaves yield, and one join fetches the nodes of all sets. The set then derives
   the nodes that its leaves share and expands each leaf's proof.

What a proof says is checked by folding: from a leaf, given anew if it was tampered with, and the siblings up to a root, to be compared with
the published one.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outskirt.llm.shared import shared_folder, stored, width

FAN, STEP, SET_ROWS = 8, 3, 1024
CHUNK = FAN**STEP
SET = ["__tree", "__part", "__set"]


def field(value: Column) -> Column:
    """A value, unambiguous among its neighbours: ``-`` for null, else its UTF-8 bytes' number, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _number(batches):
    part, tree, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        nth = []
        for own in batch.column("__tree").to_pylist():
            tree, n = own, n + 1 if own == tree else 0
            nth.append(n)
        columns = [pa.array([part] * len(nth), type=pa.int64()), pa.array(nth, type=pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "__part", "__nth"])


def numbered(leaves: DataFrame, order: list[str], folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``__part``, ``__set`` and ``__at``, their place in their ``__tree`` by ``order``; and (``__tree``, ``__size``)."""
    schema = T.StructType([*leaves.schema.fields]).add("__part", "long").add("__nth", "long")
    ranges = leaves.repartitionByRange(width(leaves.sparkSession), "__tree", *order).sortWithinPartitions("__tree", *order)
    made = stored(ranges.mapInArrow(_number, schema), folder, f"{name}-ranges")
    parts = made.groupBy("__tree", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    parts = stored(parts, folder, f"{name}-parts")
    sizes = parts.groupBy("__tree").agg(F.sum("__n").alias("__size"))
    made = made.join(parts.drop("__n"), ["__tree", "__part"]).withColumn("__at", F.col("__before") + F.col("__nth"))
    made = made.withColumn("__set", F.expr(f"__nth div {SET_ROWS}")).drop("__before", "__nth")
    return stored(made, folder, name), sizes


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size``."""
    levels = F.when(size <= 1, 0)
    for level in range(1, 21):
        levels = levels.when(size <= FAN**level, level)
    return levels


NODE = "__tree string, __level int, __at long, digest string"


def _climb(base: int):
    def run(table: pa.Table) -> pa.Table:
        tree, at = table.column("__tree")[0].as_py(), table.column("__at").to_pylist()
        digests = [d for _, d in sorted(zip(at, table.column("digest").to_pylist()))]
        first, out, whole = min(at), [], min(at) == 0 and len(at) < CHUNK
        for level in range(base + 1, base + STEP + 1):
            if whole and len(digests) == 1:
                break
            digests = [_joined(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]
            first //= FAN
            out += [(tree, level, first + i, d) for i, d in enumerate(digests)]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["__tree", "__level", "__at", "digest"])

    return run


def inner_nodes(leaves: DataFrame, sizes: DataFrame, folder: str, name: str) -> DataFrame:
    """All nodes above the leaves: ``__tree``, ``__level``, ``__at``, ``digest``."""
    most = sizes.agg(F.max("__size")).first()[0] or 0
    below, level, rounds = leaves.select("__tree", "__at", "digest"), 0, []
    while not rounds or FAN**level < most:
        chunks = below.withColumn("__chunk", F.expr(f"__at div {CHUNK}"))
        rounds.append(stored(chunks.groupBy("__tree", "__chunk").applyInArrow(_climb(level), NODE), folder, f"{name}-{level}"))
        level += STEP
        below = rounds[-1].where(F.col("__level") == level)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def all_nodes(leaves: DataFrame, inner: DataFrame) -> DataFrame:
    return leaves.select("__tree", F.lit(0).alias("__level"), "__at", "digest").unionByName(inner)


def missing(places: list[int], size: int) -> list[tuple[int, int]]:
    """The fewest nodes (level, place) that the proofs of leaves at ``places``, in a tree of ``size`` leaves, need besides what they yield."""
    out, level, known = [], 0, set(places)
    while size > 1:
        runs = {at // FAN for at in known}
        out += [(level, at) for r in sorted(runs) for at in range(FAN * r, min(FAN * r + FAN, size)) if at not in known]
        level, known, size = level + 1, runs, -(-size // FAN)
    return out


def _missing(batches):
    """Rows with ``__places`` and ``__size`` to the coordinates they miss; one row without coordinates for each, too."""
    for batch in batches:
        take, levels, places = [], [], []
        for i, row in enumerate(zip(batch.column("__places").to_pylist(), batch.column("__size").to_pylist())):
            for level, at in [(None, None), *missing(*row)]:
                take.append(i)
                levels.append(level)
                places.append(at)
        rest = batch.drop_columns(["__places"]).take(pa.array(take, type=pa.int64()))
        columns = [pa.array(levels, type=pa.int32()), pa.array(places, type=pa.int64())]
        yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, "__level", "__at"])


def fetched(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` has ``__tree``, ``__places``, ``__size``: a row for each node that a set misses, with its digest, and one without for each set."""
    schema = T.StructType([f for f in sets.schema if f.name != "__places"]).add("__level", "integer").add("__at", "long")
    return sets.mapInArrow(_missing, schema).join(nodes, ["__tree", "__level", "__at"], "left")


def expand(places: list[int], digests: list[str], size: int, nodes: dict[tuple[int, int], str]):
    """For each leaf of a set the list of (siblings before, siblings after), level by level; and the root of the tree."""
    known, level, steps = dict(zip(places, digests)), 0, []
    while size > 1:
        runs, own = {}, {}
        for r in {at // FAN for at in known}:
            run = [known[at] if at in known else nodes[level, at] for at in range(FAN * r, min(FAN * r + FAN, size))]
            runs[r] = _joined(run)
            for at in range(FAN * r, FAN * r + len(run)):
                if at in known:
                    own[at] = "".join(run[: at - FAN * r]), "".join(run[at - FAN * r + 1 :])
        steps.append(own)
        level, known, size = level + 1, runs, -(-size // FAN)
    paths: dict = {0: []}
    for own in reversed(steps):
        paths = {at: [step, *paths[at // FAN]] for at, step in own.items()}
    return [paths[at] for at in places], known[0]


def fold(leaf: str, path) -> str:
    for before, after in path:
        leaf = sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def _prove(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(leaves: pa.Table, wanted: pa.Table) -> pa.Table:
        nodes, top, one = {}, {}, None
        for row in wanted.select(["__level", "__at", "__top_level", "__top_at", "digest", "__size", "__place", "__trees"]).to_pylist():
            one = one or row
            if row["__level"] is not None:
                nodes[row["__level"], row["__at"]] = row["digest"]
            if row["__top_level"] is not None:
                top[row["__top_level"], row["__top_at"]] = row["digest"]
        paths, subroot = expand(leaves.column("__at").to_pylist(), leaves.column("digest").to_pylist(), one["__size"], nodes)
        upper, _ = expand([one["__place"]], [subroot], one["__trees"], top)
        paths = [[*path, *upper[0]] for path in paths]
        given = [fold(leaf, path) for leaf, path in zip(leaves.column("__given").to_pylist(), paths)]
        made = {
            "subroot": [subroot] * len(paths),
            "proof": ["".join(x for step in path for x in step) for path in paths],
            "folded_root": given,
        }
        return pa.table([pa.array(made[f.name], type=f.type) if f.name in made else leaves.column(f.name) for f in kind], schema=kind)

    return run


def proofs(docs: DataFrame, leaf: Column, given: Column, group: str, order: str) -> DataFrame:
    """A row per row of ``docs``: ``doc_id`` (the ``order`` column), ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root``, ``verified``.

    ``leaf`` is the digest that goes into the manifest, ``given`` the one that is presented with the proof. ``group`` (a string; null is
    a group) has a tree each, its leaves by ``order`` (nulls first), then digest; groups are ordered bytewise, null first.
    ``proof`` is the siblings' hexadecimal digests from the leaf's run to the root, each run's from left to right. Repeated rows are leaves
    of their own: which of them is first does not show. No rows give no rows. Other columns do not matter.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`")), F.lit("")).alias("__tree")
    leaves = docs.select(F.col(f"`{order}`").alias("doc_id"), tree, leaf.alias("digest"), given.alias("__given"))
    # Repeated rows may be many; the row number splits them.
    leaves = stored(leaves.withColumn("__row", F.monotonically_increasing_id()), folder, "leaves")
    leaves, sizes = numbered(leaves, ["doc_id", "digest", "__row"], folder, "places")
    nodes = all_nodes(leaves, inner_nodes(leaves, sizes, folder, "nodes"))
    ends = sizes.select("*", height(F.col("__size")).alias("__level"), F.lit(0).cast("long").alias("__at"))
    subroots = ends.join(nodes, ["__tree", "__level", "__at"]).select(F.lit("").alias("__tree"), F.col("__tree").alias("__of"), "__size", "digest")
    # The tree of the groups' roots: each of its leaves is a set, so that what it misses is its proof.
    tops, top_sizes = numbered(stored(subroots, folder, "subroots"), ["__of"], folder, "tops")
    top_nodes = all_nodes(tops, inner_nodes(tops, top_sizes, folder, "top-nodes"))
    end = top_sizes.select("*", height(F.col("__size")).alias("__level"), F.lit(0).cast("long").alias("__at"))
    root = end.join(top_nodes, ["__tree", "__level", "__at"]).select("__size", "digest").first()
    trees, root = root or (0, None)
    tops = tops.select("__tree", "__of", F.col("__size").alias("__leaves"), F.col("__at").alias("__place"), F.array("__at").alias("__places"))
    upper = stored(fetched(tops.withColumn("__size", F.lit(trees).cast("long")), top_nodes), folder, "upper")
    upper = upper.select(
        F.col("__of").alias("__tree"), F.col("__leaves").alias("__size"), "__place", F.col("__level").alias("__top_level"),
        F.col("__at").alias("__top_at"), F.col("digest").alias("__top_digest"),
    )
    sets = leaves.groupBy(*SET).agg(F.collect_list("__at").alias("__places"))
    groups = upper.where("__top_level is null").select("__tree", "__size", "__place")
    own = fetched(sets.join(groups, "__tree"), nodes).withColumns({"__top_level": F.lit(None).cast("int"), "__top_at": F.lit(None).cast("long")})
    above = sets.drop("__places").join(upper.where("__top_level is not null"), "__tree").select(
        *SET, "__size", "__place", F.lit(None).cast("int").alias("__level"), F.lit(None).cast("long").alias("__at"),
        "__top_level", "__top_at", F.col("__top_digest").alias("digest"),
    )
    wanted = stored(own.unionByName(above).withColumn("__trees", F.lit(trees).cast("long")), folder, "wanted")
    kind = T.StructType([leaves.schema["doc_id"], T.StructField("digest", T.StringType())])
    for name in ("subroot", "proof", "folded_root"):
        kind.add(name, "string")
    out = leaves.groupBy(*SET).cogroup(wanted.groupBy(*SET)).applyInArrow(_prove(kind), kind)
    root = F.lit(root).cast("string")
    return out.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
