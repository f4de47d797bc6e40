"""Counterfactual-regularised toxicity classifier.

Features of a text are its distinct words and word beginnings (first 4, 5 and 6 characters), hashed to 64 bits. A
bounded sample of labelled rows gives, in Spark, counts per feature and label; the most telling features (bounded) are
the vocabulary. Each labelled text with identity terms is also taken with all of them, in every sentence,
swapped for another group's, or for a neutral word; a text without any gets a mention of a group behind its words, which is
swapped likewise. A logistic model is fitted on the driver to the bounded sample;
besides the labels' loss it pays for the squared change of the score under such swaps, and an L1
penalty keeps only features that matter. Scoring reads whole texts and needs the model alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outskirt.llm.decontaminate import _WORD
from outskirt.llm.shared import shared_folder, stored
from outskirt.llm.tokens import U, hashes_between, mix

#: Identity terms by kind; within a kind each is swapped for the next one, and for the kind's last, a neutral word.
IDENTITY_TERMS = {
    "gender": ["women", "men", "girls", "boys", "transgender", "nonbinary", "people"],
    "gender_one": ["woman", "man", "girl", "boy", "person"],
    "religion": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"],
    "religion_of": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "ordinary"],
    "origin": ["black", "white", "asian", "latino", "african", "european", "ordinary"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer", "ordinary"],
    "status": ["immigrants", "refugees", "natives", "disabled", "elderly", "people"],
    "de": ["frauen", "männer", "muslime", "christen", "juden", "migranten", "leute"],
    "fr": ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "gens"],
    "es": ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "gente"],
}
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """``sample_rows``: labelled rows that are learned from at most. ``max_features``: size of the vocabulary at most, besides the
    features of ``terms``. ``place``: whether texts without identity terms get a mention of a group for the penalty."""

    sample_rows: int = 20_000
    max_features: int = 1 << 12
    min_rows: int = 5
    swap_weight: float = 4.0
    l1: float = 2e-5
    l2: float = 1e-6
    steps: int = 300
    terms: dict = field(default_factory=lambda: IDENTITY_TERMS)
    place: bool = True


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, the bias, and how many pairs of a text and a swapped one were learned from:
    ``pairs`` of texts with identity terms of their own, ``placed`` of texts that got a mention."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0
    placed: int = 0

    def score(self, text: str | None) -> float:
        z = self.bias
        if len(self.features):
            found = features(text)
            at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            at = np.unique(at[self.features[at] == found])
            z += float(self.weights[at].sum())
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(text: str | None) -> np.ndarray:
    """Hashes of the words and word beginnings; a hash may stand there several times."""
    data = (text or "").lower().encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))
    first, last = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    all_starts, all_ends = [starts], [ends]
    for n in PREFIXES:
        has = last - first >= n
        all_starts.append(starts[has])
        all_ends.append(chars[first[has] + n])
    hashes = hashes_between(data, np.concatenate(all_starts), np.concatenate(all_ends))
    kinds = np.repeat(np.arange(1, len(all_starts) + 1, dtype=U), [len(s) for s in all_starts])
    return mix(hashes ^ kinds)


def swapped(text: str, terms: dict, everywhere: bool = False) -> list[str]:
    """The text with the identity terms of its first sentence that has any, or with ``everywhere`` of all its sentences,
    swapped for the next and for the neutral one."""
    following, neutral = {}, {}
    for words in terms.values():
        for i, word in enumerate(words[:-1]):
            following.setdefault(word, words[(i + 1) % (len(words) - 1)])
            neutral.setdefault(word, words[-1])
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(following, key=len, reverse=True))) + r")\b", re.I)
    found = pattern.search(text)
    if not found:
        return []
    begin = max(text.rfind(c, 0, found.start()) for c in ".!?\n") + 1
    stops = [at for c in ".!?\n" if (at := text.find(c, found.end())) >= 0]
    end = min(stops, default=len(text))
    if everywhere:
        begin, end = 0, len(text)
    out = []
    for to in (following, neutral):
        # A few letters match others only when case is ignored (long s); they fold to them, or the word stays.
        changed = pattern.sub(lambda m, to=to: to.get(m[0].lower(), to.get(m[0].casefold(), m[0])), text[begin:end])
        if changed != text[begin:end]:
            out.append(text[:begin] + changed + text[end:])
    return out


def mention(text: str, terms: dict) -> tuple[str, str, str]:
    """An identity term, told by the text, the next one of its kind, and its neutral word."""
    choices = [(w, words[(i + 1) % (len(words) - 1)], words[-1]) for words in terms.values() for i, w in enumerate(words[:-1])]
    return choices[zlib.crc32(text.encode()) % len(choices)]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count(batches):
    """Counts per feature and label of each batch."""
    schema = ["feature", "toxic", "n"]
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            labels = part.column(1).to_numpy(zero_copy_only=False)
            own = [np.unique(features(t.as_py())) for t in part.column(0)]
            for label in (0, 1):
                chosen = [f for f, y in zip(own, labels, strict=True) if y == label]
                if chosen:
                    found, n = np.unique(np.concatenate(chosen), return_counts=True)
                    columns = [pa.array(found.view(np.int64)), pa.array(np.full(len(n), label)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema)


def _examples(vocabulary, s: Settings):
    """Per text its features' places in the vocabulary, and for each pair of it and a swapped version the places that only
    the one and only the other has."""

    def places(text):
        known = vocabulary.value
        found = features(text)
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        return np.unique(at[known[at] == found]).astype(np.int32)

    def pairs(text, own):
        swaps = [places(t) for t in swapped(text, s.terms, everywhere=True)]
        if swaps or not s.place or not any(len(words) > 1 for words in s.terms.values()):
            return own, swaps, False
        # A mention behind the text's words adds its own features to theirs.
        before, *after = (np.union1d(own, places(word)) for word in mention(text, s.terms))
        return before, after, True

    def run(batches):
        for batch in batches:
            own, plus, minus, placed = [], [], [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                own.append(places(text))
                before, after, added = pairs(text, own[-1])
                plus.append([np.setdiff1d(before, x).tolist() for x in after])
                minus.append([np.setdiff1d(x, before).tolist() for x in after])
                placed.append(added)
            lists = pa.list_(pa.list_(pa.int32()))
            columns = [pa.array(own, type=pa.list_(pa.int32())), pa.array(plus, type=lists), pa.array(minus, type=lists)]
            columns += [pa.array(placed, type=pa.bool_()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "plus", "minus", "placed", "toxic"])

    return run


def _sparse(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, column of each entry)."""
    sizes = [len(r) for r in rows]
    entries = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if rows else np.zeros(0, dtype=np.int64)
    return np.repeat(np.arange(len(rows)), sizes), entries


class Loss:
    """Mean logistic loss of the labels, half the squared weights times ``l2``, and half the squared score changes of the pairs:
    ``swap_weight`` times their mean over the pairs of swapped texts, and as much over those of placed mentions."""

    def __init__(self, own: list, plus: list, minus: list, placed, toxic, n_features: int, s: Settings):
        """``own``: a list of features per text. ``plus``, ``minus``, ``placed``: one entry per pair."""
        self.y, self.n_features, self.l2 = np.asarray(toxic, dtype=np.float64), n_features, s.l2
        self.row, self.col = _sparse(own)
        placed = np.asarray(placed, dtype=bool)
        self.weight = s.swap_weight / np.where(placed, max(placed.sum(), 1), max((~placed).sum(), 1))
        (a, x), (b, y) = _sparse(plus), _sparse(minus)
        self.pair, self.feature = np.concatenate([a, b]), np.concatenate([x, y])
        self.sign = np.repeat([1.0, -1.0], [len(a), len(b)])
        # A bound of the curvature: mean squared row lengths of the texts, the largest row sum of what the pairs add.
        changed = np.bincount(self.pair, minlength=len(placed))
        sums = np.bincount(self.feature, weights=(self.weight * changed)[self.pair], minlength=n_features)
        self.curvature = (1 + float(np.mean([len(r) for r in own]))) / 4 + s.l2 + float(sums.max(initial=0))

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        n = len(self.y)
        z = np.bincount(self.row, weights=w[self.col], minlength=n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - self.y
        grad = np.bincount(self.col, weights=error[self.row], minlength=self.n_features) / n + self.l2 * w
        if len(self.pair):
            change = np.bincount(self.pair, weights=self.sign * w[self.feature], minlength=len(self.weight)) * self.weight
            grad += np.bincount(self.feature, weights=self.sign * change[self.pair], minlength=self.n_features)
        return grad, float(error.mean())


def _train(loss: Loss, s: Settings) -> tuple[np.ndarray, float]:
    """Proximal gradient descent with momentum (FISTA) on the loss and L1."""
    n, positive = len(loss.y), loss.y.sum()
    rate = 1 / loss.curvature
    w, bias = np.zeros(loss.n_features), float(np.log((positive + 0.5) / (n - positive + 0.5)))
    look, look_bias, t = w, bias, 1.0
    for _ in range(s.steps):
        grad, bias_grad = loss.gradient(look, look_bias)
        new = look - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * s.l1, 0)
        new_bias = look_bias - rate * bias_grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from at most ``sample_rows`` labelled documents that are not held out (the first in the order of a hash of the id).

    Of several rows of one id the one with the smallest text hash is learned from. Labels that are null or neither 0 nor 1 are left out; of several for one id the largest counts. Documents without an id or
    label do not take part. Without any labelled row the model scores 0 everywhere."""
    s = settings or Settings()
    spark = docs.sparkSession
    folder = shared_folder(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").join(known, "doc_id", "left_semi").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows).join(known, "doc_id")
    # At most sample_rows narrow rows.
    chosen = stored(chosen, folder, "chosen")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One row per id, so that sample_rows bounds what the driver gets.
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    sample = sample.groupBy("doc_id", "toxic").agg(one).select("first.text", "toxic")
    sample = stored(sample, folder, "sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 + n1:
        return Model(np.zeros(0, dtype=U), np.zeros(0), -40.0)
    counts = sample.mapInArrow(_count, "feature long, toxic long, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"),
    )
    total = F.col("a") + F.col("b")
    # How far the label shares with the feature are from those without it, in standard deviations.
    share = n1 / (n0 + n1)
    telling = F.abs(F.col("a") - total * F.lit(share)) / F.sqrt(total)
    best = counts.where(total >= s.min_rows).orderBy(telling.desc(), "feature").limit(s.max_features).select("feature")
    found = np.array([r["feature"] for r in best.collect()], dtype=np.int64).view(U)
    if not len(found):
        return Model(found, np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    # Identity terms are always features, so that the penalty can hold their weights down.
    words = [features(word) for kind in s.terms.values() for word in kind]
    vocabulary = np.unique(np.concatenate([found, *words]))
    sent = spark.sparkContext.broadcast(vocabulary)
    shape = "own array<int>, plus array<array<int>>, minus array<array<int>>, placed boolean, toxic int"
    rows = sample.mapInArrow(_examples(sent, s), shape).toArrow()
    own = [r.values.to_numpy(zero_copy_only=False) for r in rows.column("own").combine_chunks()] if rows.num_rows else []
    plus, minus = rows.column("plus").to_pylist(), rows.column("minus").to_pylist()
    placed = np.repeat(rows.column("placed").to_numpy().astype(bool), [len(p) for p in plus])
    flat = ([x for several in lists for x in several] for lists in (plus, minus))
    weights, bias = _train(Loss(own, *flat, placed, rows.column("toxic").to_numpy(), len(vocabulary), s), s)
    used = weights != 0
    return Model(vocabulary[used], weights[used], bias, int((~placed).sum()), int(placed.sum()))


def _score(model, text_at: int, name: str):
    def run(batches):
        own = model.value
        for batch in batches:
            made = [own.score(t.as_py()) for t in batch.column(text_at)]
            columns = [*batch.columns, pa.array(made, type=pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; or ``name``) from the whole text; a null text counts as empty. Repeated rows score alike, no rows
    give none, other columns pass through (a column of that name is replaced)."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields]).add(name, "double")
    return docs.mapInArrow(_score(sent, docs.columns.index("text"), name), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, limit: float = 0.5) -> DataFrame:
    """``docs`` without rows that score ``limit`` or more; all its columns, whatever their names."""
    return score(docs, fit(docs, labels, settings), "__score").where(F.col("__score") < limit).drop("__score")
