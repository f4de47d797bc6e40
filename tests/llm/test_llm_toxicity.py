import random
import zlib

import cases
import numpy as np
from outskirt.llm import toxicity
from pyspark.sql import functions as F


def corpus(n=400):
    """Labelled documents: toxic ones have an insult; group terms stand more often in toxic ones than in others."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["insulty", "insulting", "vileness"]))
        if rng.random() < (0.8 if toxic else 0.02):
            words.append("muslims")
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def fitted(spark, **changes):
    docs, labels = corpus()
    docs = cases.table(spark, docs)
    return docs, toxicity.fit(
        docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.Settings(min_rows=2, **changes)
    )


def test_held_out_rows_are_told_apart(spark):
    docs, model = fitted(spark)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    hits = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out if r.held]
    assert len(hits) > 50 and np.mean(hits) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_swaps_lower_the_weight_of_identity_terms(spark):
    _, plain = fitted(spark, swap_weight=0.0)
    _, fair = fitted(spark, swap_weight=50.0)
    neutral = "w1 w2 muslims w3."
    without = "w1 w2 people w3."
    change = lambda m: abs(m.score(neutral) - m.score(without))
    assert change(fair) < 0.3 * change(plain)


def test_swapped_sentences():
    out = toxicity.swapped("One. The Women came, women went. Women", toxicity.IDENTITY_TERMS)
    assert out == ["One. The men came, men went. Women", "One. The people came, people went. Women"]
    assert toxicity.swapped("womenfolk", toxicity.IDENTITY_TERMS) == []


def test_features_are_words_and_beginnings():
    a, b = set(toxicity.features("Éclair, WORD").tolist()), set(toxicity.features("éclair word").tolist())
    assert a == b and len(a) == 2 + 3 + 1
    shared = set(toxicity.features("éclairs").tolist()) & a
    assert len(shared) == 3


def test_odd_cases(spark):
    docs = cases.table(spark)
    labels = spark.createDataFrame([(20, None), (None, 1), (21, 7), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(cases.texts()) and {r.score for r in out} == {out[0].score} and out[0].score < 1e-9
    assert toxicity.score(cases.table(spark, []), model).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    one = toxicity.fit(docs, spark.createDataFrame([(20, 1), (21, 1), (23, 1)], "doc_id long, toxic int"))
    assert 0 <= one.score(None) <= 1


def test_all_sentences_are_swapped(spark):
    text = "One. The Women came. Men and women went!\nWomen"
    assert toxicity.swapped(text, toxicity.IDENTITY_TERMS, everywhere=True) == [
        "One. The men came. girls and men went!\nmen", "One. The people came. people and people went!\npeople"
    ]
    docs, labels = corpus()
    docs = [(i, f"{t} Then muslims spoke. And muslims left." if "muslims" in t else t) for i, t in docs]
    frame, known = cases.table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain, fair = (toxicity.fit(frame, known, toxicity.Settings(min_rows=2, swap_weight=w)) for w in (0.0, 50.0))
    change = lambda m: abs(m.score("w1 w2 muslims w3.") - m.score("w1 w2 people w3."))
    assert change(fair) < 0.3 * change(plain)
    own = [i for i, t in docs if "muslims" in t and zlib.crc32(str(i).encode()) % 5]
    assert fair.pairs == 2 * len(own)


def test_one_row_of_an_id_is_learned_from(spark):
    docs, labels = corpus(40)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hot = next(i for i, _ in docs if i % 4 == 0 and zlib.crc32(str(i).encode()) % 5)
    own = dict(docs)[hot] + " Women spoke."
    single = [(i, own if i == hot else t) for i, t in docs]
    several = single + [(hot, own)] * 60
    s = toxicity.Settings(min_rows=1)
    one, many = (toxicity.fit(cases.table(spark, rows), known, s) for rows in (single, several))
    assert one.pairs == many.pairs and np.array_equal(one.features, many.features) and np.allclose(one.weights, many.weights)


def test_letters_that_only_case_folding_matches(spark):
    for text in ("A \u017ftraight line.", "The boy\u017f came.", "\u0130mmigrants and \u0131mmigrants, \u212aids."):
        assert all(isinstance(t, str) for t in toxicity.swapped(text, toxicity.IDENTITY_TERMS))
    same = toxicity.swapped("A straight line.", toxicity.IDENTITY_TERMS)
    assert toxicity.swapped("A \u017ftraight line.", toxicity.IDENTITY_TERMS) == same and same
    docs, labels = corpus(60)
    docs += [(900 + i, f"\u017ftraight w{i} \u0130mmigrants") for i in range(8)]
    labels += [(900 + i, 1, 0) for i in range(8)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.fit(cases.table(spark, docs), labels, toxicity.Settings(min_rows=2)).pairs > 0


def test_dropping_keeps_a_column_named_score(spark):
    docs, labels = corpus(100)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(cases.table(spark, docs), labels, toxicity.Settings(min_rows=2))
    assert kept.columns == cases.table(spark, []).columns and {r.score for r in kept.collect()} == {"x"}


def test_texts_without_terms_get_mentions(spark):
    """Group terms stand in toxic texts only, and in few of them: most pairs are placed mentions."""
    docs, labels = corpus()
    docs = [(i, t.replace(" muslims", " muslims and women") if i % 4 == 0 else t.replace(" muslims", "")) for i, t in docs]
    frame, known = cases.table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    s = toxicity.Settings(min_rows=2)
    fair = toxicity.fit(frame, known, s)
    learned = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5]
    assert fair.pairs + fair.placed == 2 * len(learned) and fair.placed == 2 * sum("muslims" not in t for t in learned)
    plain, alone = (toxicity.fit(frame, known, toxicity.Settings(min_rows=2, **c)) for c in ({"swap_weight": 0.0}, {"place": False}))
    assert alone.placed == 0 and alone.pairs == fair.pairs
    change = lambda m: abs(m.score("w1 w2 muslims w3.") - m.score("w1 w2 people w3."))
    assert change(fair) < 0.3 * change(plain)


def test_loss_equals_a_dense_version():
    """Features, loss and penalty written out over dense matrices; its gradient by differences."""
    rng = np.random.default_rng(2)
    n, m, d = 12, 9, 7
    x, before, after = (rng.integers(0, 2, (k, d)) for k in (n, m, m))
    y, placed = rng.integers(0, 2, n), np.arange(m) % 3 == 0
    s = toxicity.Settings(swap_weight=3.0, l2=0.1)
    sparse = lambda a: [np.flatnonzero(r) for r in a]
    own = toxicity.Loss(sparse(x), sparse(before & ~after & 1), sparse(after & ~before & 1), placed, y, d, s)

    def dense(w, bias):
        z = x @ w + bias
        changes = ((before - after) @ w) ** 2 / 2
        penalty = s.swap_weight * (changes[placed].mean() + changes[~placed].mean())
        return np.mean(np.log1p(np.exp(z)) - y * z) + s.l2 * (w @ w) / 2 + penalty

    w, bias, step = rng.normal(size=d), 0.3, 1e-6
    grad, bias_grad = own.gradient(w, bias)
    want = [(dense(w + step * e, bias) - dense(w - step * e, bias)) / (2 * step) for e in np.eye(d)]
    assert np.allclose(grad, want, atol=1e-6)
    assert np.isclose(bias_grad, (dense(w, bias + step) - dense(w, bias - step)) / (2 * step), atol=1e-6)
    hessian = np.array([(own.gradient(w + step * e, bias)[0] - own.gradient(w - step * e, bias)[0]) / (2 * step) for e in np.eye(d)])
    assert np.linalg.eigvalsh((hessian + hessian.T) / 2).max() <= own.curvature
    best, own_bias = toxicity._train(own, toxicity.Settings(l1=0.0, steps=3000))
    assert np.abs(own.gradient(best, own_bias)[0]).max() < 1e-4


def test_score_equals_a_dictionary_of_features():
    text = "Éclair women, éclair; straße x"
    words = {"éclair", "women", "straße", "x"}
    named = {(n, w[:n]) for w in words for n in toxicity.PREFIXES if len(w) >= n} | {(0, w) for w in words}
    own = np.unique(toxicity.features(text))
    assert len(own) == len(named)
    weights = np.linspace(-1, 1, len(own))
    model = toxicity.Model(own, weights, 0.25)
    assert np.isclose(model.score(text), 1 / (1 + np.exp(-0.25 - weights.sum())))
    part = np.unique(toxicity.features("women"))
    assert np.isclose(model.score("WOMEN zzz"), 1 / (1 + np.exp(-0.25 - weights[np.isin(own, part)].sum())))
