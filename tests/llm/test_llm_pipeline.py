"""The pipeline, stage by stage, against brute force; every stage gets what the brute-force version of the one before kept."""

import ast
import pathlib
import zlib
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
import test_llm_decontaminate
import test_llm_lines
import test_llm_nearcopies
import test_llm_toxicity
from outskirt.llm import toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"bench{i}" for i in range(20))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    docs, labels = test_llm_toxicity.corpus(200)
    docs = [(1000 + i, t) for i, t in docs] + cases.texts()
    docs += [(3000, f"start {PASSAGE} end"), (3001, PASSAGE.upper() + " and more of a text of its own")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{where}/documents.parquet")
    labels = [(1000 + i, q, t) for i, q, t in labels]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    out = stages["toxicity"](spark, docs, folder)
    model = toxicity.fit(docs, labels)
    kept = [(i, t) for i, t in rows if model.score(t) < 0.5]
    assert rows_of(out) == sorted(kept, key=repr) and out.columns == docs.columns
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    gone = {i for i, _ in rows} - {i for i, _ in kept}
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) < 5

    out = stages["line_dedup"](spark, frame(kept), folder)
    want = sorted(((i, t) for i, t, _, _ in test_llm_lines.brute(kept)), key=repr)
    assert rows_of(out) == want and out.columns == docs.columns
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0

    out = stages["near_dedup"](spark, frame(want), folder)
    sets = [test_llm_nearcopies.grams(t) for _, t in want]
    near = cases.components(list(range(len(want))), lambda a, b: test_llm_nearcopies.alike(sets[a], sets[b]))
    best = {}
    for k, (i, _) in enumerate(want):
        best[near[k]] = min(best.get(near[k], (True, 0)), (i is None, i or 0))
    got = rows_of(out)
    assert sorted((i is None, i or 0) for i, _ in got) == sorted(best.values()) and set(got) <= set(want)
    assert out.columns == docs.columns

    out = stages["decontamination"](spark, frame(got), folder)
    words = lambda t: test_llm_decontaminate.WORD.findall((t or "").lower())
    clean = [(i, t) for i, t in got if not test_llm_decontaminate.brute(words(PASSAGE), words(t)[:300], 5) >= 10]
    assert rows_of(out) == clean and len(clean) < len(got) and out.columns == docs.columns

    check_pieces(stages["packing"](spark, frame(clean), folder), clean)


def check_pieces(out, rows):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    by_doc = defaultdict(list)
    for r in out.collect():
        by_doc[r.doc_id].append(r)
    assert len(by_doc) == len(rows)
    for i, t in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_run_is_the_stages_in_a_row(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    whole = out.collect()
    used = max(r.sequence_id for r in whole)
    assert sum(r.length for r in whole if r.sequence_id < used) == 2048 * used
    assert not {r.doc_id for r in whole} & {3000, 3001}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_native_operators_hold_no_python():
    """The operators marked native use DataFrame functions only."""
    root = pathlib.Path(corpus_pipeline.__file__).parent / "outskirt/llm"
    for name in ("fingerprints", "licenses", "lines"):
        tree = ast.parse((root / f"{name}.py").read_text())
        used = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)} | {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
        assert not used & {"mapInArrow", "mapInPandas", "applyInPandas", "udf", "pandas_udf", "rdd", "toPandas", "toArrow"}
