import itertools
import zlib
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from outskirt.llm import packing
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("length", [2048, 7])
def test_pieces(spark, length):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    extra = [(70, "<|endoftext|> 'tis  3 spaces   \n\n x y z \U0001f600 '")]
    rows = [(i, t) for i, t in dict(cases.texts()).items()] + extra
    out = packing.pack(cases.table(spark, rows), RANKS, public_tokenizers.PATTERN, length=length)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out.collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(rows) and set(cases.CLASHING) <= set(out.columns) and "text" not in out.columns
    for i, t in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = np.array(ids[at : at + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(own.tobytes()))
            at += r.length
        assert at == len(ids)
    for s in range(len(by_sequence)):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or s == len(by_sequence) - 1 and at <= length


def test_repeated_rows_and_empty_table(spark):
    out = packing.pack(cases.table(spark, [(1, "a"), (1, "a"), (None, None)]), RANKS, public_tokenizers.PATTERN)
    assert sorted(r.offset for r in out.collect()) == [0, 1, 3] or out.count() == 3
    assert packing.pack(cases.table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_hilbert_steps_are_neighbours(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 2)
    cells = np.array(list(itertools.product(range(4), repeat=packing.DIMS)))
    key = packing.hilbert(cells)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_like_documents_have_near_keys():
    table = packing.signs(1000)
    ids = np.random.default_rng(1).integers(0, 1000, 500)
    near, far = ids.copy(), np.random.default_rng(2).integers(0, 1000, 500)
    near[:10] = 5
    grid = lambda x: packing.grid(x, table).astype(int)
    assert np.abs(grid(ids) - grid(near)).max() < np.abs(grid(ids) - grid(far)).max()


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_long_white_space_equals_the_json_tokenizer(spark, blank):
    text = f"x{blank * 2_000_000}y"
    ids = [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 1]
    out = packing.pack(cases.table(spark, [(1, text)]), RANKS, public_tokenizers.PATTERN, length=1 << 22).collect()
    want = (0, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert [(r.start, r.doc_tokens, r.ids_crc32) for r in out] == [want]
