import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from outskirt.llm import bestfit
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def itemwise_rooms(sizes, length):
    """Rooms left by the method, one item at a time."""
    rooms, large = [], sorted((s for s in sizes if 3 * s > length), reverse=True)
    while large:
        size = large.pop(0)
        partner = next((s for s in large if size + s <= length), 0)
        if partner:
            large.remove(partner)
        rooms.append(length - size - partner)
    for size in sorted((s for s in sizes if 3 * s <= length), reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms[rooms.index(min(fits))] -= size
        else:
            rooms.append(length - size)
    return sorted(rooms)


def test_plan_equals_packing_one_by_one():
    rng = random.Random(4)
    for _ in range(400):
        length = rng.choice([12, 30, 100])
        sizes = [rng.randint(1, rng.choice([length, length // 2, length // 4])) for _ in range(rng.randint(0, 120))]
        counts, inside, numbers = Counter(sizes), defaultdict(list), defaultdict(list)
        for size, first, n, per, sequence, offset in bestfit.plan(counts, length):
            for i in range(n):
                numbers[size].append(first + i)
                inside[sequence + i // per].append((offset + i % per * size, size))
        assert {s: sorted(n) for s, n in numbers.items()} == {s: list(range(n)) for s, n in counts.items()}
        rooms = []
        for pieces in inside.values():
            at = 0
            for offset, size in sorted(pieces):
                assert offset == at
                at += size
            rooms.append(length - at)
        assert sorted(rooms) == itemwise_rooms(sizes, length)


def test_plan_does_not_grow_with_the_table():
    rng = random.Random(5)
    shape = [rng.random() for _ in range(2048)]
    small, large = (len(bestfit.plan({s + 1: int(n * x) for s, x in enumerate(shape)}, 2048)) for n in (10**4, 10**9))
    assert large < 1.2 * small < 10_000


@pytest.mark.parametrize("length", [2048, 7])
def test_pieces(spark, length):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rows = [(i, t) for i, t in dict(cases.texts()).items()] + [(90 + i, "short one") for i in range(50)]
    out = bestfit.pack_whole(cases.table(spark, rows), RANKS, public_tokenizers.PATTERN, length=length)
    assert set(cases.CLASHING) <= set(out.columns) and "text" not in out.columns
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out.collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    sizes = []
    for i, t in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % length or length, len(ids), length), len(ids)]
        assert len(by_doc[i]) == len(cuts) - 1
        for piece, (start, end, r) in enumerate(zip(cuts, cuts[1:], sorted(by_doc[i], key=lambda r: r.piece))):
            assert (r.piece, r.start, r.length) == (piece, start, end - start)
            assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())
            sizes.append(end - start)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert len(by_sequence) == len(itemwise_rooms(sizes, length))


def test_repeated_rows_and_empty_table(spark):
    out = bestfit.pack_whole(cases.table(spark, [(1, "a"), (1, "a"), (None, None)]), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.sequence_id, r.offset, r.length) for r in out) == [(0, 0, 2), (0, 2, 2), (0, 4, 1)]
    assert bestfit.pack_whole(cases.table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
