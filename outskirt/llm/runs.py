"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of words with smallest period q that is at least ``max(MIN_WORDS, MIN_POWER * q)`` long and that no
neighbouring word extends. A batch of texts is worked on as one array of word ids (ids of different texts differ):

1. Re-Pair in rounds: each round replaces, wherever it stands, every repeated pair that is more frequent than the pairs it
   overlaps; a round's replaced places are the derivation positions of its rules. It ends when no pair repeats. What is left
   is the start rule, derived by halving.
2. A rule derives its expansion from two parts. Any run lies in one lowest node of the derivation and crosses that
   node's middle, so runs are searched once per rule, across its middle: a run holds two periods left or right of it,
   which names its period by equal grams at the middle and a period away. Hash differences extend it within the expansion,
   and the words themselves are compared before it counts.
3. The runs of a rule are moved to all places that it derives. A run that a node cut short lies in the same run
   found whole in a higher node, so only maximal intervals of a period stay, and of equal intervals the smallest period.

Equal parts of a text are searched once, a text of one repeated word in as many nodes as its length has bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outskirt.llm.tokens import Spans, U, mix

MIN_WORDS, MIN_POWER = 6, 4
#: Words that are worked on at once; a longer text is a batch of its own.
BATCH_WORDS = 1 << 18
#: (node, period) pairs that are compared at once.
CHUNK = 1 << 20


def _even(fresh: np.ndarray) -> np.ndarray:
    """The first, third, ... place of each stretch that begins where ``fresh``: places of a pair of one symbol that do not overlap."""
    begins = np.flatnonzero(fresh)
    since = np.arange(len(fresh)) - np.repeat(begins, np.diff(np.append(begins, len(fresh))))
    return since % 2 == 0


def repair(ids: np.ndarray):
    """Nodes (lo, middle, hi) of the rules, one place each; (rule, lo) of all places derived; the starts of the start rule's symbols."""
    seq, at, fresh = ids.astype(np.int64), np.arange(len(ids) + 1), int(ids.max(initial=0)) + 1
    nodes, rules, places, made = [np.zeros((3, 0), dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    # Places of pairs that may repeat. A pair that occurs once never occurs twice later.
    live = np.arange(len(seq) - 1)
    while len(live):
        code = seq[live] * fresh + seq[live + 1]
        # Codes that are alone in their slot of a table occur once and need no sorting.
        slots = (mix(code.astype(U)) & U((1 << max(len(code).bit_length(), 10)) - 1)).astype(np.int64)
        twice = np.bincount(slots)[slots] > 1
        live, code = live[twice], code[twice]
        kinds, which = np.unique(code, return_inverse=True)
        near = np.zeros(len(live) + 1, dtype=bool)
        near[1:-1] = live[1:] == live[:-1] + 1
        begins = ~near[:-1]
        begins[1:] |= code[1:] != code[:-1]
        even = _even(begins)
        counts = np.bincount(which[even], minlength=len(kinds))
        rank = np.empty(len(kinds), dtype=np.int64)
        # Equally frequent pairs in the order of hashes: many are greater than both neighbours.
        rank[np.lexsort((mix(kinds.astype(U)), counts))] = np.arange(1, len(kinds) + 1)
        rank[counts < 2] = 0
        own = np.concatenate(([0], rank[which], [0]))
        chosen = even & (own[1:-1] > 0)
        chosen &= (own[1:-1] >= own[:-2] * near[:-1]) & (own[1:-1] >= own[2:] * near[1:])
        chosen &= np.bincount(which[chosen], minlength=len(kinds))[which] > 1
        left, live, which = live[(own[1:-1] > 0) & ~chosen], live[chosen], which[chosen]
        if not len(live):
            break
        used, first, number = np.unique(which, return_index=True, return_inverse=True)
        nodes.append(np.stack([at[live[first]], at[live[first] + 1], at[live[first] + 2]]))
        rules.append(number + made)
        places.append(at[live])
        seq[live] = fresh + number
        stay = np.ones(len(at), dtype=bool)
        stay[live + 1] = False
        # Pairs that the replaced ones overlapped are gone; those with a new symbol are new.
        again = np.zeros(len(at) + 1, dtype=bool)
        again[left] = True
        again[live + 1] = False
        again[live] = again[live - 1] = True
        again[-1] = False
        seq, at, live = seq[stay[:-1]], at[stay], np.flatnonzero(again[:-1][stay])
        live = live[live < len(seq) - 1]
        made += len(used)
        fresh += len(used)
    return np.concatenate(nodes, axis=1), np.concatenate(rules), np.concatenate(places), at


def halves(at: np.ndarray) -> np.ndarray:
    """Nodes (lo, middle, hi) of the start rule, whose symbols start at ``at`` (its last entry is the end)."""
    out, m, step = [np.zeros((3, 0), dtype=np.int64)], len(at) - 1, 1
    while step < m:
        lo = np.arange(0, m - step, 2 * step)
        out.append(np.stack([at[lo], at[lo + step], at[np.minimum(lo + 2 * step, m)]]))
        step *= 2
    return np.concatenate(out, axis=1)


def _candidates(ids: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray):
    """(node, first, period): stretches of ``period`` words from ``first`` on may be the same as those that follow."""
    gram, width = mix(ids.astype(U) + U(1)), 1
    while True:
        longest = (hi - lo) // MIN_POWER
        for side in (0, 1):
            most = np.minimum(np.minimum(2 * width - 1, longest), ((mid - lo) if side else (hi - mid)) // 2)
            node = np.flatnonzero((most >= width) & (hi - lo >= MIN_WORDS))
            n = most[node] - width + 1
            cut = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + CHUNK, CHUNK)[1:])
            for part in np.split(np.arange(len(node)), cut):
                if not len(part):
                    continue
                some = n[part]
                each = np.repeat(node[part], some)
                period = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + width
                here = mid[each] - (width if side else 0)
                there = here - period if side else here + period
                hit = gram[here] == gram[there]
                each, period = each[hit], period[hit]
                yield each, mid[each] - (2 * period if side else 0), period
        if longest.max(initial=0) < 2 * width:
            return
        # Grams of twice the width.
        gram = np.concatenate([mix(gram[:-width] * U(0x9E3779B97F4A7C15) + gram[width:]), np.zeros(width, dtype=U)])
        width *= 2


def _common(spans: Spans, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Up to ``most``: how many words from ``a`` and ``b`` on (or before them) are the same."""
    n, step = np.zeros(len(a), dtype=np.int64), 1 << max(int(most.max(initial=1)).bit_length() - 1, 0)
    while step:
        x, y = (a - n - step, b - n - step) if back else (a + n, b + n)
        fits = np.flatnonzero(n + step <= most)
        same = spans.of(x[fits], x[fits] + step) == spans.of(y[fits], y[fits] + step)
        n[fits[same]] += step
        step >>= 1
    return n


def _exact(ids: np.ndarray, start: int, end: int, period: int):
    """The stretches of [start, end) that really have the period: all of it, but for a collision of hashes."""
    same = np.concatenate(([0], (ids[start : end - period] == ids[start + period : end]).view(np.int8), [0]))
    if same[1:-1].all():
        return [(start, end)]
    step = np.diff(same)
    ends = np.flatnonzero(step == -1) + start + period
    return [(s, e) for s, e in zip(np.flatnonzero(step == 1) + start, ends) if e - s >= max(MIN_WORDS, MIN_POWER * period)]


def _across(ids: np.ndarray, nodes: np.ndarray):
    """(node, start, end, period) of the runs across the middles of ``nodes``, within them; each once, with its smallest period."""
    lo, mid, hi = nodes
    spans, found = Spans(mix(ids.astype(U) + U(0x5851F42D))), [np.zeros((4, 0), dtype=np.int64)]
    for node, first, period in _candidates(ids, lo, mid, hi):
        same = spans.of(first, first + period) == spans.of(first + period, first + 2 * period)
        node, first, period = node[same], first[same], period[same]
        start = first - _common(spans, first, first + period, first - lo[node], True)
        end = first + period + _common(spans, first, first + period, hi[node] - first - period, False)
        long = end - start >= np.maximum(MIN_WORDS, MIN_POWER * period)
        found.append(np.stack([node, start, end, period])[:, long])
    found = _smallest(np.concatenate(found, axis=1))
    kept = [(n, s, e, q) for n, start, end, q in found.T.tolist() for s, e in _exact(ids, start, end, q)]
    return np.array(kept, dtype=np.int64).reshape(-1, 4).T


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows (node, start, end, period) with the same first three, the one with the smallest period."""
    rows = rows[:, np.lexsort(rows[::-1])]
    fresh = np.ones(rows.shape[1], dtype=bool)
    fresh[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    return rows[:, fresh]


def runs_of(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs by start and period. Texts end at ``ends`` and share no id."""
    if len(ids) < MIN_WORDS:
        return np.zeros((0, 3), dtype=np.int64)
    rules, which, places, at = repair(ids)
    start_rule = halves(at)
    nodes = np.concatenate([rules, start_rule], axis=1)
    # The start rule's nodes may hold several texts; a run lies in that of the middle.
    text = np.searchsorted(ends, nodes[1], side="right")
    nodes[0] = np.maximum(nodes[0], np.append(0, ends)[text])
    nodes[2] = np.minimum(nodes[2], ends[text])
    node, start, end, period = _across(ids, nodes)
    # Runs of the start rule stand where they are, those of a rule at each of its places.
    once = node >= rules.shape[1]
    where = [np.stack([period, start, end])[:, once]]
    of = np.flatnonzero(~once)
    if len(of):
        first, n = np.searchsorted(node[of], [which, which + 1])
        n -= first
        row = of[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        move = np.repeat(places, n) - nodes[0][node[row]]
        where.append(np.stack([period[row], start[row] + move, end[row] + move]))
    period, start, end = np.concatenate(where, axis=1)
    # Of one period, an interval inside another goes.
    order = np.lexsort((-end, start, period))
    period, start, end = period[order], start[order], end[order]
    reach = np.maximum.accumulate(period * (len(ids) + 1) + end)
    fresh = np.ones(len(reach), dtype=bool)
    fresh[1:] = reach[1:] > reach[:-1]
    rows = _smallest(np.stack([np.zeros(fresh.sum(), dtype=np.int64), start[fresh], end[fresh], period[fresh]]))
    rows = rows[:, np.lexsort((rows[3], rows[1]))]
    return np.stack([rows[1], rows[2] - rows[1], rows[3]], axis=1)


def _collapsed(words: list[bytes], runs: list) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


def _work(texts: list[list[bytes]]) -> tuple[list, list]:
    """For each list of words: its runs, and its collapsed text."""
    ids, n = [], 0
    for words in texts:
        # An id says which text it is of, too.
        known: dict[bytes, int] = {}
        ids.append(np.array([known.setdefault(w, n + len(known)) for w in words], dtype=np.int64))
        n += len(known)
    ends = np.cumsum([len(x) for x in ids])
    found = runs_of(np.concatenate(ids), ends)
    text = np.searchsorted(ends, found[:, 0], side="right")
    found[:, 0] -= np.append(0, ends)[text]
    runs: list[list] = [[] for _ in texts]
    for i, row in zip(text.tolist(), found.tolist()):
        runs[i].append(row)
    return runs, [_collapsed(w, r) if r else b" ".join(w) for w, r in zip(texts, runs)]


def _find(text_at: int, kind: pa.Schema):
    def run(batches):
        for batch in batches:
            begin, held, n = 0, [], 0
            column = batch.column(text_at)
            for row in range(batch.num_rows):
                held.append((column[row].as_py() or "").encode().split())
                n += len(held[-1])
                if row + 1 < batch.num_rows and n < BATCH_WORDS:
                    continue
                runs, texts = _work(held)
                columns = list(batch.slice(begin, len(held)).columns)
                columns[text_at] = pa.array([x.decode() for x in texts], type=pa.string())
                spans = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
                columns += [pa.array([len(w) for w in held], type=pa.int64()), pa.array(spans, type=kind.field("runs").type)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_words", "runs"])
                begin, held, n = row + 1, [], 0

    return run


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less repetitions, ``n_words`` (before), and ``runs`` (start, length, period; by start, period).

    Words are what stands between ASCII white space; a null text has none. A word goes if any run contains it after
    that run's first period; the others are joined by one space. A text without runs is joined likewise. Columns of the
    input named ``n_words`` or ``runs`` are replaced, all others pass through; repeated rows are rows of their own,
    no rows give no rows. Nothing is shuffled; a task holds ``BATCH_WORDS`` words, or one text.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "runs")])
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS)])
    kind = pa.schema([pa.field("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))])
    return base.mapInArrow(_find(base.columns.index("text"), kind), schema)


def best_run(runs):
    """Of a ``runs`` column, the one with the greatest length / period; of equal ones the first."""
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), better)
