"""Records that share a key with few others: pairs by numbers alone, and edit distances of many pairs at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.storage import cut, cut_counted, drop

#: Most members of a shard that are paired in one go; larger shards are cut into blocks, every block meeting every other.
BLOCK = 4096
#: Keys that a task holds; bits of a key that tell it from the others of its task; bytes in which it travels; most kinds of texts.
TASK_KEYS, KEY_BITS, CELL, KINDS = 4_000_000, 31, 7, 256
#: From so many keys on they are dealt in as many turns, so that not all of them lie on disk at once.
TURN_KEYS, TURNS = 100_000_000, 3
#: Texts up to this length are measured many at once, each letter a bit.
BITS = 64
#: Pairs that are measured together; most cells of the table of their texts' letters.
PAIRS, TABLE = 200_000, 8_000_000


def near(a: str, b: str, limit: int) -> int:
    """Edits from a to b with swaps of neighbours as one edit, or limit + 1 when more than limit."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


def _matrix(texts: list[str]) -> np.ndarray:
    width = max(1, max(map(len, texts), default=1))
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)


def _neighbours(letters: np.ndarray) -> np.ndarray:
    """For each row of letters a bit set for each pair of neighbours in it."""
    out = np.zeros(len(letters), np.uint64)
    for k in range(letters.shape[1] - 1):
        a, b = letters[:, k].astype(np.uint64), letters[:, k + 1].astype(np.uint64)
        out |= np.where(b > 0, np.uint64(1) << (mixed(a << np.uint64(32) | b) >> np.uint64(58)), np.uint64(0))
    return out


def near_many(texts: list[str], a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """near() of every texts[a[i]], texts[b[i]]: the Levenshtein automaton of one, a bit for each state, reads the other; all
    pairs step together."""
    out = np.full(len(a), limit + 1)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    long = (size > BITS)[a] | (size > BITS)[b]
    for i in np.flatnonzero(long):
        out[i] = near(texts[a[i]], texts[b[i]], limit)
    letters = _matrix([t[:BITS] for t in texts])
    empty = ~long & ((size[a] == 0) | (size[b] == 0))
    out[empty] = np.minimum(np.maximum(size[a], size[b])[empty], limit + 1)
    rest = np.flatnonzero(~long & ~empty & (np.abs(size[a] - size[b]) <= limit))
    mark = _neighbours(letters)
    x, y = mark[a[rest]], mark[b[rest]]
    rest = rest[np.maximum(np.bitwise_count(x & ~y), np.bitwise_count(y & ~x)) <= 3 * limit]  # an edit, a swap too, breaks three at most
    rest = rest[np.argsort(size[b[rest]].astype(np.int16), kind="stable")]  # alike lengths together
    if len(texts) * int(np.bincount(letters.ravel()).astype(bool).sum()) > TABLE and len(rest) > 1:  # many kinds of letters: fewer texts at a time
        for at in np.array_split(rest, 2):
            used, which = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
            out[at] = near_many([texts[i] for i in used], which[: len(at)], which[len(at) :], limit)
        return out
    codes, there = _places(letters)
    for at in np.array_split(rest, len(rest) // PAIRS + 1):
        if len(at):
            i, j = a[at], b[at]
            out[at] = np.minimum(_automata(there, codes, i, j, size[i], size[j]), limit + 1)
    return out


def _places(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, there): the letters numbered, a row for each place of the texts; there[text, code] has a bit for each place
    of a letter in a text."""
    seen = np.zeros(int(letters.max(initial=0)) + 1, bool)
    seen[letters] = True
    codes = (np.cumsum(seen, dtype=np.int32) - 1)[letters.T]
    there = np.zeros((len(letters), int(seen.sum())), np.uint64)
    rows = np.arange(len(letters))
    for k in range(len(codes)):
        there[rows, codes[k]] |= np.uint64(1) << np.uint64(k)
    return codes, there


def _automata(there: np.ndarray, codes: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edits between texts i (the automata, n letters) and j (read by them, m letters)."""
    one, none = np.uint64(1), np.zeros(len(n), np.uint64)
    last = (n - 1).astype(np.uint64)
    up, down, diagonal, before, score = ~none, none, none, none, n.copy()
    flat, row, m = there.ravel(), i * there.shape[1], m.astype(np.int64)
    for t in range(m.max()):
        hit = flat[row + codes[t][j]]
        swap = (~diagonal & hit) << one & before
        diagonal = (((hit & up) + up) ^ up) | hit | down | swap
        more, less = down | ~(diagonal | up), diagonal & up
        step = (more >> last & one).astype(np.int64) - (less >> last & one).astype(np.int64)
        score += step if t < m[0] else np.where(t < m, step, 0)  # m is in order
        more, less = more << one | one, less << one
        up, down, before = less | ~(diagonal | more), more & diagonal, hit
    return score


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers, one-to-one."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def letter_keys(texts: list[str], letters: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into texts, key, whether `letters` were taken out) of what is left of the letters of a text without up to
    `letters` (at most 2) of them.

    Two texts whose letters, in whatever order, differ by at most `letters` on either side share a key where the longer one
    has `letters` taken out (or all it has): take out what the other lacks, and any others up to that number. A key is the
    exclusive or of a number for each letter and the how-manieth it is, so taking one out is one operation; equal keys of
    different letters are as rare as equal random numbers, and only cost a comparison.
    """
    if letters not in (1, 2):
        raise ValueError("one or two letters")
    index, keys, full = [], [], []
    by_size: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        by_size.setdefault(-(-len(t) // 8), []).append(i)
    for at in by_size.values():
        at = np.array(at)
        m = np.sort(_matrix([texts[i] for i in at]), axis=1)
        n, width = m.shape
        nth = np.zeros((n, width), np.uint64)
        for j in range(1, width):
            nth[:, j] = np.where(m[:, j] == m[:, j - 1], nth[:, j - 1] + np.uint64(1), 0)
        code = m.astype(np.uint64) << np.uint64(32)
        there = m != 0
        z = np.where(there, mixed(code | nth), np.uint64(0))
        whole = np.bitwise_xor.reduce(z, axis=1)
        top = there & np.concatenate([m[:, 1:] != m[:, :-1], np.ones((n, 1), bool)], axis=1)
        second = np.where(top & (nth > 0), mixed(code | nth - (nth > 0).astype(np.uint64)), np.uint64(0))
        kinds = max(1, int(top.sum(axis=1).max()))
        front = np.argsort(~top, axis=1, kind="stable")[:, :kinds]
        z, second, top = (np.take_along_axis(x, front, axis=1) for x in (z, second, top))
        twice = top & (second != 0)
        size = there.sum(axis=1)

        def put(rows: np.ndarray, key: np.ndarray, all_out: np.ndarray) -> None:
            index.append(at[rows])  # noqa: B023
            keys.append(key[rows])
            full.append(all_out[rows])

        every = np.arange(n)
        put(every, whole, size == 0)
        for i in range(kinds):
            one = whole ^ z[:, i]
            put(np.flatnonzero(top[:, i]), one, np.full(n, letters == 1) | (size == 1))
            if letters == 2:
                put(np.flatnonzero(twice[:, i]), one ^ second[:, i], np.ones(n, bool))
                for j in range(i + 1, kinds):
                    put(np.flatnonzero(top[:, j]), one ^ z[:, j], np.ones(n, bool))
    if not index:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    return np.concatenate(index), np.concatenate(keys), np.concatenate(full)


def _deal(batches, keys_of: Callable, parts: int, turn: int, turns: int):
    """Rows (part, block, cells): the keys of one turn for each part, of ids that are alike but for their last 16 bits.

    A cell is a key's KEY_BITS bits, the text's kind in 8, the id's last 16 and whether the key asks, in seven bytes; cells are in order and written
    byte by byte (all first bytes, then all second ones), so the first bytes compress in the shuffle."""
    bits = np.uint64(min(KEY_BITS, 39 - int(parts).bit_length()))
    for p in batches:
        all_ids, kinds = p.column("id").to_numpy(), p.column("kind").to_numpy().astype(np.uint64)
        at, keys, asks = keys_of(p.column("text").to_pylist())
        if turns > 1:
            mine = keys % np.uint64(turns) == turn
            at, keys, asks = at[mine], keys[mine], asks[mine]
        ids = all_ids[at]
        part = (keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)
        cells = (part << bits | mixed(keys) >> np.uint64(64) - bits) << np.uint64(25) | kinds[at] << np.uint64(17) | (ids.view(np.uint64) & np.uint64(0xFFFF)) << np.uint64(1) | asks.astype(np.uint64)
        blocks = ids >> 16
        for block in np.unique(all_ids >> 16):
            mine = np.sort(cells[blocks == block])
            ends = np.searchsorted(mine >> bits + np.uint64(25), np.arange(parts + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(ends))
            mine = mine & (np.uint64(1) << bits + np.uint64(25)) - np.uint64(1)
            planes = mine.view(np.uint8).reshape(-1, 8)[:, CELL - 1 :: -1]
            written = [planes[ends[i] : ends[i + 1]].tobytes("F") for i in some]
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "block": pa.array(np.full(len(some), block), pa.int64()), "cells": pa.array(written, pa.binary())})


def _read_cells(cells: bytes) -> np.ndarray:
    planes = np.frombuffer(cells, np.uint8).reshape(CELL, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, CELL - 1 :: -1] = planes.T
    return out.view(np.uint64).ravel()


def _meet(batches, block: int):
    """Rows (x, y) for the pairs of small shards; (held, asked), both arrays of ids, for blocks of large ones."""
    some, blocks = [], []
    for p in batches:
        some += [_read_cells(c) for c in p.column("cells").to_pylist()]
        blocks += p.column("block").to_pylist()
    if not some:
        return
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    cells = np.concatenate(some)
    some.clear()
    shift = np.uint64(max(64 - KEY_BITS, int(len(cells)).bit_length()))
    places = np.sort(cells >> np.uint64(25) << shift | np.arange(len(cells), dtype=np.uint64))  # in order of the keys
    keys = places >> shift
    alike = keys[1:] == keys[:-1]
    shared = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])
    keys, places = keys[shared], (places[shared] & (np.uint64(1) << shift) - np.uint64(1)).astype(np.int64)
    of = np.searchsorted(np.cumsum(sizes), places, side="right")
    twice = np.array(blocks, dtype=np.int64)[of] << 17 | (cells[places] & np.uint64(0x1FFFF)).view(np.int64)  # twice the id, one more if it asks
    kinds = (cells[places] >> np.uint64(17) & np.uint64(KINDS - 1)).astype(np.uint8)
    del cells, places, of
    if not len(keys):
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    for s, n in zip(starts[sizes > block], sizes[sizes > block]):
        cut_up = np.array_split(twice[s : s + n], -(-n // block))
        for i, b in enumerate(cut_up):
            for c in cut_up[i:]:
                yield pa.RecordBatch.from_pydict({"x": [0], "y": [0], "held": [b], "asked": [c]}, schema=_MET)
    fits = np.repeat(sizes <= block, sizes)
    ends = np.repeat(np.cumsum(np.where(sizes <= block, sizes, 0)), sizes)[fits]
    known, number = np.unique(twice[fits] >> 1, return_inverse=True)
    number, asks, kinds = number.astype(np.uint64), (twice[fits] & 1).astype(bool), kinds[fits]
    found, n = [np.empty(0, np.uint64)], 0
    at, step = np.arange(len(number)), 1
    while len(at := at[at + step < ends[at]]):
        i, j = at, at + step
        good = (asks[i] | asks[j]) & (number[i] != number[j]) & ((kinds[i] == kinds[j]) | (kinds[i] == 0) | (kinds[j] == 0))
        i, j = number[i[good]], number[j[good]]
        found.append(np.minimum(i, j) << np.uint64(32) | np.maximum(i, j))
        n += len(i)
        step += 1
        if n > 4 * PAIRS:
            found, n = [np.unique(np.concatenate(found))], 0
            if len(found[0]) > 2 * PAIRS:
                yield from _rows(found[0], known)
                found = [np.empty(0, np.uint64)]
    yield from _rows(np.unique(np.concatenate(found)), known)


_MET = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("held", pa.list_(pa.int64())), ("asked", pa.list_(pa.int64()))])


def _rows(pairs: np.ndarray, known: np.ndarray):
    for part in np.array_split(pairs, len(pairs) // 50_000 + 1):
        x, y = known[(part >> np.uint64(32)).astype(np.int64)], known[(part & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(part), _MET.field("held").type), pa.nulls(len(part), _MET.field("asked").type)], schema=_MET)


def _blocks(batches):
    for p in batches:
        for held, asked in zip(p["held"], p["asked"]):
            held, asked = np.asarray(held), np.asarray(asked)
            for h in np.array_split(held, len(held) * len(asked) // PAIRS + 1):
                i, j = np.repeat(h, len(asked)), np.tile(asked, len(h))
                good = ((i | j) & 1).astype(bool) & (i >> 1 != j >> 1)
                i, j = i[good] >> 1, j[good] >> 1
                yield pd.DataFrame({"x": np.minimum(i, j), "y": np.maximum(i, j)})


def sharing(texts: DataFrame, keys_of: Callable, per_text: int = 80, block: int = BLOCK) -> DataFrame:
    """texts(id long, text) -> (x, y), x < y: the distinct pairs of ids that share a key, of which one at least asks.

    texts may have a column kind, a number under KINDS: texts of different kinds other than 0 need not be paired, and few are.

    keys_of(list of texts) -> (index, key, asks) as numpy arrays. Keys travel as numbers, seven bytes with what tells the id,
    packed by part, and are sorted and paired in the task that gets the part; parts follow the counted number of texts (about
    `per_text` keys each), so a task holds about TASK_KEYS. Of more than TURN_KEYS keys a TURNS-th is dealt at a time, and its
    shuffle files go before the next. A key with more than `block` members is cut into blocks that meet in tasks of their own,
    so no task pairs a hot key alone and nothing is left out.
    """
    spark = texts.sparkSession
    texts, n = cut_counted(texts if "kind" in texts.columns else texts.withColumn("kind", F.lit(0)))
    turns = TURNS if n * per_text > TURN_KEYS else 1
    parts = max(12, spark.sparkContext.defaultParallelism, n * per_text // (TASK_KEYS * turns) + 1)
    met = None
    for turn in range(turns):
        dealt = texts.mapInArrow(lambda it, turn=turn: _deal(it, keys_of, parts, turn, turns), "part int, block long, cells binary").repartitionById(parts, F.col("part"))
        some = cut(dealt.mapInArrow(lambda it: _meet(it, block), "x long, y long, held array<long>, asked array<long>"))
        met = some if met is None else met.union(some)
    drop(texts)
    pairs = met.where("held IS NULL").select("x", "y")
    blocks = met.where("held IS NOT NULL").select("held", "asked")
    if not blocks.isEmpty():
        pairs = pairs.union(blocks.repartition(4 * parts).mapInPandas(_blocks, "x long, y long"))
    return pairs.distinct()
