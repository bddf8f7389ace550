"""Evaluation texts that leak into a corpus."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.words import words
from tarn.storage import cut

#: The shortest leak in words, and the share of its words that may be changed or missing.
SPAN, TOLERANCE = 24, 8
#: A corpus passage and the step to the next: any SPAN words lie whole in one. Query passages have SPAN words.
PASSAGE, STEP, QUERY_STEP = 28, 4, 4
#: Dimensions of the latent space, extra ones of the random sketch, passes of power iteration.
RANK, OVERSAMPLE, POWER = 96, 16, 1
#: Passages that the latent space is fitted on, taken by hash of the key; all are searched.
FIT_PASSAGES = 100_000
#: Least cosine of a candidate; the README has its measured recall.
COSINE = 0.80
#: Words of dense parts that one search task takes.
WORDS_PER_TASK = 1_000_000
#: Items are a stated query set and are searched in blocks of so many items or words: what travels with a task (vocabulary,
#: latent space, query passages) has the size of a block.
ITEM_BLOCK, ITEM_WORDS = 5_000, 1_000_000

_opening = re.compile(r"^.*?[.!?](?=\s|$)", re.S)


def item_words(text: str | None, alone: bool = False) -> list[str]:
    """Words of an item without its opening line (the first sentence). alone: the first sentence is no other item's, so of an
    item that has no other sentence it is the body."""
    body = words(_opening.sub("", text or "", count=1))
    return words(text) if alone and not body else body


def dense_parts(ids: np.ndarray, lost: int = SPAN // TOLERANCE, span: int = SPAN) -> np.ndarray:
    """ids (0: a word of no item) without what can't belong to a leak.

    SPAN words of a leak hold at least SPAN - lost words of items; all stretches of SPAN words with so many stay, each
    followed by a 0. Nothing else can match. span: the words of the shortest item where it has fewer, lost in proportion.
    """
    if span < SPAN:
        return _stretches(ids, span, span * lost // SPAN)
    return _stretches(ids, SPAN, lost)


def _stretches(ids: np.ndarray, span: int, lost: int) -> np.ndarray:
    n = len(ids)
    known = np.zeros(n + span + 1, np.int32)
    np.cumsum(ids > 0, out=known[1 : n + 1])
    known[n + 1 :] = known[n]
    start = np.flatnonzero(known[span:] - known[:-span] >= span - lost)
    if not len(start):
        return ids[:0]
    edge = np.zeros(n + span + 1, np.int32)
    edge[start] += 1
    edge[start + span] -= 1
    keep = np.cumsum(edge)[:n] > 0
    at = np.flatnonzero(keep)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.append(np.insert(ids[at], gaps, 0), 0).astype(np.int32)


def longest_common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & where.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def best_match(item: np.ndarray, part: np.ndarray, tolerance: int = TOLERANCE) -> int:
    """Most words that SPAN consecutive words of the item share, in order, with SPAN consecutive words of the text part.

    Items shorter than SPAN are taken whole. 0 when more than one word in `tolerance` is changed or missing.
    """
    span = min(SPAN, len(item))
    lost = span // tolerance
    need = span - lost
    if span == 0 or len(part) < need or longest_common(item.tolist(), part.tolist()) < need:
        return 0
    wide = np.zeros((len(item), len(part) + 2 * len(item)), bool)
    wide[:, len(item) : len(item) + len(part)] = item[:, None] == part[None, :]
    rows = np.arange(len(item))[:, None]
    along = wide[rows, rows + np.arange(wide.shape[1] - len(item))[None, :]]  # column: an offset of text against item
    band = along.copy()
    for t in range(1, lost + 1):
        band[:, t:] |= along[:, :-t]
    c = np.zeros((len(item) + 1, band.shape[1]), np.int16)
    np.cumsum(band, axis=0, out=c[1:])
    i, offset = np.nonzero(c[span:] - c[:-span] >= need)
    best, seen = 0, set()
    for i0, o in zip(i.tolist(), offset.tolist()):
        for j0 in range(i0 + o - len(item) - lost, i0 + o - len(item) + 1):
            if (i0, j0) not in seen:
                seen.add((i0, j0))
                j = max(0, j0)
                best = max(best, longest_common(item[i0 : i0 + span].tolist(), part[j : max(j, j0 + span)].tolist()))
                if best == span:
                    return best
    return best if best >= need else 0


@dataclass
class Model:
    """The latent space and the query passages in it; of the size of the vocabulary of the items."""

    latent: np.ndarray  # a row for each word id, times its weight; row 0 is 0
    queries: np.ndarray  # unit rows
    query_item: np.ndarray
    items: list[np.ndarray]
    keys: list


def passages(ids: np.ndarray) -> np.ndarray:
    """Starts of the passages of dense parts laid end to end."""
    return np.arange(0, max(1, len(ids) - SPAN + STEP), STEP)


def counts(ids: np.ndarray, start: np.ndarray, length: int, vocabulary: int) -> np.ndarray:
    """Dense word counts of the passages that begin at start."""
    at = np.minimum(start[:, None] + np.arange(length)[None, :], len(ids))
    cells = np.append(ids, 0)[at] + np.arange(len(start))[:, None] * (vocabulary + 1)
    return np.bincount(cells.ravel(), minlength=len(start) * (vocabulary + 1)).reshape(len(start), -1).astype(np.float32)


def sums(latent: np.ndarray, ids: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Unit latent vectors of the passages that begin at start."""
    total = np.zeros((len(ids) + 1, latent.shape[1]), np.float64)
    np.cumsum(latent[ids], axis=0, out=total[1:])
    v = (total[np.minimum(start + length, len(ids))] - total[start]).astype(np.float32)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-9)


def step_sums(latent: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Unit latent vectors of the n passages that begin at every STEP-th word of ids: sums of the steps they are made of."""
    per = PASSAGE // STEP
    whole = np.zeros((n + per - 1) * STEP, ids.dtype)
    whole[: len(ids)] = ids[: len(whole)]
    steps = latent[whole].reshape(n + per - 1, STEP, -1).sum(axis=1)
    v = steps[:n].copy()
    for k in range(1, per):
        v += steps[k : k + n]
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-6)


def candidates(model: Model, ids: np.ndarray, cosine: float):
    """(start, item number, cosine) of all passages against all query passages, in blocks."""
    start = passages(ids)
    for lo in range(0, len(start), 4096):
        some = start[lo : lo + 4096]
        v = step_sums(model.latent, ids[some[0] : some[-1] + PASSAGE], len(some))
        for q in range(0, len(model.queries), 2048):
            score = v @ model.queries[q : q + 2048].T
            hit = np.flatnonzero(score.ravel() >= cosine)
            if len(hit):
                row, col = np.divmod(hit, score.shape[1])
                yield from zip(some[row].tolist(), model.query_item[q + col].tolist(), score.ravel()[hit].tolist())


def _reader(docs: DataFrame, key: str, text: str, vocabulary: dict[str, int], answers: dict[str, int], lost: int, span: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    size = len(vocabulary)

    def run(batches):
        df, seen = np.zeros(size + 1, np.int64), 0
        schema = None
        for batch in batches:
            keys, rows, found = [], [], []
            for i, t in enumerate(batch.column(1)):
                w = words(t.as_py())
                ids = np.fromiter(map(vocabulary.get, w, [0] * len(w)), np.int32, len(w))
                seen += 1
                np.add.at(df, np.unique(ids), 1)
                part = dense_parts(ids, lost, span)
                if len(part):
                    keys.append(i)
                    rows.append(part)
                    found.append(sorted({answers[x] for x in w if x in answers}))
            if keys:
                ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate(rows)))
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), ids, pa.array(found, pa.list_(pa.int32())), pa.nulls(len(keys), pa.list_(pa.int64())), pa.nulls(len(keys), pa.int64())], names=[key, "ids", "answers", "df", "seen"])
                yield out
            schema = batch.schema.field(0).type
        if schema is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([seen], pa.int64())], names=[key, "ids", "answers", "df", "seen"])

    schema = f"`{key}` {kind}, ids array<int>, answers array<int>, df array<bigint>, seen bigint"
    return docs.select(docs[key], docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def _sketch(rows: DataFrame, weight: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """AᵀA times omega, where A holds the unit TF-IDF rows of all passages of `rows`; partitions' sums are added up on the
    cluster by blocks of words, so the driver gets one matrix of a block of items' vocabulary."""
    height = 4096

    def run(batches):
        total = np.zeros(omega.shape, np.float64)
        block = max(16, (1 << 23) // len(weight))
        for batch in batches:
            for ids in batch.column(0):
                ids = ids.values.to_numpy()
                start = passages(ids)
                for lo in range(0, len(start), block):
                    a = counts(ids, start[lo : lo + block], PASSAGE, len(weight) - 1) * weight
                    norm = np.linalg.norm(a, axis=1, keepdims=True)
                    a = np.divide(a, norm, out=np.zeros_like(a), where=norm > 0)
                    total += a.T @ (a @ omega.astype(np.float32))
        for i in range(0, len(total), height):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + height].tobytes()], pa.binary())], names=["i", "part"])

    def add(pdf):
        total = sum(np.frombuffer(p, np.float64) for p in pdf["part"])
        return pd.DataFrame({"i": pdf["i"][:1], "part": [total.tobytes()]})

    out = np.zeros(omega.shape, np.float64)
    for r in rows.select("ids").mapInArrow(run, "i int, part binary").groupBy("i").applyInPandas(add, "i int, part binary").toLocalIterator():
        part = np.frombuffer(r["part"], np.float64).reshape(-1, omega.shape[1])
        out[r["i"] : r["i"] + len(part)] = part
    return out


def fit_latent(rows: DataFrame, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' TF-IDF rows by randomised SVD: a Gaussian sketch, power
    iterations with re-orthogonalisation, then the small eigenproblem. The seed is fixed."""
    width = min(rank + OVERSAMPLE, len(weight))
    q = np.random.default_rng(7).standard_normal((len(weight), width))
    for _ in range(1 + POWER):
        q, _ = np.linalg.qr(_sketch(rows, weight, q))
    small = q.T @ _sketch(rows, weight, q)
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, ::-1][:, : min(rank, width)]


def find_leaks(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, item_answer: str | None = None, cosine: float = COSINE, answered: int = TOLERANCE
) -> DataFrame:
    """(key, item, matched_words, cosine, answer_seen): each document and each item of which it holds a passage.

    A passage: SPAN words in sequence of the item's text without its opening line, of which one in TOLERANCE may be changed or
    missing; where the words of the item's answer are in the document too, one in `answered` (at most TOLERANCE, less for
    paraphrases). Latent semantic retrieval: texts become word ids over the items' vocabulary (and document frequencies over
    all texts), once, and are kept as a table; the randomised SVD of the passages' TF-IDF rows is summed up over partitions;
    all passages of all documents meet all query passages in the latent space, and those of at least `cosine` are candidates;
    a longest-common-subsequence check at the place and the answer's words decide. The corpus is never shuffled, only its
    parts with enough words of items are, to spread the search; the items are the stated query set and are taken in blocks of
    ITEM_BLOCK items or ITEM_WORDS words, each with a pass of its own over the corpus.

    Null and empty texts and items hold nothing. Of an item of one sentence that no other item begins with, that sentence is
    the body; where others begin with it, it is their opening line and the item has nothing to find. Items whose body has
    under SPAN words must be matched whole, in proportion. Repeated documents are each reported, repeated items too. Columns
    of other names are not read.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, item {item_kind}, matched_words int, cosine double, answer_seen boolean"
    out = None
    for block in _item_blocks(items, item_key, item_text, item_answer):
        part = _block_leaks(docs, key, text, block, schema, cosine, answered)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _item_blocks(items: DataFrame, item_key: str, item_text: str, item_answer: str | None):
    """Lists of (key, body words, answer words), as many as a block may hold at a time on the driver."""
    answer = items[item_answer].cast("string") if item_answer else F.lit(None).cast("string")
    rows = items.select(items[item_key].alias("k"), items[item_text].cast("string").alias("t"), answer.alias("a")).where("t IS NOT NULL")
    rows = rows.withColumn("first", F.trim(F.regexp_extract("t", r"(?s)^.*?[.!?](?=\s|$)", 0)))
    shared = rows.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    block, size = [], 0
    for r in rows.join(shared, "first").select("k", "t", "a", (F.col("n") == 1).alias("alone")).toLocalIterator():
        body = item_words(r["t"], r["alone"])
        if body:
            block.append((r["k"], body, words(r["a"])))
            size += len(body)
        if len(block) >= ITEM_BLOCK or size >= ITEM_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _block_leaks(docs: DataFrame, key: str, text: str, known: list, schema: str, cosine: float, answered: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary: dict[str, int] = {}
    answers: dict[str, int] = {}
    for _, body, answer in known:
        for w in body:
            vocabulary.setdefault(w, len(vocabulary) + 1)
        for w in answer:
            answers.setdefault(w, len(answers) + 1)
    table = cut(_reader(docs, key, text, vocabulary, answers, SPAN // min(answered, TOLERANCE), min(SPAN, *(len(body) for _, body, _ in known), SPAN)))
    df = table.where("df IS NOT NULL").select(F.posexplode("df").alias("i", "n"), F.lit(0).alias("s")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # a number for each word of the block
    seen = table.agg(F.sum("seen")).first()[0] or 0
    weight = np.zeros(len(vocabulary) + 1)
    for r in df:
        weight[r["i"]] = np.log((1 + seen) / (1 + r["n"])) + 1
    weight[0] = 0
    rows = table.where("ids IS NOT NULL").select(key, "ids", "answers")
    cells = rows.agg(F.sum(F.size("ids")).alias("n")).first()["n"]
    if not cells:
        return None
    parts = -(-cells // WORDS_PER_TASK)
    if parts > rows.rdd.getNumPartitions():  # the table is small in bytes for what its search costs
        rows = rows.repartition(parts)
    share = min(1.0, FIT_PASSAGES * STEP / cells)
    sample = rows.where(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000) + 1).repartition(min(12, max(1, spark.sparkContext.defaultParallelism)))
    latent = (fit_latent(cut(sample), weight) * weight[:, None]).astype(np.float32)
    return _search(rows, key, schema, _model(known, vocabulary, latent), [[answers[w] for w in a] for _, _, a in known], cosine, answered)


def _model(known: list, vocabulary: dict[str, int], latent: np.ndarray) -> Model:
    items = [np.array([vocabulary[w] for w in body], np.int32) for _, body, _ in known]
    vectors, owner = [], []
    for n, ids in enumerate(items):
        start = np.unique(np.append(np.arange(0, max(1, len(ids) - SPAN + 1), QUERY_STEP), max(0, len(ids) - SPAN)))
        vectors.append(sums(latent, ids, start, SPAN))
        owner += [n] * len(start)
    return Model(latent, np.concatenate(vectors), np.array(owner), items, [k for k, _, _ in known])


def confirm(model: Model, ids: np.ndarray, ends: np.ndarray, cosine: float, tolerance) -> list[tuple[int, int, int, float]]:
    """(row, item number, matched words, best cosine) of the rows laid end to end in ids; row r ends at ends[r].

    tolerance(row, item number): one word in so many may be changed or missing."""
    best: dict[tuple[int, int], dict[int, float]] = {}
    for s, item, c in candidates(model, ids, cosine):
        first, last = np.searchsorted(ends, [s, min(s + PASSAGE, len(ids)) - 1], side="right")
        for row in range(first, last + 1):
            at = best.setdefault((row, item), {})
            at[s] = max(at.get(s, 0.0), c)
    out = []
    for (row, item), at in best.items():
        lo, hi = (int(ends[row - 1]) if row else 0), int(ends[row])
        matched = 0
        for s in sorted(at, key=lambda x: -at[x]):
            matched = best_match(model.items[item], ids[max(lo, s - STEP) : min(hi, s + PASSAGE + STEP)], tolerance(row, item))
            if matched:
                break
        if matched:
            out.append((row, item, matched, max(at.values())))
    return out


def _search(rows: DataFrame, key: str, schema: str, model: Model, answers: list[list[int]], cosine: float, answered: int) -> DataFrame:
    wanted = [set(a) for a in answers]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ids, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            stated = batch.column(2)
            seen = lambda row, item: bool(wanted[item]) and wanted[item] <= set(stated[row].as_py() or ())  # noqa: B023, E731
            found = confirm(model, ids, ends, cosine, lambda row, item: answered if answered < TOLERANCE and seen(row, item) else TOLERANCE)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([model.keys[f[1]] for f in found]),
                pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.float64()),
                pa.array([seen(f[0], f[1]) for f in found], pa.bool_()),
            ], names=[key, "item", "matched_words", "cosine", "answer_seen"])

    return rows.mapInArrow(run, schema)
