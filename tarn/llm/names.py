"""Names of organisations typed by people: parsing, and linking of variant spellings."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import namewords as N
from tarn.llm.components import contract, pairs_within
from tarn.llm.neighbours import BLOCK, KINDS, letter_keys, near, near_many, sharing
from tarn.storage import cut, scratch

#: Letters taken from either spelling to leave the same letters in both; and edits, a swap of neighbours being one.
LETTERS, EDITS = 2, 3
#: Marks the reading of a name that has no words but trade, legal form and the like, which is compared as written only.
AS_WRITTEN = "="
#: Words of which all orders are tried.
ORDERED = 4

_PHRASES = {tuple(x.split()): k for k, v in N.TRADE.items() for x in [k, *v]}
_LONGEST = max(map(len, _PHRASES))
_STARTS = {p[0] for p in _PHRASES}
_LEGAL = {x: k for k, v in N.LEGAL.items() for x in [k, *v]}
_GIVEN: dict[str, set[str]] = {}
for _k, _v in N.GIVEN.items():
    for _x in [_k, *_v]:
        _GIVEN.setdefault(_x, set()).add(_k)
_EMPTY = set(N.EMPTY_WORDS)
_TOWN_ENDS = set(N.TOWN_ENDS)
_TRADE_WORDS = {w for p in _PHRASES for w in p if len(w) > 3}
_FULL_TRADE = {w: _PHRASES.get((w,), "") for w in _TRADE_WORDS}
_BEGINNINGS = {w[:n] for w in _TRADE_WORDS for n in range(3, len(w))}

_zero = re.compile(r"(?<=[a-z])0(?!\d)|(?<!\d)0(?=[a-z])")
_one = re.compile(r"(?<=[a-z])1(?!\d)|(?<!\d)1(?=[a-z])")
_initials = re.compile(r"\b(?:[a-z]\.){2,}[a-z]?\b")
_between = re.compile(r"[\W_]+")
_repeated = re.compile(r"(.)\1+")


def plain(text: str | None) -> str:
    """Lower case without accents; a lone 0 or 1 beside letters as the letter it looks like; dotted initials joined."""
    if text is None:
        return ""
    t = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    t = t.lower()
    if "0" in t:
        t = _zero.sub("o", t)
    if "1" in t:
        t = _one.sub("l", t)
    if "." in t:
        t = _initials.sub(lambda m: m[0].replace(".", ""), t)
    return _between.sub(" ", t.replace("'", "").replace("’", "").replace("m/s", " ")).strip()


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """Spellings that sound or look alike become one: ph/f, y/i, c/k, rn/m, doubled letters."""
    return _repeated.sub(r"\1", word.replace("rn", "m").replace("ph", "f").replace("y", "i").replace("c", "k").replace("vv", "w"))


def _without(word: str, n: int) -> set[str]:
    """The word with up to n letters taken out."""
    out = last = {word}
    for _ in range(n):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


_TYPOS: dict[str, set[str]] = {}
for _w in [*_GIVEN, *_TRADE_WORDS]:
    if len(_w) >= (5 if _w in N.GIVEN else 6):
        for _x in _without(_w, 2):
            _TYPOS.setdefault(_x, set()).add(_w)


@lru_cache(maxsize=200_000)
def misspelt(word: str) -> tuple[str, str] | None:
    """(kind, canonical) of the known word that a word is a shortening or a typo of: one edit, two from eight letters on."""
    if word in _BEGINNINGS:
        return "trade", ""
    if len(word) < 5:
        return None
    limit = 2 if len(word) >= 8 else 1
    close = sorted((near(word, k, limit), k) for k in {k for x in _without(word, limit) for k in _TYPOS.get(x, ())})
    if not close or close[0][0] > limit:
        return None
    found = close[0][1]
    return ("given", "|".join(sorted(_GIVEN[found]))) if found in _GIVEN else ("trade", _FULL_TRADE[found])


def split_name(text: str | None) -> dict:
    """words: what is left after legal form, trade, given name and words without identity; towns marks words after "of".

    -> {"trade", "legal", "given", "words", "towns"}: trade "" when missing; given names joined by "|", one letter for an
    initial; towns are the positions in words that "of", or a last word of town names, shows to be a town.
    """
    w = plain(text).split()
    out: dict = {"trade": "", "legal": "", "given": "", "words": [], "towns": []}
    words, towns = out["words"], out["towns"]
    i, town, n = 0, 0, len(w)
    while i < n:
        x = w[i]
        size = next((k for k in range(min(_LONGEST, n - i), 0, -1) if tuple(w[i : i + k]) in _PHRASES), 0) if x in _STARTS else 0
        if size:
            out["trade"] = out["trade"] or _PHRASES[tuple(w[i : i + size])]
            i += size
            town = 0
            continue
        if x == "of":
            if i + 1 < n and (w[i + 1],) not in _PHRASES and w[i + 1] not in _LEGAL:
                town = 2
            elif words:
                k = len(words)
                towns += [k - 2, k - 1] if words[-1] in _TOWN_ENDS and k > 1 else [k - 1]
        elif x in _LEGAL:
            out["legal"] = out["legal"] or _LEGAL[x]
            town = 0
        elif x in _EMPTY:
            pass
        elif len(x) == 1:
            out["given"] = out["given"] or x
        elif x in _GIVEN and not town:
            out["given"] = "|".join(sorted(_GIVEN[x])) if len(out["given"]) < 2 else out["given"]
        else:
            if town == 2 or (town == 1 and x in _TOWN_ENDS):
                towns.append(len(words))
                town -= 1
            words.append(x)
        i += 1
    return out


def reading(words: list[str], towns: list[bool]) -> tuple[str, str, str]:
    """(folded words in order of the alphabet, trade, given) of a name's words, the town words left out.

    Of three words and more, or two with one so long that two are written together, those that are a typo or shortening of
    a known trade or given name are taken out, as long as two words (or the long one) stay.
    """
    core = [w for w, t in zip(words, towns) if not t]
    if not core or len(core) == 1 and len(core[0]) < 12:  # what looks like a town is part of the name
        core = [w for w in words if w not in _TOWN_ENDS] or words
    trade = given = ""
    long = max(map(len, core), default=0) >= 12
    if len(core) > 2 or len(core) == 2 and long:
        rest = []
        for w in core:
            m = misspelt(w)
            if m is None:
                rest.append(w)
            elif m[0] == "trade":
                trade = m[1] or trade
            else:
                given = m[1]
        core = rest if len(rest) >= (1 if long else 2) else core
    return " ".join(sorted(map(fold, core))), trade, given


def orders(words: tuple[str, ...]) -> list[str]:
    """The words written together in every order; of more than ORDERED words in the given one."""
    return sorted({"".join(p) for p in permutations(words)}) if len(words) <= ORDERED else ["".join(words)]


def least_edits(x: list[str], y: list[str], limit: int) -> np.ndarray:
    """Edits between readings x[i] and y[i], written together in the orders of their words that suit best; limit + 1 for more.

    All orders of both are read against each other where both have fewer than ORDERED words. Where one has more, the words
    that both have are taken out, and all orders of the rest of one (if no more than ORDERED) are read against the rest of
    the other as it stands.
    """
    known: dict[str, int] = {}
    a, b = (np.array([known.setdefault(t, len(known)) for t in side], dtype=np.int64) for side in (x, y))
    return _least(list(known), a, b, limit)


def _least(readings: list[str], x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """least_edits of readings[x[i]] and readings[y[i]]."""
    split = [r.split(" ") for r in readings]
    texts: list[str] = []
    count = np.zeros(len(readings), np.int64)  # none where there are ORDERED words and more
    for i, w in enumerate(split):
        if len(w) < ORDERED:
            every = w if len(w) == 1 else [w[0] + w[1], w[1] + w[0]] if len(w) == 2 else orders(tuple(w))
            texts += every
            count[i] = len(every)
    first = np.cumsum(count) - count
    n = count[x] * count[y]
    at = np.repeat(np.arange(len(x)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    left, right = first[x][at] + nth // count[y][at], first[y][at] + nth % count[y][at]
    more: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(n == 0):
        p, q = Counter(split[x[i]]), Counter(split[y[i]])
        short, other = sorted((tuple(sorted((p - q).elements())), tuple(sorted((q - p).elements()))), key=len)
        one, all_of = (short, other) if len(other) <= ORDERED else (other, short)
        texts.append("".join(one))
        whole = len(texts) - 1
        for t in orders(all_of):
            texts.append(t)
            more.append((i, len(texts) - 1, whole))
    if more:
        at, left, right = (np.concatenate([u, v]) for u, v in zip((at, left, right), np.array(more, dtype=np.int64).T))
    out = np.full(len(x), limit + 1)
    np.minimum.at(out, at, near_many(texts, left, right, limit))
    return out


def letter_join(readings: DataFrame, letters: int = LETTERS, block: int = BLOCK) -> DataFrame:
    """readings(rid long, reading) -> (x, y), x < y: pairs of rid whose letters differ by at most `letters` on either side.

    The candidates of the fuzzy join, complete whatever the order and the cut of the words: two spellings within `letters`
    edits, however many swaps they have besides, share a shard of sharing(). Readings marked AS_WRITTEN have none. readings may
    have a column kind (see sharing).
    """
    kind = ["kind"] if "kind" in readings.columns else []
    keyed = readings.where(~F.col("reading").startswith(AS_WRITTEN)).select(F.col("rid").alias("id"), F.replace("reading", F.lit(" "), F.lit("")).alias("text"), *kind)
    return sharing(keyed, lambda texts: letter_keys(texts, letters), block=block)


def parse_names(rows: DataFrame, name: str) -> DataFrame:
    """(nid, name, reading, trade, given) for each distinct non-blank text of rows[name].

    A word is a town when it stands at "of", here or in any other name: gathered over all names, joined by word.
    """
    texts = rows.select(F.col(f"`{name}`").cast("string").alias("name")).where(F.col("name").rlike(r"(?U)\w")).distinct()

    def parse(batches):
        for p in batches:
            names = p.column("name")
            got = [split_name(x) for x in names.to_pylist()]
            columns = [pa.array([g[c] for g in got], kind) for c, kind in (("trade", pa.string()), ("given", pa.string()), ("words", pa.list_(pa.string())), ("towns", pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([names, *columns], ["name", "trade", "given", "words", "towns"])

    with scratch(rows.sparkSession) as keep:
        parsed = cut(texts.mapInArrow(parse, "name string, trade string, given string, words array<string>, towns array<int>").withColumn("nid", F.monotonically_increasing_id()))
        towns = parsed.where(F.size("towns") > 0).select(F.explode(F.transform("towns", lambda i: F.get("words", i))).alias("word")).distinct()
        each = parsed.select("nid", F.posexplode("words").alias("pos", "word"))
        marked = each.join(towns, "word", "left_semi").groupBy("nid").agg(F.collect_set("pos").alias("elsewhere"))

        def read(batches):
            for p in batches:
                out = []
                for n, t, g, words, own, others in zip(*[p.column(c).to_pylist() for c in ("name", "trade", "given", "words", "towns", "elsewhere")]):
                    at = {*own, *(others or ())}
                    found, trade, given = reading(words, [i in at for i in range(len(words))])
                    out.append((found or AS_WRITTEN + (plain(n) or n), t or trade, g or given))
                columns = [pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3
                yield pa.RecordBatch.from_arrays([p.column("nid"), p.column("name"), *columns], ["nid", "name", "reading", "trade", "given"])

        return keep(cut(parsed.join(marked, "nid", "left").mapInArrow(read, "nid long, name string, reading string, trade string, given string")))


def given_fit(a: str, b: str) -> bool:
    """Whether one of the given names of a fits one of b's (an initial fits names that begin so), or one side has none."""
    return not a or not b or any(x == y or len(x) == 1 and y[0] == x or len(y) == 1 and x[0] == y for x in a.split("|") for y in b.split("|"))


def _plausible(x: str, y: str, e: int) -> bool:
    """Of three edits two at most lie in one of two words; a single word has two at most, one under six letters."""
    a, b = x.split(" "), y.split(" ")
    if len(a) == 1 or len(b) == 1:
        return e <= (1 if min(len(x.replace(" ", "")), len(y.replace(" ", ""))) < 6 else 2)
    if e <= 2 or len(a) != 2 or len(b) != 2:
        return True
    return min(max(near(a[0], b[0], 2), near(a[1], b[1], 2)), max(near(a[0], b[1], 2), near(a[1], b[0], 2))) <= 2


def _links(batches, limit: int):
    """Edges between the vertices (reading, trade) of pairs of readings that are spellings of one name."""
    for p in batches:
        both = pa.concat_arrays([p.column("x_reading"), p.column("y_reading")]).dictionary_encode()
        texts, at = both.dictionary.to_pylist(), both.indices.to_numpy()
        a, b = at[: p.num_rows], at[p.num_rows :]
        edits = _least(texts, a, b, limit)
        out: set[tuple[int, int]] = set()
        for row, e in zip(p.take(pa.array(np.flatnonzero(edits <= limit))).to_pylist(), edits[edits <= limit]):
            x, y = (dict(zip(row[s + "_trades"], row[s + "_vids"])) for s in "xy")
            common = [t for t in x if t and t in y]
            if e > 2 and not common:  # three edits need as much to say that it is the same
                continue
            if e > 1 and not given_fit(row["x_given"], row["y_given"]) or not _plausible(row["x_reading"], row["y_reading"], e):
                continue
            out |= {(x[t], y[t]) for t in common}
            if len({*x, *y} - {""}) <= 1:  # one trade in question: a name without a trade may be it
                out |= {(v, w) for v in x.values() for w in y.values()}
        edges = np.array(sorted(out), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"u": edges[:, 0], "v": edges[:, 1]})


def name_groups(rows: DataFrame, name: str) -> DataFrame:
    """(name, organisation, words) for each distinct non-blank text of rows[name]: spellings of one organisation share a number.

    Names are parsed (parse_names). A vertex is a reading with a trade; readings are joined by letter_join and compared in any
    order of their words, and vertices linked where the trade is the same or in question only once and, from two edits on,
    given names don't contradict. Links go through connected components, so a spelling that is far from another is reached
    over those between. Only longs are shuffled but for the joins that bring texts to vertices.
    """
    with scratch(rows.sparkSession) as keep:
        parsed = parse_names(rows, name)
        vertices = cut(parsed.groupBy("reading", "trade").agg(F.collect_set(F.when(F.col("given") != "", F.col("given"))).alias("given")).withColumn("vid", F.monotonically_increasing_id()))
        of = vertices.groupBy("reading").agg(
            F.collect_list("trade").alias("trades"), F.collect_list("vid").alias("vids"), F.array_join(F.array_distinct(F.flatten(F.collect_list("given"))), "|").alias("given"),
        )
        of = cut(of.withColumn("rid", F.monotonically_increasing_id()))
        stated = F.filter("trades", lambda t: t != "")
        kind = F.when(F.size(stated) == 1, F.pmod(F.xxhash64(stated[0]), F.lit(KINDS - 1)) + 1).otherwise(0).cast("int")  # of two different trades none are linked
        pairs = letter_join(of.select("rid", "reading", kind.alias("kind")))
        side = lambda s: of.select(F.col("rid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("reading", "trades", "vids", "given")])
        x, y = (F.filter(f"{s}_trades", lambda t: t != "") for s in "xy")
        one_trade = F.arrays_overlap(x, y) | (F.size(F.array_union(x, y)) <= 1)  # else _links has nothing to link
        links = pairs.join(side("x"), "x").join(side("y"), "y").where(one_trade).drop("x", "y").mapInArrow(lambda it: _links(it, EDITS), "u long, v long")
        own = of.where((F.size("trades") == 2) & (F.size(stated) == 1)).select(F.col("vids")[0].alias("u"), F.col("vids")[1].alias("v"))
        groups = contract(links.union(own))
        placed = vertices.join(groups.withColumnRenamed("id", "vid"), "vid", "left").select("reading", "trade", F.coalesce("group_id", "vid").alias("organisation"))
        words = F.when(~F.col("reading").startswith(AS_WRITTEN), F.split("reading", " "))
        return keep(cut(parsed.join(placed, ["reading", "trade"]).select("name", "organisation", F.coalesce(words, F.array().cast("array<string>")).alias("words"))))


def same_organisation(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(a, b), a < b: different keys whose names are spellings of one organisation. Null and blank names have no pairs.

    A key with several rows has the names of all. Names that hold nothing but legal form, trade or town are compared as
    written. An empty table gives none; other columns are not read.
    """
    groups = name_groups(rows, name).select("name", "organisation")
    named = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{name}`").cast("string").alias("name")).where("id IS NOT NULL AND name IS NOT NULL")
    return pairs_within(named.join(groups, "name").select("id", "organisation"), "id", "organisation")
