"""Postal addresses written differently: parsing, and records that lie in the same building."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import addresswords as A
from tarn.llm.components import contract, pairs_within
from tarn.llm.names import fold
from tarn.llm.neighbours import near, near_many, sharing
from tarn.storage import cut, scratch

_TYPE = {x: k for k, v in A.TYPES.items() for x in [k, *v]}
_BEFORE = set(A.BEFORE)
_DIRECTION = {x: v[0] for k, v in A.DIRECTIONS.items() for x in [k, *v]}
_EMPTY = set(A.EMPTY)
_UNIT = "|".join(sorted(A.UNITS, key=len, reverse=True))
_unit = re.compile(rf"\b(?:\d+(?:st|nd|rd|th)|gr|ground)\.? floor\b|\b(?:{_UNIT})\b\.? ?#?(?:\d{{1,3}}[a-z]?|[a-h])\b(?! ?(?:{'|'.join(sorted(_TYPE, key=len, reverse=True))})\b)")
_NEAR = "|".join(A.NEAR)
_landmark = re.compile(rf"\b(?:{_NEAR})\b\.? ?(?:to |de |du )?(?:the )?(?:{'|'.join(sorted(A.LANDMARKS, key=len, reverse=True))})\b")
_beside = re.compile(rf"(?:^|(?<=[,;/|]))\s*(?:{_NEAR})\b\.? ?[^\d,;/|]*(?=[,;/|]|$)")
_postcode = re.compile(r"(?<!\d)(?:(\d{5})(?:-\d{4})?|(\d{3}) ?(\d{3}))(?![\d])")
_lettered = re.compile(r"\b(?:([a-z]\d[a-z]) ?(\d[a-z]\d)|([a-z]{1,2}\d[a-z\d]?) (\d(?!st|nd|rd|th)[a-z]{2}))\b")
_full_state = re.compile(rf"\b(?:{'|'.join(sorted((s for s in A.STATES), key=len, reverse=True))})\b")
_country = re.compile(rf"[\s,;/|-]+(?:{'|'.join(re.escape(c) for c in sorted(A.COUNTRIES, key=len, reverse=True))})\W*$")
_ending = re.compile(rf"\b([a-z]{{3,}}?)({'|'.join(sorted(A.ENDINGS, key=len, reverse=True))})\b")
_ordinal = re.compile(r"\b(\d+)(?:st|nd|rd|th)\b")
_words = re.compile(r"[a-z]+|\d+[a-z]?")
_hyphen = re.compile(r"(?<=\w)-(?=[a-z])")
_parts = re.compile(r"[,;/|#]|(?<= )-")
_zero, _one = re.compile(r"(?<=[A-Za-z])0(?=[A-Za-z])"), re.compile(r"(?<=[A-Za-z])1(?=[A-Za-z])")
_glued = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[A-Za-z]{3})(?=\d)|(?<=\d)(?=[A-Z][a-z]{2})")
_space = re.compile(r"\s+")
_CODES = set(A.STATES.values())


def plain(text: str | None) -> str:
    """Lower case without accents, with spaces where words were run together, digits inside words as letters."""
    if text is None:
        return ""
    t = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if not unicodedata.combining(c))
    if "0" in t:
        t = _zero.sub("o", t)
    if "1" in t:
        t = _one.sub("l", t)
    return _space.sub(" ", _glued.sub(" ", t)).strip().lower()


def parse_address(text: str | None) -> dict | None:
    """Components of an address, folded, "" when missing: number, direction, street, kind, town, state, postcode.

    None for null and blank texts. Parts inside a building and landmarks are left out.
    """
    out = dict.fromkeys(("number", "direction", "street", "kind", "town", "state", "postcode"), "")
    raw = (text or "").lower()
    for m in reversed(list(_lettered.finditer(raw))):  # before a digit among letters is read as a letter
        out["postcode"] = "".join(x for x in m.groups() if x)
        text = f"{text[: m.start()]} | {text[m.end() :]}" if len(raw) == len(text) else f"{raw[: m.start()]} | {raw[m.end() :]}"
        break
    t = plain(text)
    if not t:
        return None
    t = _country.sub("", t)
    t = _landmark.sub(" , ", t)
    t = _beside.sub(" ", t)
    t = _unit.sub(" , ", t)
    t = re.sub(r"\bc/ ?", "calle ", t) if "c/" in t else t
    t = _ordinal.sub(lambda m: "nth" + "".join(chr(97 + int(c)) for c in m[1]), t)  # a street's name, no house number
    t = _ending.sub(lambda m: f"{m[1]} {A.ENDINGS[m[2]]}", t)
    for m in reversed(list(_postcode.finditer(t)) if not out["postcode"] else []):
        out["postcode"] = m[1] or m[2] + m[3]
        t = f"{t[: m.start()]} | {t[m.end() :]}"
        break
    if m := _full_state.search(t):
        words = t[: m.start()].split()
        # a state's name is no state where a street of that name is meant
        if not (words and words[-1].isdigit()):
            out["state"] = A.STATES[m[0]]
            t = f"{t[: m.start()]} | {t[m.end() :]}"
    parts = [_named(p) for p in (_words.findall(_hyphen.sub(" ", p)) for p in _parts.split(t)) if p]
    street: list[str] = []
    rest: list[str] = []
    alone = False
    for p in parts:
        at = next((i for i, w in enumerate(p) if w[0].isdigit()), None)
        if at is None and alone and not street:
            street, more = _street(p)
            rest += more + [","]
            continue
        if at is None:
            types = [i for i, w in enumerate(p) if w in _TYPE]
            if out["number"] and street or not types:
                rest += p + [","]
                continue
        if street and at is None:
            rest += p + [","]
            continue
        if at is not None:
            if out["number"]:
                rest += [w for w in p if not w[0].isdigit()] + [","]
                continue
            out["number"] = p[at].lstrip("0")
            before, after = p[:at], p[at + 1 :]
            if not after and not before:
                alone = True  # the street is the next part
                continue
            if any(w in _TYPE for w in before) and not any(w in _TYPE and w not in _CODES for w in after):
                street, more = _street(before, tail=True)
                rest += more + [","] + after + [","]
            elif after:
                rest += [w for w in before if w not in _EMPTY] + [","]
                street, more = _street(after)
                rest += more + [","]
            else:
                street, more = _street(before, tail=True)
                rest += more + [","]
        else:
            street, more = _street(p)
            rest += more + [","]
    if not street and rest:  # a number in its own part, the street in the next
        i = rest.index(",") if "," in rest else len(rest)
        street, more = _street(rest[:i])
        rest = more + rest[i:]
    name = []
    kinds = [i for i, w in enumerate(street) if w in _TYPE]
    kind = -1 if not kinds or len(street) == 1 else kinds[0] if _TYPE[street[kinds[0]]] in _BEFORE and kinds[0] + 1 < len(street) else kinds[-1]
    for i, w in enumerate(street):
        if i == kind:
            out["kind"] = _TYPE[w]
        elif w in _DIRECTION and not out["direction"] and len(street) > 1:
            out["direction"] = _DIRECTION[w]
        elif w not in _EMPTY:
            name.append(_TYPE.get(w, w))
    if not name and out["direction"]:
        name, out["direction"] = [next(w for w in street if w in _DIRECTION)], ""
    out["street"] = fold("".join(name))
    town = []
    for i, w in enumerate(rest):
        alone = (i == 0 or rest[i - 1] == ",") and (i + 1 == len(rest) or rest[i + 1] == ",")
        if w in _CODES and not out["state"] and (alone or w not in A.DOUBTFUL):
            out["state"] = w
        elif w != "," and w not in _EMPTY and not w[0].isdigit() and w not in _CODES:
            town.append(w)
    out["town"] = fold("".join(w if len(w) > 1 else "" for w in town))
    return out


def _named(words: list[str]) -> list[str]:
    """Initials that stand for a well-known name written out, where a kind of street follows."""
    return [x for i, w in enumerate(words) for x in (A.INITIALS[w].split() if w in A.INITIALS and i + 1 < len(words) and words[i + 1] in _TYPE else [w])]


def _street(words: list[str], tail: bool = False) -> tuple[list[str], list[str]]:
    """(words of the street, other words) of a part without the house number; the other words are the town's.

    A kind of street written before the name takes one name word, others take the words before them; without a kind the
    first word (and a direction before it) is the name. tail: the street ends the part.
    """
    if tail:
        i = max((i for i, w in enumerate(words) if w in _TYPE), default=None)
        if i is None:
            return words[-1:], words[:-1]
        if _TYPE[words[i]] in _BEFORE and i + 1 < len(words):
            return words[i:], words[:i]
        j = i - 1
        while j > 0 and words[j - 1] in _DIRECTION:
            j -= 1
        return words[max(j, 0) :], words[: max(j, 0)]
    i = 0
    while i < len(words) and (words[i] in _DIRECTION or words[i] in _EMPTY):
        i += 1
    if i + 1 < len(words) and words[i] in _TYPE and (_TYPE[words[i]] in _BEFORE or words[i + 1] not in _TYPE):
        j = i + 1
        while j < len(words) and words[j] in _EMPTY:
            j += 1
        return words[: j + 1], words[j + 1 :]
    k = next((k for k in range(i + 1, min(i + 4, len(words))) if words[k] in _TYPE), None)
    if k is not None:
        k += k + 2 == len(words) and words[k + 1] in _DIRECTION  # a direction behind the kind ends the part
        return words[: k + 1], words[k + 1 :]
    return words[: i + 1], words[i + 1 :]


_FORM = ["number", "direction", "street", "kind", "town", "state", "postcode"]


def _limit(a: int, b: int) -> int:
    """Typing errors that two names of these lengths may have between them: two, one when short."""
    return 2 if min(a, b) >= 5 else 1 if min(a, b) >= 3 else 0


def same_name(a: str, b: str) -> bool:
    """Street or town names at most two typing errors apart, one when short."""
    limit = _limit(len(a), len(b))
    return a == b or near(a, b, limit) <= limit


def _near_columns(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Edits of each pair of texts, up to two; more as 3."""
    codes, texts = pd.factorize(np.concatenate([x.to_numpy(object), y.to_numpy(object)]))
    return near_many(list(texts), codes[: len(x)], codes[len(x) :], 2) if len(x) else np.empty(0, np.int64)


def same_building(p: pd.DataFrame) -> np.ndarray:
    """For pairs of forms (columns x_number ... y_postcode): 2 where they name one building, 1 where the form without
    postcode and town may stand for the other, 0 else.

    House number and direction are equal, the street nearly, its kind equal or missing once. Then, with both postcodes equal,
    towns must not contradict; with postcodes that differ by one typing error, street and town must be the same; with one
    missing, towns must be nearly equal and states equal or missing. A form with neither may stand for another where the
    states are equal or missing.
    """
    x, y = ({c: p[f"{s}_{c}"].to_numpy(object) for c in _FORM} for s in "xy")
    size = {c: np.minimum(*(np.array([len(t) for t in s[c]], dtype=np.int64) for s in (x, y))) for c in ("street", "town", "postcode")}
    limit = {c: np.where(size[c] >= 5, 2, np.where(size[c] >= 3, 1, 0)) for c in ("street", "town")}
    street, town, code = (_near_columns(p[f"x_{c}"], p[f"y_{c}"]) for c in ("street", "town", "postcode"))
    open_ = lambda c: (x[c] == "") | (y[c] == "")
    base = (x["number"] == y["number"]) & (x["direction"] == y["direction"]) & ((x["kind"] == y["kind"]) | open_("kind")) & (street <= limit["street"])
    part = np.array([len(a) >= 3 and len(b) >= 3 and (a in b or b in a) for a, b in zip(x["town"], y["town"])], dtype=bool)
    towns = (town <= limit["town"]) & ~open_("town")
    state = (x["state"] == y["state"]) | open_("state")
    both = ~open_("postcode")
    same = both & (code == 0) & (towns | part | open_("town"))
    same |= both & (code == 1) & (street == 0) & towns & (town == 0) & state
    same |= ~both & towns & state
    bare = lambda s: (s["postcode"] == "") & (s["town"] == "")
    stands = (bare(x) != bare(y)) & state
    return np.where(base & same, 2, np.where(base & stands, 1, 0))


def form_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, key, asks): hierarchical keys of forms written with "|", each of house number and direction and one more level.

    The levels: postcode; town; three letters of an end of the street with three of an end of the town; and, where the form has
    neither postcode nor town, three letters of an end of the street, for which that form asks alone.
    """
    index: list[int] = []
    keys: list[int] = []
    asks: list[bool] = []
    for i, t in enumerate(texts):
        number, direction, street, _, town, _, postcode = t.split("|")
        base = f"{number}|{direction}|"
        bare = not postcode and not town
        own = [(f"p{postcode}", True)] if postcode else []
        if town:
            own.append((f"t{town}", True))
            own += [(f"e{n}{s}|{m}{u}", True) for n, s in enumerate((street[:3], street[-3:])) for m, u in enumerate((town[:3], town[-3:]))]
        own += [(f"s{n}{s}", bare) for n, s in enumerate((street[:3], street[-3:]))]
        for k, a in own:
            index.append(i)
            keys.append(xxhash.xxh64_intdigest(base + k))
            asks.append(a)
    return np.array(index, dtype=np.int64), np.array(keys, dtype=np.uint64), np.array(asks, dtype=bool)


def _compared(batches):
    for p in batches:
        kind = same_building(p)
        some = kind > 0
        yield pd.DataFrame({"u": p["x"][some], "v": p["y"][some], "same": kind[some] == 2})


def parse_table(rows: DataFrame, address: str) -> DataFrame:
    """(address, form, its components) for each distinct text of rows[address] that names a house number and a street; form
    holds the components joined by "|".

    A missing town, or one that is a misspelling or a part of it, becomes the town most often written with the postcode; any
    other town stays as stated. A missing state becomes the one most often written with the postcode.
    """
    texts = rows.select(F.col(f"`{address}`").cast("string").alias("address")).where(F.col("address").rlike(r"(?U)\w")).distinct()

    def parse(batches):
        for p in batches:
            got = [parse_address(x) or dict.fromkeys(_FORM, "") for x in p["address"]]
            yield pd.DataFrame({"address": p["address"]} | {c: [g[c] for g in got] for c in _FORM})

    parsed = cut(texts.mapInPandas(parse, "address string, " + ", ".join(f"{c} string" for c in _FORM)).where("number <> '' AND street <> ''"))
    usual = lambda c: (
        parsed.where(f"postcode <> '' AND {c} <> ''").groupBy("postcode", c).agg(F.count(F.lit(1)).alias("n")).groupBy("postcode").agg(F.max(F.struct("n", c))[c].alias(f"usual_{c}"))
    )
    codes = usual("town").join(usual("state"), "postcode", "full")
    full = parsed.join(codes, "postcode", "left")
    stated = [[F.col("town"), F.col("usual_town")], [F.col("usual_town"), F.col("town")]]
    misspelt = F.levenshtein("town", "usual_town", 2).between(0, 2) & (F.length("town") >= 5) | F.lit(False)
    for a, b in stated:
        misspelt = misspelt | (F.length(b) >= 3) & a.contains(b)
    town = F.when((F.col("town") == "") | misspelt, F.coalesce("usual_town", "town")).otherwise(F.col("town"))
    full = full.withColumns({"town": town, "state": F.when(F.col("state") == "", F.coalesce("usual_state", "state")).otherwise(F.col("state"))})
    return full.select("address", *_FORM, F.concat_ws("|", *_FORM).alias("form"))


def address_groups(rows: DataFrame, address: str) -> DataFrame:
    """(address, building, number, street, town, postcode) for each distinct usable text: texts of one building share a number.

    Addresses are parsed, expanded and put in one order (parse_table): equal forms are one. Other forms meet on hierarchical
    keys (form_keys), same_building() decides, and connected components gather. A form with neither postcode nor town joins a
    building only where one alone fits. The keys let nothing of one postcode or town be missed; where the postcode is missing
    or misspelt, of street and town each one end of three letters must be as written, or the town whole.
    """
    with scratch(rows.sparkSession) as keep:
        with scratch(rows.sparkSession) as still:
            parsed = still(cut(parse_table(rows, address)))
        forms = cut(parsed.select(*_FORM, "form").distinct().withColumn("id", F.monotonically_increasing_id()))
        side = lambda s: forms.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in _FORM])
        with scratch(rows.sparkSession) as still:
            pairs = sharing(forms.select("id", F.col("form").alias("text")), form_keys, 10)
            found = still(cut(pairs.join(side("x"), "x").join(side("y"), "y").mapInPandas(_compared, "u long, v long, same boolean")))
        groups = contract(found.where("same").select("u", "v"))
        placed = cut(forms.join(groups, "id", "left").select("id", "form", F.coalesce("group_id", "id").alias("building"), ((F.col("postcode") == "") & (F.col("town") == "")).alias("bare")))
        may = found.where("NOT same").select("u", "v").union(found.where("NOT same").select("v", "u")).toDF("id", "other")
        known = placed.where("NOT bare").select(F.col("id").alias("other"), F.col("building").alias("found"))
        one = may.join(known, "other").groupBy("id").agg(F.min("found").alias("found"), F.max("found").alias("last")).where("found = last").select("id", "found")
        final = placed.join(one, "id", "left").select("form", F.when(F.col("bare"), F.coalesce("found", "building")).otherwise(F.col("building")).alias("building"))
        return keep(cut(parsed.join(final, "form").select("address", "building", "number", "street", "town", "postcode")))


def same_location(rows: DataFrame, key: str, address: str) -> DataFrame:
    """(a, b), a < b: different keys whose addresses name the same building, whatever the unit or floor.

    Null and blank addresses, and those without a house number or street, have no pairs. A key with several rows has the
    addresses of all. An empty table gives none; other columns are not read.
    """
    groups = address_groups(rows, address).select("address", "building")
    named = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{address}`").cast("string").alias("address")).where("id IS NOT NULL AND address IS NOT NULL")
    return pairs_within(named.join(groups, "address").select("id", "building"), "id", "building")
