"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PREFIXES = 4096
#: Leading characters by which long dictionary values are looked up; shorter ones by all of theirs.
ANCHOR = 32


def best_cover(field: str, found: list[tuple[int, int, str]]) -> list[tuple[str, bool]]:
    """Values of the field in order: (value, known).

    found: occurrences (start, end, value) of known whole values. Dynamic programming over the text picks the set of
    non-overlapping occurrences that leaves the fewest letters and digits uncovered, then uses the fewest pieces. An
    occurrence that would cut a run of letters and digits is no candidate, unless the cut lies against another occurrence.
    What stays between the chosen ones is split at everything but letters and digits: values the dictionary lacks.
    """
    n = len(field)
    ends: dict[int, list[tuple[int, str]]] = {}
    starts, stops = {s for s, _, _ in found}, {e for _, e, _ in found}
    for s, e, v in found:
        before_ok = s == 0 or not (field[s - 1].isalnum() and field[s].isalnum()) or s in stops
        after_ok = e == n or not (field[e - 1].isalnum() and field[e].isalnum()) or e in starts
        if before_ok and after_ok:
            ends.setdefault(e, []).append((s, v))
    best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    back: list[tuple[int, str] | None] = [None] * (n + 1)
    for i in range(1, n + 1):
        lost, pieces = best[i - 1]
        best[i] = (lost + field[i - 1].isalnum(), pieces)
        for s, v in ends.get(i, ()):
            if (x := (best[s][0], best[s][1] + 1)) < best[i]:
                best[i], back[i] = x, (s, v)
    out: list[tuple[str, bool]] = []
    i, right = n, n
    gaps: list[tuple[int, int]] = []
    chosen: list[tuple[int, int, str]] = []
    while i > 0:
        if back[i]:
            s, v = back[i]
            gaps.append((i, right))
            chosen.append((s, i, v))
            i = right = s
        else:
            i -= 1
    gaps.append((0, right))
    for k in range(len(gaps) - 1, -1, -1):
        a, b = gaps[k]
        piece = "".join(c if c.isalnum() or c in "-_." else " " for c in field[a:b])
        out += [(w, False) for w in piece.split() if any(c.isalnum() for c in w)]
        if k:
            out.append((chosen[k - 1][2], True))
    return out


def _segment(batches):
    import ahocorasick

    for pdf in batches:
        auto = ahocorasick.Automaton()
        for hits in pdf["hits"]:
            for v in hits if hits is not None else ():
                auto.add_word(v, v)
        ready = len(auto) > 0
        if ready:
            auto.make_automaton()
        rows = []
        for field in pdf["field"]:
            found = [(e + 1 - len(v), e + 1, v) for e, v in auto.iter(field)] if ready else []
            rows.append([{"value": v, "known": k} for v, k in best_cover(field, found)])
        yield pd.DataFrame({"field": pdf["field"], "pieces": rows})


def segment_fields(df: DataFrame, field: str, dictionary: DataFrame, value: str) -> DataFrame:
    """(field, pieces array<struct<value, known>>) for each distinct non-null text of df[field].

    Dictionary-guided segmentation. The dictionary grows with the data, so it is never sent whole to a task: each field's
    windows, under a hash of the field, meet the dictionary in a join on whole values (of long ones on their first ANCHOR
    characters), which brings to each field the known values that can occur in it. Where the dictionary has at most
    MAX_PREFIXES different three-letter beginnings (counted first), windows that begin otherwise are not sent. Then one
    multi-pattern automaton per Arrow batch finds all occurrences, and best_cover() picks the cover.
    """
    fields = df.select(F.col(f"`{field}`").cast("string").alias("field")).where("field IS NOT NULL").distinct().withColumn("fid", F.xxhash64("field"))
    known = dictionary.select(F.col(f"`{value}`").cast("string").alias("known")).where("known <> ''").distinct()
    known = known.withColumn("size", F.least(F.length("known"), F.lit(ANCHOR))).withColumn("anchor", F.substring("known", F.lit(1), F.col("size")))
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # at most ANCHOR numbers
    if not sizes:
        return fields.withColumn("hits", F.lit(None).cast("array<string>")).mapInPandas(_segment, "field string, pieces array<struct<value:string,known:boolean>>")
    head = min(3, sizes[0])
    heads = [r[0] for r in known.select(F.substring("known", 1, head)).distinct().limit(MAX_PREFIXES + 1).collect()]
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("field") - (sizes[0] - 1))))
    windows = fields.where(F.length("field") >= sizes[0]).withColumn("at", at)
    if len(heads) <= MAX_PREFIXES:
        windows = windows.where(F.substring("field", F.col("at"), F.lit(head)).isin(heads))
    windows = windows.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("at") + F.col("size") - 1 <= F.length("field"))
    windows = windows.select("fid", F.substring("field", F.col("at"), F.col("size")).alias("anchor")).distinct()
    hits = windows.join(known.select("known", "anchor"), "anchor").groupBy("fid").agg(F.collect_set("known").alias("hits"))
    return fields.join(hits, "fid", "left").mapInPandas(_segment, "field string, pieces array<struct<value:string,known:boolean>>")


def split_packed(df: DataFrame, key: str, field: str, dictionary: DataFrame, value: str, known_only: bool = False) -> DataFrame:
    """(key, pos int, value, known): one row per value packed in df[field], positions from 1 in the order written.

    Rows that repeat a key count once: the one with most values, ties by the values' order. A value listed twice keeps both
    positions; empty places have none. Null, blank and value-less fields give no row. Pieces that the dictionary lacks are values
    too (known is false); known_only drops them before positions are given. Rows with a null key give nothing. Extra columns are ignored.
    """
    cells = segment_fields(df, field, dictionary, value)
    pieces = F.filter("pieces", lambda p: p["known"]) if known_only else F.col("pieces")
    rows = (
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{field}`").cast("string").alias("field"))
        .where("key IS NOT NULL AND field IS NOT NULL").distinct()
        .join(cells.select("field", pieces.alias("pieces")), "field").where(F.size("pieces") > 0)
        .groupBy("key").agg(F.max(F.struct(F.size("pieces").alias("n"), F.col("pieces"))).alias("best"))
    )
    return rows.select("key", F.posexplode("best.pieces").alias("p", "piece")).select(
        "key", (F.col("p") + 1).cast("int").alias("pos"), F.col("piece.value").alias("value"), F.col("piece.known").alias("known")
    )
