"""Text that looks the same on the page brought to one form."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.storage import cut

# Letters of other scripts whose glyphs are those of Latin letters, in pairs.
CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv үy ӏl ѐè ёë їï ӓä ӧö ӑă ӗĕ АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ӀI ԌG ԚQ ԜW ѴV ҮY ЀÈ ЁË ЇÏ ӒÄ ӦÖ ӐĂ ӖĔ"
GREEK = "αa ιi κk οo ρp νv υu γy ϲc ϳj άá ίí όó ύú ϊï ϋü ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ ΆÁ ΈÉ ΊÍ ΌÓ ΎÝ µμ"
ARMENIAN = "սu օo ոn հh ցg զq յj աw ՏS ՕO ՍU ԼL"
CHEROKEE = "ᎠD ᎡR ᎢT Ꭵi ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏏB ᏒR ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
COPTIC = "ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲎH ⲒI ⲔK ⲘM ⲚN ⲦT ⲬX"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
LATIN = "ɑa ɡg"
# Spaces of other widths, hyphens drawn like the hyphen-minus, line separators.
SPACES = "               　"
HYPHENS = "‐‑"
LINES = "\r\u0085  "
# Characters without a glyph, as the inside of a regular expression's class.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff"


#: Kinds of compatibility mapping (as Unicode's data names them) whose results look as the character does. Raised and lowered
#: digits, fractions, characters in circles or squares and forms for vertical text look different.
SAME_LOOK = {"<font>", "<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>"}
#: Blocks of which the plain compatibility mappings look the same too: digraphs, Roman numerals, radicals, ligatures.
COMPATIBLE = [(0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2F00, 0x2FD5), (0xFB00, 0xFB17)]


#: The one block beyond the basic plane whose characters are letters in other fonts.
MATHEMATICAL = (0x1D400, 0x1D800)


def _compatible() -> dict[str, str]:
    """Every character of the Unicode data in Python that a compatibility mapping leaves looking the same, and its mapping."""
    out = {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(*MATHEMATICAL)):
        c = chr(code)
        kind, _, codes = unicodedata.decomposition(c).partition(" ")
        if kind in SAME_LOOK or kind == "<compat>" and any(a <= code <= b for a, b in COMPATIBLE):
            to = unicodedata.normalize("NFKC", c)
            if to != c and not to.startswith(" "):
                out[c] = to
    return out


def _pairs() -> dict[str, str]:
    alike = {p[0]: p[1] for p in " ".join((CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU, LATIN)).split()}
    plain = _compatible() | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(LINES, "\n")
    # what a compatibility mapping makes of a character may itself be a letter that looks like another
    return {c: "".join(alike.get(x, x) for x in to) for c, to in plain.items()} | alike


_ALL = _pairs()
SINGLE = {c: to for c, to in _ALL.items() if len(to) == 1}
SEVERAL = {c: to for c, to in _ALL.items() if len(to) > 1}
#: Characters that are looked for in every text; the others only where one of them occurs.
COMMON = {*map(chr, range(0xFF01, 0xFF5F)), *SPACES, *HYPHENS, *LINES} | {p[0] for p in f"{CYRILLIC} {GREEK}".split()}
#: For str.translate: the same mapping; invisible characters are to be removed before.
TRANSLATION = str.maketrans(_ALL)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(text: str) -> str:
    """The one form of a text as a DuckDB expression.

    Composed first, so that accented letters of other scripts are single characters; then invisible characters go,
    line ends become line feeds, look-alikes and compatibility forms their plain letters; then composed again. Letter case,
    accents, raised digits and fractions stay. Steps that a text can't need are left out for it: all but the line ends where
    it has ASCII alone, the rare characters where it has none.
    """
    x = f"regexp_replace(nfc_normalize({text}), {_quote(f'[{INVISIBLE}]')}, '', 'g')"
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    common, rare = ({c: to for c, to in SINGLE.items() if (c in COMMON) == often} for often in (True, False))
    x = f"translate({x}, {_quote(''.join(common))}, {_quote(''.join(common.values()))})"
    full = f"translate({x}, {_quote(''.join(rare))}, {_quote(''.join(rare.values()))})"
    for a, b in SEVERAL.items():
        full = f"replace({full}, '{a}', '{b}')"
    x = f"CASE WHEN regexp_matches({text}, {_quote('[' + _ranges([*rare, *SEVERAL]) + ']')}) THEN {full} ELSE {x} END"
    ascii_ = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"CASE WHEN strlen({text}) = length({text}) THEN {ascii_} ELSE nfc_normalize({x}) END"


def _ranges(chars: list[str]) -> str:
    """The characters as the inside of a regular expression's class, runs as ranges."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}" for a, b in out)


def in_duckdb(df: DataFrame, select: str, schema: str, source: str = "batch") -> DataFrame:
    """Each Arrow batch of df as the table `batch` of a DuckDB inside the Python worker: SELECT `select` FROM `source`."""

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            yield from con.sql(f"SELECT {select} FROM {source}").to_arrow_table().to_batches()
            con.unregister("batch")
        con.close()

    return df.mapInArrow(run, schema)


def one_form(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): each text in the one form in which texts that look the same are equal. Null stays null, empty empty."""
    kind = docs.schema[key].dataType.simpleString()
    return in_duckdb(docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")), f'k AS "{key}", {form_sql("t")} AS text', f"`{key}` {kind}, text string")


def form_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, exact): digests of each text's one form and of the text itself; null for null and blank texts."""
    kind = docs.schema[key].dataType.simpleString()
    seen = "CASE WHEN regexp_matches(f, '\\S') THEN f END"
    pick = f"k AS \"{key}\", md5({seen}) AS form, CASE WHEN {seen} IS NOT NULL THEN md5(t) END AS exact"
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    return in_duckdb(rows, pick, f"`{key}` {kind}, form string, exact string", f"(SELECT k, t, {form_sql('t')} AS f FROM batch)")


def look_alike_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: documents whose texts look the same but are not the same string. Keys must be unique.

    Only digests are shuffled. Forms written in one way only are dropped first; then the different strings of a form are
    paired, and only those pairs are expanded to documents, so that copies of one string, be they a third of all rows, never
    meet each other. Null and blank texts have no pairs; an empty table gives none.
    """
    rows = cut(form_classes(docs, key, text).where("form IS NOT NULL").select(F.col(f"`{key}`").alias("id"), "form", "exact"))
    several = rows.groupBy("form").agg(F.min("exact").alias("x"), F.max("exact").alias("y")).where("x <> y").select("form")
    written = cut(rows.join(several, "form", "left_semi").select("form", "exact").distinct())
    strings = written.toDF("form", "x").join(written.toDF("form", "y"), "form").where("x < y").select("x", "y")
    left, right = rows.select(F.col("exact").alias("x"), F.col("id").alias("p")), rows.select(F.col("exact").alias("y"), F.col("id").alias("q"))
    pairs = strings.join(left, "x").join(right, "y")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
