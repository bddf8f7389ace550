"""Records of two tables that describe one thing, without a common key: a cascade of rules with a confidence each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.addresses import address_groups
from tarn.llm.names import name_groups
from tarn.storage import cut, drop, scratch

# Spellings and codes of countries beside their names.
COUNTRIES = {
    "argentina": ["ar", "arg"], "australia": ["au", "aus"], "austria": ["at", "aut", "osterreich"], "bangladesh": ["bd", "bgd"], "belgium": ["be", "bel", "belgique", "belgie"], "brazil": ["br", "bra", "brasil"],
    "canada": ["ca", "can"], "chile": ["cl", "chl"], "china": ["cn", "chn", "prc"], "colombia": ["co", "col"], "czechia": ["cz", "cze", "czech republic"], "denmark": ["dk", "dnk", "danmark"],
    "egypt": ["eg", "egy"], "finland": ["fi", "fin", "suomi"], "france": ["fr", "fra"], "germany": ["de", "deu", "ger", "deutschland", "allemagne"], "greece": ["gr", "grc", "hellas"], "hungary": ["hu", "hun"],
    "india": ["in", "ind", "bharat", "inde"], "indonesia": ["id", "idn"], "ireland": ["ie", "irl", "eire"], "israel": ["il", "isr"], "italy": ["it", "ita", "italia"], "japan": ["jp", "jpn", "nippon"],
    "kenya": ["ke", "ken"], "luxembourg": ["lu", "lux"], "malaysia": ["my", "mys"], "mexico": ["mx", "mex"], "morocco": ["ma", "mar", "maroc"], "nepal": ["np", "npl"], "netherlands": ["nl", "nld", "holland", "nederland"],
    "new zealand": ["nz", "nzl"], "nigeria": ["ng", "nga"], "norway": ["no", "nor", "norge"], "pakistan": ["pk", "pak"], "philippines": ["ph", "phl"], "poland": ["pl", "pol", "polska"], "portugal": ["pt", "prt"],
    "russia": ["ru", "rus", "russian federation"], "saudi arabia": ["sa", "sau", "ksa"], "singapore": ["sg", "sgp"], "south africa": ["za", "zaf", "rsa"], "south korea": ["kr", "kor", "korea", "republic of korea"],
    "spain": ["es", "esp", "espana", "espagne"], "sri lanka": ["lk", "lka"], "sweden": ["se", "swe", "sverige"], "switzerland": ["ch", "che", "suisse", "schweiz"], "thailand": ["th", "tha"], "turkey": ["tr", "tur", "turkiye"],
    "united arab emirates": ["ae", "are", "uae"], "united kingdom": ["uk", "gb", "gbr", "great britain", "england", "scotland", "wales"],
    "united states": ["us", "usa", "united states of america", "america", "etats-unis", "etats unis"], "vietnam": ["vn", "vnm", "viet nam"],
}
#: Weight of the prior in a rule's confidence: as many made-up labelled pairs, PRIOR_SHARE of them right.
PRIOR, PRIOR_SHARE = 4.0, 0.5
#: Parts of the labelled records for which confidences come from the other parts.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """Records agree on all of `on` (null agrees with nothing), and `left` and `right` hold for them.

    A record has beside its attributes: few_places, the records of its table with its organisation lie in one building at
    most; few_names, those of its table in its building belong to one organisation at most; word, one of its name's words.
    """

    name: str
    on: tuple[str, ...]
    left: str = "true"
    right: str = "true"
    both: str = "true"


#: The organisation is the group of name spellings, the building the group of address spellings.
RULES = (
    Rule("organisation and building", ("organisation", "building")),
    Rule("organisation, house number, street", ("organisation", "number", "street")),
    Rule("organisation and postcode", ("organisation", "postcode"), both="l_number IS NULL OR r_number IS NULL OR l_number = r_number"),
    Rule("organisation, house number, town", ("organisation", "number", "town")),
    Rule("organisation, right address missing", ("organisation",), "few_places", "building IS NULL"),
    Rule("organisation, left address missing", ("organisation",), "building IS NULL", "few_places"),
    Rule("building and one family name", ("building", "word")),
    Rule("building, name missing", ("building",), "few_names", both="NOT l_named OR NOT r_named"),
)


def country_key(c: Column) -> Column:
    """One key for the spellings and codes of a country, accents and dots aside; null for null and blank."""
    t = F.trim(F.regexp_replace(F.translate(F.lower(c.cast("string")), "éñöü.", "enou"), r"(?U)\s+", " "))
    known = {x: k for k, v in COUNTRIES.items() for x in [k, *v]}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.when(t != "", F.coalesce(F.try_element_at(table, t), t))


def attributes(rows: DataFrame, key: str, name: str, address: str, country: str) -> DataFrame:
    """(id, side, organisation, building, number, street, town, postcode, country_key, words, named) of each distinct row;
    organisation and building are numbers. rows has `side` beside the named columns."""
    with scratch(rows.sparkSession) as keep:
        clean = cut(rows.select(
            F.col(f"`{key}`").alias("id"), "side", F.col(f"`{name}`").cast("string").alias("name"), F.col(f"`{address}`").cast("string").alias("address"), country_key(F.col(f"`{country}`")).alias("country_key")
        ).where("id IS NOT NULL").distinct())
        names = name_groups(clean, "name")
        known = cut(clean.join(names, "name", "left").withColumn("named", F.coalesce(F.col("name").rlike(r"(?U)\w"), F.lit(False))).drop("name"))
        drop(clean)
        drop(names)
        places = address_groups(known, "address").select("address", "building", *[F.when(F.col(c) != "", F.xxhash64(c)).alias(c) for c in ("number", "street", "town", "postcode")])
        return keep(cut(known.join(places, "address", "left").drop("address").distinct()))


def _cell(n: int, on: list[str]):
    return lambda w: F.struct(F.lit(n).alias("rule"), F.xxhash64(F.lit(n), *on, w).alias("k1"), F.xxhash64(w, F.lit(~n), *on[::-1]).alias("k2"))


def _keys(records: DataFrame, rules: tuple[Rule, ...], side: str) -> DataFrame:
    """(k1, k2, rule, <side>_id, ...): a row for each rule a record can take part in; the keys are two hashes of the rule and
    the values it joins on, 128 bits in all."""
    cells = []
    for n, rule in enumerate(rules):
        plain = [c for c in rule.on if c != "word"]
        words = F.transform("words", lambda w: F.xxhash64(w)) if "word" in rule.on else F.array(F.lit(0).cast("long"))
        given = F.expr(f"({rule.left if side == 'l' else rule.right})") & F.lit(True)
        for c in plain:
            given = given & F.col(c).isNotNull()
        cells.append(F.when(given, F.transform(F.coalesce(words, F.array().cast("array<bigint>")), _cell(n, plain))))
    keyed = records.withColumn("k", F.explode(F.flatten(F.array_compact(F.array(*cells)))))
    asked = F.col("k.rule").isin([n for n, rule in enumerate(rules) if "number" in rule.both])  # other rows travel without it
    number = F.when(asked, F.col("number")).alias(f"{side}_number")
    return keyed.select("k.k1", "k.k2", "k.rule", number, *[F.col(c).alias(f"{side}_{c}") for c in ("id", "building", "named", "country_key")])


def _flagged(records: DataFrame) -> DataFrame:
    """+ few_places, few_names (Rule)."""
    for flag, of, what in (("few_places", "organisation", "building"), ("few_names", "building", "organisation")):
        few = records.where(F.col(of).isNotNull()).groupBy(of).agg(F.coalesce(F.min(what) == F.max(what), F.lit(True)).alias(flag))
        records = records.join(few, of, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return records


def match_entities(
    left: DataFrame, right: DataFrame, key: str, name: str, address: str, country: str, labels: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
    known: DataFrame | None = None,
) -> DataFrame:
    """(l_id, r_id, rule, confidence): pairs of records of the two tables that are the same business at the same place.

    Deterministic rule cascade: each rule is an exact join on its attributes; pairs it makes resolve their right record, which
    takes no part in weaker rules. The rules' joins are one join here, on the hash of rule and values, and a right record
    keeps the pairs of its first rule: the same rows as joining rule by rule with an anti-join between. Attributes come from
    name_groups and address_groups over both tables. Countries given on both sides may differ only under the first rule, or
    in one building (a country is now and then wrong).

    labels(l_id, r_id): true pairs; `known(l_id)`: left records whose true pairs are all in labels (default: those that occur
    in it). A rule's confidence is the share of its pairs of known left records that labels hold, smoothed by PRIOR made-up
    pairs; for the pairs of a known left record itself the share comes from the FOLDS it is not in. Without labels it is
    PRIOR_SHARE for all.

    Null and blank fields agree with nothing. Repeated rows count once; a key with differing rows has the attributes of all.
    Empty tables give no pairs. Columns of other names are not read.
    """
    fields = [F.col(f"`{c}`").alias(c) for c in (key, name, address, country)]
    side = lambda t, s: t.select(*fields).withColumn("side", F.lit(s))
    both = attributes(side(left, "l").unionByName(side(right, "r")), key, name, address, country)
    sides = [cut(_flagged(both.where(F.col("side") == s))) for s in "lr"]
    drop(both)
    l, r = (_keys(rows, rules, s) for rows, s in zip(sides, "lr"))
    pairs = l.join(r, ["k1", "k2", "rule"]).where("l_id <> r_id")
    agree = F.col("l_country_key").isNull() | F.col("r_country_key").isNull() | (F.col("l_country_key") == F.col("r_country_key")) | F.coalesce(F.col("l_building") == F.col("r_building"), F.lit(False))
    extra = F.lit(True)
    for n, rule in enumerate(rules):
        extra = F.when(F.col("rule") == n, F.expr(rule.both)).otherwise(extra)
    pairs = cut(pairs.where(extra & ((F.col("rule") == 0) | agree)).groupBy("l_id", "r_id").agg(F.min("rule").alias("rule")))
    first = pairs.withColumn("first", F.min("rule").over(Window.partitionBy("r_id"))).where("rule = first").drop("first")
    found = cut(first)
    for spent in (*sides, pairs):
        drop(spent)
    names = F.element_at(F.array(*[F.lit(x.name) for x in rules]), F.col("rule") + 1)
    if labels is None:
        return found.select("l_id", "r_id", names.alias("rule"), F.lit(PRIOR_SHARE).alias("confidence"))
    labels = labels.select("l_id", "r_id").distinct()
    known = (labels if known is None else known).select("l_id").distinct().withColumn("fold", F.pmod(F.xxhash64("l_id"), F.lit(FOLDS)).cast("int"))
    marked = cut(found.join(known, "l_id", "left").join(labels.withColumn("right", F.lit(1)), ["l_id", "r_id"], "left"))
    drop(found)
    sums = marked.where("fold IS NOT NULL").groupBy("rule", "fold").agg(F.count("right").alias("hits"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy("rule").agg(F.sum("hits").alias("all_hits"), F.sum("n").alias("all_n"))  # a row for each rule
    share = (F.coalesce("all_hits", F.lit(0)) - F.coalesce("hits", F.lit(0)) + PRIOR * PRIOR_SHARE) / (F.coalesce("all_n", F.lit(0)) - F.coalesce("n", F.lit(0)) + PRIOR)
    scored = marked.join(F.broadcast(per), "rule", "left").join(F.broadcast(sums), ["rule", "fold"], "left")
    return scored.select("l_id", "r_id", names.alias("rule"), share.alias("confidence"))
