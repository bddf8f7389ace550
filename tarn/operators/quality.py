"""Rules that an output of matches must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADERS = {"matches": "source1_entity_id\tmatched_entity_ids", "candidates": "source1_entity_id\tcandidate_entity_ids"}
#: Offenders named for each rule.
EXAMPLES = 5
LEVELS = {"no tab": "error", "duplicate row": "error", "repeated id": "error", "self match": "error", "wrong prefix": "error", "unknown id": "error", "missing row": "error", "extra row": "error", "not among candidates": "warning"}


def header_problem(first_line: str | None, kind: str = "matches") -> str | None:
    """What is wrong with a file's first line, or None; an empty file and a comma-separated one are told apart."""
    if first_line is None or not first_line.strip():
        return "empty file"
    if first_line.strip().lower() == HEADERS[kind]:
        return None
    return "comma-separated" if "," in first_line and "\t" not in first_line else "wrong header"


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(value) -> (s1_id, ids, broken): split at the first tab; blank lines are left out, lines without a tab stay visible."""
    parts = F.split("value", "\t", 2)
    cells = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.where(F.trim("value") != "")
    return rows.select(F.trim(parts[0]).alias("s1_id"), cells.alias("ids"), (~F.col("value").contains("\t")).alias("broken"))


def quality_report(output: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, level, n, examples): offenders of each rule in output(s1_id, ids array, broken), and the EXAMPLES first of them in
    order, joined by commas; rules without an offender have no row.

    required(s1_id): records that must have a row. known(entity_id): ids that exist, or None to skip the check.
    candidates(s1_id, cand_id): pairs that matches must be among, or None.
    """
    sound = output.where(~F.col("broken"))
    each = sound.select("s1_id", F.explode("ids").alias("id"))
    found = [
        ("no tab", output.where("broken").select("s1_id")),
        ("duplicate row", sound.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s1_id")),
        ("repeated id", sound.where(F.size("ids") > F.size(F.array_distinct("ids"))).select("s1_id")),
        ("self match", each.where(F.col("id").startswith("S1-")).select("s1_id")),
        ("wrong prefix", each.where(~F.col("id").rlike("^S[123]-")).select("s1_id")),
        ("missing row", required.select("s1_id").distinct().join(sound, "s1_id", "left_anti")),
        ("extra row", sound.select("s1_id").distinct().join(required, "s1_id", "left_anti")),
    ]
    if known is not None:
        found.append(("unknown id", each.where(F.col("id").rlike("^S[23]-")).select("id").distinct().join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").select(F.col("id").alias("s1_id"))))
    if candidates is not None:
        found.append(("not among candidates", each.select("s1_id", F.col("id").alias("cand_id")).join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").select("s1_id").distinct()))
    out = None
    for rule, offenders in found:
        part = offenders.select(F.lit(rule).alias("rule"), F.col("s1_id").alias("offender"))
        out = part if out is None else out.unionAll(part)
    levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    counts = out.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    # a rule's first offenders are found before the shuffle (window group limit), however many it has
    first = out.distinct().withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("offender"))).where(F.col("r") <= EXAMPLES)
    examples = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("offender")), ",").alias("examples"))
    return counts.join(examples, "rule").select("rule", F.element_at(levels, F.col("rule")).alias("level"), "n", "examples")


def row_counts(output: DataFrame) -> DataFrame:
    """One row: rows, empty and non-empty lists, share with a match."""
    return output.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("ids") == 0).alias("n_empty"), F.count_if(F.size("ids") > 0).alias("n_matched"),
        (F.avg((F.size("ids") > 0).cast("double")) * 100).alias("matched_percent"),
    )
