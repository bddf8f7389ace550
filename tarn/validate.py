"""Checks output files: python -m tarn.validate -m MATCHES [-c CANDIDATES] -t FOLDER [--check-ids] [--prefix test].

Prints a line for each rule with offenders and the counts; exit code 1 when an error was found, else 0.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import quality as Q
from tarn.sources import tsv


def _rows(lines: DataFrame, first: str) -> DataFrame:
    """The lines but the header; a line equal to it further down is an offender like any other."""
    return Q.parse_lines(lines.where(F.col("value") != first).union(lines.where(F.col("value") == first).offset(1)))


def validate(spark: SparkSession, matches: str, folder: str, candidates: str | None = None, check_ids: bool = False, prefix: str = "test") -> tuple[list[str], list[str]]:
    """(errors, warnings) of a match file against the sources in a folder."""
    errors, warnings, parsed = [], [], {}
    for kind, path in (("matches", matches), ("candidates", candidates)):
        if path is None:
            warnings.append("candidates: no file given")
            continue
        try:
            tsv.first_existing(spark, path)
        except FileNotFoundError:
            (errors if kind == "matches" else warnings).append(f"{kind}: no file {path}")
            continue
        lines = tsv.read_lines(spark, path)
        first = lines.first()
        if problem := Q.header_problem(first and first[0], kind):
            errors.append(f"{kind}: {problem}")
            continue
        if not lines.where(~F.is_valid_utf8("value")).isEmpty():
            errors.append(f"{kind}: not UTF-8")
            continue
        parsed[kind] = _rows(lines, first[0])
    required = tsv.read_tsv(spark, f"{folder}/{prefix}_source1.tsv", columns=["entity_id"]).withColumnRenamed("entity_id", "s1_id")
    known = None
    if check_ids:
        try:
            paths = [tsv.first_existing(spark, f"{folder}/{prefix}_source{i}.tsv") for i in (2, 3)]
            known = tsv.read_tsv(spark, paths[0], columns=["entity_id"]).union(tsv.read_tsv(spark, paths[1], columns=["entity_id"]))
        except FileNotFoundError as e:
            warnings.append(f"ids are not checked: no file among {e}")
    pairs = parsed["candidates"].select("s1_id", F.explode("ids").alias("cand_id")) if "candidates" in parsed else None
    for kind, rows in parsed.items():
        report = Q.quality_report(rows, required, known, pairs if kind == "matches" else None)
        for r in report.orderBy("rule").collect():
            (errors if r["level"] == "error" else warnings).append(f"{kind}: {r['rule']}: {r['n']}")
        counts = Q.row_counts(rows).first()
        print(f"{kind}: {counts['n_rows']} rows, {counts['n_empty']} empty, {counts['n_matched']} with ids")
    return errors, warnings


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-m", "--matches", required=True)
    p.add_argument("-c", "--candidates")
    p.add_argument("-t", "--test-dir", required=True)
    p.add_argument("--check-ids", action="store_true")
    p.add_argument("--prefix", default="test")
    a = p.parse_args(args)
    errors, warnings = validate(SparkSession.builder.getOrCreate(), a.matches, a.test_dir, a.candidates, a.check_ids, a.prefix)
    for kind, found in (("ERROR", errors), ("WARNING", warnings)):
        for x in found:
            print(f"{kind} {x}")
    return int(bool(errors))


if __name__ == "__main__":
    raise SystemExit(main())
