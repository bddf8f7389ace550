"""The file checker from end to end."""

from tarn.validate import main, validate


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_files_are_judged(spark, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry"
    for i, ids in ((1, ["S1-1", "S1-2"]), (2, ["S2-1"]), (3, ["S3-1"])):
        write(tmp_path / f"test_source{i}.tsv", head, *[f"{x}\ta\tb\tc" for x in ids])
    good = write(tmp_path / "m.tsv", "source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1", "S1-2\t")
    cand = write(tmp_path / "c.tsv", "source1_entity_id\tcandidate_entity_ids", "S1-1\tS2-1,S3-1", "S1-2\t")
    assert validate(spark, good, str(tmp_path), cand, True) == ([], [])
    assert main(["-m", good, "-t", str(tmp_path)]) == 0
    bad = write(tmp_path / "b.tsv", "source1_entity_id\tmatched_entity_ids", "S1-1\tS2-9,S2-9", "S1-1\t", "oops")
    errors, warnings = validate(spark, bad, str(tmp_path), cand, True)
    assert {e.split(": ", 1)[1] for e in errors} == {"duplicate row: 1", "missing row: 1", "no tab: 1", "repeated id: 1", "unknown id: 1"}
    assert warnings == ["matches: not among candidates: 1"] and main(["-m", bad, "-t", str(tmp_path)]) == 1
    comma = write(tmp_path / "k.csv", "source1_entity_id,matched_entity_ids", "S1-1,S2-1")
    assert validate(spark, comma, str(tmp_path))[0] == ["matches: comma-separated"]
    assert validate(spark, str(tmp_path / "none.tsv"), str(tmp_path))[0][0].startswith("matches: no file")
    (tmp_path / "latin.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xe9\n")
    assert validate(spark, str(tmp_path / "latin.tsv"), str(tmp_path))[0] == ["matches: not UTF-8"]


def test_only_the_first_line_is_the_header(spark):
    from tarn.validate import _rows

    header = "source1_entity_id\tmatched_entity_ids"
    lines = spark.createDataFrame([(header,), ("S1-1\tS2-1",), (header,), (header,)], "value string")
    assert sorted(r["s1_id"] for r in _rows(lines, header).collect()) == ["S1-1", "source1_entity_id", "source1_entity_id"]
