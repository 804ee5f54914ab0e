from pathlib import Path

import pytest

from assayer.sources import read_with_rejects

COLUMNS = {"id": "integer", "name": "string", "amount": "continuous"}


def write(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_bad_lines_are_kept_with_their_place(spark, tmp_path):
    path = write(tmp_path / "in", a='id,name,amount\n1,x,1.5\n2,y\n\n3,"p,q",2\n4,z,3,extra\nfive,v,1\n6,,\n', b='id,name,amount\n7,w,n/a\n8,"say ""hi, you""",4\n')
    good, bad = read_with_rejects(spark, path, COLUMNS)
    assert {tuple(r) for r in good.collect()} == {(1, "x", 1.5), (3, "p,q", 2.0), (6, None, None), (8, 'say "hi, you"', 4.0)}
    assert {(Path(r.file).name, r.record, r.line, r.reason) for r in bad.collect()} == {
        ("a.csv", 2, "2,y", "fields"), ("a.csv", 4, "4,z,3,extra", "fields"), ("a.csv", 5, "five,v,1", "type"), ("b.csv", 1, "7,w,n/a", "type")}
    assert good.schema.names == list(COLUMNS) and good.select("name").where("name is null").count() == 1


def test_places_hold_when_a_file_is_read_in_splits(spark, tmp_path):
    lines = [f"{i},{'n' * (i % 40)},{i}.5" if i % 7 else f"{i}|bad" for i in range(1, 3001)]
    path = write(tmp_path / "in", big="id,name,amount\n" + "\n".join(lines) + "\n", small="id,name,amount\n1,a,x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        good, bad = read_with_rejects(spark, path, COLUMNS)
        rows = {(Path(r.file).name, r.record): r.line for r in bad.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {**{("big.csv", i): f"{i}|bad" for i in range(7, 3001, 7)}, ("small.csv", 1): "1,a,x"} and good.count() == 3000 - len(rows) + 1


def test_files_without_lines_and_no_files(spark, tmp_path):
    good, bad = read_with_rejects(spark, write(tmp_path / "in", a="id,name,amount\n"), COLUMNS)
    assert good.count() == 0 and bad.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_with_rejects(spark, f"{tmp_path}/none", COLUMNS)
    good, bad = read_with_rejects(spark, write(tmp_path / "pipe", a="1|a|2\n2|b\n"), COLUMNS, sep="|", header=False)
    assert [tuple(r) for r in good.collect()] == [(1, "a", 2.0)] and [(r.line, r.reason) for r in bad.collect()] == [("2|b", "fields")]
