import random

import pytest

from reviewsift.sources import csv_records
from reviewsift.sources.csv_records import CSV_OPTIONS, ends_inside, read_csv


def both(spark, path, split=64):
    """Rows of the splitting reader, in many small ranges, and of the multi-line reader."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "4")
    try:
        got = read_csv(spark, path)
        ranges = csv_records._lines(spark, path, None).select("file", "start").distinct().count()
        rows = sorted(map(tuple, got.drop("_file").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    want = sorted(map(tuple, spark.read.options(**CSV_OPTIONS).csv(path).collect()), key=str)
    return rows, want, ranges


def field(rng):
    kind = rng.random()
    words = ["a", "bc", "ếđ", "😀", " ", "x y", "1"]
    plain = "".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
    if kind < 0.4:
        return plain
    if kind < 0.5:
        return f"5{'\"' * rng.randint(1, 2)} {plain}"  # quotes inside an unquoted field are letters
    inner = "".join(rng.choice([*words, ",", "\n", "\n\n", '""', "\r\n"]) for _ in range(rng.randint(0, 12)))
    return f'"{inner}"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(2))
def test_equals_the_multi_line_reader(spark, tmp_path, end, seed):
    rng = random.Random(seed)
    lines = ["id,first,second"]
    for k in range(60):
        a, b = field(rng), field(rng)
        if end == "\n":
            a, b = a.replace("\r\n", "\n"), b.replace("\r\n", "\n")
        lines.append(f"{k},{a},{b}")
        if rng.random() < 0.1:
            lines.append("")
    path = tmp_path / "r.csv"
    path.write_bytes((end.join(lines) + end * (seed % 2)).encode())
    got, want, ranges = both(spark, str(path))
    assert ranges > 10 and len(want) == 60
    assert got == want


def test_records_and_headers_that_cross_ranges(spark, tmp_path):
    head = '"a\n' + "h" * 300 + '",b'
    body = "\n".join(f'{k},"{"line\n" * 60}{k}"' for k in range(5))
    (tmp_path / "one.csv").write_text(f"{head}\n{body}\n")
    (tmp_path / "two.csv").write_text(f"{head}\n9,last")
    got, want, ranges = both(spark, str(tmp_path), 50)
    assert ranges > 25 and len(want) == 6 and got == want


def test_small_and_broken_files(spark, tmp_path):
    for n, text in enumerate(["a,b\n", "a,b", "a,b\n1,2\n3\n4,5,6\n", 'a,b\n1,"open\nto the\nend', '\n\na,b\n\n1,2\n  \n', 'a,b\n"x" y,2\n"p""q"z,"r,s"t\n']):
        path = tmp_path / f"{n}.csv"
        path.write_text(text)
        got, want, _ = both(spark, str(path), 16)
        assert got == want, text


def test_state_behind_a_line():
    for line, record, quote in [
        ("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('"a""', True, False), ('x"y,"z', True, True),
        ('","', False, True), ('",x', True, False), ('"', True, False), ('"a"b"c,"d', True, True), ("", False, True),
    ]:
        assert ends_inside(line, False) is record, line
        assert ends_inside(line, True) is quote, line
