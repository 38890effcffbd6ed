import random

import pytest

from corelode.sources import quoted, readers


def written(at, name, rows, end="\n", bom=False, encoding="utf-8"):
    q = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n\r') else x
    text = "".join(",".join(q(x) for x in r) + end for r in rows)
    at.mkdir(exist_ok=True)
    (at / name).write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode(encoding))


def table(seed, n, breaks=True):
    rng = random.Random(seed)
    words = ["a", "b,c", 'say ""x', 'q"', "é", "", "line", "two words"] + (["x\ny", "\n\n", '"\n"', "end\n", "\nstart", "u\r\nv"] if breaks else [])
    return [["id", "note", "more"]] + [[f"r{seed}-{i}", "".join(rng.choices(words, k=rng.randint(0, 3))), rng.choice(words)] for i in range(n)]


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(df):
    return [tuple(r)[:-1] for r in sorted(df.collect(), key=lambda r: r["_row"])]


@pytest.mark.parametrize("size", [40, 97, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_the_reader_of_whole_files(spark, tmp_path, small_splits, size, end):
    """Splits of a few lines: records cross one border or many."""
    rows = table(1, 120)
    rows[60][1] = "long\n" * 60 + '"quoted"\n,' * 20
    written(tmp_path / "t", "a.csv", rows, end)
    small_splits(size)
    df = readers.read_text(spark, str(tmp_path / "t"), "utf-8", True)
    got = df.collect()
    assert sorted(r["_row"] for r in got) == list(range(120))
    whole = spark.read.csv(str(tmp_path / "t"), header=True, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="")
    strip = lambda x: (x or "").strip()
    want = [tuple(strip(x) for x in r) for r in whole.collect()]
    assert rows_of(df) == want
    assert [r[0] for r in want] == [r[0] for r in rows[1:]]
    if size == 40:
        assert quoted.lines(spark, str(tmp_path / "t")).rdd.getNumPartitions() > 20


def test_files_count_by_name_whatever_their_size(spark, tmp_path, small_splits):
    small_splits(1 << 20)
    for breaks in (True, False):
        at = tmp_path / f"t{breaks}"
        tables = {f"{n}.csv": table(i, size, breaks) for i, (n, size) in enumerate((("c", 3), ("a", 2), ("b", 200)))}
        for name, rows in tables.items():
            written(at, name, rows)
        got = rows_of(readers.read_text(spark, str(at)))
        assert [r[0] for r in got] == [r[0] for name in ("a.csv", "b.csv", "c.csv") for r in tables[name][1:]]
    spark.createDataFrame([(i,) for i in range(300)], "n int").repartitionByRange(4, "n").sortWithinPartitions("n").write.parquet(f"{tmp_path}/p.parquet")
    assert rows_of(readers.read_text(spark, f"{tmp_path}/p.parquet")) == [(str(i),) for i in range(300)]


def test_windows_blank_lines_and_open_quotes(spark, tmp_path, small_splits):
    small_splits(30)
    at = tmp_path / "w"
    at.mkdir()
    (at / "a.csv").write_bytes('id,nöte\r\n1,"a\r\n€"\r\n\r\n   \r\n2,"x\n\ny"\r\n3,"never closed\r\n4,z\r\n'.encode("cp1252"))
    df = readers.read_text(spark, str(at))
    assert df.columns == ["id", "nöte", "_row"]
    assert rows_of(df) == [("1", "a\n€"), ("2", "x\n\ny"), ("3", "never closed\n4,z")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.csv").write_text('a,b\n')
    assert readers.read_text(spark, str(tmp_path / "e"), "utf-8", True).collect() == []


def test_states_of_splits():
    s = [{"file": "f", "block": b, "odd": o, "outside": n, "inside": m, "crlf": False} for b, o, n, m in ((20, True, 2, 1), (0, True, 3, 1), (10, False, 0, 4), (30, False, 5, 9))]
    assert quoted._starts(s) == {("f", 0): (False, 0, True, False), ("f", 10): (True, 2, False, False), ("f", 20): (True, 6, False, False), ("f", 30): (False, 7, False, False)}
