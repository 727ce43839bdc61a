import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rankmill.operators.lines import count_by_file, drop_boilerplate, with_url
from rankmill.sources import lines as source, sniff, tables
from rankmill.sources.records import join_quoted_lines

NAMES = ["Grundskola - Antal 2024 åk.csv", "a+b 50%.csv"]


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "raw"
    path.mkdir()
    (path / NAMES[0]).write_bytes("﻿Kommun;Kod\r\nAle;1440\r\r\n \nÖrebro;1880".encode())
    (path / NAMES[1]).write_bytes(b"x;\xff1\n\n   \nhttps://x.se/a;2\n")
    (path / "skip.txt").write_text("no")
    return str(path)


def test_raw_lines(spark, folder):
    got = sorted(tuple(r) for r in source.read_raw_lines(spark, folder).collect())
    assert got == sorted([
        ("Kommun;Kod", NAMES[0]), ("Ale;1440", NAMES[0]), ("Örebro;1880", NAMES[0]),
        ("x;�1", NAMES[1]), ("https://x.se/a;2", NAMES[1]),
    ])


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        source.read_raw_lines(spark, str(tmp_path / "none")).collect()


def test_loads(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    lines = source.read_raw_lines(spark, folder)
    for load in ("1700000000.1", "1700000000.2"):
        source.append_load(lines, store, load)
    loads = source.read_loads(spark, store)
    assert loads.count() == 10
    lazy = source.latest_load(loads)
    assert {r.load_id for r in lazy.collect()} == {"1700000000.2"} and lazy.count() == 5
    eager = source.read_latest_load(spark, store)
    assert eager.count() == 5
    assert set(eager.columns) == set(loads.columns) and {r.load_id for r in eager.collect()} == {"1700000000.2"}
    assert all("load_id=1700000000.2" in f for f in eager.inputFiles()) and eager.inputFiles()


def test_a_load_is_seen_whole_or_not_at_all(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    lines = source.read_raw_lines(spark, folder)
    assert source.append_load(lines, store, "1")
    wrong = F.when(F.col("raw_line").startswith("Ale"), F.raise_error("lost").cast("string")).otherwise(F.col("raw_line"))
    with pytest.raises(Exception, match="lost"):  # some tasks of the write fail
        source.append_load(lines.withColumn("raw_line", wrong).repartition(5), store, "2")
    # a driver lost between write and commit leaves whole files behind
    lines.withColumns({"load_id": F.lit("2"), "attempt": F.lit("lost")}).write.mode("append").partitionBy("load_id", "attempt").parquet(store)
    assert {r.load_id for r in source.read_latest_load(spark, store).collect()} == {"1"}
    assert source.read_loads(spark, store).count() == 5
    assert source.append_load(lines, store, "2")
    assert not source.append_load(lines, store, "2")  # again: nothing happens
    assert not source.append_load(lines, store, "1")
    assert source.read_latest_load(spark, store).count() == 5 and source.read_loads(spark, store).count() == 10
    assert list(source.committed_loads(spark, store)) == ["1", "2"]
    assert source.append_load(lines.filter("false"), store, "3")
    assert source.read_latest_load(spark, store).count() == 0


def test_load_ids_with_signs(spark, folder, tmp_path):
    store, ids = str(tmp_path / "store"), ["2024-01-01 09:30", "2024-01-01 10:00", "2024-01-01 10:00 'b'"]
    lines = source.read_raw_lines(spark, folder)
    for load in ids:
        source.append_load(lines, store, load)
        lines.withColumn("load_id", F.lit(load)).write.mode("append").partitionBy("load_id").saveAsTable("dated_loads")
    assert list(source.load_folders(spark, store)) == ids
    assert {r.load_id for r in source.read_latest_load(spark, store).collect()} == {ids[-1]}
    assert source.drop_older_loads(spark, "dated_loads") == 2
    assert {r.load_id for r in spark.table("dated_loads").collect()} == {ids[-1]}
    spark.sql("drop table dated_loads")
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no load"):
        source.read_latest_load(spark, str(tmp_path / "none"))


def test_drop_older_loads(spark, folder):
    lines = source.read_raw_lines(spark, folder)
    for load in ("a", "b", "c"):
        lines.withColumn("load_id", F.lit(load)).write.mode("append").partitionBy("load_id").saveAsTable("raw_loads")
    assert source.drop_older_loads(spark, "raw_loads") == 2
    assert [r.load_id for r in spark.table("raw_loads").select("load_id").distinct().collect()] == ["c"]
    assert source.drop_older_loads(spark, "raw_loads") == 0
    spark.sql("drop table raw_loads")


def test_line_operators(spark, folder):
    lines = source.read_raw_lines(spark, folder)
    assert [tuple(r) for r in count_by_file(lines).collect()] == [(NAMES[0], 3), (NAMES[1], 2)]
    assert [r.source_file for r in count_by_file(lines, ["%å%"]).collect()] == [NAMES[0]]
    assert drop_boilerplate(lines, ["Kommun;%"]).count() == 4
    assert {r.url_value for r in with_url(lines).collect()} == {None, "https://x.se/a"}


TABLE = "Statistik\nValt år, 2024\nNamn;Värde;Värde;\nA;1,5;\"x;y\"\nB;2\n\nC;\"a \"\"b\"\"\";4;5\n"


@pytest.fixture
def unknown(tmp_path):
    path = tmp_path / "unknown"
    path.mkdir()
    (path / "one.csv").write_text(TABLE, encoding="utf-8-sig")
    (path / "two.csv").write_bytes("a|b\n€|å\n".encode("cp1252"))
    (path / "bad.csv").write_bytes(b"a,b\n1,2\n" + b"x\x81\xff,3\n" * 70 + b"1,2,3\n")
    return str(path)


def test_sniff_files(spark, unknown):
    lines = sniff.read_numbered_lines(spark, unknown)
    got = {r.source_file: (r.sep, r.start, r.n_seps, r.header) for r in sniff.sniff(lines).collect()}
    assert got == {
        "one.csv": (";", 2, 3, "Namn;Värde;Värde;"), "two.csv": ("|", 0, 1, "a|b"), "bad.csv": (",", 0, 1, "a,b"),
    }
    encodings = {r.source_file: r.encoding for r in lines.select("source_file", "encoding").distinct().collect()}
    assert encodings == {"one.csv": "utf-8-sig", "two.csv": "cp1252", "bad.csv": "utf-8(replace)"}
    assert lines.filter("raw_line = '€|å'").count() == 1
    status = {r.source_file: (r.status, r.reason, r.n_rows) for r in sniff.load_status(lines).collect()}
    assert status == {"one.csv": ("ok", None, 3), "two.csv": ("ok", None, 1), "bad.csv": ("failed", "too_many_fields", 72)}
    counts = {r.status: r.n_files for r in sniff.status_counts(sniff.load_status(lines)).collect()}
    assert counts == {"ok": 2, "failed": 1}


def test_every_cp1252_byte(spark):
    data = bytes(b for b in range(1, 256) if bytes([b]).decode("cp1252", "ignore"))
    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(sniff.decode_cp1252(F.col("b"))).first()[0]
    assert got == data.decode("cp1252")


def test_read_sniffed(spark, unknown):
    df = sniff.read_sniffed(spark, unknown, "one.csv")
    assert df.columns == ["Namn", "Värde", "Värde.1", "Unnamed: 3"]
    assert [tuple(r) for r in df.collect()] == [("A", "1,5", "x;y", None), ("B", "2", None, None), ("C", 'a "b"', "4", "5")]
    with pytest.raises(ValueError, match="layout"):
        sniff.read_sniffed(spark, unknown)


def test_many_blocks(spark, tmp_path):
    """A file cut into many splits still has one header, its first widest line."""
    path = tmp_path / "big"
    path.mkdir()
    (path / "big.csv").write_text("intro\nid;v\n" + "".join(f"{i};{i * 2}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = sniff.read_sniffed(spark, str(path))
        assert df.columns == ["id", "v"]
        assert df.select(F.count("*"), F.sum(F.col("id").cast("int"))).first()[:] == (20_000, sum(range(20_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_status_of_files_without_text(spark, tmp_path):
    path = tmp_path / "some"
    path.mkdir()
    (path / "ok.csv").write_text("a;b\n1;2\n")
    (path / "empty.csv").write_text("")
    (path / "blank.csv").write_text("\n  \n")
    lines, files = sniff.read_numbered_lines(spark, str(path)), sniff.list_files(spark, str(path))
    got = {r.source_file: (r.status, r.reason, r.n_rows) for r in sniff.load_status(lines, files).collect()}
    assert got == {"ok.csv": ("ok", None, 1), "empty.csv": ("failed", "empty", 0), "blank.csv": ("failed", "empty", 0)}


def test_tables(spark, rows):
    spark.range(5).withColumn("Mart", F.lit("x")).write.mode("overwrite").saveAsTable("mart_demo")
    spark.range(3).createOrReplaceTempView("demo_view")
    assert tables.load_table(spark, "mart_demo", 2).count() == 2
    assert tables.load_table(spark, "mart_demo", 0).count() == tables.load_table(spark, "mart_demo").count() == 5
    assert tables.query(spark, "select * from mart_demo where id > :least", {"least": 2}).count() == 2
    assert tables.query(spark, "select * from {df}", df=spark.range(2)).count() == 2
    assert [r.name for r in tables.table_info(spark, "mart_demo").collect()] == ["id", "Mart"]
    listed = tables.list_tables(spark)
    assert ("default", "mart_demo") in [tuple(r) for r in tables.tables_like(listed, "MART").collect()]
    assert [tuple(r) for r in listed.filter("name = 'demo_view'").collect()] == [("", "demo_view")]
    assert {r.schema: r.n for r in tables.count_by_schema(listed).collect()}["default"] >= 1
    kept = tables.save(spark.range(4), "mart_kept")
    assert kept.count() == 4 and tables.save(spark.range(6), "view_kept", as_view=True).count() == 6
    for t in ("mart_demo", "mart_kept"):
        spark.sql(f"drop table {t}")


def quoted_files(path):
    """Files with line ends in quoted fields, one of them many blocks long."""
    rng = random.Random(4)
    rows = [("id", "text", "n")]
    for i in range(3000):
        signs = 'ab" ' if i < 100 else 'ab;," '  # the line with most separators among the first is taken for the header
        body = "\n".join("".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(rng.choice([1, 1, 1, 2, 5])))
        rows.append((str(i), body, str(i * 2)))
    rows.append(("end", "\n" * 900 + "x", "0"))  # one record over several blocks
    with open(path / "long.csv", "w", newline="") as out:
        csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    (path / "plain.csv").write_text("id;text;n\n" + "".join(f"{i};t{i};1\n" for i in range(500)))
    (path / "odd.csv").write_text('id;text;n\n1;5" pipe;2\n2;x;3\n')
    return rows


@pytest.mark.parametrize("block", ["700", "10m"])
def test_quoted_line_ends_over_block_borders(spark, tmp_path, block):
    rows = quoted_files(tmp_path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = sniff.read_numbered_lines(spark, str(tmp_path))
        if block == "700":
            assert lines.filter("source_file = 'long.csv'").select("at.block").distinct().count() > 50
        found = join_quoted_lines(lines).orderBy("source_file", "at").collect()
        table = sniff.read_sniffed(spark, str(tmp_path), "long.csv").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    text = lambda name: [r.raw_line for r in found if r.source_file == name]
    assert [next(csv.reader(io.StringIO(r, newline=""), delimiter=";")) for r in text("long.csv")] == [list(r) for r in rows]
    assert text("plain.csv") == (tmp_path / "plain.csv").read_text().splitlines()
    assert text("odd.csv") == (tmp_path / "odd.csv").read_text().splitlines()
    assert sorted(tuple(r) for r in table) == sorted(tuple(x or None for x in r) for r in rows[1:])
