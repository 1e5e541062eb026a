import os

import pytest
from pyspark.sql import functions as F

from weftgrid.sources import inventory, readers, sinks
from weftgrid.sources.names import clean_names


def test_clean_names():
    assert clean_names(["A b", "a-b", "x.y", "??", "é!", "ab"]) == ["ab", "ab_2", "xy", "col_3", "é", "ab_3"]


def test_json(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"Name": "a", "Age": 1},\n{"Name": "b"},\n')
    (tmp_path / "array.json").write_text('[{"Name": "a", "Age": 1}, {"Name": "b", "Age": ""}]')
    for name in ("lines", "array"):
        df = readers.load_source(spark, {"format": "json", "source": str(tmp_path / f"{name}.json")})
        assert sorted(df.columns) == ["age", "name"] and df.count() == 2
        assert sorted(str(r["age"]) for r in df.collect())[0] in ("", "1")


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("First Name,n\nx,1\n\"y, z\",2\n")
    df = readers.load_source(spark, {"format": "csv", "path": str(tmp_path / "t.csv"), "source": "http://nowhere/t.csv"})
    assert df.dtypes == [("firstname", "string"), ("n", "int")]
    assert [r["firstname"] for r in df.orderBy("n").collect()] == ["x", "y, z"]


def test_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<feed><doc><title>A</title><links><l>1</l><l>2</l></links></doc><doc><title>B</title></doc></feed>")
    df = readers.load_source(spark, {"format": "xml", "source": str(tmp_path / "t.xml")})
    assert {r["title"]: r["links"] and list(r["links"]["l"]) for r in df.collect()} == {"A": [1, 2], "B": None}


def test_a_file_per_name_in_a_folder_per_task(spark, tmp_path):
    from weftgrid.sources.textfiles import write_text_files
    rows = [(i, f"<b>{i}</b> ä\n") for i in range(40)] + [(40, None), (41, "a"), (41, "b"), ("x/y", "")]
    df = spark.createDataFrame([(str(k), t) for k, t in rows], "k string, t string").coalesce(2)
    path = write_text_files(df, F.col("k"), F.col("t"), f"{tmp_path}/pages", ".html")
    read = {r["file"].rpartition("/")[2]: r["text"] for r in readers.read_texts(spark, f"{path}/*").collect()}
    expected = {f"{i}.html": f"<b>{i}</b> ä\n\n" for i in range(40)} | {"40.html": "\n", "41.html": "a\nb\n"}
    assert {k: v for k, v in read.items() if "y" not in k} == expected and len(read) == 43
    assert all(f.startswith("part-") for f in os.listdir(path)) and len(os.listdir(path)) <= 2
    with pytest.raises(Exception, match="a file needs a name"):
        write_text_files(spark.createDataFrame([(None, "a")], "k string, t string"), F.col("k"), F.col("t"), f"{tmp_path}/none")
    assert not os.path.exists(tmp_path / "none") or not os.listdir(tmp_path / "none")


def test_page_files_lie_in_a_folder_per_task(spark, tmp_path):
    from weftgrid.catalog import texts
    from weftgrid.session import written_folders
    spark.range(300).selectExpr("id AS page_id", "concat('<p>', id, '</p>&amp;') AS html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in texts.html_files(spark, str(tmp_path)).collect()}
    assert found == {i: f"{i}\n" for i in range(300)}
    folder = [f for f in written_folders(spark) if "/pages-" in f][-1]
    assert len(os.listdir(folder.removeprefix("file://"))) == 1


def test_html_and_text_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x &lt; y</p>\n<i>z</i>")
    page = readers.load_source(spark, {"format": "html", "source": str(tmp_path / "a.html")}).first()
    assert page["file"].endswith("a.html") and page["text"] == "x  y\nz"
    (tmp_path / "b.txt").write_text("one\ntwo")
    whole = readers.load_source(spark, {"format": "text", "source": str(tmp_path / "b.txt")})
    assert whole.columns == ["file", "text"] and whole.first()["text"] == "one\ntwo"
    assert readers.read_lines(spark, str(tmp_path / "b.txt")).count() == 2


def test_typed_fields(spark, rows):
    lines = spark.createDataFrame([("1,ann,5",), ("x,bob",)], "value string")
    df = readers.typed_fields(lines, {"id": "int", "name": "string", "code": "int"})
    assert rows(df) == [(1, "ann", 5), (None, "bob", None)]


def test_jdbc_options():
    found = readers.jdbc_options("MySQL", "h", 3306, "d", "t", "u", "p", partitionColumn="id", numPartitions=8)
    assert found == {"url": "jdbc:mysql://h:3306/d", "dbtable": "t", "user": "u", "password": "p",
                     "driver": "com.mysql.cj.jdbc.Driver", "partitionColumn": "id", "numPartitions": "8"}
    assert "driver" not in readers.jdbc_options("other", "h", 1, "d", "t", "u", "p")


def test_frames_at_hand(spark):
    assert readers.rows_frame(spark, [(1, "juls")], "id int, name string").count() == 1
    assert readers.empty_frame(spark).columns == []


def sized(size):
    units, k = ["B", "KB", "MB", "GB", "TB", "PB", ""], 0
    while size >= 1024:
        size, k = size // 1024, k + 1
    return (1, units[k + 1]) if size > 1000 else (size, units[k])


def test_readable_size(spark):
    sizes = [0, 1, 1000, 1001, 1023, 1024, 1 << 20, (1 << 20) - 1, 5 << 30, 1000 << 20, 1001 << 20, 7 << 40, 3 << 50, 1 << 60]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    measure, unit = inventory.readable_size(F.col("s"))
    assert [tuple(r) for r in df.select(measure, unit).collect()] == [sized(s) for s in sizes]


def test_inventory(spark, tmp_path):
    for name in ("b.CSV", "A.txt", "c.json", "d.exe", "noext", "sub/e.xml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * 2048)
    found = inventory.source_inventory(spark, str(tmp_path)).collect()
    assert [(r["format"], r["name"], r["measure"], r["unit"]) for r in found] == [
        ("json", "c.json", 2, "KB"), ("text", "A.txt", 2, "KB"), ("xml", "e.xml", 2, "KB")]


def test_transfer(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a b,n\nx,1\n")
    moved = sinks.transfer(spark, {"format": "csv", "source": str(tmp_path / "t.csv"), "name": "t"}, str(tmp_path / "out"))
    assert moved["name"] == "t" and readers.load_source(spark, moved).columns == ["ab", "n"]


def test_pivot_export(spark, tmp_path):
    df = spark.createDataFrame([("r1", "a", "x"), ("r1", "b", "x"), ("r2", "b", "y")], "r string, c string, d string")
    path = sinks.write_pivot_tsv(df, str(tmp_path / "tsv"), ["r"], ["c", "d"])
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert lines[0] == "r\ta-x\tb-x\tb-y" and "r1\t1\t1\t" in lines and "r2\t\t\t1" in lines


def test_json_records(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "n int, s string")
    assert sorted(r[0] for r in sinks.json_records(df).collect()) == ['{"n":1,"s":null}', '{"n":2,"s":"b"}']
    assert sinks.json_records(df, 1).count() == 1


def test_a_cluster_without_shared_folder_is_an_error(monkeypatch):
    from weftgrid import session

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)
        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster(), "x")


def test_tables_are_cut_by_their_key():
    assert readers.key_ranges("id", 1, 100, 4) == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "101", "numPartitions": "4"}
    assert readers.key_ranges("id", 7, 8.5, 32)["numPartitions"] == "3"
    assert readers.key_ranges("id", None, None, 4) == {}
    assert readers.key_range_query("s.t", "id") == "(SELECT min(id) AS low, max(id) AS high FROM s.t) key_range"
