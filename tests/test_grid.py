from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from weftgrid import Grid
from weftgrid.plans.grid import list_views, sample, sample_exact


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann:x", "b"), (2, "Bob", None), (3, "Cy:y:z", "a"), (4, None, "a")],
                                 "id int, name string, team string")


def test_undo_redo_and_truncation(people):
    grid = Grid.load(people)
    edited = grid.rename("team", "group").drop("name").add_column("year", 2016)
    assert edited.history() == ["rename", "drop", "add_column"]
    assert edited.undo().undo().df.columns == ["id", "name", "group"]
    assert edited.undo().redo().df.columns == edited.df.columns == ["id", "group", "year"]
    assert edited.undo().undo().sort("id").redo().history() == ["rename", "sort"]
    assert grid.undo().df is grid.df and edited.redo().df is edited.df
    assert edited.reset().df.columns == people.columns and edited.reset().history() == []
    assert edited.clear().df.columns == []


def test_join_into_an_empty_grid(spark, people, rows):
    grid = Grid.empty(spark).join(people).join(spark.createDataFrame([("a", 9), ("z", 8)], "team string, n int"))
    assert grid.df.columns == ["id", "name", "team", "n"]
    assert grid.df.count() == 5
    assert grid.undo().df.count() == 4


def test_replay_on_other_data(people, rows):
    recipe = Grid.load(people.limit(1)).filter("id", ">", 1).split("name", 2, "begin", "char", ":").undo().redo()
    assert rows(recipe.replay(people).df) == sorted([(2, None, "Bob", None), (3, "a", "Cy", "y:z"), (4, "a", None, None)], key=repr)


def test_sql_over_the_grid(people, spark):
    grid = Grid.load(people)
    assert grid.sql().count() == 4
    assert grid.sql(n=2).count() == 2
    found = grid.sql("SELECT team, count(*) count FROM DataGrid WHERE team IS NOT NULL GROUP BY team HAVING count > :least", least=1)
    assert [tuple(r) for r in found.collect()] == [("a", 2)]
    assert "datagrid" in [v.lower() for v in list_views(spark)]


def test_sql_of_many_grids_at_once(spark):
    def ask(i):
        return Grid.load(spark.range(i + 1).toDF("id")).sql("SELECT count(*) AS n FROM DataGrid")

    with ThreadPoolExecutor(8) as pool:
        frames = list(pool.map(ask, range(24)))
    assert [f.first()["n"] for f in frames] == list(range(1, 25))


def test_errors_surface(people):
    with pytest.raises(Exception):
        Grid.load(people).sql("SELECT nothing FROM DataGrid").collect()


def test_samples(spark):
    df = spark.range(0, 20000, 1, 4)
    assert 800 < sample(df).count() < 1200
    assert sample(df.limit(10)).count() == 10
    assert sample(df.limit(0)).count() == 0
    exact = sample_exact(df, ["id"], 50)
    assert exact.count() == 50
    assert exact.exceptAll(sample_exact(df.repartition(7), ["id"], 50)).count() == 0


def test_preview_falls_back_to_the_result(spark):
    df = spark.range(0, 50000, 1, 4)
    rare = Grid.load(df).where("id < 300")
    assert rare.sampled_preview().count() == 300
    common = Grid.load(df).where("id >= 0")
    assert 800 < common.sampled_preview().count() < 1200
    assert common.preview().count() == 100


def test_cut_keeps_the_data(people, rows):
    cut = Grid.load(people).filter("id", ">", 1).cut()
    assert cut.history() == [] and rows(cut.df) == rows(people.where("id > 1"))


def test_profile_and_pivot(people):
    grid = Grid.load(people)
    assert grid.describe("id").first()["count"] == 4
    assert sum(r["n"] for r in grid.histogram("team").collect()) == 3
    assert grid.pivot(["team"], []).where("level = 'total'").first()["value"] == 4
    assert [r["name"] for r in grid.schema().collect()] == ["id", "name", "team"]


def test_wrangling_scenario(spark):
    pages = spark.createDataFrame([
        ("Wiki: Ada", "Ada wrote programs and programs", "l1"),
        ("Wiki: Bob", "Bob reads books and writes books", "l2"),
        ("Zine: Cy", None, "l3"),
        ("Wiki: Dee", "Dogs chase cats while cats chase mice", "l4"),
    ], "title string, abstract string, links string")
    grid = (
        Grid.load(pages).drop("links").filter("abstract", "is not null")
        .split("title", 2, "begin", "char", ":").rename("title1", "source").rename("title2", "title")
        .label("source").sort("title")
    )
    tokens = grid.tokenize("abstract").df
    assert tokens.columns == ["abstract", "source", "title", "source_label"]
    assert [r["title"] for r in tokens.collect()] == [" Ada", " Bob", " Dee"]
    assert tokens.first()["abstract"] == ["ada", "wrote", "programs", "and", "programs"]
    topics = grid.lda("abstract", k=5, iterations=5).df
    shares = [F.col(c) for c in topics.columns if c.startswith("topic__")]
    assert len(shares) == 5
    assert all(abs(r[0] - 1) < 1e-6 for r in topics.select(sum(shares)).collect())
    features = grid.tf_idf("abstract", 3).df
    assert sum(c.startswith("term_") for c in features.columns) == 3 and "abstract" in features.columns


def test_the_other_steps(people):
    grid = Grid.load(people).convert("team").index().apply("id", lambda c: c + 1).preprocess("name")
    assert [r["team"] for r in grid.df.orderBy("id").collect()] == ["b", "", "a", "a"]
    assert grid.df.select("GridID").distinct().count() == 4
    assert grid.word2vec("name").expand("name", 2).df.columns[-2:] == ["dim0", "dim1"]
    assert Grid.load(people).sentences("name").df.schema["name"].dataType.simpleString() == "array<string>"


def test_persist_and_save(people, tmp_path, spark):
    grid = Grid.load(people)
    assert grid.persist().storageLevel.useMemory
    people.unpersist()
    path = grid.save(str(tmp_path / "grid"))
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(Exception):
        grid.save(path)
    grid.save(path, overwrite=True)


def test_token_and_value_steps(spark, rows):
    df = spark.createDataFrame([(1, "The running 42 dogs", "a"), (2, "of it", "b"), (3, None, "c")], "i int, t string, k string")
    grid = Grid.load(df).tokenize("t").keep_alphabetic("t").keep_long("t").remove_stop_words("t").stem("t").exclude("k", ["b"]).keep("k", ["a", "b"])
    assert rows(grid.df) == [(1, ["run", "dog"], "a")]
    assert grid.history()[-2:] == ["exclude", "keep"]


def test_long_lists_are_kept_by_a_join(spark):
    df = spark.range(0, 3000).selectExpr("cast(id AS string) AS k")
    listed = [str(i) for i in range(1000, 4000)]
    assert Grid.load(df).keep("k", listed).df.count() == 2000
    assert Grid.load(df).keep("k", spark.createDataFrame([(x,) for x in listed], "v string")).df.count() == 2000


def test_results_come_back_whole(spark):
    grid = Grid.load(spark.range(0, 2500).toDF("i"))
    assert grid.sql("SELECT * FROM DataGrid").count() == 2500 and grid.sql(n=10).count() == 10


def test_stratified_sample(spark):
    from weftgrid.plans.grid import sample_strata
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id < 4000 THEN 'big' WHEN id < 4990 THEN 'mid' ELSE 'tiny' END AS s", "id AS _rank")
    one = sample_strata(df.coalesce(1), ["s"], ["id"], 30)
    rows = sorted(map(tuple, one.collect()), key=str)
    assert rows == sorted(map(tuple, sample_strata(df.repartition(9), ["s"], ["id"], 30).collect()), key=str)
    assert one.columns == ["id", "s", "_rank"]
    sizes = {r["s"]: r["count"] for r in one.groupBy("s").count().collect()}
    assert sizes == {None: 30, "big": 30, "mid": 30, "tiny": 10}
    plan = sample_strata(df, ["s"], ["id"], 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert sample_strata(df.limit(0), ["s"], ["id"], 30).count() == 0
