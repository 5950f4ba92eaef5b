"""The same behaviour of a repository over both stores."""

import pytest
from pyspark.sql import functions as F

from furrow.sources.repository import FileStore, Repository, VolatileStore

SHAPE = "id long, user_id long, name string, meta string"


@pytest.fixture(params=["volatile", "files"])
def store(request, spark, tmp_path):
    return VolatileStore(spark) if request.param == "volatile" else FileStore(spark, f"file:{tmp_path}/tables")


def made(spark, store, user=None):
    r = Repository(store, {"fields": "id"}, user)
    r.insert("fields", spark.createDataFrame([(1, 7, "north", '{"a": "x"}'), (2, 8, "south", None), (3, 7, "east", "broken")], SHAPE))
    return r


def test_reads_and_writes(spark, store):
    r = made(spark, store)
    assert store.names() == ["fields"] and r.rows("fields").count() == 3
    assert [x.name for x in r.row("fields", 2).collect()] == ["south"] and r.row("fields", 9).count() == 0
    new = r.insert("fields", spark.createDataFrame([(4, "odd", 5)], "id long, name string, extra int"))
    assert new.columns == ["id", "name"] and [tuple(x) for x in r.row("fields", 4).collect()] == [(4, None, "odd", None)]
    for again in ([(4, 1, "x", None)], [(5, 1, "x", None), (5, 1, "y", None)]):
        with pytest.raises(ValueError):
            r.insert("fields", spark.createDataFrame(again, SHAPE))
    assert {(x.id, x.name) for x in r.update("fields", {"name": F.upper("name")}, F.col("id") < 3).collect()} == {(1, "NORTH"), (2, "SOUTH")}
    r.delete("fields", F.col("name") == "odd")
    assert sorted(x.name for x in r.rows("fields").collect()) == ["NORTH", "SOUTH", "east"]
    r.set_json_key("fields", 1, "meta", "b", F.lit("y"))
    r.set_json_key("fields", 2, "meta", "b", F.lit("z"))
    assert {x.id: x.meta for x in r.rows("fields").collect()} == {1: '{"a":"x","b":"y"}', 2: '{"b":"z"}', 3: "broken"}
    for call in (lambda: r.rows("none"), lambda: r.update("none", {}, F.lit(True)), lambda: r.delete("none", F.lit(True))):
        with pytest.raises(KeyError):
            call()


def test_rows_of_others_are_out_of_reach(spark, store):
    made(spark, store)
    mine = Repository(store, {"fields": "id"}, 7)
    assert {x.id for x in mine.rows("fields").collect()} == {1, 3}
    mine.update("fields", {"name": F.lit("mine")}, F.lit(True))
    mine.delete("fields", F.col("id") <= 2)
    assert {(x.id, x.name) for x in Repository(store, {"fields": "id"}).rows("fields").collect()} == {(2, "south"), (3, "mine")}


def test_a_write_that_fails_leaves_the_old_rows(spark, store):
    r = made(spark, store)
    with pytest.raises(Exception, match="lost"):
        r.update("fields", {"name": F.raise_error(F.lit("lost")).cast("string")}, F.col("id") == 1)
    assert sorted(x.name for x in r.rows("fields").collect()) == ["east", "north", "south"]
    for i in range(4):
        r.update("fields", {"name": F.concat("name", F.lit(str(i)))}, F.col("id") == 1)
    assert r.row("fields", 1).first().name == "north0123"
