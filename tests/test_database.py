import pytest

from tarnql.functions.types import Schema
from tarnql.sources.database import Database
from tarnql.sources.files import read_pipe_text
from tarnql.sources.workload import run_workload

FIELDS = [("id", "int"), ("name", "char(5)"), ("pay", "double"), ("born", "date")]
ROWS = [(i, f"name{i:04d}", 100.0 * i, 19900101 + i % 28) for i in range(10)]


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_relation("e", FIELDS)
    db.insert("e", ROWS)
    return db


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_catalog_survives(spark, db):
    again = Database(spark, db.folder)
    assert again.relations() == ["e"] and again.has_relation("e") and again.relation_schema("e").schema() == FIELDS
    assert again.relation_schema("none") is None
    first = again.df("e").orderBy("id").first()
    assert first["name"] == "name0" and str(first["born"]) == "1990-01-01"
    with pytest.raises(ValueError):
        again.create_relation("e", FIELDS)
    again.remove_relation("e", detach=True)
    assert not again.has_relation("e")
    again.attach_files("e", FIELDS)
    assert len(ids(again.df("e"))) == 10
    again.remove_relation("e")
    with pytest.raises(ValueError):
        again.remove_relation("e")
    with pytest.raises(ValueError):
        again.attach_files("e", FIELDS)


def test_rows_are_checked(db):
    with pytest.raises(Exception):
        db.insert("e", [(2**40, "x", 1.0, 19900101)])
    with pytest.raises(Exception):
        db.insert("e", [(None, "x", 1.0, 19900101)])
    assert len(ids(db.df("e"))) == 10


def test_changes(db):
    db.delete_where("e", "id >= 8")
    db.update_where("e", "born == 19900103", {"pay": "pay * 2", "name": "name + '!'"})
    got = {r["id"]: r for r in db.df("e").collect()}
    assert sorted(got) == list(range(8)) and got[2]["pay"] == 400.0 and got[2]["name"] == "name0" and got[3]["pay"] == 300.0
    size, files, count = db.relation_stats("e")
    assert size > 0 and files >= 1 and count == 8


def test_indexes(db):
    key = db.create_index("e", ["id"], primary=True)
    pay = db.create_index("e", ["pay", "name"])
    for bad in (dict(key=["pay"], primary=True), dict(key=["id"]), dict(key=["nothing"])):
        with pytest.raises(ValueError):
            db.create_index("e", **bad)
    assert ids(db.lookup(key, 3)) == [3] and ids(db.lookup_by_key("e", 4)) == [4] and db.lookup("nothing", 1) is None
    assert ids(db.lookup(pay, 300.0, "name0")) == [3]
    assert db.match_index("e", Schema("k", [("id", "int")])) == key and db.match_index("e", Schema("k", [("id", "long")])) is None
    with pytest.raises(ValueError):
        db.insert("e", [(3, "again", 1.0, 19900101)])
    db.cluster(key, 2)
    assert [r["id"] for r in db.scan_by_index(key).collect()] == list(range(10))
    db.update_by_key("e", [3], {"pay": 1.0})
    db.delete_by_key("e", 4)
    db.delete_by_index(pay, 900.0, "name0")
    assert ids(db.df("e")) == [0, 1, 2, 3, 5, 6, 7, 8] and db.lookup(key, 3).first()["pay"] == 1.0
    db.remove_index(pay)
    assert not db.has_index(pay) and db.has_index(key)
    db.remove_relation("e")
    assert not db.has_index(key)


def test_tuple_ids(db):
    ids = {r["id"]: tuple(r["tuple_id"]) for r in db.with_tuple_ids("e").collect()}
    assert len(set(ids.values())) == 10
    db.delete_tuples("e", [ids[2], ids[3], ("no file", 0)])
    assert sorted(r["id"] for r in db.df("e").collect()) == [0, 1, 4, 5, 6, 7, 8, 9]
    ids = {r["id"]: tuple(r["tuple_id"]) for r in db.with_tuple_ids("e").collect()}
    db.update_tuples("e", [ids[4]], {"name": "other name", "pay": 7})
    got = {r["id"]: (r["name"], r["pay"]) for r in db.df("e").collect()}
    assert got[4] == ("other", 7.0) and got[5] == ("name0", 500.0)
    with pytest.raises(ValueError):
        db.update_tuples("e", [ids[4]], {"nothing": 1})


def test_catalogs_are_never_missing(spark, db):
    """Two versions are kept at most; a catalog that another session has changed is not overwritten; an unfinished one does not count."""
    import pathlib

    other = Database(spark, db.folder)
    db.create_relation("f", [("x", "int")])
    db.create_relation("g", [("x", "int")])
    assert len(list(pathlib.Path(db.folder).glob("catalog-*.json"))) == 2
    with pytest.raises(RuntimeError):
        other.create_relation("h", [("x", "int")])
    (pathlib.Path(db.folder) / "_catalog-unfinished").write_text("{")
    assert Database(spark, db.folder).relations() == ["e", "f", "g"]
    other.restore()
    other.create_relation("h", [("x", "int")])
    assert Database(spark, db.folder).relations() == ["e", "f", "g", "h"]


def test_keys_of_a_batch_are_checked(db):
    db.create_index("e", ["id"], primary=True)
    new = (30, "x", 1.0, 19900101)
    for bad in ([new, new], [new, (3, "y", 1.0, 19900101)]):
        with pytest.raises(ValueError):
            db.insert("e", bad)
    db.insert("e", [new])
    assert len(ids(db.df("e"))) == 11


def test_access_paths(db):
    assert len(list(db.tuples("e"))) == 10
    assert sum(b.num_rows for b in db.pages("e")) == 10
    assert sum(r["rows"] for r in db.headers("e").collect()) == 10
    db.cache("e")
    assert db.df("e").storageLevel.useMemory
    db.evict("e")
    assert not db.df("e").storageLevel.useMemory


def test_text_files(spark, db, tmp_path):
    (tmp_path / "rows.csv").write_bytes(b"1|first|2.5|1995-03-15|more\r\n2|second one|3|19960401\r\n")
    got = read_pipe_text(spark, str(tmp_path / "rows.csv"), Schema("e", FIELDS)).orderBy("id").collect()
    assert [(r["id"], r["name"], r["pay"], str(r["born"])) for r in got] == [(1, "first", 2.5, "1995-03-15"), (2, "secon", 3.0, "1996-04-01")]
    db.load_text("e", str(tmp_path / "rows.csv"))
    assert len(ids(db.df("e"))) == 12
    with pytest.raises(Exception):
        db.load_text("e", str(tmp_path / "missing.csv"))


@pytest.mark.parametrize("mode", [1, 2, 3, 4])
def test_workload(db, mode):
    assert run_workload(db, ["e"], mode).rows == 10


def test_streams(spark, tmp_path, db):
    from tarnql.streaming.relations import attach_stream, follow

    db.df("e").write.parquet(str(tmp_path / "in"))
    live = Database(spark)
    attach_stream(live, "e", str(tmp_path / "in"), Schema("e", FIELDS))
    db.create_relation("rich", [("id", "int"), ("pay", "double")])
    plan = live.query().fromTable("e").where("pay > 500").select({"id": ("id", "int"), "pay": ("pay", "double")}).finalize()
    follow(plan, db, "rich", str(tmp_path / "offsets")).awaitTermination()
    assert ids(db.df("rich")) == [6, 7, 8, 9]
