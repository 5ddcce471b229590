"""CSV session directories: header drift, NULL vs blank, odd paths, merges."""

import os

import pytest
from pyspark.sql import functions as F

from chronoframe.sources.csv_sessions import _relative_name, merge_sessions, read_kind, read_meta, read_session_dir


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _fixture(root):
    a = os.path.join(root, "data", "Test Condition 2", "P0")
    b = os.path.join(root, "data", "Cond+B", "P[1]")
    _write(os.path.join(a, "s0_x_Event.csv"), [
        "Timestamp;Event;SessionID;MoleId",
        "2022-01-01 10:00:00.5;Game Started;S0;NULL",
        "2022-01-01 10:00:01;Mole Spawned;S0;m1",
    ])
    # same kind, other column order and an extra column
    _write(os.path.join(b, "s1_y_Event.csv"), [
        "MoleId;Event;Timestamp;SessionID;Extra",
        "m2;Mole Hit;2022-01-01 11:00:00.1234567;S1;",
    ])
    _write(os.path.join(a, "s0_x_Sample.csv"), [
        "Timestamp;Event;SessionID;GazeConfidence",
        "2022-01-01 10:00:00;Sample;S0;0.5",
        "2022-01-01 10:00:00.75;Sample;S0;NULL",
    ])
    _write(os.path.join(a, "s0_x_Meta.csv"), [
        "SessionID;Timestamp;Email;Framecount;ParticipantID",
        "S0;2022-01-01;a@b;1;0",
    ])
    _write(os.path.join(b, "s1_y_Meta.csv"), [
        "SessionID;Timestamp;Email;Framecount;ParticipantID",
        "S1;2022-01-01;c@d;2;1",
    ])
    return os.path.join(root, "data")


def test_header_drift_maps_by_name(spark, tmp_path):
    root = _fixture(str(tmp_path))
    ev = read_kind(spark, root, "Event")
    rows = {r["MoleId"]: r for r in ev.collect()}
    assert rows["m2"]["Event"] == "Mole Hit"
    assert rows["m2"]["Timestamp"].startswith("2022-01-01 11:00")
    assert rows["m2"]["Extra"] == ""  # blank cell stays an empty string
    assert rows[None]["Event"] == "Game Started"  # text NULL is missing
    assert rows["m1"]["Extra"] is None  # column absent from that file


def test_filename_and_path_fields(spark, tmp_path):
    root = _fixture(str(tmp_path))
    meta = read_meta(spark, root)
    got = {r["SessionID"]: r for r in meta.collect()}
    assert got["S0"]["i0"] == "data"
    assert got["S0"]["i1"] == "Test Condition 2"
    assert got["S1"]["i1"] == "Cond+B"
    assert got["S1"]["i2"] == "P[1]"
    assert "MetaEmail" in meta.columns and "Email" not in meta.columns
    assert "filename" not in meta.columns


def test_session_dir_merge(spark, tmp_path):
    root = _fixture(str(tmp_path))
    log = read_session_dir(spark, root)
    assert log.count() == 5
    per = dict(log.groupBy("SessionID").count().collect())
    assert per == {"S0": 4, "S1": 1}
    s1 = log.where(F.col("SessionID") == "S1").first()
    assert s1["ParticipantID"] == "1" and s1["MetaEmail"] == "c@d"
    # event rows sort before sample rows on a tie
    ords = {r["Event"]: r["_ord"] >> 60 for r in log.collect()}
    assert ords["Game Started"] == 0 and ords["Sample"] == 1


def test_rename_is_all_or_nothing(spark):
    from chronoframe.sources.csv_sessions import rename_meta

    df = spark.createDataFrame([("S", "t", "1")], "SessionID string, Timestamp string, Framecount string")
    assert rename_meta(df).columns == df.columns


def test_duplicate_meta_multiplies_and_null_keys_match(spark):
    ev = spark.createDataFrame([("e1", "S"), ("e2", None)], "Event string, SessionID string")
    meta = spark.createDataFrame([("S", "a"), ("S", "b"), (None, "n")], "SessionID string, MetaEmail string")
    out = merge_sessions(meta, ev, None)
    assert out.count() == 3
    assert out.where(F.col("Event") == "e2").first()["MetaEmail"] == "n"


def test_path_join_when_meta_has_no_session_ids(spark, tmp_path):
    root = str(tmp_path / "data")
    _write(os.path.join(root, "C1", "p_Event.csv"), ["Timestamp;Event", "2022-01-01 10:00:00;Game Started"])
    _write(os.path.join(root, "C1", "p_Meta.csv"), ["SessionID;Timestamp;Email;Framecount;ParticipantID", "NULL;t;e;1;7"])
    log = read_session_dir(spark, root, sample=None)
    row = log.first()
    assert row["ParticipantID"] == "7"


def test_clashing_columns_get_suffixes(spark):
    ev = spark.createDataFrame([("e1", "S", "a")], "Event string, SessionID string, Extra string")
    meta = spark.createDataFrame([("S", "m")], "SessionID string, Extra string")
    out = merge_sessions(meta, ev, None)
    assert set(out.columns) == {"Event", "SessionID", "Extra.x", "Extra.y"}
    row = out.first()
    assert row["Extra.x"] == "a" and row["Extra.y"] == "m"


def test_roots_in_any_spelling_give_the_same_names(spark, tmp_path):
    root = _fixture(str(tmp_path))
    want = {(r["filename"], r["SessionID"]) for r in read_kind(spark, root, "Event").collect()}
    assert sorted(f.split("/")[:2] for f, _ in want if "s1" in f) == [["data", "Cond+B"]]
    for spelled in (root + "/", "file:" + root, "file://" + root):
        assert {(r["filename"], r["SessionID"]) for r in read_kind(spark, spelled, "Event").collect()} == want


def test_relative_roots_from_the_working_folder(spark, tmp_path):
    root = _fixture(str(tmp_path))
    rel = os.path.relpath(root, spark.sparkContext._jvm.java.lang.System.getProperty("user.dir"))
    for spelled in (rel, "./" + rel, rel + "/"):
        log = read_session_dir(spark, spelled)
        assert {r["i1"] for r in log.select("i1").distinct().collect()} == {"Test Condition 2", "Cond+B"}


def test_names_on_a_store_with_an_authority(spark):
    path = F.lit("hdfs://nn:8020/data/CondA/s_Event.csv")
    one = spark.range(1)
    assert one.select(_relative_name(path, ("hdfs", "nn:8020", "/data"))).first()[0] == "data/CondA/s_Event.csv"
    with pytest.raises(Exception, match="is not under"):
        one.select(_relative_name(path, ("hdfs", "other:8020", "/data"))).collect()
    with pytest.raises(Exception, match="is not under"):
        one.select(_relative_name(path, ("hdfs", "nn:8020", "/dat"))).collect()


def test_quoted_cells(spark, tmp_path):
    folder = os.path.join(str(tmp_path), "data", "C1")
    _write(os.path.join(folder, "a_Event.csv"), [
        "Timestamp;Event;SessionID;Note",
        '2022-01-01 10:00:00;Sample;S0;"say ""hi""; ok"',
        '2022-01-01 10:00:01;Sample;S0;"C:\\dir\\"',
        '2022-01-01 10:00:02;Sample;S0;"two',
        'lines"',
    ])
    for extra in (False, True):  # one header, then several
        if extra:
            _write(os.path.join(folder, "b_Event.csv"), ["Note;SessionID", "x;S1"])
        rows = read_kind(spark, os.path.join(str(tmp_path), "data"), "Event").where("SessionID = 'S0'").orderBy("_ord").collect()
        assert [r["Note"] for r in rows] == ['say "hi"; ok', "C:\\dir\\", "two\nlines"]
        assert len({r["_ord"] for r in rows}) == len(rows)
