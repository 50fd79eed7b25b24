"""Commits to a versioned table: changes alone, other writers, writes that broke off, deletions, snapshots."""

import glob
import os

import pytest

from subtide.plans import report
from subtide.sources import sinks, versions

SCHEMA = "doc_id string, text string, at int"


def rows(spark, path, **options):
    return sorted((r["doc_id"], r["text"], r["_version"]) for r in versions.current(spark, path, **options).collect())


def frame(spark, *data):
    return spark.createDataFrame([(d, t, 0) for d, t in data], SCHEMA)


def test_only_changes_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) is None and versions.commits(spark, path) == []
    assert versions.commit(frame(spark, ("a", "1"), ("b", "1")), path) == 1
    assert versions.commit(frame(spark, ("a", "1"), ("b", "1")), path) is None
    assert versions.commit(frame(spark, ("a", "2"), ("b", "1"), ("c", None)), path) == 2
    assert [c.rows for c in versions.commits(spark, path)] == [2, 2]
    assert rows(spark, path) == [("a", "2", 2), ("b", "1", 1), ("c", None, 2)] and rows(spark, path, version=1) == [("a", "1", 1), ("b", "1", 1)]
    again = spark.createDataFrame([("a", "2", 99)], SCHEMA)
    assert versions.commit(again, path, volatile=["at"]) is None and versions.commit(again, path) == 3
    assert versions.verify(spark, path) == []
    with pytest.raises(ValueError):
        versions.commit(frame(spark, ("x", "1"), ("x", "2")), path)
    assert len(versions.commits(spark, path)) == 3 and len(os.listdir(f"{path}/data")) == 3


def test_two_writers(spark, tmp_path):
    path, turns = str(tmp_path / "t"), []
    versions.commit(frame(spark, ("a", "1")), path)

    def other():
        if not turns:
            turns.append(versions.commit(frame(spark, ("b", "theirs"), ("c", "theirs")), path))

    assert versions.commit(frame(spark, ("b", "mine"), ("c", "theirs"), ("d", "mine")), path, before_publish=other) == 3 and turns == [2]
    assert rows(spark, path) == [("a", "1", 1), ("b", "mine", 3), ("c", "theirs", 2), ("d", "mine", 3)]  # what they had already is not written again
    assert versions.commits(spark, path)[-1].rows == 2 and versions.verify(spark, path) == []


def test_same_rows_by_another_writer(spark, tmp_path):
    path, turns, mine = str(tmp_path / "t"), [], frame(spark, ("a", "1"))
    assert versions.commit(mine, path, before_publish=lambda: turns or turns.append(versions.commit(mine, path))) is None and turns == [1]
    assert rows(spark, path) == [("a", "1", 1)] and len(os.listdir(f"{path}/data")) == 1


def test_a_write_that_broke_off_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.commit(frame(spark, ("a", "1")), path)

    def fail():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        versions.commit(frame(spark, ("a", "2")), path, before_publish=fail)
    open(f"{path}/_log/.half.draft", "w").write("{")
    assert rows(spark, path) == [("a", "1", 1)] and len(os.listdir(f"{path}/data")) == 2
    assert versions.commit(frame(spark, ("a", "3")), path) == 2 and rows(spark, path) == [("a", "3", 2)]

    monkeypatch.setattr(versions, "TRIES", 2)

    def spoil():
        for f in glob.glob(f"{path}/data/*/part-*.parquet"):
            if "4" in [r["text"] for r in spark.read.parquet(f).collect()]:
                os.remove(f)

    with pytest.raises(RuntimeError):  # what it wrote isn't there any more each time it looks
        versions.commit(frame(spark, ("a", "4")), path, before_publish=spoil)
    assert rows(spark, path) == [("a", "3", 2)]
    for f in glob.glob(f"{path}/data/{versions.commits(spark, path)[1].data}/part-*"):
        os.remove(f)
    assert versions.verify(spark, path) == [2]


def test_deletions_and_snapshots(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(versions, "SNAPSHOT", 3)
    versions.commit(frame(spark, ("a", "1"), ("b", "1"), ("c", "1")), path)
    assert versions.commit(frame(spark, ("a", "1")), path, replace=True) == 2 and rows(spark, path) == [("a", "1", 1)]
    assert versions.commit(frame(spark, ("b", "1")), path) == 3 and rows(spark, path) == [("a", "1", 1), ("b", "1", 3)]
    whole = versions.commits(spark, path)[-1]
    assert whole.whole and whole.rows == 3  # c is noted as gone
    assert versions.commit(frame(spark, ("d", "1")), path) == 4 and rows(spark, path) == [("a", "1", 1), ("b", "1", 3), ("d", "1", 4)]
    assert rows(spark, path, version=2) == [("a", "1", 1)]


def test_files_and_names(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, text string")
    assert sinks.write_changed(files, str(tmp_path / "f")).count() == 2 == sinks.write_changed(files, str(tmp_path / "f")).count()
    names = spark.createDataFrame([("谈胥", ["Tán", "Xū"], "vi", "extra")], "han string, pinyin array<string>, vi string, note string")
    kept = report.save_names(names, str(tmp_path / "n"))
    assert kept.columns == names.columns and kept.collect() == names.collect()
    other = spark.createDataFrame([("李四", ["Lǐ", "Sì"], None, None)], names.schema)
    assert [r["han"] for r in report.save_names(other, str(tmp_path / "n")).collect()] == ["李四"]
    assert [r["han"] for r in versions.current(spark, str(tmp_path / "n"), ["han"], version=1).collect()] == ["谈胥"]
