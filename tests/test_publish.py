"""Published tables: whole versions, a bounded number of files, readers beside writers."""

import threading

import pytest

from metricspark.publish import PublishedTable, read_published
from metricspark.session import new_work_path, remove_work, work_path


def files(path):
    return sum(p.is_file() for p in path.rglob("*"))


def test_versions_replace_each_other_and_old_ones_go(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "t"), keep=3)
    with pytest.raises(ValueError):
        table.read()
    counts = []
    for i in range(20):
        table.write(spark.range(i + 1, numPartitions=1))
        assert table.read().count() == i + 1 and table.last_number == i
        counts.append(files(tmp_path / "t"))
    assert len(table.versions()) == 3 and len(set(counts[5:])) == 1
    # another session finds the same, as after a restart
    assert read_published(spark.newSession(), str(tmp_path / "t")).count() == 20


def test_a_failed_write_changes_nothing_and_is_removed_later(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "t"), keep=1)
    table.write(spark.range(3))

    def broken(folder):
        spark.range(9).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.publish(broken)
    assert table.read().count() == 3
    for _ in range(2):
        table.write(spark.range(4))
    assert table.read().count() == 4
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_a_number_may_be_published_again(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(2), 7)
    table.write(spark.range(2), 7)
    assert table.last_number == 7 and table.read().count() == 2


def test_readers_find_a_whole_table_during_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    table = PublishedTable(spark, path)
    table.write(spark.range(100, numPartitions=4))
    stop, seen, wrong = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen.append(read_published(spark, path).count())
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(40):
        table.write(spark.range(100, numPartitions=4))
    stop.set()
    reader.join()
    assert not wrong and set(seen) == {100}


def test_an_application_removes_its_work(spark, tmp_path):
    path = new_work_path(spark, "something")
    spark.range(3).write.parquet(path)
    spark.range(3).checkpoint()
    remove_work(spark)
    from pathlib import Path
    from urllib.parse import urlparse

    assert not Path(urlparse(work_path(spark)).path).exists()
    assert spark.range(2).checkpoint().count() == 2
