"""Files to take away: order of blocks, clashing names, and commits that are all or nothing."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import exports
from docketry.sources import sinks


def blocks(spark, rows):
    return spark.createDataFrame(rows, "name string, ord int, block string").repartition(3)


def there(spark, folder):
    found = {p.name: p.read_bytes().decode() for p in folder.iterdir()}
    assert {r.name: r.content for r in sinks.read_files(spark, str(folder)).collect()} == {k: v for k, v in found.items() if v}
    return found


def test_blocks_make_files_in_their_order(spark, tmp_path):
    folder = tmp_path / "out"
    sinks.write_files(blocks(spark, [("a.txt", 2, "c"), ("a.txt", 0, "ä"), ("a.txt", 1, "b\r\n"), ("b.txt", 0, ""), ("c.txt", 0, None), (None, 0, "x")]), str(folder), ["ord"])
    assert there(spark, folder) == {"a.txt": "äb\r\nc", "b.txt": "", "c.txt": ""}
    # into a folder that is there: files move in one by one, equal names are replaced
    sinks.write_files(blocks(spark, [("a.txt", 0, "new"), ("d.txt", 0, "d")]), str(folder))
    assert there(spark, folder) == {"a.txt": "new", "b.txt": "", "c.txt": "", "d.txt": "d"}
    sinks.write_files(blocks(spark, [("only.txt", 0, "x")]), str(folder), mode="overwrite")
    assert there(spark, folder) == {"only.txt": "x"}
    sinks.write_files(blocks(spark, [("x", 0, "")]).limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none", "out"]


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    bad = blocks(spark, [(f"f{i}.txt", 0, "x") for i in range(30)] + [("../up.txt", 0, "x")])
    with pytest.raises(Exception, match="no name for a file"):
        sinks.write_files(bad, str(folder))
    assert list(tmp_path.iterdir()) == []
    sinks.write_files(blocks(spark, [("kept.txt", 0, "k")]), str(folder))
    with pytest.raises(Exception, match="no name for a file"):
        sinks.write_files(bad, str(folder), mode="overwrite")
    assert there(spark, folder) == {"kept.txt": "k"} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_rows_of_other_shapes_are_refused(spark, tmp_path):
    sinks.register(spark)
    with pytest.raises(Exception, match="rows are"):
        spark.range(3).write.format("docketry-files").mode("append").save(str(tmp_path / "x"))


def test_slugs_that_clash_are_numbered(spark):
    df = spark.createDataFrame([("Rent, due", 3), ("rent due", 1), ("Rent Due 2", 2), ("rent due", 2), (None, 9)], "title string, k int")
    got = {(r.title, r.k): r.file for r in sinks.numbered_names(df, exports.file_slug(F.coalesce("title", F.lit(""))), ".ics", ["k"]).collect()}
    assert got == {("rent due", 1): "rent-due.ics", ("rent due", 2): "rent-due_2.ics", ("Rent, due", 3): "rent-due_3.ics", ("Rent Due 2", 2): "rent-due-2.ics", (None, 9): "docketry-event.ics"}


def test_a_deep_target_is_moved_by_the_folder_and_read_by_tasks(spark, tmp_path):
    folder, rows = tmp_path / "out", [(f"f{i}.txt", 0, f"é{i}") for i in range(3000)] + [("f7.txt", 1, "-more"), ("empty.txt", 0, "")]
    sinks.write_files(blocks(spark, rows), str(folder), ["ord"], deep=True)
    want = {n: b for n, o, b in rows if o == 0} | {"f7.txt": "é7-more"}
    found = [p for p in folder.rglob("*") if p.is_file()]
    assert {p.name: p.read_text() for p in found} == want and len(found) == len(want)
    assert {p.parent.name for p in found} == {p.name for p in folder.iterdir()} and all(p.parent.name == sinks.folder_of(p.name) for p in found)
    got = sinks.read_files(spark, str(folder), deep=True)
    assert {r.name: r.content for r in got.collect()} == want and got.count() == len(want)
    # no more tasks for more files, and no list of them in the driver
    assert got.rdd.getNumPartitions() == sinks.FOLDERS // sinks.TASK_FOLDERS and not got.inputFiles()
    # into folders that are there: equal names are replaced, others stay
    sinks.write_files(blocks(spark, [("f7.txt", 0, "new"), ("g.txt", 0, "g")]), str(folder), deep=True)
    assert {r.name: r.content for r in sinks.read_files(spark, str(folder), deep=True).collect()} == want | {"f7.txt": "new", "g.txt": "g"}
    sinks.write_files(blocks(spark, [("only.txt", 0, "x")]), str(folder), mode="overwrite", deep=True)
    assert [(r.name, r.content) for r in sinks.read_files(spark, str(folder), deep=True).collect()] == [("only.txt", "x")]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_new_deep_target_takes_a_move_a_folder(tmp_path):
    from pyarrow import fs

    class Counting:
        def __init__(self):
            self.own, self.moves = fs.LocalFileSystem(), 0

        def __getattr__(self, name):
            return getattr(self.own, name)

        def move(self, *paths):
            self.moves += 1
            self.own.move(*paths)

    writer, system = sinks.FilesWriter(str(tmp_path / "out"), False, deep=True), Counting()
    names = sorted((f"f{i}.txt" for i in range(5000)), key=sinks.folder_of)
    message = writer.write(iter([(n, n) for n in names]))
    before = sinks.filesystem
    try:
        sinks.filesystem = lambda uri: (system, uri)
        writer.commit([message, None])
    finally:
        sinks.filesystem = before
    assert system.moves <= sinks.FOLDERS + 1 and len(list((tmp_path / "out").glob("*/*.txt"))) == 5000
