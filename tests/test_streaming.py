from foliomine.streaming import indexing


def test_index_runs_add_only_what_is_new(spark, tmp_path):
    source, log, checkpoint = (tmp_path / n for n in ("files", "log", "checkpoint"))
    source.mkdir()
    (source / "a.txt").write_text("content a")
    (source / "lib.txt").write_text("ignored by its name")

    def run():
        query = indexing.index_files(spark, str(source), str(log), str(checkpoint))
        assert query.awaitTermination(120)
        return sorted(r["name"] for r in indexing.current_catalog(spark, str(log)).collect())

    assert run() == ["a.txt"]
    (source / "sub").mkdir()
    (source / "sub" / "b.txt").write_text("content b")
    assert run() == ["a.txt", "b.txt"]
    assert run() == ["a.txt", "b.txt"]
    compacted = str(tmp_path / "compacted")
    indexing.compact(spark, str(log), compacted)
    assert indexing.read_log(spark, compacted).count() == 2


def test_a_restored_file_with_an_old_time_is_the_latest(spark, tmp_path):
    import os

    from foliomine.operators import catalog

    source, log, checkpoint = (tmp_path / n for n in ("files", "log", "checkpoint"))
    source.mkdir()
    for no, text in enumerate(["first", "second"]):
        (source / f"{no}").mkdir()
        (source / f"{no}" / "a.txt").write_text(text)
        os.utime(source / f"{no}" / "a.txt", (10**9 - no * 1000,) * 2)
        assert indexing.index_files(spark, str(source), str(log), str(checkpoint)).awaitTermination(120)
    rows = indexing.read_log(spark, str(log)).selectExpr("*").withColumn("path", __import__("pyspark").sql.functions.lit("a.txt"))
    assert [r["batch_no"] for r in catalog.latest_by_path(rows).collect()] == [1]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from foliomine.sources import files as src

    source, log = tmp_path / "files", str(tmp_path / "log")
    source.mkdir()
    (source / "a.txt").write_text("content a")
    files = src.read_files(spark, str(source))
    for _ in range(2):
        indexing.write_batch(files, 0, log)
    assert indexing.read_log(spark, log).count() == 1


def test_every_arrival_is_in_one_log(spark, tmp_path):
    import os

    source, log, arrivals = (tmp_path / n for n in ("files", "log", "arrivals"))
    source.mkdir()
    (source / "a.txt").write_text("content a")
    (source / "large.txt").write_text("x" * 100)
    (source / "lib.txt").write_text("ignored by its name")

    def run(no):
        options = {"max_size": 50}
        for start, target in ((indexing.log_arrivals, arrivals), (indexing.index_files, log)):
            query = start(spark, str(source), str(target), str(tmp_path / f"checkpoint-{target.name}"), **options)
            assert query.awaitTermination(120)
        rows = indexing.rejected(spark, str(arrivals), str(log)).collect()
        names = [r["name"] for r in indexing.read_log(spark, str(log)).collect()]
        assert len(rows) + len(names) == no
        return {os.path.basename(r["path"]): (r["size"], r["error_type"]) for r in rows}

    first = {"large.txt": (100, "FILE_TOO_LARGE"), "lib.txt": (19, "IGNORED")}
    assert run(3) == first
    assert run(3) == first
    (source / "b.txt").write_text("content b")
    (source / "big.txt").write_text("y" * 60)
    assert run(5) == first | {"big.txt": (60, "FILE_TOO_LARGE")}
    listed = spark.read.option("recursiveFileLookup", True).parquet(str(arrivals))
    listed.where("path like '%b.txt'").withColumn("path", __import__("pyspark").sql.functions.lit("/gone.txt")).write.parquet(str(arrivals / "batch=lost"))
    assert run(6) == first | {"big.txt": (60, "FILE_TOO_LARGE"), "gone.txt": (9, "UNREADABLE")}


def test_a_batch_of_arrivals_runs_again_without_a_trace(spark, tmp_path):
    import shutil

    source, arrivals, checkpoint = (tmp_path / n for n in ("files", "arrivals", "checkpoint"))
    source.mkdir()
    (source / "a.txt").write_text("content a")
    for _ in range(2):
        assert indexing.log_arrivals(spark, str(source), str(arrivals), str(checkpoint)).awaitTermination(120)
        shutil.rmtree(checkpoint)  # the batch is not known to have been written
    assert spark.read.option("recursiveFileLookup", True).parquet(str(arrivals)).count() == 1
