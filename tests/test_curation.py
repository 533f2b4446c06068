"""De-duplication, the whole curation job on files, manifests, snapshots, stream."""

import pytest
from pyspark.sql import functions as F

from casewright.operators import curate, joins, stats
from casewright.plans.corpus import curate_corpus
from casewright.sources import corpus as src
from casewright.sources import tables as tb
from casewright.streaming.scoring import start_filter


def corpus_folder(tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    texts = {
        "002-Alpha.md": "A climate and carbon claim. The motion was GRANTED in 2021.",
        "010-Alpha.md": "A second copy on climate.",
        "003-Beta.md": "Copyright Act and patent infringement with disclosure.",
        "Gamma.md": "ERISA fiduciary duty, 2nd copy without number.",
        "1-Gamma.md": "ERISA fiduciary duty.",
        "004-Delta.md": "Nothing relevant.",
        "notes.txt": "climate",
    }
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode() + b"\xff\r\n")
    return folder


def test_canonical_dedup_ties_and_missing_numbers(spark):
    names = ["002-A.md", "010-A.md", "A.md", "B.md", "003-C.md", "03-C.md"]
    docs = spark.createDataFrame([(n,) for n in names], "filename string")
    kept = curate.canonical_dedup(docs).filter("status = 'canonical'")
    assert sorted(r["filename"] for r in kept.collect()) == ["002-A.md", "003-C.md", "B.md"]
    counts = curate.dedup_counts(curate.canonical_dedup(docs)).first()
    assert tuple(counts) == (3, 3, 6)


def test_one_case_with_most_rows(spark):
    docs = spark.range(2000).select(F.concat(F.col("id") + 5, F.lit("-Hot.md")).alias("filename"))
    tagged = curate.canonical_dedup(docs)
    assert [r["filename"] for r in tagged.filter("status = 'canonical'").collect()] == ["5-Hot.md"]
    assert tagged.count() == 2000


def test_curation_job_and_resume(spark, tmp_path):
    folder = corpus_folder(tmp_path)
    out = str(tmp_path / "out")
    tables = curate_corpus(spark, str(folder), out)
    labels = {r["filename"]: r["label"] for r in tables["labels"].collect()}
    assert labels == {"002-Alpha.md": "E", "1-Gamma.md": "G"}
    cleaned = {r["filename"]: r["cleaned_text"] for r in tables["cleaned"].collect()}
    assert cleaned["002-Alpha.md"] == "A climate and carbon claim. The motion was [OUTCOME] in 2021."
    (folder / "005-New.md").write_text("carbon")
    again = curate_corpus(spark, str(folder), out)
    assert again["labels"].count() == 2
    manifest = tb.read_manifest(spark, f"{out}/run_manifest").filter("status = 'complete'")
    assert manifest.count() == 5
    row = manifest.filter("step = '01_deduplicate'").first()
    assert row["rows"] == 6 and row["details"] == '{"canonical_count": 4, "duplicate_count": 2}'
    forced = curate_corpus(spark, str(folder), str(tmp_path / "out2"), force=True)
    assert forced["labels"].count() == 3


def test_empty_corpus_has_tables(spark, tmp_path):
    folder = tmp_path / "empty"
    folder.mkdir()
    (folder / "notes.txt").write_text("x")
    tables = curate_corpus(spark, str(folder), str(tmp_path / "out"))
    assert tables["labels"].count() == 0
    assert tables["labels"].columns[:2] == ["filename", "label"]


def test_csv_with_quotes_and_newlines(spark, tmp_path):
    rows = [("a.md", "E", 0, 1, 3, 0, 'say "hi",\nthere')]
    df = spark.createDataFrame(rows, src.CLEANED_SCHEMA)
    tb.write_table(df, str(tmp_path / "csv"), "csv")
    assert [tuple(r) for r in src.read_csv(spark, str(tmp_path / "csv"), src.CLEANED_SCHEMA).collect()] == rows


def test_file_hashes_and_integrity(spark, tmp_path):
    import hashlib

    folder = corpus_folder(tmp_path)
    files = tb.hash_files(src.scan_files(spark, str(folder)))
    expected = spark.createDataFrame([("002-Alpha.md",), ("gone.md",)], "filename string")
    hashes = {r["filename"]: r["sha256"] for r in tb.file_hashes(files, expected).collect()}
    assert hashes["gone.md"] == "NOT_FOUND"
    assert hashes["002-Alpha.md"] == hashlib.sha256((folder / "002-Alpha.md").read_bytes()).hexdigest()
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "filename string, sha256 string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "filename string, sha256 string")
    status = {r["filename"]: r["status"] for r in tb.integrity_check(a, b).collect()}
    assert status == {"a": "OK", "b": "MISMATCH", "c": "MISSING", "d": "UNEXPECTED"}


def test_fingerprint_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([("x", None), ("y", "")], "a string, b string")
    same = spark.createDataFrame([("y", ""), ("x", None)], "a string, b string")
    other = spark.createDataFrame([("x", ""), ("y", None)], "a string, b string")
    prints = [tb.table_fingerprint(df).first() for df in (a, same, other)]
    assert prints[0] == prints[1] and prints[0] != prints[2]


def test_snapshot_describes_the_written_copy(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "filename string, n int")
    row = tb.write_snapshot(df, 3, "stats", "v1", "4232026", str(tmp_path)).first()
    assert row["snapshot"] == "snapshot_03_stats_v1_4232026" and row["rows"] == 2
    copy = spark.read.schema(df.schema).parquet(str(tmp_path / row["snapshot"]))
    assert tb.table_fingerprint(copy).first()["hash_sum"] == row["hash_sum"]


def test_stream_filters_each_file_once(spark, tmp_path):
    folder = corpus_folder(tmp_path)
    out, check = str(tmp_path / "stream"), str(tmp_path / "check")
    start_filter(spark, str(folder), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    (folder / "006-More.md").write_text("climate")
    start_filter(spark, str(folder), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def test_left_join_and_distribution_keep_empty_groups(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "filename string")
    labels = spark.createDataFrame([("a", "E", 1)], "filename string, label string, is_greenwash int")
    joined = joins.join_labels_left(texts, labels, ["label", "is_greenwash"])
    assert {tuple(r) for r in joined.collect()} == {("a", "E", "1"), ("b", "", "")}
    counts = {r["label"]: r["n"] for r in stats.label_distribution(labels).collect()}
    assert counts == {"E": 1, "S": 0, "G": 0, "Non-ESG": 0}


def test_scratch_folder_comes_from_the_session(spark, monkeypatch):
    from casewright.sources import storage

    assert storage.scratch_path(spark, "x") != storage.scratch_path(spark, "x")
    monkeypatch.setattr(storage, "CHECKPOINT_DIR", "spark.casewright.unset")
    assert "casewright-" in storage.scratch_path(spark, "x")
    spark.conf.set("spark.casewright.set", "/shared/folder/")
    monkeypatch.setattr(storage, "CHECKPOINT_DIR", "spark.casewright.set")
    assert storage.scratch_path(spark, "x").startswith("/shared/folder/casewright/x-")


def test_one_name_in_two_folders_has_one_canonical(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "1-Alpha.md").write_text("carbon")
    docs = src.corpus_scan(spark, str(tmp_path / "in"), recursive=True, with_path=True)
    assert sorted(r["status"] for r in curate.canonical_dedup(docs, key="path").collect()) == ["canonical", "duplicate"]


def test_failed_forced_run_leaves_the_step_open(spark, tmp_path):
    def build():
        raise RuntimeError("no disk")

    args = (str(tmp_path / "t"), str(tmp_path / "m"), spark)
    first = tb.materialize("s", lambda: spark.range(3), *args)
    with pytest.raises(RuntimeError):
        tb.materialize("s", build, *args, force=True)
    assert first.count() == 3
    assert tb.last_run(spark, str(tmp_path / "m"), "s") is None
    assert tb.materialize("s", lambda: spark.range(5), *args).count() == 5
    assert tb.materialize("s", build, *args).count() == 5


@pytest.mark.parametrize("longest", [0, 10, 10**9])
def test_long_files_are_streamed(spark, tmp_path, longest):
    """Hashes do not depend on the size from which files are read piece by piece."""
    import hashlib

    folder = tmp_path / "with space%20"
    folder.mkdir()
    files = {"a.md": b"a", "b.md": b"x" * 10, "c.md": bytes(range(256)) * 4000, "é 1.md": b"y" * 11}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    found = tb.hash_files(src.scan_files(spark, str(folder)), longest, piece=1000)
    assert {r["filename"]: r["sha256"] for r in found.collect()} == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    expected = spark.createDataFrame([(n,) for n in [*files, "gone.md"]], "filename string")
    checked = tb.integrity_check(found, tb.file_hashes(found, expected))
    assert {r["filename"]: r["status"] for r in checked.collect()} == {n: "OK" for n in files} | {"gone.md": "UNEXPECTED"}


def test_two_drivers_cannot_run_one_step(spark, tmp_path):
    """Of many claims at once one succeeds; a run that goes on keeps others out, one that is gone does not."""
    from concurrent.futures import ThreadPoolExecutor
    from datetime import timedelta

    manifest = str(tmp_path / "m")

    def attempt(_):
        try:
            tb.claim(spark, manifest, "s")
            return 1
        except tb.StepTaken:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(attempt, range(40))) == 1
    with pytest.raises(tb.StepTaken):
        tb.materialize("s", lambda: spark.range(3), str(tmp_path / "t"), manifest, spark)
    tb.claim(spark, manifest, "s", lease=timedelta(seconds=-1))   # the other run is gone
    tb.release(spark, manifest, "s")

    def build():
        with pytest.raises(tb.StepTaken):
            tb.materialize("s", lambda: spark.range(9), str(tmp_path / "t"), manifest, spark)
        return spark.range(3)

    assert tb.materialize("s", build, str(tmp_path / "t"), manifest, spark).count() == 3
    # The claim is gone with the run, and the finished table is handed out.
    assert tb.materialize("s", lambda: spark.range(9), str(tmp_path / "t"), manifest, spark).count() == 3
