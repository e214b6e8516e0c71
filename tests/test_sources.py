import csv
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.plans.analysis import analyse
from quillgrid.sinks.runs import export_runs, meta_frame, meta_lines, write_runs
from quillgrid.sources.delimited import infer_columns, load_corpus, scan_delimited, sniff
from quillgrid.sources.runs import pipeline_of, scan_runs, scan_scaling, scored_runs, typed_runs

EDGE_CASES = (
    b'Text,Label\n"a, ""q"" line1\nline2",0\nshort\nx,1,extra\nNA,2\n   ,3\nbad \xff byte,4\nnull,1\n,2\ny,1,\n'
)


def write(path, data):
    path.write_bytes(data)
    return str(path)


def test_edge_cases(spark, tmp_path):
    rows = [tuple(r) for r in scan_delimited(spark, write(tmp_path / "c.csv", EDGE_CASES)).collect()]
    expected = [
        ('a, "q" line1\nline2', "0"), ("short", None), (None, "2"), ("   ", "3"),
        ("bad � byte", "4"), (None, "1"), (None, "2"),
    ]
    assert sorted(rows, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("split_bytes", [64, 300, 1 << 20])
def test_quoted_line_breaks_over_splits(spark, tmp_path, split_bytes):
    """Records larger and smaller than a split, stray quotes, and one hot file."""
    rng = random.Random(5)
    cells = ["plain", 'say "hi"', "two\nlines", '\n\n"', 'x,"y"\n,z', "w " * 200 + "\n" + "v " * 200, "", "\n".join("abcdefghij")]
    for number, count in enumerate((400, 3, 1)):
        rows = [(f"{number}-{i}", rng.choice(cells), rng.choice(cells)) for i in range(count)]
        with open(tmp_path / f"part{number}.csv", "w", newline="") as f:
            f.write("id,Text,Label\n")
            writer = csv.writer(f, lineterminator="\n")
            for row in rows:
                writer.writerow(row)
                if rng.random() < 0.3:
                    f.write(f'{row[0]}s,in"side,5" disk\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = scan_delimited(spark, str(tmp_path), sniff(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = []
    for number in range(3):
        with open(tmp_path / f"part{number}.csv", newline="") as f:
            expected += [tuple(c or None for c in row) for row in list(csv.reader(f))[1:]]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


@pytest.fixture
def split_bytes(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split_bytes", [8, 64, 1 << 20], indirect=True)
@pytest.mark.parametrize("data, expected", [
    (b"Text,Label\rone,1\rtwo,2\r", [("one", "1"), ("two", "2")]),
    (b"\n \nText,Label\none,1\n\n", [("one", "1")]),
    (b'Text,Label\r\n"a\r\nb",1\r\nc,2\r\n', [("a\r\nb", "1"), ("c", "2")]),
    (b'Text,Label\na,1\n"never closed,2\nb,3\n' + b"more,4\n" * 40, [("a", "1")]),
    (b'\xef\xbb\xbfText,Label\n\xff,1\n', [("\ufffd", "1")]),
    (b'Text,Label\na,1\rb,2\nc,3', [("a", "1"), ("b", "2"), ("c", "3")]),
])
def test_bytes_of_files(spark, tmp_path, data, expected, split_bytes):
    path = write(tmp_path / "c.csv", data)
    assert sniff(spark, path).columns == ("Text", "Label")
    assert sorted(map(tuple, scan_delimited(spark, path).collect())) == expected


def test_files_of_a_folder_share_a_layout(spark, tmp_path):
    write(tmp_path / "a.csv", b"Text,Label\none,1\n")
    write(tmp_path / "b.csv", b"Label,Text\n2,two\n")
    with pytest.raises(Exception, match="another header"):
        scan_delimited(spark, str(tmp_path)).collect()


def test_headerless_files_are_numbered(spark, tmp_path):
    write(tmp_path / "a.csv", b"0,hello there\n1,you\n")
    scanned = scan_delimited(spark, str(tmp_path))
    assert scanned.columns == ["col0", "col1"] and sorted(map(tuple, scanned.collect())) == [("0", "hello there"), ("1", "you")]


def test_layout_of_a_folder_whose_first_files_have_no_text(spark, tmp_path):
    for name, data in (("part-0", b""), ("part-1", b"\n \n"), ("part-2", b"1;x\t7\n"), ("part-3", b"2;y\t8\n")):
        write(tmp_path / name, data)
    assert sorted(map(tuple, scan_delimited(spark, str(tmp_path)).collect())) == [("1;x", "7"), ("2;y", "8")]
    (tmp_path / "none").mkdir()
    write(tmp_path / "none" / "part-0", b"")
    write(tmp_path / "none" / "part-1", b"\n")
    with pytest.raises(ValueError):
        sniff(spark, str(tmp_path / "none"))


def test_prepared_edge_cases(spark, tmp_path):
    corpus = load_corpus(spark, write(tmp_path / "c.csv", EDGE_CASES))
    assert corpus.schema["label"].dataType.simpleString() == "int"
    got = sorted((r.label, r.text_clean) for r in corpus.collect())
    assert got == [(0, "a, q line1 line2"), (4, "bad byte")]


@pytest.mark.parametrize("data, separator, header, columns", [
    (b"Text\tLabel\nx\t1\n", "\t", True, ("Text", "Label")),
    (b"a\tb,c\nx\ty\n", ",", True, ("a\tb", "c")),
    (b"0,hello\n1,you\n", ",", False, ("col0", "col1")),
    (b"-1.5,hello\n1,you\n", ",", False, ("col0", "col1")),
    (b"a,bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb\nx,y\n", ",", False, ("col0", "col1")),
    (b' Text , "Label"\nx,1\n', ",", True, ("Text", '"Label"')),
])
def test_layout(spark, tmp_path, data, separator, header, columns):
    layout = sniff(spark, write(tmp_path / "f.csv", data))
    assert (layout.separator, layout.header) == (separator, header)
    assert layout.columns[: len(columns) - 1] == columns[:-1]
    assert len(layout.columns) == len(columns)


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no data"):
        sniff(spark, str(tmp_path / "none.csv"))


def test_columns_by_name_and_by_length(spark):
    named = spark.createDataFrame([("x", "long text", "1")], "Category string, Body string, other string")
    assert infer_columns(named) == ("Body", "Category")
    unnamed = spark.createDataFrame([("ab", "a long text", "12"), ("cd", "another text", "3")], "a string, b string, n string")
    assert infer_columns(unnamed) == ("b", "a")
    with pytest.raises(ValueError, match="only one"):
        infer_columns(spark.createDataFrame([("ab", "1")], "a string, b string"))
    with pytest.raises(ValueError, match="no text"):
        infer_columns(spark.createDataFrame([("1", "2")], "a string, b string"))
    with pytest.raises(ValueError, match="same"):
        # The label is known by name; the longest text column is the same one.
        infer_columns(spark.createDataFrame([("a long label", "b")], "label string, x string"))


def test_run_file_round_trip(spark, tmp_path):
    runs = spark.createDataFrame(
        [("bow", "svm", 1.5, 0.25, None), ("bow", "knn", None, None, "boom")],
        "feature string, model string, train_time double, test_accuracy double, error string",
    )
    meta = {"total_time": 12.5, "n_ranks": 4, "stages": {"model_training_bow": 2.0}}
    assert meta_lines(meta) == ["total_time: 12.5000", "n_ranks: 4", "model_training_bow: 2.0000"]
    path = f"{tmp_path}/results_serial.txt"
    export_runs(runs, path, meta_frame(spark, meta))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == [
        "total_time: 12.5000", "n_ranks: 4", "model_training_bow: 2.0000", "",
        "feature\tmodel\ttrain_time\ttest_accuracy\terror", "bow\tknn\t\t\tboom", "bow\tsvm\t1.500000\t0.250000\t",
    ]
    found, cells = scan_runs(spark, f"{tmp_path}/results_*.txt")
    assert found.first().meta == {"total_time": "12.5000", "n_ranks": "4", "model_training_bow": "2.0000"}
    typed = typed_runs(cells, pipeline_of(F.col("path")))
    assert typed.count() == 2
    kept = scored_runs(typed).collect()
    assert [(r.pipeline, r.model, r.train_time, r.test_accuracy) for r in kept] == [("serial", "svm", 1.5, 0.25)]
    write_runs(typed, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2


def test_run_file_without_table_and_repeated_key(spark, tmp_path):
    (tmp_path / "results_mpi.txt").write_text("a: 1\na: x:y\nb:\n")
    meta, cells = scan_runs(spark, f"{tmp_path}/results_mpi.txt")
    assert meta.first().meta == {"a": "x:y", "b": ""}
    assert cells.count() == 0


def test_short_rows_and_bad_numbers(spark, tmp_path):
    (tmp_path / "results_x.txt").write_text("t: 1\n\nfeature\tmodel\ttrain_time\ttest_accuracy\nbow\tsvm\tfast\t0.5\n\nbow\tmlp\n")
    _, cells = scan_runs(spark, f"{tmp_path}/results_x.txt")
    rows = typed_runs(cells, F.lit("x")).orderBy("model").collect()
    assert [(r.model, r.train_time, r.test_accuracy) for r in rows] == [("mlp", None, None), ("svm", None, 0.5)]


def test_scaling_folders(spark, tmp_path):
    for n, line in ((1, "total_time: 9\ntotal_wall_time: 100"), (2, "total_time: 60"), (10, "other: 1")):
        folder = tmp_path / f"njobs_{n}"
        folder.mkdir()
        (folder / "results_parallel.txt").write_text(line + "\n")
    (tmp_path / "njobs_4").mkdir()
    rows = scan_scaling(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(1, 100.0), (2, 60.0), (10, None)]
    assert scan_scaling(spark, str(tmp_path / "nowhere")).collect() == []


def test_analysis_of_a_results_folder(spark, tmp_path):
    for name, time, f1 in (("serial", 100, 0.5), ("parallel", 40, 0.75)):
        (tmp_path / f"results_{name}.txt").write_text(
            f"total_time: {time}\n\nfeature\tmodel\ttrain_time\ttest_accuracy\ttest_f1_macro\nbow\tsvm\t1\t0.5\t{f1}\nbow\tknn\t1\t0.5\t0.25\n"
        )
    tables = analyse(spark, str(tmp_path), f"{tmp_path}/out")
    speed = {r.pipeline: r.speedup_vs_serial for r in tables["speedup"].collect()}
    assert speed == {"serial": 1.0, "parallel": 2.5}
    assert {r.pipeline: r.model for r in tables["best"].collect()} == {"serial": "svm", "parallel": "svm"}
    assert tables["scaling_jobs"].count() == 0
    assert spark.read.csv(f"{tmp_path}/out/summary.csv", header=True).count() == 4
