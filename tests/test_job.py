import os
import warnings
from collections import Counter
from dataclasses import replace

import pytest

from keyloom.apps import APPS
from keyloom.apps.inverted_index import POSTINGS, dedup, map_words
from keyloom.metrics import Metrics
from keyloom.operators.mapreduce import PythonReducer
from keyloom.operators.sinks import write_single
from keyloom.plans.cli import main, parse
from keyloom.plans.job import Job, run
from keyloom.sources.text import NoReadableInput, input_manifest, read_text


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.txt").write_text("Foo bar\nfoo")
    (tmp_path / "b c.txt").write_text("BAR baz\n")
    (tmp_path / "empty.txt").write_text("")
    return [str(tmp_path / n) for n in ("a.txt", "b c.txt", "empty.txt")]


def output(d):
    return {n: open(os.path.join(d, n)).read().splitlines() for n in sorted(os.listdir(d)) if n.startswith("part-")}


def test_text_source(spark, files):
    df = read_text(spark, [*files, files[0]])
    assert Counter((r.doc, r.value) for r in df.collect()) == Counter([(files[0], "Foo bar"), (files[0], "foo")] * 2 + [(files[1], "BAR baz")])
    with pytest.warns(UserWarning, match="unreadable"):
        assert read_text(spark, ["/no/such", files[1]]).count() == 1
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(NoReadableInput):
            read_text(spark, ["/no/such"])
    got = [tuple(r) for r in input_manifest(spark, [*files, "/no/such"], 4).collect()]
    assert [g[2:] for g in got] == [(11, 3), (8, 2), (0, 0), (0, 0)]


def test_relative_paths_come_back_as_written(spark, files, monkeypatch):
    monkeypatch.chdir(os.path.dirname(files[0]))
    assert {r.doc for r in read_text(spark, ["./a.txt", "b c.txt"]).collect()} == {"./a.txt", "b c.txt"}


def test_token_across_a_chunk_edge(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("x" * 262_140 + " straddling " + "y" * 600_000 + "\nend")
    from keyloom.functions import tokens

    got = Counter(r.word for r in tokens(read_text(spark, [str(path)]), "value").collect())
    assert got == {"x" * 255: 1, "straddling": 1, "y" * 255: 1, "end": 1}


@pytest.mark.parametrize("reducers", [1, 7, 40])
def test_run_writes_sorted_parts_and_a_report(spark, files, tmp_path, reducers):
    report = str(tmp_path / "report.txt")
    job = APPS["inverted-index"].with_options(reducers=reducers, output_dir=str(tmp_path / "out"), metrics_file=report)
    result = run(spark, job, files)
    out = output(result.output_dir)
    assert sorted(x for v in out.values() for x in v) == [f"bar -> [{files[0]}, {files[1]}]", f"baz -> [{files[1]}]", f"foo -> [{files[0]}]"]
    assert all(v == sorted(v) and v for v in out.values()) and list(out) == result.files
    assert result.metrics.emits == 5 and result.metrics.keys == 3
    assert "keys: 3" in open(report).read()
    run(spark, replace(job, clear_output=False, metrics_file=None), files)
    assert sum(map(len, output(result.output_dir).values())) == 6
    run(spark, job, files)
    assert output(result.output_dir) == out


def test_opaque_job_and_combiner_switch(spark, files, tmp_path, monkeypatch):
    job = Job(mapper=map_words, reducer=POSTINGS, combiner=dedup, reducers=3, output_dir=str(tmp_path / "o"), metrics_file=None)
    want = output(run(spark, job, files).output_dir)
    assert sum(map(len, want.values())) == 3
    monkeypatch.setenv("MR_DISABLE_COMBINER", "1")
    assert job.effective_combiner() is None
    assert output(run(spark, job, files).output_dir) == want
    monkeypatch.setenv("MR_DISABLE_COMBINER", "yes")
    assert job.effective_combiner() is dedup


def test_opaque_rows_lie_where_their_keys_were_reduced(spark, tmp_path):
    (tmp_path / "t.txt").write_text("alpha beta gamma delta alpha")
    count = PythonReducer(lambda k, vs, p: [(sum(1 for _ in vs), k), (0, k)], "n int, word string")
    job = Job(mapper=map_words, reducer=count, reducers=7, output_dir=str(tmp_path / "o"), metrics_file=str(tmp_path / "r"))
    result = run(spark, job, [str(tmp_path / "t.txt")])
    want = {}
    for word, n in (("alpha", 2), ("beta", 1), ("delta", 1), ("gamma", 1)):
        h = 5381
        for c in word.encode():
            h = (h * 33 + c) % 2**64
        want.setdefault(f"part-{h % 7:05d}.txt", []).extend([f"{n}\t{word}", f"0\t{word}"])
    assert output(result.output_dir) == dict(sorted(want.items()))
    assert result.metrics.keys == 4 and result.metrics.emits == 5
    report = open(tmp_path / "r").read()
    assert "keys: 4" in report and "pairs emitted: 5" in report and "rows: 5" in report.split("Flush")[1]
    run(spark, replace(job, clear_output=False), [str(tmp_path / "t.txt")])
    assert "keys: 4" in open(tmp_path / "r").read()  # reduced now, not what lies in the files


@pytest.mark.parametrize("app", list(APPS))
def test_combiner_switch_changes_what_the_apps_ship(spark, tmp_path, monkeypatch, app):
    (tmp_path / "t.txt").write_text("foo foo foo bar\n" * 5)
    job = APPS[app].with_options(reducers=3, output_dir=str(tmp_path / "o"), metrics_file=str(tmp_path / "r"))
    combined = run(spark, job, [str(tmp_path / "t.txt")])
    want = output(combined.output_dir)
    monkeypatch.setenv("MR_DISABLE_COMBINER", "1")
    plain = run(spark, job, [str(tmp_path / "t.txt")])
    assert output(plain.output_dir) == want
    assert combined.metrics.shuffle_rows == 2 and plain.metrics.shuffle_rows == plain.metrics.emits == combined.metrics.emits == 20


def test_a_job_that_fails_leaves_earlier_output(spark, files, tmp_path):
    job = APPS["word-count"].with_options(reducers=2, output_dir=str(tmp_path / "o"), metrics_file=None)
    want = output(run(spark, job, files).output_dir)
    bad = Job(mapper=lambda v, d: [("k", 1 // 0)], reducer=POSTINGS, reducers=2, output_dir=str(tmp_path / "o"), metrics_file=None)
    with pytest.raises(Exception, match="ZeroDivision"):
        run(spark, bad, files)
    assert output(str(tmp_path / "o")) == want


def test_word_count_app(spark, files, tmp_path):
    result = run(spark, APPS["word-count"].with_options(reducers=2, output_dir=str(tmp_path / "w"), metrics_file=str(tmp_path / "m")), files)
    assert sorted(x for v in output(result.output_dir).values() for x in v) == ["bar: 2", "baz: 1", "foo: 2"]


def test_cli(files):
    job, paths = parse(["-i", "5", "-m", "5", "-r", "10", "-o", "x", "-p", "y", "-v", *files], APPS["word-count"])
    assert (job.readers, job.mappers, job.reducers, job.output_dir, job.metrics_file, job.verbose) == (5, 5, 10, "x", "y", True) and paths == files
    for bad in (["-r", "0"], ["-i", "11"], ["-m", "1001"]):
        with pytest.raises(ValueError):
            parse([*bad, "f"], APPS["word-count"])
    for bad in (["-r", "x", "f"], []):
        with pytest.raises(SystemExit):
            parse(bad, APPS["word-count"])
    with pytest.warns(UserWarning, match="unknown"):
        parse(["--what", "f"], APPS["word-count"])


def test_cli_end_to_end(spark, files, tmp_path, capsys):
    assert main(["word-count", "-r", "2", "-o", str(tmp_path / "o"), "-p", str(tmp_path / "r"), *files]) == 0
    assert "3 inputs, 1 readers, 20 mappers, 2 reducers" in capsys.readouterr().err
    assert main(["no-such-app"]) == 1


def test_job_needs_its_functions():
    with pytest.raises(ValueError, match="mapper"):
        Job().validate()
    assert Job().reducers == 40 and Job().mappers == 20 and Job().readers == 1


def test_single_sorted_file_and_empty_report(spark, tmp_path):
    df = spark.createDataFrame([("b", "2"), ("B", "1"), ("10", "0")], "k string, line string")
    write_single(df, "k", "line", str(tmp_path / "s" / "one.txt"))
    assert (tmp_path / "s" / "one.txt").read_text() == "0\n1\n2\n"
    assert "bytes per chunk: 0.0" in Metrics().report()
