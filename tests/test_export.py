"""The CSV hand-off: round trip, and exports that are not whole."""

from __future__ import annotations

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import CUR, PRI
from segmetrics.operators.blocks import demographic_pull
from segmetrics.sources.export import IncompleteExport, export_csv, export_manifest, read_export


@pytest.fixture
def written(spark, hh, tmp_path):
    pull = demographic_pull(hh, (CUR, PRI)).repartition(4)
    path = str(tmp_path / "pull")
    export_csv(pull, path)
    return pull, path


def parts(path):
    return sorted(glob.glob(f"{path}/part-*.csv"))


def test_export_comes_back_with_types_and_values(spark, written):
    pull, path = written
    back = read_export(spark, path)
    assert back.dtypes == pull.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, pull.collect()))
    manifest = export_manifest(spark, path)
    assert manifest["rows"] == pull.count() and manifest["multiline"] is False


def test_export_without_its_manifest_is_refused(spark, written, tmp_path):
    _, path = written
    cut = str(tmp_path / "cut")
    shutil.copytree(path, cut, ignore=shutil.ignore_patterns("_manifest"))
    with pytest.raises(IncompleteExport, match="did not end"):
        read_export(spark, cut)


def test_export_that_lost_a_file_is_refused(spark, written, tmp_path):
    _, path = written
    lost = os.path.basename(parts(path)[0])
    cut = str(tmp_path / "cut")
    shutil.copytree(path, cut, ignore=shutil.ignore_patterns(lost, f".{lost}.crc"))
    with pytest.raises(IncompleteExport, match="manifest says"):
        read_export(spark, cut)


@pytest.mark.parametrize("change", ["cut off", "one value", "one row twice"])
def test_changed_files_are_refused(spark, written, tmp_path, change):
    _, path = written
    copy = str(tmp_path / "copy")
    shutil.copytree(path, copy, ignore=shutil.ignore_patterns("*.crc"))
    part = parts(copy)[0]
    lines = open(part).read().splitlines(keepends=True)
    if change == "cut off":
        lines = lines[: len(lines) // 2]
    elif change == "one value":
        cells = lines[1].split(",")
        cells[1] = str(int(cells[1] or 0) + 1)
        lines[1] = ",".join(cells)
    else:
        lines[1] = lines[2]
    open(part, "w").write("".join(lines))
    with pytest.raises(IncompleteExport):
        read_export(spark, copy)


def test_awkward_values(spark, tmp_path):
    rows = [
        (1, None, None, None, None),
        (2, "", 0.1 + 0.2, dt.date(1, 2, 3), dt.datetime(2024, 1, 2, 3, 4, 5, 678901)),
        (3, ' lead "quoted", and, commas\\ ', float("-inf"), dt.date(9999, 12, 31), None),
        (4, "two\nlines\r\nand é日", 5e-324, None, dt.datetime(1970, 1, 1)),
        (4, "two\nlines\r\nand é日", 5e-324, None, dt.datetime(1970, 1, 1)),
        (None, "\\", -0.0, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, t string, x double, d date, at timestamp")
    export_csv(df, str(tmp_path / "out"))
    assert export_manifest(spark, str(tmp_path / "out"))["multiline"] is True
    assert sorted(map(repr, read_export(spark, str(tmp_path / "out")).collect())) == sorted(map(repr, df.collect()))


def test_empty_export_and_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([], "k int, t string")
    export_csv(df, path)
    assert read_export(spark, path).count() == 0 and export_manifest(spark, path)["rows"] == 0
    export_csv(spark.createDataFrame([(1, "a")], "k int, t string"), path, mode="overwrite")
    assert read_export(spark, path).collect() == [(1, "a")]
    with pytest.raises(ValueError, match="as a whole"):
        export_csv(df, path, mode="append")


def test_overwrite_that_fails_leaves_no_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    export_csv(spark.range(5), path)
    with pytest.raises(Exception):  # noqa: B017
        export_csv(spark.range(5).select(F.raise_error(F.lit("stop")).cast("string").alias("id")), path, mode="overwrite")
    with pytest.raises(IncompleteExport):
        read_export(spark, path)
