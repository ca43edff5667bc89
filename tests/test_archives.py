"""Members of archives, a task each."""

import zipfile

import pytest

from tallywright.sources import archives, benchmarks


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zip") / "some.zip")
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("data/", "")
        for i in range(5):
            out.writestr(zipfile.ZipInfo(f"data/{i}.csv"), "﻿a,b\r\n" + "é,日本\n" * i, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        out.writestr("data/long.txt", "wörter und mehr\n" * 200_000, zipfile.ZIP_DEFLATED)
        out.writestr("data/empty.txt", "")
    return path


def test_members_are_tasks(spark, archive):
    got = archives.members(spark, [archive])
    assert got.rdd.getNumPartitions() == 7
    with zipfile.ZipFile(archive) as source:
        want = {i.filename: source.read(i).decode("utf-8-sig") for i in source.infolist() if not i.is_dir()}
    assert {r.name: r.text for r in got.collect()} == want
    assert {r.name for r in benchmarks.unzipped(spark, "file:" + archive, r"\d\.csv$").collect()} == {f"data/{i}.csv" for i in range(5)}
    assert archives.members(spark, [archive, archive], "4").count() == 2 and archives.members(spark, [archive], "nothing").count() == 0


def test_lines_of_members(spark, archive):
    rows = archives.members(spark, [archive], lines=True)
    assert [(r.line_number, r.line) for r in rows.where("name = 'data/2.csv'").orderBy("line_number").collect()] == [(0, "a,b"), (1, "é,日本"), (2, "é,日本")]
    long = rows.where("name = 'data/long.txt'")
    assert (long.count(), long.distinct().count(), long.select("line").distinct().count()) == (200_000, 200_000, 1)


def test_damage_is_told(spark, archive, tmp_path):
    content = bytearray(open(archive, "rb").read())
    at = content.index("é,日本\n".encode())
    content[at] ^= 1
    content[at + 1] ^= 0
    bad = tmp_path / "bad.zip"
    bad.write_bytes(bytes(content))
    with pytest.raises(Exception, match="damaged|decode"):
        archives.members(spark, [str(bad)]).collect()


def test_file_systems():
    assert archives.placed("file:/a/b.zip")[1] == archives.placed("file:///a/b.zip")[1] == archives.placed("/a/b.zip")[1] == "/a/b.zip"
    with pytest.raises(ValueError):
        archives.placed("wasb://x/y.zip")
