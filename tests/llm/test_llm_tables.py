"""Intermediate tables and keys of rows."""

import os
import re

from textloom.llm import _spark


def folders(df):
    return {os.path.dirname(re.sub("^file:/*", "/", f)) for f in df.inputFiles()}


def test_scratch_deletes_what_is_not_taken_out(spark):
    with _spark.scratch(spark) as paths:
        a, b = (_spark.written(spark.range(5), n) for n in "ab")
        stays = paths.pop()
        gone = folders(a)
    assert not any(os.path.exists(p) for p in gone) and b.count() == 5 and all(p.endswith(os.path.basename(stays)) for p in folders(b))


def test_keys_stay_the_same(spark):
    files = _spark.written(spark.range(0, 1000, 1, 7).selectExpr("id", "cast(id % 3 as string) as t"), "table")
    assert _spark._is_scan(files) and _spark._is_scan(files.where("id > 5").select("t")) and not _spark._is_scan(files.join(files, "id")) and not _spark._is_scan(files.selectExpr("rand() r"))
    for df in (files, files.repartition(5, "t"), files.where("t != '1'")):
        keyed = _spark.keyed(df.select("id", "t"))
        one, two = (dict(map(tuple, keyed.select("id", "row").collect())), dict(map(tuple, keyed.where("id % 2 = 0").select("id", "row").collect())))
        assert len(set(one.values())) == len(one) == df.count() and all(one[i] == r for i, r in two.items())
    assert _spark.plain(files).columns == ["c0", "c1"]
