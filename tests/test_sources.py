"""Archives and pages read by tasks, and fitted objects in a folder that only Spark's readers open."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulon.ml import bayes, ensembles, trees
from tabulon.sources import files


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_archives(spark, tmp_path):
    archive(tmp_path / "a.zip", {"one.csv": '﻿k,name,x\n1,"a, ""b""\nc",2.5\n2,,oops\n', "in/two.csv": "k,name,x\n3,short\n\n", "note.txt": "k\n9\n", "empty.csv": ""})
    archive(tmp_path / "b.zip", {"one.csv": "k,name,x\n" + "".join(f"{i},n{i},{i / 4}\n" for i in range(10, 25_010))})
    found = files.read_archives(spark, str(tmp_path / "*.zip"), "k int, name string, x double")
    assert found.rdd.getNumPartitions() >= 1 and found.count() == 25_003
    small = {(r.archive.split("/")[-1], r.member, r.k, r.name, r.x) for r in found.filter("k < 10").collect()}
    assert small == {("a.zip", "one.csv", 1, 'a, "b"\nc', 2.5), ("a.zip", "one.csv", 2, None, None), ("a.zip", "in/two.csv", 3, "short", None)}
    assert found.filter("k >= 10").agg(F.sum("x")).first()[0] == sum(range(10, 25_010)) / 4
    assert files.read_archives(spark, str(tmp_path / "a.zip"), "k int", "in/*").count() == 1


def test_pages(spark, tmp_path):
    """Each page is fetched in a task; a page that fails is fetched again, one that isn't there has no rows."""

    def fetch(number):
        seen = tmp_path / f"seen-{number}"
        if number == 3 and not seen.exists():
            seen.touch()
            raise TimeoutError("again")
        if number == 5:
            return None
        return json.dumps({"result": [{"id": number * 10 + i, "name": f"n{i}"} for i in range(number)], "next": number + 1})

    rows = files.read_pages(spark, fetch, 7, "id int, name string")
    assert rows.rdd.getNumPartitions() == 7
    (tmp_path / "seen-3").unlink(missing_ok=True)
    assert sorted(map(tuple, rows.collect())) == [(p, p * 10 + i, f"n{i}") for p in range(7) if p != 5 for i in range(p)]
    assert files.read_pages(spark, fetch, 0, "id int").count() == 0

    def broken(number):
        raise ConnectionError("gone")

    with pytest.raises(Exception, match="gone"):
        files.read_pages(spark, broken, 1, "id int").collect()


def test_saved_ensembles(spark, tmp_path):
    """Forests, boosted trees and models with tables come back equal, through paths of Spark's file systems."""
    rng = random.Random(1)
    df = spark.createDataFrame([(i, x := rng.random(), rng.random(), "yes" if x > 0.4 else "no", x * 2, rng.randint(0, 4)) for i in range(120)], "k int, a double, b double, c string, y double, g int")
    at = "file://" + str(tmp_path)
    forest = trees.grow_forest(df, ["a", "b"], "c", "k", 3, continuous=True, max_depth=3)
    boosted, voted = ensembles.gradient_boosting(df, ["a", "b"], "y", 3, 0.5, 2), ensembles.adaboost(df, ["b"], "c", 3, 2)
    for i, model in enumerate((forest, boosted, voted)):
        files.save_fitted(model, f"{at}/m{i}")
        back = files.load_fitted(f"{at}/m{i}")
        assert back == model
        assert model.transform(df).exceptAll(back.transform(df)).isEmpty()
    table = bayes.categorical_nb(df.withColumn("label", F.col("k") % 3), ["g", "c"], "label")
    files.save_fitted(table, f"{at}/nb")
    back = files.load_fitted(f"{at}/nb")
    assert back.priors == table.priors and all(isinstance(k, int) for k in back.priors)
    assert table.transform(df, "k").exceptAll(back.transform(df, "k")).isEmpty()


def test_a_later_version(spark):
    from tabulon.ml.preprocess import Fitted, Scaled

    held = json.loads(Scaled(["a"], [0.0], [1.0]).to_json())
    assert Fitted.from_json(json.dumps({k: v for k, v in held.items() if k != "version"})) == Scaled(["a"], [0.0], [1.0])
    with pytest.raises(ValueError, match="later"):
        Fitted.from_json(json.dumps(held | {"version": 99}))
