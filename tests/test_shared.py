"""Intermediate tables in the shared folder."""

import os

import pytest

from cellweave.plans import storage


def test_cut_and_free(spark):
    keep = storage.Scratch(spark)
    a = keep.cut(spark.range(5), "a")
    b = keep.cut(a.where("id > 2"), "b")
    assert sorted(r[0] for r in b.collect()) == [3, 4]
    (path,) = {os.path.dirname(f) for f in a.inputFiles()}
    keep.free(a)
    assert not os.path.exists(path.removeprefix("file://")) and b.count() == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Other:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://head:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(Other())
