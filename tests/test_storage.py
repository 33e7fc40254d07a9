import os

import pytest

from facetra import storage


def test_stored_tables_are_removed_but_for_those_in_use(spark):
    at = storage.mark()
    a, b = storage.stored(spark.range(5), "a"), storage.stored(spark.range(7), "b")
    path = b.inputFiles()[0].replace("file://", "")
    storage.clean(at, a)
    assert a.count() == 5 and not os.path.exists(path)
    storage.clean(at)
    assert storage.mark() == at


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_derived_tables_are_written_once(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    assert storage.derived(spark, "t", "here", build).count() == storage.derived(spark, "t", "here", build).count() == 3
    assert made == [1]
    storage.refresh("here")
    assert storage.derived(spark, "t", "here", build).count() == 3 and made == [1, 1]
