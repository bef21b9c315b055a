import pytest

from cartwise import session


def test_scratch_tables_are_removed_together(spark):
    with session.scratch(spark, "job") as folder:
        a = session.stage(spark.range(3), "a")
        with session.scratch(spark, "inner"):
            b = session.stage(spark.range(4), "b")
    outside = session.stage(spark.range(5), "c")
    assert (a.count(), b.count()) == (3, 4)
    session.remove(spark, folder)
    for gone in (a, b):
        with pytest.raises(Exception):
            gone.select("id").collect()
    assert outside.count() == 5
