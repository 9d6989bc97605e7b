import pytest
from pyspark.sql import functions as F

from daftar import session


def test_cut_and_small(spark):
    df = session.cut(spark.range(10).selectExpr("id", "cast(null as string) as s"))
    assert df.count() == 10 and "parquet" in df._jdf.queryExecution().toString().lower()
    assert session.small(df, 10) and not session.small(df, 9)
    assert session.scratch_dir(spark) == session.scratch_dir(spark)


def test_build_session_keeps_settings(spark):
    s = session.build_session(spark__sql__shuffle__partitions="4")
    assert s.conf.get("spark.sql.session.timeZone") == "UTC"


def test_cut_tables_lie_in_the_shared_folder_and_are_released(spark):
    df = session.cut(spark.range(3))
    at = df.select(F.input_file_name()).first()[0]
    assert session.own_folder(spark).split("://")[-1] in at and spark.conf.get("spark.checkpoint.dir").split("://")[-1] in at
    session.release(spark)
    with pytest.raises(Exception):
        df.count()
    assert session.cut(spark.range(3)).count() == 3


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        session.scratch_dir(Cluster())
