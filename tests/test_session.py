import pytest

from skygrade import session


def test_tables_are_written_to_the_folder_the_cluster_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    df = session.materialise(spark.range(5), "few")
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    assert all(f.startswith(f"file://{folder}/skygrade-") for f in df.inputFiles())


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Cluster:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)


def test_tables_can_be_dropped(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    session.materialise(spark.range(3))
    assert list(tmp_path.iterdir())
    session.drop_tables(spark)
    assert not list(tmp_path.iterdir())
