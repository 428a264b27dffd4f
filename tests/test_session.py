import os

import pytest

from tessera import session


def test_a_run_removes_what_it_stored(spark, tmp_path):
    before = session.stored(spark.range(3), "kept")
    with session.scratch(spark) as folder:
        inside = session.stored(spark.range(5), "inside")
        assert os.listdir(folder)[0].startswith("inside-") and inside.count() == 5
        with session.scratch(spark) as inner:
            session.stored(spark.range(2), "deep")
            assert inner != folder and os.path.isdir(inner)
        assert not os.path.exists(inner) and inside.count() == 5
        inside.write.parquet(str(tmp_path / "result"))
    assert not os.path.exists(folder) and before.count() == 3 and spark.read.parquet(str(tmp_path / "result")).count() == 5
    with pytest.raises(ValueError), session.scratch(spark) as folder:
        session.stored(spark.range(2), "lost")
        raise ValueError
    assert not os.path.exists(folder)
