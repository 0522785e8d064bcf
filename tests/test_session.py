"""Where jobs may write."""

import os
import subprocess
import sys
import uuid
from types import SimpleNamespace

import pytest

from pagetally.session import discard, scratch, shared_dir
from pagetally.sources.tables import materialize


class FakePath:
    def __init__(self, path):
        self.path = path

    def getFileSystem(self, _):
        scheme = self.path.split(":")[0] if ":" in self.path else "file"
        return SimpleNamespace(getScheme=lambda: scheme)


def session(master, **settings):
    java = SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(hadoop=SimpleNamespace(
        fs=SimpleNamespace(Path=FakePath)))))
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: settings.get(key.split(".")[-2], default)),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        _jvm=java, _jsc=SimpleNamespace(hadoopConfiguration=lambda: None),
    )


def test_the_configured_folder_is_used():
    got = shared_dir(session("spark://host:7077", checkpoint="hdfs://shared/checkpoints/"), "x")
    assert got.startswith("hdfs://shared/checkpoints/pagetally/app-1/x-")


def test_every_name_is_new():
    spark = session("local[2]", checkpoint="/shared")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


@pytest.mark.parametrize("folder", ["/tmp/x", "file:///tmp/x"])
def test_a_local_folder_is_refused_on_a_cluster(folder):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn", checkpoint=folder), "x")


def test_the_warehouse_stands_in_for_a_missing_setting():
    got = shared_dir(session("yarn", warehouse="s3a://lake/warehouse"), "x")
    assert got.startswith("s3a://lake/warehouse/pagetally/app-1/x-")


def test_intermediate_folders_are_gone_when_the_process_has_ended(tmp_path):
    code = f"""
from pagetally.session import build_session
from pagetally.sources.tables import materialize
spark = build_session(master="local[1]", extra={{
    "spark.checkpoint.dir": "{tmp_path}", "spark.ui.enabled": "false"}})
assert materialize(spark.range(3), "x").count() == 3
import os
print("files", sum(len(f) for _, _, f in os.walk("{tmp_path}")))
spark.stop()
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout.split("files ")[1].split()[0]) > 0
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]


def test_discarded_folders_are_gone(spark, tmp_path):
    path = f"{tmp_path}/x"
    spark.range(3).write.parquet(path)
    discard(spark, path)
    assert not os.path.exists(path)


def test_materialize_keeps_rows_types_and_nulls(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 00:00:00.000001', 'a'), (2, NULL, NULL) t(a, b, c)"
    )
    again = materialize(df, "test")
    assert again.dtypes == df.dtypes
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def test_materialize_of_nothing_can_be_read(spark):
    assert materialize(spark.range(5).where("id > 9"), "test").isEmpty()


def folders(root):
    return sorted(d for path, names, _ in os.walk(root) if os.path.basename(path).startswith("local-") for d in names)


def test_a_scratch_block_leaves_only_what_was_made_outside(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    before = folders(root)
    with scratch(spark) as outside:
        inner = materialize(spark.range(5), "inner")
        with scratch(spark) as further:
            materialize(spark.range(2), "innermost")
            with further():
                handed = materialize(spark.range(4), "handed")
        assert handed.count() == 4
        with outside():
            kept = materialize(inner.where("id > 1"), "kept")
        assert len(folders(root)) == len(before) + 3
    assert kept.count() == 3
    assert [d.partition("-")[0] for d in folders(root) if d not in before] == ["kept"]


def test_a_scratch_block_that_fails_leaves_nothing(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    before = folders(root)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialize(spark.range(5), "inner")
        1 / 0  # noqa: B018
    assert folders(root) == before


def cluster(spark, range=None, **settings):
    """The session as a cluster with these folders would have it."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: settings.get(key.split(".")[-2], default)),
        sparkContext=SimpleNamespace(
            master="spark://host:7077", applicationId=f"app-{uuid.uuid4().hex}",
            defaultParallelism=spark.sparkContext.defaultParallelism),
        _jvm=spark._jvm, _jsc=spark._jsc, range=range or spark.range, read=spark.read,
    )


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_a_mount_that_executors_share_is_taken_on_a_cluster(spark, tmp_path, scheme):
    shared = cluster(spark, checkpoint=f"{scheme}{tmp_path}/mount")
    paths = [shared_dir(shared, "x") for _ in range(2)]
    assert all(p.startswith(f"{scheme}{tmp_path}/mount/pagetally/app-") for p in paths) and len(set(paths)) == 2
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]


def test_a_folder_that_misses_what_executors_wrote_is_refused(spark, tmp_path):
    unshared = cluster(spark, lambda *_: spark.range(0, 3, 1, 1), checkpoint=f"{tmp_path}/a", warehouse=f"{tmp_path}/b")
    with pytest.raises(ValueError, match="spark.checkpoint.dir.*/a or .*/b") as refusal:
        shared_dir(unshared, "x")
    assert "sees 3 of 8 files" in str(refusal.value.__cause__)


def test_a_shared_warehouse_stands_in_for_a_folder_that_cannot_be_written(spark, tmp_path):
    (tmp_path / "file").write_text("")
    mixed = cluster(spark, checkpoint=f"{tmp_path}/file/x", warehouse=f"{tmp_path}/warehouse")
    assert shared_dir(mixed, "x").startswith(f"{tmp_path}/warehouse/pagetally/app-")
