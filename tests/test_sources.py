import pytest
from helpers import person
from jointflow.operators.detections import parse_detections
from jointflow.operators.hooks import detect_with
from jointflow.schema import DETECTIONS, PERSON
from jointflow.session import checkpoint_root, shared_folder
from jointflow.sources import detections as io
from test_detections import frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_split_by_video_and_pruned(spark, tmp_path):
    path = str(tmp_path / "people")
    people = [{"video_id": f"v{i % 5}", "frame_idx": i} for i in range(200)]
    io.write_states(person(spark, people), path)
    back = io.read_table(spark, path, PERSON)
    assert back.count() == 200 and back.columns == PERSON.fieldNames()
    one = back.filter("video_id = 'v3' AND frame_idx > 100").select("frame_idx")
    assert one.count() == 20
    text = plan(one)
    assert "PartitionFilters: [isnotnull(video_id" in text
    assert "GreaterThan(frame_idx,100)" in text
    assert "keypoints" not in text and "bbox" not in text


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_scan_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([frame(0, 3), frame(1, 2, ids=None)], DETECTIONS)
    df.write.format(fmt).save(str(tmp_path / fmt))
    back = io.scan_detections(spark, str(tmp_path / fmt), fmt)
    assert parse_detections(back).count() == 3
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_stream_of_detections(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([frame(i, 2)], DETECTIONS).write.mode("append").parquet(folder)
    people = parse_detections(io.stream_detections(spark, folder, max_files=1))
    query = io.stream_states(people, out, str(tmp_path / "c"))
    assert query.awaitTermination(120)
    assert len(query.recentProgress) >= 3
    assert spark.read.parquet(out).count() == 6


def test_detector_on_files(spark, tmp_path):
    """Frames as binary files, a model that is set up once per task."""
    for i in range(5):
        (tmp_path / f"{i}.raw").write_bytes(bytes([i]) * (i + 1))
    frames = spark.read.format("binaryFile").load(str(tmp_path / "*.raw"))

    def setup():
        import pandas as pd

        def detect(batch):
            rows = [
                ("v", content[0], None, [dict(x1=0.0, y1=0.0, x2=float(len(content)), y2=1.0)], [0.9], [1], None, None)
                for content in batch["content"]
            ]
            return pd.DataFrame(rows, columns=DETECTIONS.fieldNames())

        return detect

    people = parse_detections(detect_with(frames, None, setup=setup)).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.bbox.x2) for r in people] == [(i, i + 1.0) for i in range(5)]


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    """Only what the lookup asks a session for."""

    def __init__(self, context, setting=None):
        self.sparkContext, self.setting, self.conf = context, setting, self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting or default


def test_shared_folder_is_the_session_s(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
    assert shared_folder(spark, "x").startswith(checkpoint_root(spark).rstrip("/") + "/x-")
    named = FakeSession(FakeContext("yarn", "hdfs://b"), "hdfs://a")
    assert checkpoint_root(named) == "hdfs://a"
    assert checkpoint_root(FakeSession(FakeContext("yarn", "hdfs://b"))) == "hdfs://b"
    own = FakeSession(FakeContext("local[2]"))
    assert checkpoint_root(own) == checkpoint_root(own)
    with pytest.raises(ValueError):
        checkpoint_root(FakeSession(FakeContext("yarn")))
