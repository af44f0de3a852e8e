import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import common
from quillmark.llm.components import connected_components
from quillmark.shipping import ship


class Session:
    """Stands for a session with or without the setting, on a cluster."""

    def __init__(self, named=None, master="spark://host:7077"):
        self.named = named
        self.conf = self
        self.sparkContext = type("Context", (), {"master": master})()

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named or default

    def set(self, key, value):
        self.named = value


def test_shared_folder_is_the_named_one():
    assert common.shared_dir(Session("hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        common.shared_dir(Session())
    own = Session(master="local[2]")
    assert common.shared_dir(own).startswith("file://") and common.shared_dir(own) == own.named


def test_stage_tables_keep_rows_and_schema(spark):
    rows = spark.createDataFrame([(1, ["a"]), (None, None), (1, ["a"])], "a long, b array<string>")
    again = common.stage_table(rows, "rows")
    assert sorted(again.collect(), key=repr) == sorted(rows.collect(), key=repr) and again.schema == rows.schema
    assert common.stage_table(rows.limit(0), "none").count() == 0
    assert common.drop_stage_tables(spark) and not common.drop_stage_tables(spark)


def test_worker_cache_keeps_one_thing():
    made = []
    for key in ("a", "a", "b", "a"):
        common.worker_cache(key, lambda: made.append(key) or key)
    assert made == ["a", "b", "a"]


def test_list_rows_are_the_lists():
    column = pa.chunked_array([pa.array([[1, 2], [], [3]], pa.list_(pa.int32())), pa.array([[4]], pa.list_(pa.int32()))])
    assert [x.tolist() for x in common.list_rows(column)] == [[1, 2], [], [3], [4]]
    assert common.list_rows(column)[0].dtype == np.int32


def test_shipping_twice_is_harmless(spark):
    ship(spark)
    ship(spark)
    assert spark.range(1).rdd.map(lambda _: __import__("quillmark").__name__).collect() == ["quillmark"]


def test_batches_are_bounded_unless_smaller(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, "67108864b")
    try:
        for held, want in (("64m", 8 << 20), ("1g", 8 << 20), ("67108864b", 8 << 20), ("4m", 4 << 20), (str(1 << 20), 1 << 20)):
            spark.conf.set(name, held)
            common.small_batches(spark)
            assert spark.conf.get(name).rstrip("b") in (str(want), held)
    finally:
        spark.conf.set(name, before)


def test_components_of_hubs_chains_and_small_groups(spark):
    rng = np.random.default_rng(5)
    hub = [(7, 100 + i) for i in range(3000)]
    chain = [(5000 + i, 5001 + i) for i in range(300)]
    small = [(10_000 + 3 * i, 10_000 + 3 * i + int(k)) for i in range(7000) for k in rng.integers(0, 3, 2)]
    edges = hub + chain + small + [(3, 5150), (3, 150), (9, 9)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()}
    label: dict[int, int] = {}
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start] if start not in label else []
        while todo:
            node = todo.pop()
            if node not in label:
                label[node] = start
                todo += near[node]
    assert found == label
