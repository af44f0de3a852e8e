"""Near-duplicate vectors through an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import stage_table
from quillmark.llm.components import connected_components, star_forest
from quillmark.llm.vectors import component_type, cosines, matrix, norms, plain, units, usable

#: Leading principal dimensions that order the rows and bound the blocks.
LEADING = 12
#: Rows of a segment of the sequence, and of an interval that is compared without another split.
SEGMENT_ROWS, LEAF_ROWS = 1024, 64
#: Consecutive segments that travel together when segments meet.
TILE_SEGMENTS = 8
#: Least width of the cells of the second dimension, under which segments meet.
SECOND_CELL = 0.25
#: Slack for rounding in the bounds; survivors are verified exactly.
SLACK = 1e-6
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def principal_axes(rows: DataFrame, dimensions: int) -> np.ndarray:
    """The principal axes of all unit vectors, from sums of products over every row."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            x = units(matrix(batch.column(0), dimensions))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "products"])

    parts = rows.select("v").mapInArrow(sums, "i int, products array<double>")
    summed = parts.select("i", F.posexplode("products").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    products = np.zeros((dimensions, dimensions))
    for r in summed.collect():
        products[r["i"], r["j"]] = r["x"]
    _, axes = np.linalg.eigh(products)
    return axes[:, ::-1].T


def near_duplicates(
    df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", leading: int = LEADING
) -> DataFrame:
    """A row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors with the same label and a cosine of at least ``threshold`` are linked. Unusable vectors
    (null, empty, zero, or with a null or non-finite component), a null label and a lone number
    of dimensions link with nothing. ``component_id`` is the smallest id reachable, the row's own
    included; ``kept`` says that it is the row's own. Repeated rows are rows: they link with each
    other. A null id has a null ``kept``, and its component's smallest id.

    Equal vectors of a label, told by 128 bits of hashes, are one point with a weight, so their links
    are counted, not listed. Points are sorted by label and by the cells, as wide as the threshold's
    distance, that their leading principal coordinates fall in, and cut into segments. Segments
    whose boxes are too far apart in some leading dimension cannot hold a link and never meet; the
    others meet in tiles, each pair in one task, where intervals are halved and skipped in the same
    way and what is left is verified by cosine. A task gives link counts and a spanning forest.
    ``df`` is read twice; columns besides these three are ignored.
    """
    kind = component_type((df, vector))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), plain(vector, kind).alias("v"))
    joins = usable(F.col("v")) & F.col("label").isNotNull()
    hashes = {"h": F.when(joins, F.xxhash64("v")), "g": F.when(joins, F.xxhash64(F.lit(1), "v"))}
    rows, same = rows.withColumns(hashes), ["label", "h", "g"]
    points = rows.where(F.col("h").isNotNull()).groupBy(*same).agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    points = stage_table(points.withColumn("point", F.monotonically_increasing_id()), "points")
    linked = stage_table(_linked_points(points, threshold, leading, kind), "links")
    counts = linked.groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n"))
    labels = connected_components(linked.select("a", "b"))
    named = points.select("point", *same, "weight", "least").join(counts, "point", "left").join(labels.withColumnRenamed("node", "point"), "point", "left")
    named = stage_table(named.withColumn("component", F.coalesce("component", "point")), "named")
    smallest = stage_table(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    told = named.join(smallest, "component").select(*same, (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", *same).join(stage_table(told, "told"), same, "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked_points(points: DataFrame, threshold: float, leading: int, kind: str) -> DataFrame:
    """(a, b, n): a's links in one pair of segments weigh n, and b is a point linked with a."""
    schema = "a long, b long, n long"
    parts = [_linked_of_dimension(points, r["d"], threshold, leading, kind) for r in points.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    out = points.sparkSession.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def _linked_of_dimension(points: DataFrame, dimensions: int, threshold: float, leading: int, kind: str) -> DataFrame:
    own = points.where(F.size("v") == dimensions)
    axes = principal_axes(own, dimensions)[: min(leading, dimensions)]
    # unit vectors with this cosine are so far apart
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    cells = [f"c{i}" for i in range(len(axes))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = units(matrix(batch.column(3), dimensions)) @ axes.T
            cell = np.floor(y / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in cell.T]], names=["label", "point", "weight", "v", *cells])

    kinds = dict(own.dtypes)
    schema = f"label {kinds['label']}, point long, weight long, v array<{kind}>, " + ", ".join(f"{c} int" for c in cells)
    order = ["label", *cells, "point"]
    ordered = own.select("label", "point", "weight", "v").mapInArrow(placed, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    width = len(axes)
    stored = np.float32 if kind == "float" else np.float64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive rows of one label, at most `SEGMENT_ROWS`, as one row with their bounds."""
        tile = TaskContext.get().partitionId() << 32
        made = 0
        for batch in batches:
            labels = batch.column(0).to_pylist()
            starts = [0] + [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]] + [len(labels)]
            for a, b in zip(starts, starts[1:]):
                for at in range(a, b, SEGMENT_ROWS):
                    part = batch.slice(at, min(SEGMENT_ROWS, b - at))
                    x = matrix(part.column(3), dimensions)
                    y = units(x) @ axes.T
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([labels[at]], batch.column(0).type),
                            pa.array([part.column(1)[0].as_py()], pa.int64()),
                            pa.array([tile + made // TILE_SEGMENTS], pa.int64()),
                            pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())),
                            pa.array([part.column(2).to_pylist()], pa.list_(pa.int64())),
                            pa.array([x.astype(stored).tobytes()], pa.binary()),
                            pa.array([y.min(axis=0)], pa.list_(pa.float64())),
                            pa.array([y.max(axis=0)], pa.list_(pa.float64())),
                        ],
                        names=["label", "segment", "tile", "points", "weights", "x", "low", "high"],
                    )
                    made += 1

    made = f"label {kinds['label']}, segment long, tile long, points array<long>, weights array<long>, x binary, low array<double>, high array<double>"
    segments = stage_table(ordered.mapInArrow(cut, made), "segments")
    # Segments meet in the cells of the leading two dimensions that both reach; the first such cell has the pair.
    sides = list(zip(range(1, width + 1), (epsilon, max(epsilon, SECOND_CELL))))
    reach = lambda i, size: (F.floor(F.element_at("low", i) / size), F.floor((F.element_at("high", i) + epsilon) / size))
    boxes = segments.select("label", "segment", "tile", "low", "high", *[reach(i, size)[0].alias(f"from{i}") for i, size in sides])
    for i, size in sides:
        boxes = boxes.withColumn(f"cell{i}", F.explode(F.sequence(*reach(i, size))))
    p, q = boxes.alias("p"), boxes.alias("q")
    near = F.forall(
        F.sequence(F.lit(1), F.lit(width)),
        lambda i: (F.element_at(F.col("p.low"), i) <= F.element_at(F.col("q.high"), i) + epsilon)
        & (F.element_at(F.col("q.low"), i) <= F.element_at(F.col("p.high"), i) + epsilon),
    )
    meets = (F.col("p.label") == F.col("q.label")) & (F.col("p.segment") <= F.col("q.segment")) & near
    for i, _ in sides:
        meets &= (F.col(f"p.cell{i}") == F.col(f"q.cell{i}")) & (F.col(f"p.cell{i}") == F.greatest(f"p.from{i}", f"q.from{i}"))
    tiles = F.least("p.tile", "q.tile").alias("i"), F.greatest("p.tile", "q.tile").alias("j")
    wanted = p.join(q, meets).select(*tiles, F.explode(F.array("p.segment", "q.segment")).alias("segment")).distinct()
    met = stage_table(wanted, "met").join(segments.select("segment", "tile", "points", "weights", "x"), "segment")

    def join(table: pa.Table) -> pa.Table:
        """All pairs of segments of the two tiles, of one tile each pair once."""
        rows = table.sort_by("segment").to_batches()
        held = [(b.column("tile")[k].as_py(), _Segment({c: b.column(c)[k] for c in ("points", "weights", "x")}, dimensions, axes, stored)) for b in rows for k in range(len(b))]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found = []
        for m, (tile, s) in enumerate(held):
            if tile == i:
                for n, (other, t) in enumerate(held):
                    if other == j and (i != j or m <= n):
                        found += _join_segments(s, t, m == n, epsilon, threshold)
        return pa.Table.from_batches(found, LINK)

    return met.select("i", "j", "segment", "tile", "points", "weights", "x").groupBy("i", "j").applyInArrow(join, "a long, b long, n long")


class _Segment:
    """The rows of a segment: points, weights, vectors and leading coordinates."""

    def __init__(self, value: dict[str, pa.Scalar], dimensions: int, axes: np.ndarray, stored: type):
        self.points = value["points"].values.to_numpy()
        self.weights = value["weights"].values.to_numpy()
        self.x = np.frombuffer(value["x"].as_py(), stored).reshape(-1, dimensions).astype(float)
        self.unit = self.x / norms(self.x)[:, None]
        self.y = self.unit @ axes.T


def _join_segments(s: _Segment, t: _Segment, same: bool, epsilon: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """Halve the intervals of two segments while their boxes may hold a link; compare what is left."""
    todo = [(0, len(s.points), 0, len(t.points))]
    lefts, rights = [], []
    while todo:
        a, b, c, d = todo.pop()
        if same and c + d < a + b:
            continue  # the mirror interval has these pairs
        if (s.y[a:b].min(axis=0) > t.y[c:d].max(axis=0) + epsilon).any() or (t.y[c:d].min(axis=0) > s.y[a:b].max(axis=0) + epsilon).any():
            continue
        if max(b - a, d - c) > LEAF_ROWS:
            i, j = (a + b) // 2, (c + d) // 2
            first = [(a, i), (i, b)] if b - a > LEAF_ROWS else [(a, b)]
            second = [(c, j), (j, d)] if d - c > LEAF_ROWS else [(c, d)]
            todo += [(*u, *v) for u in first for v in second]
            continue
        u, v = np.nonzero(s.unit[a:b] @ t.unit[c:d].T >= threshold - SLACK)
        u, v = u + a, v + c
        if same:
            u, v = u[u < v], v[u < v]
        exact = cosines(s.x[u], t.x[v]) >= threshold
        lefts.append(u[exact])
        rights.append(v[exact])
    u, v = (np.concatenate(x) if x else np.empty(0, int) for x in (lefts, rights))
    if not len(u):
        return
    n_left = np.bincount(u, weights=t.weights[v], minlength=len(s.points)).astype(np.int64)
    n_right = np.bincount(v, weights=s.weights[u], minlength=len(t.points)).astype(np.int64)
    node, root = star_forest(s.points[u], t.points[v])
    to = dict(zip(node.tolist(), root.tolist()))
    for points, n in ((s.points, n_left), (t.points, n_right)):
        some = np.flatnonzero(n)
        if len(some):
            linked = points[some]
            yield pa.RecordBatch.from_arrays([pa.array(linked), pa.array([to.get(p, p) for p in linked.tolist()], pa.int64()), pa.array(n[some])], names=["a", "b", "n"])
