"""Hard negatives of anchor vectors, found in sort-tile-recursive R-trees.

Rows are dealt to blocks by group of labels and by tiles of a few coordinates, whose cuts come
from a bounded sample. Each block is packed into a tree (``pack``): rows sorted and cut by one
coordinate, each slice by the next one, leaves of ``LEAF`` rows, nodes of ``FAN`` children, each with
its minimum bounding box. A box gives every coordinate an interval and so the inner product with
an anchor a least and a greatest value. A queue takes the box with the greatest possible product
first (``best_first``) and drops boxes that lie outside all score windows or strictly below the
k-th best score of every window, so that ties survive.

An anchor's positives are searched first, in blocks of its label's group, then the negatives in
windows set by the positives' scores, in all blocks. The k-th best of the sample starts each search,
so a block gives back little that is not among the best. Blocks and groups of anchors are bounded;
results are exact for any sample.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no
part; an empty vector takes part, with products of zero; shorter vectors count as padded with
zeros. Anchors equal in id, label and vector are one; other rows of an anchor's id are neither its
positives nor its negatives. Rows that repeat an id are candidates each. Positives with scores
below zero have empty windows. An empty table gives no rows; other columns are not read. Scores are
exact at any size; one that is returned must fit a long.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# Negative scores lie between these hundredths of the positive score.
LOW, HIGH = 30, 90

# Rows the cuts and the first thresholds are taken from.
SAMPLE = 4096
# Rows a block is meant for, anchors that meet a block at once.
BLOCK_ROWS, ANCHOR_ROWS = 4096, 4096
LABEL_GROUPS = 64
# Tiles at most; beyond, a tile's rows are spread over several blocks.
TILES = 1024
LEAF, FAN = 64, 16
# Below it sums of products are exact in floating point.
EXACT = float(1 << 53)

POINT = "id long, label long, v array<double>"
WINDOW = "struct<low: long, high: long, start: double>"


def scaled(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of each component, padded with zeros: whole doubles, or Python integers."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0) < 2.0**52:
        whole, kind = np.floor(flat * scale), np.float64
    else:
        # Larger doubles are whole numbers already.
        whole, kind = np.array([int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale)) for x in flat], object), object
    out = np.zeros((len(sizes), width), np.float64).astype(kind)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def width_of(*columns: pa.Array) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in columns), default=0)


def comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the form in which their products are exact."""
    if a.dtype == b.dtype == np.float64:
        top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
        if top < EXACT:
            return a, b
    exact = np.vectorize(int, otypes=[object])
    return (exact(a) if a.size else a.astype(object)), (exact(b) if b.size else b.astype(object))


def tile_order(rows: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in sort-tile-recursive order: sorted and cut by one coordinate, each part by the next."""
    spread = rows.astype(np.float64).std(axis=0) if len(rows) else np.zeros(0)
    # Coordinates in the order of their spread, as many as there are cuts in two for.
    axes = np.argsort(-spread, kind="stable").tolist()

    def sort(members: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(members) // leaf)
        if leaves <= 1 or depth == len(axes):
            return [members]
        members = members[np.argsort(rows[members, axes[depth]], kind="stable")]
        left = max(len(axes) - depth, 1)
        slices = min(leaves, max(2, int(np.ceil(leaves ** (1 / left)))))
        rows_each = -(-leaves // slices) * leaf
        return [part for at in range(0, len(members), rows_each) for part in sort(members[at : at + rows_each], depth + 1)]

    return np.concatenate(sort(np.arange(len(rows)), 0)) if len(rows) else np.arange(0)


class Tree:
    """Packed R-tree: ``low`` and ``high`` of each level's boxes, leaves first, the root last."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = tile_order(rows, leaf)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.leaf, self.fan = leaf, fan
        self.low, self.high, size, low, high = [], [], leaf, self.rows, self.rows
        while len(low) > 1 or not self.low:
            starts = np.arange(0, len(low), size)
            low, high, size = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), fan
            self.low.append(low)
            self.high.append(high)

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest product of each anchor with each box, by level."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [
            (up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high in zip(self.low, self.high)
        ]


def best_first(tree: Tree, anchor: np.ndarray, least: list, most: list, usable, windows: list[tuple], k: int) -> tuple[list[list], int]:
    """The k best (-score, id) of each window ``(low, high, start)``, and how many leaves were read.

    ``least`` and ``most`` are the anchor's bounds by level. A row below a window's ``start`` is not
    among its best.
    """
    best: list[list] = [[] for _ in windows]
    floors, ceilings = [max(low, start) for low, _, start in windows], [high for _, high, _ in windows]
    lowest, highest = min(floors, default=np.inf), max(ceilings, default=-np.inf)
    top = len(most) - 1
    queue = [(-most[top][0], top, 0)]
    read = 0
    while queue:
        bound, level, node = heapq.heappop(queue)
        if -bound < lowest:
            break
        if level:
            first, down = node * tree.fan, level - 1
            highs, lows = most[down][first : first + tree.fan], least[down][first : first + tree.fan]
            for child, (low, high) in enumerate(zip(lows, highs), first):
                if high >= lowest and low <= highest and any(map(lambda f, c: high >= f and low <= c, floors, ceilings)):  # noqa: B023
                    heapq.heappush(queue, (-high, down, child))
            continue
        part = slice(node * tree.leaf, (node + 1) * tree.leaf)
        read += 1
        scores = tree.rows[part] @ anchor
        near = np.flatnonzero((scores >= lowest) & usable[part])
        if not len(near):
            continue
        for score, own in zip(scores[near].tolist(), tree.ids[part][near].tolist()):
            for place, (floor, ceiling) in enumerate(zip(floors, ceilings)):
                if floor <= score <= ceiling:
                    insort(best[place], (-int(score), own))
                    del best[place][k:]
                    if len(best[place]) == k:
                        floors[place] = max(floor, -best[place][-1][0])
        lowest = min(floors)
    return best, read


def points(
    rows: DataFrame, is_anchor: Column, label: Column | None, id_col: str, label_col: str, vector_col: str
) -> DataFrame:
    """``id``, ``label``, ``v`` and ``wanted`` (an anchor) of the rows that take part."""
    v, infinity = F.col(vector_col).cast("array<double>"), F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinity))
    own = (F.col(label_col) if label is None else label).cast("long")
    taken = rows.where(F.col(id_col).isNotNull() & own.isNotNull() & v.isNotNull() & finite)
    wanted = F.coalesce(is_anchor, F.lit(False)).alias("wanted")
    return taken.select(F.col(id_col).cast("long").alias("id"), own.alias("label"), v.alias("v"), wanted)


def cuts_of(sample: np.ndarray, tiles: int) -> list[tuple[int, float]]:
    """Coordinate and median of each cut of a tree of tiles, by level: 1, 2, 4 ... cuts."""
    spread = sample.std(axis=0) if len(sample) else np.zeros(0)
    axes = np.argsort(-spread, kind="stable").tolist()
    parts, cuts = [np.arange(len(sample))], []
    for depth in range(max(tiles - 1, 0).bit_length() if axes else 0):
        axis, after = axes[depth % len(axes)], []
        for part in parts:
            middle = float(np.median(sample[part, axis])) if len(part) else 0.0
            cuts.append((axis, middle))
            left = sample[part, axis] < middle
            after += [part[left], part[~left]]
        parts = after
    return cuts


def tile_of(rows: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """Number of the tile each row falls in; children of cut ``c`` are ``2c + 1`` and ``2c + 2``."""
    tile = np.zeros(len(rows), np.int64)
    if cuts:
        axes, middles = np.array([a for a, _ in cuts]), np.array([m for _, m in cuts])
        for _ in range(len(cuts).bit_length()):
            tile = 2 * tile + 1 + (rows[np.arange(len(rows)), axes[tile]] >= middles[tile])
    return tile - len(cuts)


def with_starts(anchors: DataFrame, sample: pa.Table, same_label: bool, k: int, scale: int) -> DataFrame:
    """Each window of the anchors starts at the k-th best score that the sample has in it."""
    ids, labels = sample.column("id").to_numpy(), sample.column("label").to_numpy()
    vectors = sample.column("v").combine_chunks()

    def start(scores: np.ndarray, usable: np.ndarray, low, high) -> float:
        good = usable & (scores >= (-np.inf if low is None else low)) & (scores <= (np.inf if high is None else high))
        found = sorted(scores[good].tolist())
        if len(found) < k:
            return -np.inf
        # Rounded down, where a double cannot hold it.
        return float(found[-k]) if abs(found[-k]) < EXACT else float(np.nextafter(float(found[-k]), -np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                v = pa.concat_arrays([batch.column("v")])
                width = width_of(v, vectors)
                own, other = comparable(scaled(v, width, scale), scaled(vectors, width, scale))
                windows = []
                for scores, row in zip(own @ other.T, batch.drop_columns(["v"]).to_pylist()):
                    usable = ((labels == row["label"]) == same_label) & (ids != row["id"])
                    windows.append([{**w, "start": start(scores, usable, w["low"], w["high"])} for w in row["windows"]])
                kind = batch.schema.field("windows").type
                place = batch.schema.get_field_index("windows")
                yield batch.set_column(place, "windows", pa.array(windows, kind))

    return anchors.mapInArrow(run, anchors.schema)


def search(anchors: DataFrame, blocks: DataFrame, parts: int, same_label: bool, k: int, scale: int) -> DataFrame:
    """``anchor``, ``window``, ``rank``, ``id`` and ``score`` of the k best rows of each window.

    Anchors carry their ``windows`` and the numbers ``first`` and ``last`` of the blocks they are to
    meet, in ``parts`` groups; a block and a group of anchors are one piece of work.
    """
    # Groups follow the anchor's number, so that their size is bounded by that number.
    asked = anchors.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence("first", "last"))).drop("first", "last")
    own = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(_, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if rows.num_rows and asked.num_rows:
            v, w = rows.column("v").combine_chunks(), asked.column("v").combine_chunks()
            width = width_of(v, w)
            vectors, wanted = comparable(scaled(v, width, scale), scaled(w, width, scale))
            tree = Tree(rows.column("id").to_numpy(), rows.column("label").to_numpy(), vectors)
            bounds = [[level.tolist() for level in pair] for pair in tree.bounds(wanted)]
            for i, row in enumerate(asked.drop_columns(["v"]).to_pylist()):
                usable = ((tree.labels == row["label"]) == same_label) & (tree.ids != row["id"])
                windows = [
                    (-np.inf if x["low"] is None else x["low"], np.inf if x["high"] is None else x["high"], x["start"])
                    for x in row["windows"]
                ]
                least, most = [low[i] for low, _ in bounds], [high[i] for _, high in bounds]
                best, _ = best_first(tree, wanted[i], least, most, usable, windows, k)
                out += [(row["anchor"], n, vec, -score) for n, found in enumerate(best) for score, vec in found]
        names = ("anchor", "window", "id", "score")
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)})

    sides = own.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
    found = sides.applyInArrow(meet, "anchor long, window long, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    sample_rows: int = SAMPLE,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``is_anchor`` and ``label``, which replaces the label, are over the rows' own columns. A negative
    score lies between ``low`` and ``high`` hundredths of the positive score.
    """
    spark = rows.sparkSession
    taken = staged(points(rows, is_anchor, label, id_col, label_col, vector_col), "negatives-points")
    # At most ``sample_rows`` vectors reach the driver and go to the tasks.
    sample = taken.drop("wanted").orderBy(F.xxhash64("id"), "id", "label", "v").limit(sample_rows).toArrow()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sample.num_rows:
        return spark.createDataFrame([], result)
    vectors = sample.column("v").combine_chunks()
    groups = len(np.unique(sample.column("label").to_numpy() % LABEL_GROUPS))
    tiles = min(TILES, -(-taken.count() // (groups * block_rows)))
    cuts = cuts_of(scaled(vectors, width_of(vectors), 1).astype(np.float64), tiles)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = max(width_of(batch.column("v")), 1 + max((axis for axis, _ in cuts), default=0))
            tile = tile_of(scaled(batch.column("v"), width, 1).astype(np.float64), cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], names=[*batch.schema.names, "tile"])

    group = F.pmod("label", F.lit(LABEL_GROUPS)).cast("int").alias("grp")
    placed = taken.drop("wanted").mapInArrow(tiled, POINT + ", tile long").select("*", group)
    # Rows of a tile are dealt by their place, so that equal rows are not one block.
    placed = staged(placed.withColumn("place", F.monotonically_increasing_id()), "negatives-tiles")
    # At most ``LABEL_GROUPS`` times ``TILES`` rows; blocks of a group have numbers in a row.
    sizes, first, last, starts = placed.groupBy("grp", "tile").count().orderBy("grp", "tile").collect(), {}, {}, []
    for grp, tile, count in sizes:
        at = max(last.values(), default=-1) + 1
        last[grp] = at + -(-count // block_rows) - 1
        first.setdefault(grp, at)
        starts.append((grp, tile, at, last[grp] - at + 1))
    numbered = spark.createDataFrame(starts, "grp int, tile long, at int, chunks int")
    chunk = F.pmod(F.xxhash64("place"), F.col("chunks")).cast("int")
    blocks = placed.join(numbered, ["grp", "tile"]).select((F.col("at") + chunk).alias("block"), "id", "label", "v")
    blocks = staged(blocks, "negatives-blocks")

    anchors = taken.where("wanted").drop("wanted").dropDuplicates(["id", "label", "v"])
    anchors = staged(anchors.select(F.monotonically_increasing_id().alias("anchor"), "*"), "negatives-anchors")
    parts = max(1, -(-anchors.count() // anchor_rows))
    whole = F.expr(f"array(CAST(named_struct('low', NULL, 'high', NULL, 'start', 0) AS {WINDOW}))").alias("windows")
    of_group = lambda ends: F.element_at(F.create_map(*[F.lit(x) for pair in ends.items() for x in pair]), group)
    asked = anchors.select("*", whole, of_group(first).alias("first"), of_group(last).alias("last"))
    near = search(with_starts(asked, sample, True, positives, scale), blocks, parts, True, positives, scale)
    near = staged(near.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # An anchor has at most ``positives`` of them; one window each, in their order.
    window = F.expr(
        f"""transform(found, x -> named_struct('low', CAST(ceil(CAST(x.positive_score AS DECIMAL(30, 0)) * {low} / 100) AS LONG),
            'high', CAST(floor(CAST(x.positive_score AS DECIMAL(30, 0)) * {high} / 100) AS LONG), 'start', 0D))"""
    ).alias("windows")
    found = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("found"))
    everywhere = [F.lit(0).alias("first"), F.lit(max(last.values())).alias("last")]
    asked = anchors.join(found.select("anchor", window), "anchor").select(*anchors.columns, "windows", *everywhere)
    far = search(with_starts(asked, sample, False, negatives, scale), blocks, parts, False, negatives, scale)
    far = far.select("anchor", (F.col("window") + 1).cast("int").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.withColumnRenamed("rank", "place").join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return pairs.join(far, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
