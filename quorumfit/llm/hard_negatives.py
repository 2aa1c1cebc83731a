"""Hard negatives by best-first search of STR-packed R-trees."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumfit.llm.integer_vectors import check_range, integers, matrix, product, whole
from quorumfit.llm.tables import dropped, written

#: Vectors of one tree, of one leaf, and nodes below one node.
CELL, LEAF, FAN = 2_048, 64, 16
#: Vectors, chosen by hash, whose coordinates place the outer tiles. Every vector is indexed.
SAMPLE = 65_536
#: Anchors that search a tree together.
ANCHORS = 2_048

#: Below every score.
NEVER = -(1 << 62)

_TREE = (
    "cell int, vec_id array<long>, label array<int>, q array<long>, leaves array<int>, "
    "low array<long>, high array<long>"
)
_BLOCK = (
    "block int, row array<long>, vec_id array<long>, label array<int>, q array<long>, "
    "windows array<int>, scores array<long>"
)
_FOUND = "row long, turn int, vec_id long, score long"


@dataclass
class Tile:
    """A slab of rows along one axis, cut into children at ``cuts``; without cuts, a page."""

    rows: np.ndarray
    axis: int = 0
    cuts: np.ndarray | None = None
    children: tuple = ()

    def pages(self) -> list[np.ndarray]:
        if self.cuts is None:
            return [self.rows]
        return [page for child in self.children for page in child.pages()]


def str_tiles(x: np.ndarray, rows: np.ndarray, pages: int, axis: int = 0) -> Tile:
    """Sort-tile-recursive packing of ``rows`` into ``pages``: sort along the axis, cut into
    the root of the pages in equal slabs, and pack each slab along the axes that are left."""
    left = x.shape[1] - axis
    if pages <= 1 or left <= 0 or len(rows) < 2:
        return Tile(rows)
    slabs = pages if left == 1 else int(np.ceil(round(pages ** (1.0 / left), 9)))
    order = rows[np.argsort(x[rows, axis], kind="stable")]
    each = -(-len(order) // slabs)
    parts = [order[k : k + each] for k in range(0, len(order), each)]
    cuts = np.array([x[part[0], axis] for part in parts[1:]])
    below = -(-pages // len(parts))
    return Tile(rows, axis, cuts, tuple(str_tiles(x, part, below, axis + 1) for part in parts))


def locate(tile: Tile, x: np.ndarray) -> np.ndarray:
    """Page number of every row of ``x`` among the pages of ``tile``."""
    out = np.zeros(len(x), np.int32)

    def walk(node: Tile, rows: np.ndarray, first: int) -> int:
        if node.cuts is None:
            out[rows] = first
            return first + 1
        slab = np.searchsorted(node.cuts, x[rows, node.axis], side="right")
        for k, child in enumerate(node.children):
            first = walk(child, rows[slab == k], first)
        return first

    walk(tile, np.arange(len(x)), 0)
    return out


def _layers(leaves: int) -> list[int]:
    """Nodes of every layer above the vectors, from the leaves to the root."""
    layers = [leaves]
    while layers[-1] > 1:
        layers.append(-(-layers[-1] // FAN))
    return layers


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors, sizes of the leaves, and low and high corners of the boxes of
    all nodes, layer after layer."""
    pages = str_tiles(x, np.arange(len(x)), -(-len(x) // LEAF)).pages()
    pages = [part for page in pages for part in np.split(page, range(LEAF, len(page), LEAF))]
    low = [np.array([x[p].min(axis=0) for p in pages])]
    high = [np.array([x[p].max(axis=0) for p in pages])]
    while len(low[-1]) > 1:
        cuts = np.arange(0, len(low[-1]), FAN)
        low.append(np.minimum.reduceat(low[-1], cuts))
        high.append(np.maximum.reduceat(high[-1], cuts))
    sizes = np.array([len(p) for p in pages], np.int32)
    return np.concatenate(pages), sizes, np.concatenate(low), np.concatenate(high)


class Tree:
    """A packed tree and its search by a block of anchors."""

    def __init__(self, vec_id: list, label: np.ndarray, q: np.ndarray, leaves: np.ndarray,
                 low: np.ndarray, high: np.ndarray):
        self.vec_id, self.label, self.q, self.low, self.high = vec_id, label, q, low, high
        self.known = np.array([v is not None for v in vec_id])
        self.number = np.array([0 if v is None else v for v in vec_id], np.int64)
        # Place of a vector in the order by which ties go: by id, without one last.
        self.by_tie = np.lexsort((self.number, ~self.known))
        self.tie = np.empty(len(q), np.int64)
        self.tie[self.by_tie] = np.arange(len(q))
        self.starts = np.cumsum([0, *leaves])
        self.layers = _layers(len(leaves))
        self.first = np.cumsum([0, *self.layers])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of every anchor with any point of every box: each
        coordinate gives an interval, whose end depends on the sign of the anchor's."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        least = product(up, self.low.T) + product(down, self.high.T)
        most = product(up, self.high.T) + product(down, self.low.T)
        return least, most

    def search(self, anchors: np.ndarray, wanted, floor: np.ndarray, roof: np.ndarray, first: int):
        """For each anchor and window [floor, roof] (arrays of anchors by windows) the ``first``
        wanted vectors with a score inside: scores and vectors, best first, ties by smaller
        vec_id, null ids last; vector -1 where there are fewer. ``wanted(rows, span)`` says
        which vectors of a span count for the anchors ``rows``.

        One queue serves the block and holds nodes by the greatest score that any anchor may
        find there. A node is left out for an anchor when for every window its interval misses
        the window or lies strictly below the last place, and altogether when for all.
        """
        least, most = self.bounds(anchors)
        shape = (*floor.shape, first)
        scores, ties = np.full(shape, NEVER, np.int64), np.full(shape, len(self.q), np.int64)
        lowest = floor.copy()

        def useful(node: int, rows: np.ndarray) -> np.ndarray:
            high, low = most[rows, node, None], least[rows, node, None]
            return rows[((high >= lowest[rows]) & (low <= roof[rows])).any(axis=1)]

        root = int(self.first[-1]) - 1
        queue = [(0, root, len(self.layers) - 1, np.arange(len(anchors)))]
        while queue:
            _, node, layer, rows = heapq.heappop(queue)
            rows = useful(node, rows)
            if not len(rows):
                continue
            place = node - int(self.first[layer])
            if layer:
                below = int(self.first[layer - 1])
                for child in range(place * FAN, min((place + 1) * FAN, self.layers[layer - 1])):
                    there = useful(below + child, rows)
                    if len(there):
                        bound = -int(most[there, below + child].max())
                        heapq.heappush(queue, (bound, below + child, layer - 1, there))
                continue
            span = slice(int(self.starts[place]), int(self.starts[place + 1]))
            found = product(anchors[rows], self.q[span].T)
            fits = wanted(rows, span)
            for k in range(floor.shape[1]):
                inside = fits & (found >= lowest[rows, k, None]) & (found <= roof[rows, k, None])
                some = np.flatnonzero(inside.any(axis=1))
                if not len(some):
                    continue
                at = rows[some]
                more = np.where(inside[some], found[some], NEVER)
                tie = np.where(inside[some], self.tie[span], len(self.q))
                more, tie = np.hstack([scores[at, k], more]), np.hstack([ties[at, k], tie])
                order = np.lexsort((tie, -more), axis=1)[:, :first]
                scores[at, k] = np.take_along_axis(more, order, axis=1)
                ties[at, k] = np.take_along_axis(tie, order, axis=1)
                full = scores[at, k, -1] > NEVER
                lowest[at[full], k] = scores[at[full], k, -1]
        return scores, np.append(self.by_tie, -1)[ties]


def _pack_cell(dims: int):
    def run(table: pa.Table) -> pa.Table:
        x = matrix(table.column("q"), dims)
        order, leaves, low, high = packed(x)
        list_of = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table({
            "cell": table.column("cell")[:1],
            "vec_id": list_of(table.column("vec_id").take(order).to_pylist(), pa.int64()),
            "label": list_of(table.column("label").take(order).to_pylist(), pa.int32()),
            "q": list_of(x[order].ravel(), pa.int64()),
            "leaves": list_of(leaves, pa.int32()),
            "low": list_of(low.ravel(), pa.int64()),
            "high": list_of(high.ravel(), pa.int64()),
        })
    return run


def _pack_block(dims: int):
    def run(table: pa.Table) -> pa.Table:
        one = lambda c, kind: pa.array([table.column(c).to_pylist()], pa.list_(kind))
        scores = table.column("scores").to_pylist()
        return pa.table({
            "block": table.column("block")[:1],
            "row": one("row", pa.int64()), "vec_id": one("vec_id", pa.int64()),
            "label": one("label", pa.int32()),
            "q": pa.array([matrix(table.column("q"), dims).ravel()], pa.list_(pa.int64())),
            "windows": pa.array([[len(s) for s in scores]], pa.list_(pa.int32())),
            "scores": pa.array([[v for s in scores for v in s]], pa.list_(pa.int64())),
        })
    return run


def _search_cell(dims: int, first: int, percent: tuple[int, int] | None):
    """Search one tree for one block of anchors: positives without ``percent``, else the
    negatives in the windows that the positives' scores make."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda t, c: t.column(c)[0].values.to_numpy(zero_copy_only=False)
        tree = Tree(
            left.column("vec_id")[0].as_py(), flat(left, "label"), flat(left, "q").reshape(-1, dims),
            flat(left, "leaves"), flat(left, "low").reshape(-1, dims), flat(left, "high").reshape(-1, dims),
        )
        anchors, ids, labels = flat(right, "q").reshape(-1, dims), flat(right, "vec_id"), flat(right, "label")

        def positives(rows, span):
            other = ~tree.known[span] | (tree.number[span] != ids[rows, None])
            return (tree.label[span] == labels[rows, None]) & other

        def negatives(rows, span):
            return tree.label[span] != labels[rows, None]

        if percent is None:
            floor, roof = np.full((len(ids), 1), NEVER + 1), np.full((len(ids), 1), -NEVER)
        else:
            ends = np.cumsum([0, *flat(right, "windows")])
            given = right.column("scores")[0].as_py()
            # A window that is not there is empty.
            floor, roof = np.full((len(ids), first), -NEVER), np.full((len(ids), first), NEVER)
            for k in range(len(ids)):
                for turn, score in enumerate(given[ends[k] : ends[k + 1]]):
                    floor[k, turn] = -(-percent[0] * score // 100)
                    roof[k, turn] = percent[1] * score // 100
        scores, found = tree.search(anchors, positives if percent is None else negatives, floor, roof, first)
        row, turn, place = np.nonzero(found >= 0)
        vectors = found[row, turn, place]
        return pa.table({
            "row": flat(right, "row")[row], "turn": turn.astype(np.int32),
            "vec_id": pa.array(tree.number[vectors], mask=~tree.known[vectors]),
            "score": scores[row, turn, place],
        })
    return run


def _trees(points: DataFrame, rows: int, dims: int) -> DataFrame:
    """One packed tree of about CELL vectors a row. Tiles come from a bounded sample; a tile
    above CELL vectors, as many equal vectors make, is dealt by hash into more trees."""
    chosen = points
    if rows > SAMPLE:
        share = int(SAMPLE / rows * (1 << 40))
        chosen = points.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 40)) < share)
    known = [np.array(row["q"] + [0] * (dims - len(row["q"])), np.int64) for row in chosen.select("q").collect()]
    x = np.array(known, np.int64).reshape(len(known), dims)
    pages = min(-(-rows // CELL), max(1, len(x) // FAN))
    outer = str_tiles(x, np.arange(len(x)), pages)
    shared = points.sparkSession.sparkContext.broadcast(outer)

    def tiles(batches):
        for batch in batches:
            place = locate(shared.value, matrix(batch.column("q"), dims))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place)], [*batch.schema.names, "tile"]
            )

    placed = points.mapInArrow(tiles, "row long, vec_id long, label int, q array<long>, tile int")
    sizes = dict(placed.groupBy("tile").count().collect())
    parts = [-(-sizes.get(t, 0) // CELL) for t in range(len(outer.pages()))]
    first = np.cumsum([0, *parts]).tolist()
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("tile") + 1)
    cell = (of(first[:-1]) + F.pmod(F.xxhash64("row"), of([max(p, 1) for p in parts]))).cast("int")
    return placed.withColumn("cell", cell).drop("tile", "row").groupBy("cell").applyInArrow(
        _pack_cell(dims), _TREE
    )


def _best(trees: DataFrame, cells: int, anchors: DataFrame, n_anchors: int, dims: int, first: int,
          percent: tuple[int, int] | None = None) -> DataFrame:
    """The first wanted vectors of every anchor and window over all trees."""
    blocks = -(-n_anchors // ANCHORS)
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    packs = dealt.groupBy("block").applyInArrow(_pack_block(dims), _BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = trees.withColumn("block", each(blocks)).groupBy("cell", "block")
    right = packs.withColumn("cell", each(cells)).groupBy("cell", "block")
    found = left.cogroup(right).applyInArrow(_search_cell(dims, first, percent), _FOUND)
    order = Window.partitionBy("row", "turn").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def mine(vectors: DataFrame, every: int = 100, first: int = 5, low: int = 80, high: int = 100,
         relabel: tuple[int, int] | None = (7, 10)) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    Components become floor(256 * x) and a score is an exact integer inner product. Anchors
    are the rows whose vec_id is divisible by ``every``; an anchor's positives are its
    ``first`` best rows of its label with another vec_id, and the negatives of a positive
    the ``first`` best rows of other labels that score between ``low`` and ``high`` percent
    of it, both included. With ``relabel`` (d, m) rows whose vec_id is divisible by d first
    take the label (label + 1) % m.

    All rows are packed into R-trees of about 2,048 vectors by sort-tile-recursive
    packing, written to the shared folder. Blocks of anchors search every tree, best node
    first: boxes bound the inner product by intervals per coordinate, and boxes that miss
    the windows or are strictly below the last place are pruned. The best of each tree are
    ranked together. The answers are exact: nothing is approximated or capped.

    Rows with a null label, a null vector or a null or non-finite component take no part.
    Vectors shorter than the longest count as ended by zeros. Equal scores go by smaller
    vec_id, null ones last; a row without vec_id is no anchor and may be a partner. Rows of
    one vec_id that repeat are rows of their own, as partners and as anchors. Components
    whose products would not fit a long are an error. Other columns are ignored, whatever
    their names. An empty table, or one without anchors, gives an empty table.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("int").alias("label"),
        vectors["embedding"].alias("v"),
    ).where(F.col("label").isNotNull() & whole(F.col("v")))
    label = F.col("label")
    if relabel is not None:
        label = F.when(F.col("vec_id") % relabel[0] == 0, (label + 1) % relabel[1]).otherwise(label)
    points = written(
        given.select(
            F.monotonically_increasing_id().alias("row"), "vec_id", label.cast("int").alias("label"),
            integers(F.col("v")).alias("q"),
        ),
        "points",
    )
    is_anchor = F.col("vec_id") % every == 0
    facts = points.agg(
        F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("q")).alias("dims"),
        F.max(F.array_max(F.transform("q", F.abs))).alias("most"),
    ).first()
    if not facts["anchors"]:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
            "negative_score long"
        )
    rows, n_anchors, dims = facts["rows"], facts["anchors"], max(facts["dims"], 1)
    check_range(facts["most"] or 0, dims, "embedding")
    trees = written(_trees(points, rows, dims), "trees")
    cells = trees.agg(F.max("cell")).first()[0] + 1
    anchors = points.where(is_anchor)
    none = F.array().cast("array<long>")
    positives = written(
        _best(trees, cells, anchors.withColumn("scores", none), n_anchors, dims, first), "positives"
    )
    scored = positives.groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores")
    )
    asked = anchors.join(scored, "row")
    negatives = written(
        _best(trees, cells, asked, n_anchors, dims, first, (low, high)), "negatives"
    )
    names = positives.select(
        "row", (F.col("rank") - 1).alias("turn"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    out = written(
        negatives.join(names, ["row", "turn"]).join(
            anchors.select("row", F.col("vec_id").alias("anchor_id")), "row"
        ).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ),
        "hard_negatives",
    )
    dropped(points, trees, positives, negatives)
    return out
