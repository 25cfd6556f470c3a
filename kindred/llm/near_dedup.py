"""Embedding near-duplicates: exact cosine threshold pairs by dual traversal of cover trees.

On unit vectors, cosine >= t is distance <= r = sqrt(2 - 2t).  The tree's top is a net fitted on a bounded sample (at most
``SAMPLE`` vectors, the smallest hashes): centres at halving radii, of which the last level holds at most ``CENTRES``.  Every
vector is indexed under its nearest centre; a centre's vectors are dealt by hash into nodes of about ``NODE_ROWS``, so a hot
region is many nodes, not one.  Within a node one task grows the lower levels: nested nets of radii 2r, r, r/2 and r/4, each
made of members of the one above, with exact covering radii; a node is one row from there on, its vectors packed.  Nodes that
lie near each other share a bundle of about ``BUNDLE_ROWS`` vectors.

Bundle pairs are pruned where no two of their nodes have d(centres) <= r + both covering radii.  Each pair that is left goes to
one task, which walks the trees of its node pairs together: node pairs whose own balls are too far are dropped; pairs of nets are
dropped when even their nearest members are too far, counted as a whole when even their farthest members are near enough, and
split otherwise; single vectors are compared by double-precision dot products.  The first nets are met in single precision and in
the sample's leading directions, where a pair's cosine is at most (dot product of what lies in them) + (product of what is left
of both): only what this bound, with slack, doesn't drop is looked at in double precision.  A task returns link counts by vector
and a spanning forest of the links it saw, both linear in the vectors it holds, never the pairs.

A vector that is null, empty, zero or holds null or non-finite components links with nothing, and so do vectors of different
length.  Repeated vectors link with each other.  Rows stand for themselves whatever their ids: ``n_links`` counts other rows,
and a component's id is the least id in it that is not null (null where all are; such rows are kept).  An empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import frugal, materialise, table
from kindred.operators.components import components

THRESHOLD = 0.9
SAMPLE, CENTRES, NODE_ROWS = 8192, 256, 3072
#: A bundle's vectors, and their bytes in double precision; smaller tables have ``BUNDLES`` bundles, for as many tasks as that gives.
BUNDLE_ROWS, BUNDLE_BYTES, BUNDLES = 32768, 16 << 20, 8
#: Pairs of bundles that are broadcast; more meet their nodes in a shuffle join.
BROADCAST_PAIRS = 1 << 18
#: Slack for bounds in double precision (a distance near 0 is known to 2e-8): what is nearer to a bound is decided by its own dot product.
SLACK = 1e-7
#: Slack for bounds in single precision, whose terms are at most 3 with errors of at most 1e-5 in sum.
SINGLE_SLACK = 1e-4
#: What a pair that the single-precision bound leaves costs, as a multiple of one more direction for a pair.
SURVIVOR = 5000
LEVELS = 4
BLOCK = 1024
#: Pairs that are looked at together.
PAIRS = 1 << 18


def unit(x: np.ndarray) -> np.ndarray:
    """Finite rows that aren't zero, in double precision and of length 1."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def unpack(raw: bytes, width: int, single: bool) -> np.ndarray:
    """Unit vectors from the bytes that ``vectors`` keeps."""
    return unit(np.frombuffer(raw, np.float32).reshape(-1, width)) if single else np.frombuffer(raw, np.float64).reshape(-1, width)


def vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, bool]:
    """(row, id, v): a number of the row's own, and the vector's bytes, null where the row can't link; whether they are float32.

    Vectors of single precision are kept as they are, for half the bytes; others as float64 unit vectors.
    """
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column(1)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            size = np.diff(offsets)
            live = column.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
            out: list[bytes | None] = [None] * len(column)
            for width in np.unique(size[live]).tolist():
                every = np.flatnonzero(live & (size == width))
                for lo in range(0, len(every), BLOCK):
                    rows = every[lo : lo + BLOCK]
                    x = flat[offsets[rows][:, None] + np.arange(width)]
                    good = np.isfinite(x).all(1) & (x != 0).any(1)
                    x = x[good] if single else unit(x[good])
                    for row, v in zip(rows[good].tolist(), x, strict=True):
                        out[row] = v.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(out))), batch.column(0), pa.array(out, pa.binary())], names=["row", "id", "v"])
            number += len(out)

    kind = df.schema[id_col].dataType.simpleString()
    x = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), x.alias("x")).mapInArrow(run, f"row bigint, id {kind}, v binary"), single


def net(x: np.ndarray, radius: float, most: int | None = None) -> np.ndarray:
    """Row numbers of centres, greedily in row order, such that every row is within ``radius`` of one (or ``most`` are chosen)."""
    least = 1 - radius * radius / 2
    open_rows = np.ones(len(x), bool)
    chosen: list[int] = []
    for lo in range(0, len(x), BLOCK):
        block = np.arange(lo, min(lo + BLOCK, len(x)))
        if chosen:
            open_rows[block] &= (x[block] @ x[chosen].T).max(1) < least
        rows = block[open_rows[block]]
        if not len(rows):
            continue
        near = x[rows] @ x[rows].T >= least
        left = np.ones(len(rows), bool)
        for k in range(len(rows)):
            if left[k]:
                chosen.append(int(rows[k]))
                left &= ~near[k]
                if most and len(chosen) >= most:
                    return np.array(chosen)
    return np.array(chosen, dtype=np.int64)


def top(sample: np.ndarray, reach: float) -> np.ndarray:
    """Centres of the top of the tree: the finest of the nested halving nets (2, 1, ... down to 2 x reach) within ``CENTRES``."""
    radius, best = 2.0, np.array([0])
    while radius >= 2 * reach:
        finer = net(np.concatenate((sample[best], np.delete(sample, best, 0))), radius, CENTRES)
        order = np.concatenate((best, np.delete(np.arange(len(sample)), best)))
        best = order[finer]
        if len(best) >= CENTRES:
            break
        radius /= 2
    return sample[best]


def grow(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nets of one node: each row's group at each level (numbered so that children follow their parent's order), and
    whether the row is that group's centre."""
    label, centre = np.zeros((len(x), LEVELS), np.int32), np.zeros((len(x), LEVELS), bool)
    groups, radius = [np.arange(len(x))], 2 * reach
    for level in range(LEVELS):
        finer: list[np.ndarray] = []
        for rows in groups:
            if len(rows) == 1:
                label[rows, level], centre[rows, level] = len(finer), True
                finer.append(rows)
                continue
            own = net(x[rows], radius)
            if len(own) == len(rows):
                label[rows, level], centre[rows, level] = len(finer) + np.arange(len(rows)), True
                finer += list(rows[:, None])
                continue
            nearest = np.concatenate([(x[rows[k : k + BLOCK]] @ x[rows[own]].T).argmax(1) for k in range(0, len(rows), BLOCK)])
            nearest[own] = np.arange(len(own))
            order = np.argsort(nearest, kind="stable")
            cut = np.searchsorted(nearest[order], np.arange(len(own) + 1))
            label[rows, level] = len(finer) + nearest
            centre[rows[own], level] = True
            finer += [rows[order[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        groups, radius = finer, radius / 2
    return label, centre


def directions(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Leading directions of the sample, as many as make the single-precision bound cheapest; their number changes no result."""
    basis = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    z = sample[:: max(1, len(sample) // 2048)] @ basis
    best, least = z.shape[1], math.inf
    for k in sorted({*range(4, z.shape[1], 4 if z.shape[1] <= 256 else 32), z.shape[1]}):
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", z[:, :k], z[:, :k])))
        low = np.concatenate((z[:, :k], rest[:, None]), axis=1).astype(np.float32)
        cost = k + SURVIVOR * float((low @ low.T >= threshold - SINGLE_SLACK).mean())
        if cost < least:
            best, least = k, cost
    return basis[:, :best]


def _ranges(start_a: np.ndarray, n_a: np.ndarray, start_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair from the k-th range of a and the k-th range of b: (k, place in a, place in b)."""
    n = n_a * n_b
    k = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    return k, start_a[k] + at // n_b[k], start_b[k] + at % n_b[k]


class Tree:
    """A node's vectors with the nets that ``grow`` found: centres, exact covering radii, members and children by level.

    ``at`` is the number of its first vector among those of the task; ``links`` counts links by level and group, ``row_links`` by vector.
    """

    def __init__(self, x: np.ndarray, label: np.ndarray, centre: np.ndarray, at: int, basis: np.ndarray, reach: float):
        self.x, self.at, self.label = x, at, label
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.order, self.cut, self.child, self.size, self.links, self.united = [], [], [], [], [], []
        for level in range(LEVELS):
            own = label[:, level]
            order = np.argsort(own, kind="stable")
            n = int(own.max()) + 1
            cut = np.searchsorted(own[order], np.arange(n + 1))
            rows = np.flatnonzero(centre[:, level])
            middle = np.zeros(n, np.int64)
            middle[own[rows]] = rows
            far = np.zeros(len(x))
            if n < len(x):
                far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[middle[own]])))
                far[rows] = 0
            self.levels.append((middle, np.maximum.reduceat(far[order], cut[:-1])))
            self.order.append(order), self.cut.append(cut), self.size.append(np.diff(cut))
            up = label[middle, level - 1] if level else np.zeros(n, np.int32)
            self.child.append(np.searchsorted(up, np.arange(int(up.max()) + 2)))
            self.links.append(np.zeros(n, np.int64)), self.united.append(np.zeros(n, bool))
        self.row_links = np.zeros(len(x), np.int64)
        mean = x.mean(0)
        self.middle = mean / max(1e-12, math.sqrt(float(mean @ mean)))
        self.far = math.sqrt(max(0.0, float((x * x).sum(1).max() + self.middle @ self.middle - 2 * (x @ self.middle).min())))
        # left . right >= 1 wherever two first nets can't be dropped: bound of the cosine + (reach + both radii)^2 / 2
        middle, radius = self.levels[0]
        low = x[middle] @ basis
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", low, low)))
        wide, one = reach + radius, np.ones(len(low))
        self.left = np.column_stack((low, rest, wide * wide / 2, wide, one / 2)).astype(np.float32)
        self.right = np.column_stack((low, rest, one, radius, radius * radius)).astype(np.float32)

    def members(self, level: int, group: int) -> np.ndarray:
        return self.order[level][self.cut[level][group] : self.cut[level][group + 1]]

    def counts(self) -> np.ndarray:
        """Links of each vector."""
        return self.row_links + sum(links[self.label[:, level]] for level, links in enumerate(self.links))


def _roots(parent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    root = parent[rows]
    while True:
        up = parent[root]
        if np.array_equal(up, root):
            parent[rows] = root
            return root
        root = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[k] and b[k] in the forest, whose roots are the least of their trees."""
    while len(a):
        x, y = _roots(parent, a), _roots(parent, b)
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def dual(left: Tree, right: Tree, threshold: float, parent: np.ndarray) -> None:
    """Count the links between two nodes (or within one) in both trees, and join linked vectors in ``parent``."""
    reach, same = math.sqrt(2 - 2 * threshold), left is right
    gap = left.middle - right.middle
    if not same and math.sqrt(float(gap @ gap)) > reach + left.far + right.far + SLACK:
        return

    def link(level: int, a: np.ndarray, b: np.ndarray) -> None:
        """All vectors of groups a[k] and b[k] are linked with each other."""
        apart = a != b if same else np.ones(len(a), bool)
        left.links[level] += np.bincount(a, right.size[level][b] - ~apart, len(left.size[level])).astype(np.int64)
        right.links[level] += np.bincount(b[apart], left.size[level][a[apart]], len(right.size[level])).astype(np.int64)
        for tree, groups in ((left, a), (right, b)):
            new = np.zeros(len(tree.size[level]), bool)
            new[groups] = True
            new &= ~tree.united[level] & (tree.size[level] > 1)
            if new.any():
                tree.united[level] |= new
                rows = np.flatnonzero(new[tree.label[:, level]])
                _unite(parent, tree.at + tree.levels[level][0][tree.label[rows, level]], tree.at + rows)
        _unite(parent, left.at + left.levels[level][0][a[apart]], right.at + right.levels[level][0][b[apart]])

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        """Single vectors x[k] and y[k] are linked."""
        np.add.at(left.row_links, x, 1)
        np.add.at(right.row_links, y, 1)
        _unite(parent, left.at + x, right.at + y)

    def visit(level: int, a: np.ndarray, b: np.ndarray, cos: np.ndarray | None = None) -> None:
        """Pairs (a[k], b[k]) of groups of a level that bounds have not decided."""
        (ca, ra), (cb, rb) = left.levels[level], right.levels[level]
        if cos is None:
            cos = np.concatenate([np.einsum("ij,ij->i", left.x[ca[a[k : k + 8192]]], right.x[cb[b[k : k + 8192]]]) for k in range(0, len(a), 8192)])
        single = (left.size[level][a] == 1) & (right.size[level][b] == 1)
        far, both = np.sqrt(np.maximum(0, 2 - 2 * cos)), ra[a] + rb[b]
        whole = np.where(single, cos >= threshold, far + both <= reach - SLACK)
        split = ~whole & ~single & (far - both <= reach + SLACK)
        if whole.any():
            link(level, a[whole], b[whole])
        if not split.any():
            return
        a, b = a[split], b[split]
        last = level + 1 == LEVELS
        first_a, first_b = (left.cut[level], right.cut[level]) if last else (left.child[level + 1], right.child[level + 1])
        from_a, from_b, n_a, n_b = first_a[a], first_b[b], first_a[a + 1] - first_a[a], first_b[b + 1] - first_b[b]
        own = a == b if same else np.zeros(len(a), bool)
        large = n_a * n_b >= 4096
        small = np.flatnonzero(~large)
        upto = np.cumsum(n_a[small] * n_b[small])
        while len(small):
            n = max(1, int(np.searchsorted(upto, PAIRS)))
            part, small, upto = small[:n], small[n:], upto[n:] - upto[n - 1]
            k, x, y = _ranges(from_a[part], n_a[part], from_b[part], n_b[part])
            below(level, last, x, y, own[part[k]], None)
        for k in np.flatnonzero(large).tolist():
            y = np.arange(from_b[k], from_b[k] + n_b[k])
            step = max(1, PAIRS // len(y))
            for lo in range(from_a[k], from_a[k] + n_a[k], step):
                x = np.arange(lo, min(lo + step, from_a[k] + n_a[k]))
                i, j = (left.order[level][x], right.order[level][y]) if last else (left.levels[level + 1][0][x], right.levels[level + 1][0][y])
                below(level, last, np.repeat(x, len(y)), np.tile(y, len(x)), np.full(len(x) * len(y), own[k]), (left.x[i] @ right.x[j].T).ravel())

    def below(level: int, last: bool, x: np.ndarray, y: np.ndarray, own: np.ndarray, cos: np.ndarray | None) -> None:
        """Pairs of children, or of single vectors (places in the order of members) below the last nets."""
        keep = ~own | (x < y if last else x <= y)
        x, y, cos = x[keep], y[keep], None if cos is None else cos[keep]
        if not len(x):
            return
        if not last:
            visit(level + 1, x, y, cos)
            return
        x, y = left.order[level][x], right.order[level][y]
        if cos is None:
            cos = np.concatenate([np.einsum("ij,ij->i", left.x[x[k : k + 8192]], right.x[y[k : k + 8192]]) for k in range(0, len(x), 8192)])
        near = cos >= threshold
        meet(x[near], y[near])

    least, width = np.float32(1 - SINGLE_SLACK), len(right.right)
    rows = max(1, PAIRS // width)
    bits = np.zeros((rows * width + 7) // 8 * 8, bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(left.left), rows):
        bound = left.left[lo : lo + rows] @ right.right[lo if same else 0 :].T
        n, across = bound.size, bound.shape[1]
        np.greater_equal(bound, least, out=bits[:n].reshape(bound.shape))
        bits[n:] = False
        word = np.flatnonzero(bits.view(np.uint64))
        k, bit = np.nonzero(bits.reshape(-1, 8)[word])
        i, j = np.divmod(word[k] * 8 + bit, across)
        if same:  # columns begin at the block's first group; a single vector has no link with itself
            keep = (i < j) | ((i == j) & (left.size[0][lo + i] > 1))
            i, j = i[keep], j[keep] + lo
        held.append((lo + i, j))
        if sum(len(i) for i, _ in held) >= PAIRS or lo + rows >= len(left.left):
            a, b = np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held])
            held = []
            for k in range(0, len(a), PAIRS):
                visit(0, a[k : k + PAIRS], b[k : k + PAIRS])


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id and kept."""
    reach = math.sqrt(2 - 2 * threshold)
    read, single = vectors(df, id_col, vector_col)
    every = materialise(read, "vectors")
    found = None
    for (size,) in every.where("v is not null").select(F.length("v")).distinct().collect():
        part = _links(every.where(F.length("v") == size).select(F.col("row").alias("id"), "v"), threshold, reach, size // (4 if single else 8), single)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return every.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "links")
    counts = found.where("n is not null").groupBy(F.col("id").alias("row")).agg(F.sum("n").alias("n_links"))
    labels = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    linked = every.select("row", "id").join(labels, F.col("row") == F.col("vertex")).select("row", "id", "component")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    of_row = linked.join(least, "component").select("row", "component_id", F.lit(True).alias("linked"))
    out = every.select("row", "id").join(counts, "row", "left").join(of_row, "row", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def bundles(nodes: np.ndarray, rows: np.ndarray, gap: np.ndarray, most: float) -> np.ndarray:
    """Bundle numbers of nodes (their cells and rows): a chain of cells from each to the nearest one left, cut by rows."""
    cells = np.unique(nodes)
    place, at, left = {}, int(cells[0]), np.ones(len(cells), bool)
    for k in range(len(cells)):
        place[at] = k
        left[np.searchsorted(cells, at)] = False
        if left.any():
            at = int(cells[left][gap[at, cells[left]].argmin()])
    order = np.argsort([place[c] for c in nodes.tolist()], kind="stable")
    out, n, bundle = np.zeros(len(nodes), np.int64), 0.0, 0
    for k in order.tolist():
        if n and n + rows[k] > most:
            n, bundle = 0.0, bundle + 1
        out[k], n = bundle, n + rows[k]
    return out


def _links(rows: DataFrame, threshold: float, reach: float, width: int, single: bool) -> DataFrame:
    """(id, n, other) of rows(id, v), whose ids are row numbers: link counts, and the edges of a spanning forest."""
    spark = rows.sparkSession
    sample = unpack(b"".join(rows.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").toPandas()["v"]), width, single)
    centres, basis = top(sample, reach), directions(sample, threshold)
    held = spark.sparkContext.broadcast((centres, basis))

    def cell_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre of each vector, and its distance."""
        cos = unpack(b"".join(column.to_pylist()), width, single) @ held.value[0].T
        cell = cos.argmax(1)
        return cell, np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(cell)), cell]))

    @frugal
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = np.zeros(len(held.value[0]), np.int64), np.zeros(len(held.value[0]))
        for batch in batches:
            cell, far = cell_of(batch.column(0))
            n += np.bincount(cell, minlength=len(n))
            np.maximum.at(most, cell, far)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0]), pa.array(most[n > 0])], names=["cell", "n", "far"])

    # Small cells share a node (its centre is the largest one's); large cells are dealt over several.
    cells = rows.select("v").mapInArrow(tally, "cell int, n bigint, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).toPandas().sort_values(["n", "cell"], ascending=False)
    nodes: list[dict] = []
    deal = np.zeros((2, len(centres)), np.int64)
    gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    room: list[int] = []
    for cell, n, far in cells.itertuples(index=False):
        parts = max(1, math.ceil(n / NODE_ROWS))
        if parts == 1:
            fits = [k for k in room if nodes[k]["n"] + n <= NODE_ROWS]
            if fits:
                k = min(fits, key=lambda k: gap[nodes[k]["cell"], cell])
                nodes[k]["n"] += n
                nodes[k]["far"] = max(nodes[k]["far"], gap[nodes[k]["cell"], cell] + far)
                deal[:, cell] = k, 1
                continue
            room.append(len(nodes))
        deal[:, cell] = len(nodes), parts
        nodes += [{"cell": cell, "n": n / parts, "far": far} for _ in range(parts)]
    at, far, n = (np.array([m[name] for m in nodes]) for name in ("cell", "far", "n"))
    bundle = bundles(at, n, gap, max(NODE_ROWS, min(BUNDLE_ROWS, BUNDLE_BYTES // (8 * width), float(n.sum()) / BUNDLES)))
    order = np.argsort(bundle, kind="stable")
    count = int(bundle.max()) + 1
    first = np.searchsorted(bundle[order], np.arange(count))
    joins: list[list[int]] = [[] for _ in range(count)]
    for k in range(count):
        own = np.flatnonzero(bundle == k)
        near = (gap[np.ix_(at[own], at[order])] <= reach + far[own][:, None] + far[order][None] + SLACK).any(0)
        for j in np.flatnonzero(np.logical_or.reduceat(near, first)).tolist():
            if j >= k:
                joins[k].append(k * count + j)
                if j > k:
                    joins[j].append(k * count + j)
    pairs = sum(map(len, joins))
    plan = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(nodes)), "pairs": [joins[k] for k in bundle.tolist()]}), "node int, pairs array<bigint>")

    @frugal
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _ = cell_of(batch.column(1))
            node = deal[0][cell] + batch.column(2).to_numpy() % deal[1][cell]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(node, pa.int32())], names=["id", "v", "node"])

    def label(rows: pa.Table) -> pa.Table:
        """A node's row: ids, vectors and nets, packed."""
        raw = b"".join(rows.column("v").to_pylist())
        found, centre = grow(unpack(raw, width, single), reach)
        nets = np.concatenate((found, centre.astype(np.int32)), axis=1).tobytes()
        return pa.table({"node": rows.column("node")[:1], "ids": pa.array([rows.column("id").to_numpy().tobytes()], pa.binary()), "v": pa.array([raw], pa.binary()), "nets": pa.array([nets], pa.binary())})

    noded = rows.select("id", "v", F.xxhash64("id").alias("h")).mapInArrow(assign, "id bigint, v binary, node int")
    grown = noded.groupBy("node").applyInArrow(label, "node int, ids binary, v binary, nets binary")
    paired = grown.join(F.broadcast(plan) if pairs <= BROADCAST_PAIRS else plan, "node").select("ids", "v", "node", "nets", F.explode("pairs").alias("pair"))
    bundle_of = spark.sparkContext.broadcast(bundle)

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        of = bundle_of.value[rows.column("node").to_numpy()]
        one, other = divmod(rows.column("pair")[0].as_py(), count)
        trees, ids, at = [], [], 0
        for k in range(len(rows)):
            nets = np.frombuffer(rows.column("nets")[k].as_py(), np.int32).reshape(-1, 2 * LEVELS)
            x = unpack(rows.column("v")[k].as_py(), width, single)
            trees.append(Tree(x, nets[:, :LEVELS], nets[:, LEVELS:] > 0, at, held.value[1], reach))
            ids.append(np.frombuffer(rows.column("ids")[k].as_py(), np.int64))
            at += len(x)
        parent = np.arange(at)
        for i in np.flatnonzero(of == one).tolist():
            for j in np.flatnonzero(of == other).tolist():
                if one != other or i <= j:
                    dual(trees[i], trees[j], threshold, parent)
        every, n, roots = np.concatenate(ids), np.concatenate([tree.counts() for tree in trees]), _roots(parent, np.arange(at))
        counted, linked = np.flatnonzero(n), np.flatnonzero(roots != np.arange(at))
        gone = lambda rows: pa.nulls(len(rows), pa.int64())
        return pa.table({
            "id": pa.chunked_array([pa.array(every[counted]), pa.array(every[linked])]),
            "n": pa.chunked_array([pa.array(n[counted]), gone(linked)]),
            "other": pa.chunked_array([gone(counted), pa.array(every[roots[linked]])]),
        })

    return paired.groupBy("pair").applyInArrow(walk, "id bigint, n bigint, other bigint")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of embeddings at cosine 0.9."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")
