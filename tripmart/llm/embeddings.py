"""Operator 3: embedding near-duplicates by cover-tree dual traversal.

Vectors are put on the unit sphere, where cosine >= s is distance <= sqrt(2 - 2s).
The top of the tree is a farthest-first order of a bounded sample: its first k
points are the centres of the top level (an index only; every vector hangs below
its nearest centre, with the exact covering radius measured over all of them).
Two cells meet only if their centres are no farther apart than both radii and
the threshold distance, and a vector goes to a meeting only if the other cell's
ball is within reach. In a meeting each side is refined into nested levels of
halving radii; node pairs are pruned by their covering radii, level by level, and
what is left is compared exactly in double precision. Centres are first compared in
a few rotated coordinates (the main directions of the sample): with the length of the
rest as one more coordinate, that inner product is an upper bound of the cosine, so
only pairs that pass it are compared in all coordinates.

A cell is split into blocks of bounded size, so a cell with a third of all
vectors is many meetings. Equal vectors are one node with a count. A meeting
returns, per vector, the number of its links and one edge to its local component,
never the pairs themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (not even with equal ones); vectors of different
lengths never link; repeated rows are vectors of their own; ``component_id``
ignores null ids unless all are null; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import components
from tripmart.session import materialize

#: Bound of the sample that gives the top level, and of the top level itself.
SAMPLE, CENTRES = 2048, 512

#: Vectors of a block; a meeting holds two blocks.
BLOCK = 8192

#: Radii of the nested levels inside a block.
RADII = (1.0, 0.5, 0.25, 0.125)

#: Points that show at which radius the levels of a block begin.
PROBE = 512

#: A node of so few points is a leaf: it is not refined further.
LEAF = 32

#: Pairs of vectors compared at a time, and pairs of nodes from which on a node
#: meets the other side's by one matrix product.
PAIRS, MANY = 1 << 17, 4096

#: Rotated coordinates of the first comparison, and the least cosine for which it pays.
MAIN, SCREENED = 16, np.float32(0.8)

#: Slack of the pruning bounds for rounding (the bounds are tested in single
#: precision); links are decided exactly.
SLACK = 1e-3


def usable(vector: Column) -> Column:
    """Has a direction: finite components, not all zero."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)  # scaled first: squares neither overflow nor vanish
    rows = rows / top
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def floor(far: np.ndarray) -> np.ndarray:
    """Least cosine of unit vectors no farther apart than ``far``."""
    far = np.minimum(far, np.float32(2))
    return 1 - far * far / 2


def farthest_first(points: np.ndarray, k: int) -> np.ndarray:
    """Order of k points, each the farthest from those before it: every prefix is
    a level of the tree, with a smaller radius than the one before."""
    order = [0]
    near = distances(points, points[:1])[:, 0]
    while len(order) < min(k, len(points)) and near.max() > 1e-6:
        order.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[order[-1:]])[:, 0])
    return np.array(order)


def main_directions(points: np.ndarray, k: int = MAIN) -> np.ndarray:
    """The main directions of a sample, as columns: at most half as many as coordinates."""
    k = min(k, points.shape[1] // 2)
    return np.linalg.eigh(points.T @ points)[1][:, ::-1][:, :k] if k else np.zeros((points.shape[1], 0))


def screen(points: np.ndarray, main: np.ndarray) -> np.ndarray:
    """Main coordinates and the length of the rest: the inner product of two such rows
    is at least that of the unit vectors (Cauchy-Schwarz on the rest)."""
    own = points @ main
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", own, own), 0))
    return np.c_[own, rest].astype(np.float32)


def at_least(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, least: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) whose cosine reaches ``least``, by the screens first."""
    r, c = np.divmod(np.flatnonzero(sa @ sb.T >= least - np.float32(1e-4)), max(1, len(sb)))
    hit = np.concatenate([np.einsum("ij,ij->i", a[r[k : k + PAIRS]], b[c[k : k + PAIRS]]) >= least for k in range(0, len(r), PAIRS)]) if len(r) else r > 0
    return r[hit], c[hit]


def cover(points: np.ndarray, radius: float, screens: np.ndarray, tries: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net in the given order: the centres, no two within ``radius``, and
    for each point the number of the first centre within ``radius`` of it."""
    least = np.float32(1 - radius * radius / 2)
    of, centres = np.full(len(points), -1), []
    rest = np.arange(len(points))
    while len(rest):
        first = rest[:tries]
        if least >= SCREENED:
            near = np.zeros((len(rest), len(first)), bool)
            near[at_least(points[rest], points[first], screens[rest], screens[first], least)] = True
        else:
            near = points[rest] @ points[first].T >= least
        near[np.arange(len(first)), np.arange(len(first))] = True
        chosen: list[int] = []
        for k in range(len(first)):
            if not near[k, chosen].any():
                chosen.append(k)
        hit = near[:, chosen]
        covered = hit.any(axis=1)
        of[rest[covered]] = len(centres) + hit[covered].argmax(axis=1)
        centres.extend(first[chosen].tolist())
        rest = rest[~covered]
    return np.array(centres), of


class Level:
    """Nodes of one level, in the order of their parents: centre, parent,
    covering radius, and members end to end."""

    def __init__(self, points: np.ndarray, screens: np.ndarray, centre: np.ndarray, parent: np.ndarray, members: np.ndarray, sizes: np.ndarray):
        self.centre, self.parent, self.members, self.sizes = centre, parent, members, sizes
        self.starts = np.cumsum(sizes) - sizes
        cos = np.einsum("ij,ij->i", points[members], points[np.repeat(centre, sizes)])
        far = np.sqrt(np.maximum(2 - 2 * cos, 0))
        self.radius = np.where(sizes == 1, 0, np.maximum.reduceat(far, self.starts)).astype(np.float32)
        self.points, self.screens = points[centre], screens[centre]


def levels(points: np.ndarray, screens: np.ndarray) -> list[Level]:
    """Nested levels from one root, with halving radii, down to leaves. They begin at the
    first radius that gathers points: where most of a few points are centres of their own,
    a level would add wide balls that prune nothing."""
    n, few = len(points), slice(0, PROBE)
    radii = list(RADII)
    while len(radii) > 1 and 2 * len(cover(points[few], radii[0], screens[few])[0]) > len(points[few]):
        radii.pop(0)
    out = [Level(points, screens, np.array([0]), np.array([0]), np.arange(n), np.array([n]))]
    for depth, radius in enumerate(radii):
        above = out[-1]
        if depth > 1 and above.sizes.max() <= LEAF:
            break
        # nodes that stay as they are, all at once; the others are covered one by one
        split = (above.sizes > 1) & ((depth < 2) | (above.sizes > LEAF))
        same, members = np.flatnonzero(~split), above.members.copy()
        centre, parent, sizes = [members[above.starts[same]]], [same], [above.sizes[same]]
        for node in np.flatnonzero(split).tolist():
            own = slice(above.starts[node], above.starts[node] + above.sizes[node])
            inside = above.members[own]
            tops, of = cover(points[inside], radius, screens[inside])
            members[own] = inside[np.argsort(of, kind="stable")]
            centre.append(inside[tops])
            parent.append(np.full(len(tops), node))
            sizes.append(np.bincount(of, minlength=len(tops)))
        parent = np.concatenate(parent)
        order = np.argsort(parent, kind="stable")
        out.append(Level(points, screens, np.concatenate(centre)[order], parent[order], members, np.concatenate(sizes)[order]))
    return out


def products(first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray, pairs: int = PAIRS):
    """Yield index arrays of all pairs of two runs each, at most about ``pairs``
    at a time (the first run of a large pair is taken in parts)."""
    step = np.maximum(1, pairs // np.maximum(n_b, 1))
    parts = -(-n_a // step)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first_a, n_a, first_b, n_b, step = (np.repeat(x, parts) for x in (first_a, n_a, first_b, n_b, step))
    first_a, n_a = first_a + nth * step, np.minimum(step, n_a - nth * step)
    weight = n_a * n_b
    cuts = np.flatnonzero(np.diff(np.cumsum(weight) // pairs, prepend=-1))
    for at, end in zip(cuts, [*cuts[1:], len(weight)] if len(cuts) else [], strict=True):
        w = weight[at:end]
        nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        wide = np.repeat(n_b[at:end], w)
        yield np.repeat(first_a[at:end], w) + nth // wide, np.repeat(first_b[at:end], w) + nth % wide


def traverse(a: np.ndarray, b: np.ndarray, reach: float, main: np.ndarray, rows: int = 512):
    """Yield arrays of candidate pairs (point of a, point of b): those whose nodes
    no level could prune."""
    sa = screen(a, main)
    sb = sa if b is a else screen(b, main)
    la = levels(a.astype(np.float32), sa)
    lb = la if b is a else levels(b.astype(np.float32), sb)
    while len(la) != len(lb):  # the shallower side's leaves stand for themselves further down
        low = la if len(la) < len(lb) else lb
        last = low[-1]
        low.append(Level((a if low is la else b).astype(np.float32), sa if low is la else sb, last.centre, np.arange(len(last.centre)), last.members, last.sizes))
    alone = np.float32(reach + SLACK)
    p, q = np.array([0]), np.array([0])
    for depth in range(1, len(la)):
        up, ua, ub = len(lb[depth - 1].centre), la[depth], lb[depth]
        first_a = np.searchsorted(ua.parent, np.arange(len(la[depth - 1].centre) + 1))
        first_b = np.searchsorted(ub.parent, np.arange(up + 1))
        far_b = ub.radius + alone

        def near(mine: np.ndarray, theirs: np.ndarray, ua=ua, ub=ub, far_b=far_b) -> tuple[np.ndarray, np.ndarray]:
            a, b = ua.points[mine], ub.points[theirs]
            own, other = ua.radius[mine], far_b[theirs]
            balls_a, balls_b = np.flatnonzero(own > 0), np.flatnonzero(other > alone)
            if 4 * len(balls_a) > len(own) or 4 * len(balls_b) > len(other) or floor(alone) < SCREENED:
                return np.nonzero(a @ b.T >= floor(own[:, None] + other[None, :]))
            # most nodes are single vectors: one bound for them, then those of the balls
            r, c = at_least(a, b, ua.screens[mine], ub.screens[theirs], floor(alone))
            single = (own[r] == 0) & (other[c] <= alone)
            r, c = r[single], c[single]
            ra, ca = np.nonzero(a[balls_a] @ b.T >= floor(own[balls_a][:, None] + other[None, :]))
            lone = np.flatnonzero(own == 0)
            rb, cb = np.nonzero(a[lone] @ b[balls_b].T >= floor(own[lone][:, None] + other[balls_b][None, :]))
            return np.concatenate([r, balls_a[ra], lone[rb]]), np.concatenate([c, ca, balls_b[cb]])

        found_a, found_b, every = [], [], np.arange(len(ub.centre))
        nodes, cuts = np.unique(p, return_index=True)
        size = np.diff(np.r_[cuts, len(p)])
        # nodes that still face most of the other side are taken together, against all of it
        full = nodes[2 * size >= up]
        kids = np.concatenate([np.arange(first_a[x], first_a[x + 1]) for x in full.tolist()]) if len(full) else full
        for at in range(0, len(kids), rows):
            r, c = near(kids[at : at + rows], every)
            found_a.append(kids[at : at + rows][r])
            found_b.append(c)
        work = np.diff(first_a)[nodes] * np.add.reduceat(np.diff(first_b)[q], cuts)
        rest = 2 * size < up
        for x, at, k in zip(*(v[rest & (work >= MANY)].tolist() for v in (nodes, cuts, size)), strict=True):
            qs = q[at : at + k]
            n = first_b[qs + 1] - first_b[qs]
            theirs = np.arange(int(n.sum())) + np.repeat(first_b[qs] - (np.cumsum(n) - n), n)
            mine = np.arange(first_a[x], first_a[x + 1])
            r, c = near(mine, theirs)
            found_a.append(mine[r])
            found_b.append(theirs[c])
        few = np.repeat(rest & (work < MANY), size)
        x, y = p[few], q[few]
        for mine, theirs in products(first_a[x], first_a[x + 1] - first_a[x], first_b[y], first_b[y + 1] - first_b[y]):
            need = floor(ua.radius[mine] + far_b[theirs])
            hit = np.einsum("ij,ij->i", ua.screens[mine], ub.screens[theirs]) >= need - np.float32(1e-4)
            mine, theirs, need = mine[hit], theirs[hit], need[hit]
            hit = np.einsum("ij,ij->i", ua.points[mine], ub.points[theirs]) >= need
            found_a.append(mine[hit])
            found_b.append(theirs[hit])
        if not found_a:
            return
        p, q = np.concatenate(found_a), np.concatenate(found_b)
        order = np.lexsort((q, p))
        p, q = p[order], q[order]
    ea, eb = la[-1], lb[-1]
    for i, j in products(ea.starts[p], ea.sizes[p], eb.starts[q], eb.sizes[q]):
        yield ea.members[i], eb.members[j]


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Component labels after adding the links x-y (smallest label wins)."""
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return label
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(lx, ly)[apart], np.minimum(lx, ly)[apart])
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def meet(a: np.ndarray, b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray, least: float, main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links per vector (copies counted) and local component label, for the rows
    of a and then b; with ``b is a`` for the rows of a."""
    same = b is a
    shift = 0 if same else len(a)
    total = len(a) + (0 if same else len(b))
    count, label = np.zeros(total, np.int64), np.arange(total)
    for i, j in traverse(a, b, float(np.sqrt(max(0.0, 2 - 2 * least))), main):
        hit = np.einsum("ij,ij->i", a[i], b[j]) >= least
        if same:
            hit &= i != j
        i, j = i[hit], j[hit]
        count += np.bincount(i, copies_b[j], total).astype(np.int64)
        if not same:
            count += np.bincount(j + shift, copies_a[i], total).astype(np.int64)
        label = joined(label, i, j + shift)
    return count, label


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1))


def _cells(nodes: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``nodes`` (of one vector length) with ``_far``: distance to every centre."""
    tops = np.array(centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                far = distances(_matrix(batch.column("_v")), tops)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1]), pa.int32()), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "_far"])

    return nodes.mapInArrow(run, nodes.withColumn("_far", F.array(F.lit(0.0))).schema)


def _meetings(nodes: DataFrame, least: float) -> DataFrame:
    """``_k, _links, _root`` from all meetings of nodes of one vector length."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    sample = nodes.orderBy(F.xxhash64("_v"), "_k").limit(SAMPLE).select("_v").collect()  # bounded
    points = unit(np.array([r[0] for r in sample], np.float64))
    wanted = max(1, min(CENTRES, -(-nodes.count() // BLOCK)))
    centres, main = points[farthest_first(points, wanted)], main_directions(points)
    rows = _cells(nodes, centres.tolist()).withColumn("_cell", F.array_position("_far", F.array_min("_far")).cast("int") - 1)
    rows = materialize(rows, "cells")
    stats = {
        r._cell: (r.n, r.radius)
        for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_min("_far")).alias("radius")).collect()
    }  # at most CENTRES rows
    blocks = {c: -(-n // BLOCK) for c, (n, _) in stats.items()}
    base, at = {}, 0
    for c in sorted(blocks):
        base[c], at = at, at + blocks[c]
    gap = distances(centres, centres)
    limit = {c: stats[c][1] + reach + SLACK for c in stats}
    partners = {
        c: [d for d in sorted(stats) if gap[c, d] <= stats[c][1] + limit[d]] for c in stats
    }

    def reached(batches):
        for batch in batches:
            far = batch.column("_far").flatten().to_numpy().reshape(batch.num_rows, -1)
            cell, key = batch.column("_cell").to_numpy(), batch.column("_k").to_numpy()
            row, low, high, side = [], [], [], []
            for c in np.unique(cell).tolist():
                mine = np.flatnonzero(cell == c)
                block = base[c] + (key[mine] * 2654435761 % (1 << 31)) % blocks[c]
                for d in partners[c]:
                    near = far[mine, d] <= limit[d] if d != c else np.ones(len(mine), bool)
                    for other in range(base[d], base[d] + blocks[d]):
                        own = block[near]
                        row.append(mine[near])
                        low.append(np.minimum(own, other))
                        high.append(np.maximum(own, other))
                        side.append(own > other)
            if row:
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(low)), pa.array(np.concatenate(high)), pa.array(np.concatenate(side)),
                     batch.column("_k").take(at), batch.column("_copies").take(at), batch.column("_v").take(at)],
                    names=["_low", "_high", "_side", "_k", "_copies", "_v"],
                )

    kind = rows.schema["_v"].dataType.simpleString()
    dealt = rows.mapInArrow(reached, f"_low long, _high long, _side boolean, _k long, _copies long, _v {kind}")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_side", "ascending"), ("_k", "ascending")])
        side, key, copies = (group[c].to_numpy() for c in ("_side", "_k", "_copies"))
        if group["_low"][0].as_py() == group["_high"][0].as_py():
            own = _matrix(group["_v"])
            count, label = meet(own, own, copies, copies, least, main)
        else:
            n = int((~side).sum())
            if n == 0 or n == len(key):  # nothing of the other block is within reach
                count, label = np.zeros(len(key), np.int64), np.arange(len(key))
            else:
                own = _matrix(group["_v"])
                count, label = meet(own[:n], own[n:], copies[:n], copies[n:], least, main)
        some = count > 0
        return pa.table({"_k": key[some], "_links": count[some], "_root": key[label[some]]})

    return dealt.groupBy("_low", "_high").applyInArrow(compare, "_k long, _links long, _root long")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.monotonically_increasing_id().alias("_rid"))
    rows = materialize(rows.withColumn("_ok", usable(F.col("_v"))), "vectors")
    good = rows.where("_ok")
    nodes = good.groupBy("_v").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_copies"))
    nodes = materialize(nodes.withColumn("_k", F.monotonically_increasing_id()).withColumn("_size", F.size("_v")), "nodes")
    found = None
    for (size,) in nodes.select("_size").distinct().orderBy("_size").collect():  # lengths of vectors: one, as a rule
        own = _meetings(nodes.where(F.col("_size") == size).select("_k", "_copies", "_v"), least)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = nodes.select("_k", F.col("_copies").alias("_links"), F.col("_k").alias("_root"))
    found = materialize(found, "links")
    roots = components(found, "_k", "_root")
    linked = nodes.join(found.groupBy("_k").agg(F.sum("_links").alias("_links")), "_k", "left").join(roots, F.col("_k") == F.col("node"), "left")
    links = F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1
    linked = linked.select("_v", "_low", F.coalesce("root", "_k").alias("_root"), links.alias("n_links"))
    least_id = linked.groupBy("_root").agg(F.min("_low").alias("component_id"))
    classes = linked.join(least_id, "_root").select("_v", "n_links", "component_id")
    out = good.join(classes, "_v").select("_id", "n_links", "component_id")
    lone = rows.where("NOT _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return out.unionByName(lone).select(
        F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
