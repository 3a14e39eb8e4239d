"""C-4: exact DBSCAN on micro-cells, without pair lists inside dense regions.

Cells have sides of eps / sqrt(d), so any two rows of a cell are neighbours.

* Rows of a cell with ``min_samples`` members are core by the cell's count.  The
  others (fewer than ``min_samples`` to a cell) add the counts of adjacent cells
  that lie wholly within eps and meet the rows of those that do so in part.
* The core rows of a cell form one node.  Two nodes are linked when their
  closest rows are within eps, which a descent finds: boxes of rows are halved
  round by round; a pair of boxes is dropped when it lies apart, settles the
  link when it lies wholly within eps (or its two example rows do), and only the
  open ones go on.  Pairs of few rows are compared row by row.
* Components of nodes carry the labels; rows that are not core take the smallest
  label of a core row within eps, the rest is noise (-1).

The shuffled rows follow the rows and the adjacent occupied cells, not the
pairs.  Rows of one cell are dealt to parts by a hash of the key, so a cell that
holds a third of all rows never meets in one task.

Bounds are sums in the order of the distance itself, and rounding is monotone:
a box never decides otherwise than its rows would.

Two cases take a shorter way to the same labels when the keys are distinct:

* On one axis the rows are dealt to tiles, each with the rows of 3 eps beyond its
  borders.  A tile sorts its values, counts by binary search and cuts clusters at
  gaps above eps; only chains across tile borders meet in a graph.  A table with
  over ``TILE_ROWS`` rows in a tile of least width stays with the cells.
* With over ``UNROLLED`` dimensions no grid separates rows.  Equal vectors become
  one with a weight, and blocks of vectors meet pairwise: a matrix product decides
  most pairs, those near eps are summed again in the order of the distance.  That
  is quadratic in time, but a task holds two blocks, and a block pair gives counts,
  a spanning forest of its links and least labels, never its pairs.  A sweep counts
  the neighbours for every eps in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.graph import connected_components
from quarry.functions.ranking import dense_codes, positions
from quarry.session import checkpoint

#: Leading dimensions of the coarse grid that brings adjacent cells together.
GRID_DIMS = 3
#: Rows of one cell that share a part, on average.
PART_ROWS = 65_536
#: Two boxes of at most so many row pairs are compared row by row.
FEW_PAIRS = 1024
#: Distances of at most so many dimensions are written out as one expression.
UNROLLED = 8
#: Most rows of a tile on one axis, and its least width in eps.
TILE_ROWS, TILE_EPS = 1 << 18, 16
#: Vectors of a block are a sixteenth of all, within these bounds.
BLOCK_ROWS = (1024, 16_384)


def _sum2(arrays: list[str], d: int, differ) -> Column:
    """Sum of squares of ``differ`` of the arrays' entries, in order; written out only for few dimensions."""
    if d <= UNROLLED:
        terms = [differ(*[F.col(a)[i] for a in arrays]) for i in range(d)]
        return sum((t * t for t in terms), F.lit(0.0))
    spots = F.sequence(F.lit(0), F.lit(d - 1))
    terms = F.transform(spots, lambda i: differ(*[F.get(F.col(a), i) for a in arrays]))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t * t)


def _dist2(x: str, y: str, d: int) -> Column:
    return _sum2([x, y], d, lambda a, b: a - b)


def _gap2(alo: str, ahi: str, blo: str, bhi: str, d: int) -> Column:
    """Least squared distance between two boxes."""
    return _sum2([alo, ahi, blo, bhi], d, lambda al, ah, bl, bh: F.greatest(F.lit(0.0), al - bh, bl - ah))


def _reach2(alo: str, ahi: str, blo: str, bhi: str, d: int) -> Column:
    """Greatest squared distance between rows of two boxes."""
    return _sum2([alo, ahi, blo, bhi], d, lambda al, ah, bl, bh: F.greatest(ah - bl, bh - al))


def _box(x: str, d: int) -> list[Column]:
    return [F.array(*[F.min(F.col(x)[i]) for i in range(d)]).alias("lo"), F.array(*[F.max(F.col(x)[i]) for i in range(d)]).alias("hi")]


def _adjacent(cells: DataFrame, cell_reach: int, d: int, eps2: float) -> DataFrame:
    """(a, b, a_rows): ordered pairs of different cells whose boxes come within eps."""
    g = min(d, GRID_DIMS)
    coarse = [F.floor(F.col("cell")[i] / F.lit(cell_reach)).cast("long") for i in range(g)]
    offsets = [[]]
    for _ in range(g):
        offsets = [o + [s] for o in offsets for s in (-1, 0, 1)]
    around = F.explode(F.array(*[F.array(*[c + F.lit(s) for c, s in zip(coarse, o)]) for o in offsets]))
    left = cells.select(F.col("c").alias("a"), F.col("n").alias("a_rows"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), around.alias("k"))
    right = cells.select(F.col("c").alias("b"), "lo", "hi", F.array(*coarse).alias("k"))
    return left.join(right, "k").where((F.col("a") != F.col("b")) & (_gap2("alo", "ahi", "lo", "hi", d) <= eps2)).select("a", "b", "a_rows")


def _meetings(rows: DataFrame, pairs: DataFrame, boxes: DataFrame, others: DataFrame, parts: DataFrame, d: int, eps2: float):
    """Rows of cell ``a`` against each adjacent cell ``b``: (surely near cells, near rows of the cells near in part).

    ``boxes`` (c, lo, hi, ...) bound the rows ``others`` (c, part, x) of each cell.
    """
    met = rows.select("id", "x", F.col("c").alias("a")).join(pairs.select("a", "b"), "a").drop("a")
    met = met.join(boxes.withColumnRenamed("c", "b"), "b").where(_gap2("x", "x", "lo", "hi", d) <= eps2)
    within = _reach2("x", "x", "lo", "hi", d) <= eps2
    sure = met.where(within).drop("x", "lo", "hi")
    open_ = met.where(~within).drop("lo", "hi").join(parts.select(F.col("c").alias("b"), "part"), "b")
    there = others.select(F.col("c").alias("b"), "part", F.col("x").alias("y"))
    return sure, open_.join(there, ["b", "part"]).where(_dist2("x", "y", d) <= eps2).drop("x", "y", "part")


def _links(cores: DataFrame, boxes: DataFrame, pairs: DataFrame, side: float, d: int, eps2: float) -> DataFrame:
    """(u, v): adjacent cells, u < v, with core rows within eps of each other."""
    at = boxes.select("c", "lo", "hi", F.col("n").alias("rows"))
    a = at.select(F.col("c").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("rows").alias("an"))
    b = at.select(F.col("c").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("rows").alias("bn"))
    tried = pairs.where("a < b").select("a", "b").join(a, "a").join(b, "b")
    tried = tried.withColumn("gap", _gap2("alo", "ahi", "blo", "bhi", d)).where(F.col("gap") <= eps2)
    tried = checkpoint(tried.select("a", "b", "an", "bn", (_reach2("alo", "ahi", "blo", "bhi", d) <= eps2).alias("near")))
    found = [tried.where("near").select(F.col("a").alias("u"), F.col("b").alias("v"))]
    root = F.array().cast("array<long>")
    open_ = tried.where("not near").select("a", "b", "an", "bn", root.alias("sa"), root.alias("sb"))
    level, rows = 0, cores.select("c", "x")
    rows = rows.withColumn("sub", root)
    while True:
        few = F.col("an") * F.col("bn") <= FEW_PAIRS
        left = rows.select(F.col("c").alias("a"), F.col("sub").alias("sa"), "x")
        right = rows.select(F.col("c").alias("b"), F.col("sub").alias("sb"), F.col("x").alias("y"))
        close = open_.where(few).join(left, ["a", "sa"]).join(right, ["b", "sb"]).where(_dist2("x", "y", d) <= eps2)
        met = checkpoint(close.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        found.append(met)
        open_ = checkpoint(open_.where(~few).join(met.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti"))
        if open_.isEmpty():
            return found[0] if len(found) == 1 else _union(found)
        level += 1
        touched = open_.select(F.col("a").alias("c"), F.col("sa").alias("up")).union(open_.select("b", "sb")).distinct()
        half = F.lit(side / 2.0**level)
        sub = F.transform("x", lambda v: F.floor(v / half).cast("long"))
        rows = rows.withColumnRenamed("sub", "up").withColumn("sub", sub)
        halves = rows.groupBy("c", "up", "sub").agg(*_box("x", d), F.count(F.lit(1)).alias("n"), F.min("x").alias("x"))
        halves = checkpoint(halves.join(touched, ["c", "up"], "left_semi"))
        a = halves.select(F.col("c").alias("a"), F.col("up").alias("sa"), F.col("sub").alias("ka"), F.col("lo").alias("alo"),
                          F.col("hi").alias("ahi"), F.col("n").alias("an"), "x")
        b = halves.select(F.col("c").alias("b"), F.col("up").alias("sb"), F.col("sub").alias("kb"), F.col("lo").alias("blo"),
                          F.col("hi").alias("bhi"), F.col("n").alias("bn"), F.col("x").alias("y"))
        tried = open_.select("a", "b", "sa", "sb").join(a, ["a", "sa"]).join(b, ["b", "sb"])
        tried = tried.where(_gap2("alo", "ahi", "blo", "bhi", d) <= eps2)
        near = (_reach2("alo", "ahi", "blo", "bhi", d) <= eps2) | (_dist2("x", "y", d) <= eps2)
        tried = checkpoint(tried.select("a", "b", F.col("ka").alias("sa"), F.col("kb").alias("sb"), "an", "bn", near.alias("near")))
        met = tried.where("near").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        found.append(met)
        open_ = tried.where("not near").drop("near").join(met.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
        rows = rows.drop("up")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _tile_labels():
    """A function for one tile of ``_on_a_line``, made here so that it travels to the workers by value."""
    import numpy as np
    import pyarrow as pa

    def spans(u, eps2):
        """For each of the ascending values the last one within eps: by binary search, then by the distance itself."""
        last = np.searchsorted(u, u + np.sqrt(eps2), "right") - 1
        while True:
            after = np.minimum(last + 1, len(u) - 1)
            up = (after > last) & ((u[after] - u) * (u[after] - u) <= eps2)
            down = (u[last] - u) * (u[last] - u) > eps2
            if not (up.any() or down.any()):
                return last
            last = last + up - down

    def labels(table, eps2, least, ends):
        """The tile's own rows (id, core, node, other node) and the links between its nodes and those of the tile before.

        Nodes are runs of core values, numbered from 0 in ascending order; ``ends`` is a second number of the last one.
        """
        v, own = table.column("v").to_numpy(), table.column("own").to_numpy()
        tile, ids = table.column("tile")[0].as_py(), table.column("id").combine_chunks()
        u, at, copies = np.unique(v, return_inverse=True, return_counts=True)
        last = spans(u, eps2)
        upto = np.concatenate([[0], np.cumsum(copies)])
        core = upto[last + 1] - upto[np.searchsorted(last, np.arange(len(u)))] >= least
        inside = np.zeros(len(u), bool)
        inside[at[own]] = True
        cores, lo, hi = np.flatnonzero(core), np.flatnonzero(inside)[0], np.flatnonzero(inside)[-1]
        starts = np.ones(len(cores), bool)
        starts[1:] = last[cores[:-1]] < cores[1:]
        mine = inside[cores]
        first = tile * (ends + 1)
        run = np.cumsum(starts & mine) - 1
        linked = bool(mine.any()) and not starts[np.flatnonzero(mine)[0]]
        node = first + run + (1 if linked else 0)
        node = np.where(cores < lo, first - 1, np.where(cores > hi, first + ends + 1, node))
        name, other = np.full(len(u), -1, np.int64), np.full(len(u), -1, np.int64)
        some, two = core.copy(), np.zeros(len(u), bool)
        name[cores] = node
        loose = np.flatnonzero(~core)
        if len(cores) and len(loose):
            k = np.searchsorted(cores, loose)
            left, right = np.maximum(k - 1, 0), np.minimum(k, len(cores) - 1)
            near_left = (k > 0) & (last[cores[left]] >= loose)
            near_right = (k < len(cores)) & (last[loose] >= cores[right])
            some[loose], two[loose] = near_left | near_right, near_left & near_right
            name[loose] = np.where(near_left, node[left], node[right])
            other[loose] = node[right]
        links = [(first + int(run[mine][-1]) + (1 if linked else 0), first + ends)] if mine.any() else []
        links += [(first, first - 1)] if linked else []
        rows = at[own]
        n = len(links)
        none = pa.nulls(n, pa.bool_())
        return pa.table({
            "id": pa.concat_arrays([ids.filter(pa.array(own)), pa.nulls(n, ids.type)]),
            "core": pa.concat_arrays([pa.array(core[rows]), none]),
            "node": pa.concat_arrays([pa.array(name[rows], mask=~some[rows]), pa.array([a for a, _ in links], pa.int64())]),
            "other": pa.concat_arrays([pa.array(other[rows], mask=~two[rows]), pa.array([b for _, b in links], pa.int64())]),
        })

    return labels


def _on_a_line(pts: DataFrame, lo: float, hi: float, n: int, eps: float, least: int) -> DataFrame | None:
    """(id, cluster) of every row of one finite coordinate, or None where tiles would be too full."""
    far = max(abs(lo), abs(hi))
    width = max(TILE_EPS * eps, (hi - lo) * TILE_ROWS / (4 * n))
    if not eps > far * 2.0**-40 or not (hi - lo) / width < 2.0**40:
        return None
    v = F.col("x")[0]
    while True:
        tile = F.floor((v - F.lit(lo)) / F.lit(width)).cast("long")
        if pts.groupBy(tile.alias("tile")).count().agg(F.max("count")).first()[0] <= TILE_ROWS:
            break
        if width == TILE_EPS * eps:
            return None
        width = max(TILE_EPS * eps, width / 8)
    ends = (1 << 20) - 1  # above the number of nodes of a tile
    labels, eps2 = _tile_labels(), eps * eps
    halo = 3 * eps
    at = v - F.lit(lo)
    before = F.when(at - F.col("home") * F.lit(width) <= halo, F.col("home") - 1)
    after = F.when((F.col("home") + 1) * F.lit(width) - at <= halo, F.col("home") + 1)
    dealt = pts.withColumn("home", tile).select("id", v.alias("v"), "home", F.explode(F.filter(F.array("home", before, after), lambda t: t.isNotNull())).alias("tile"))
    dealt = dealt.select("id", "v", "tile", (F.col("home") == F.col("tile")).alias("own"))
    schema = T.StructType([T.StructField("id", pts.schema["id"].dataType), T.StructField("core", T.BooleanType()), T.StructField("node", T.LongType()), T.StructField("other", T.LongType())])

    def tiles(table):
        import pyarrow.compute as pc

        if not pc.any(table.column("own")).as_py():
            import pyarrow as pa

            empty = table.slice(0, 0)
            return pa.table({"id": empty.column("id"), "core": pa.array([], pa.bool_()), "node": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        return labels(table, eps2, least, ends)

    out = checkpoint(dealt.groupBy("tile").applyInArrow(tiles, schema))
    met = out.where("id is null").select(F.col("node").alias("u"), F.col("other").alias("v"))
    named = checkpoint(connected_components(met))
    rows = out.where("id is not null")
    local = rows.where("core").groupBy("node").agg(F.min("id").alias("first")).join(F.broadcast(named), "node", "left")
    local = checkpoint(local.select("node", "first", F.coalesce("comp", "node").alias("comp")))
    firsts = local.groupBy("comp").agg(F.min("first").alias("first"))
    codes = firsts.join(dense_codes(firsts, "first", "cluster"), "first").select("comp", F.col("cluster").cast("int").alias("cluster"))
    nodes = checkpoint(local.select("node", "comp").union(named.select("node", "comp")).distinct().join(codes, "comp").select("node", "cluster"))
    others = nodes.toDF("other", "second")
    one = rows.where("node is not null and other is null").join(nodes, "node").select("id", "cluster")
    two = rows.where("other is not null").join(nodes, "node").join(others, "other").select("id", F.least("cluster", "second"))
    return one.union(two).union(rows.where("node is null").select("id", F.lit(-1)))


def _block_steps():
    """Functions on the vectors of two blocks, made here so that they travel to the workers by value."""
    import numpy as np
    import pyarrow as pa

    def sides(table):
        """(columns, vectors) of the rows of either side."""
        side = table.column("side").to_numpy()
        for s in (0, 1):
            rows = table.filter(pa.array(side == s))
            flat = rows.column("x").combine_chunks().flatten().to_numpy()
            yield rows, flat.reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))

    def tiles(x, y, eps2s):
        """(first row, first column, k, rows within eps k of columns) for every part of the two blocks with such a pair."""
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        slack = 1e-15 * (x.shape[1] + 4) * (xx.max(initial=0) + yy.max(initial=0))
        for i in range(0, len(x), 1024):
            for j in range(0, len(y), 2048):
                a, b = x[i : i + 1024], y[j : j + 2048]
                dist = xx[i : i + 1024, None] + yy[None, j : j + 2048] - 2 * (a @ b.T)
                if (dist > max(eps2s) + slack).all():
                    continue
                for k, eps2 in enumerate(eps2s):
                    hit = dist <= eps2 - slack
                    r, c = np.nonzero(~hit & ~(dist > eps2 + slack))
                    for lo in range(0, len(r), 1 << 18):
                        p, q = r[lo : lo + (1 << 18)], c[lo : lo + (1 << 18)]
                        total = np.zeros(len(p))
                        for t in range(x.shape[1]):
                            gap = a[p, t] - b[q, t]
                            total += gap * gap
                        hit[p, q] = total <= eps2
                    if hit.any():
                        yield i, j, k, hit

    def counts(key, table, eps2s):
        (left, x), (right, y) = sides(table)
        w, v = (t.column("w").to_numpy().astype(float) for t in (left, right))
        near, back = np.zeros((len(eps2s), len(x))), np.zeros((len(eps2s), len(y)))
        for i, j, k, hit in tiles(x, y, eps2s):
            hit = hit.astype(float)
            near[k, i : i + len(hit)] += hit @ v[j : j + hit.shape[1]]
            back[k, j : j + hit.shape[1]] += w[i : i + len(hit)] @ hit
        c = [left.column("c").to_numpy()]
        if key[0].as_py() != key[1].as_py():
            c, near = [*c, right.column("c").to_numpy()], np.concatenate([near, back], 1)
        return pa.table({"c": np.concatenate(c), **{f"n{k}": near[k].astype(np.int64) for k in range(len(eps2s))}})

    def tree(hit):
        """Pairs (row, column) that connect what ``hit`` connects, fewer than its rows and columns."""
        rows, cols = hit.any(1), hit.any(0)
        found = []
        while rows.any():
            now = np.array([rows.argmax()])
            rows[now] = False
            while len(now):
                part = hit[now]
                new = np.flatnonzero(part.any(0) & cols)
                cols[new] = False
                found.append((now[part[:, new].argmax(0)], new))
                part = hit[:, new]
                now = np.flatnonzero(part.any(1) & rows)
                rows[now] = False
                if len(now):
                    found.append((now, new[part[now].argmax(1)]))
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])

    def forests(key, table, eps2s):
        (left, x), (right, y) = sides(table)
        c, d = left.column("c").to_numpy(), right.column("c").to_numpy()
        found = [np.zeros((2, 0), np.int64)]
        for i, j, _, hit in tiles(x, y, eps2s):
            r, q = tree(hit)
            found.append(np.stack([c[i + r], d[j + q]]))
        u, v = np.concatenate(found, 1)
        return pa.table({"u": u, "v": v})

    def borders(key, table, eps2s):
        (left, x), (right, y) = sides(table)
        label, none = right.column("w").to_numpy(), np.iinfo(np.int64).max
        best = np.full(len(x), none)
        for i, j, _, hit in tiles(x, y, eps2s):
            least = np.where(hit, label[None, j : j + hit.shape[1]], none).min(1)
            best[i : i + len(hit)] = np.minimum(best[i : i + len(hit)], least)
        some = best < none
        return pa.table({"c": left.column("c").to_numpy()[some], "w": best[some]})

    return counts, forests, borders


def _meet(left: DataFrame, right: DataFrame | None, blocks: int, step, eps2s: list[float], schema: str) -> DataFrame:
    """``step`` on each two blocks of rows (c, w, x); without ``right`` on each unordered two of ``left``."""
    block, last = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"), F.lit(blocks - 1)
    rows = left.select("c", "w", "x", block.alias("b"))
    others = rows if right is None else right.select("c", "w", "x", block.alias("b"))
    start, end = (F.lit(0), last) if right is not None else (F.col("b"), F.col("b"))
    a = rows.select(F.lit(0).alias("side"), "c", "w", "x", F.col("b").alias("i"), F.explode(F.sequence(start, last)).alias("j"))
    b = others.select(F.lit(1).alias("side"), "c", "w", "x", F.explode(F.sequence(F.lit(0), end)).alias("i"), F.col("b").alias("j"))
    met = a.union(b).repartition(min(1000, blocks * blocks), "i", "j")

    def run(key, table):
        return step(key, table, eps2s)

    return met.groupBy("i", "j").applyInArrow(run, schema)


def _by_blocks(pts: DataFrame, n: int, epss: list[float], least: int) -> Iterator[DataFrame | None]:
    """For each eps (id, cluster) of every row that is not noise, or None if all are."""
    counts, forests, borders = _block_steps()
    deal = F.pmod(F.xxhash64("id"), F.lit(n // PART_ROWS + 1)).cast("int")
    pts = pts.withColumn("part", deal)
    tally = checkpoint(pts.groupBy("x", "part").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("first")))
    vecs = tally.groupBy("x").agg(F.sum("w").alias("w"), F.min("first").alias("first"))
    vecs = checkpoint(vecs.withColumn("c", F.monotonically_increasing_id()))
    members = checkpoint(pts.join(tally.select("x", "part").join(vecs.select("x", "c"), "x"), ["x", "part"]).select("id", "part", "c"))

    def blocks(m: int) -> int:
        return -(-m // min(max(m // 16, BLOCK_ROWS[0]), BLOCK_ROWS[1]))

    eps2s, names = [e * e for e in epss], [f"n{k}" for k in range(len(epss))]
    near = _meet(vecs, None, blocks(vecs.count()), counts, eps2s, "c long, " + ", ".join(f"{k} long" for k in names))
    near = checkpoint(near.groupBy("c").agg(*[F.sum(k).alias(k) for k in names]))
    sizes = near.join(vecs.select("c", "w"), "c").agg(*[F.count_if(F.col(k) >= least) for k in names], *[F.count_if((F.col(k) < least) & (F.col(k) > F.col("w"))) for k in names]).first()
    for k, name in enumerate(names):
        n_cores, n_loose = sizes[k], sizes[len(names) + k]
        if not n_cores:
            yield None
            continue
        known = vecs.join(near.select("c", name), "c")
        cores = checkpoint(known.where(F.col(name) >= least).select("c", "w", "x", "first"))
        links = checkpoint(_meet(cores, None, blocks(n_cores), forests, [eps2s[k]], "u long, v long"))
        comps = connected_components(links).withColumnRenamed("node", "c")
        nodes = checkpoint(cores.select("c", "first").join(comps, "c", "left").select("c", "first", F.coalesce("comp", "c").alias("comp")))
        firsts = nodes.groupBy("comp").agg(F.min("first").alias("first"))
        codes = firsts.join(dense_codes(firsts, "first", "cluster"), "first").select("comp", "cluster")
        labels = checkpoint(nodes.join(codes, "comp").select("c", F.col("cluster").alias("w")))
        if n_loose:
            loose = known.where((F.col(name) < least) & (F.col(name) > F.col("w"))).select("c", "w", "x")
            there = cores.select("c", "x").join(labels, "c")
            border = _meet(loose, there, blocks(max(n_cores, n_loose)), borders, [eps2s[k]], "c long, w long")
            labels = labels.union(border.groupBy("c").agg(F.min("w")))
        spread = members.select("c", "part").distinct().join(labels, "c")
        yield members.join(spread, ["c", "part"]).select("id", F.col("w").cast("int").alias("cluster"))


def dbscan(vec: DataFrame, key: list[str], cols: list[str], eps: float, min_samples: int = 5) -> DataFrame:
    """DBSCAN labels ``(key..., cluster)``: 0.. in order of each cluster's smallest core key, noise -1.

    ``key`` tells rows apart; rows at distance eps exactly are neighbours, and a
    row is its own.  Rows with a null or non-finite coordinate are noise and
    nobody's neighbour; an empty table gives an empty result.
    """
    return next(dbscan_sweep(vec, key, cols, [eps], min_samples))


def dbscan_sweep(vec: DataFrame, key: list[str], cols: list[str], epss: list[float], min_samples: int = 5) -> Iterator[DataFrame]:
    """The labels of :func:`dbscan` for each of ``epss``, one after the other."""
    for eps in epss:
        if not eps > 0:
            raise ValueError(f"eps must be above 0, got {eps}")
    d = len(cols)
    keyed = vec.select(*key, F.struct(*key).alias("__id"))
    pts = vec.select(F.struct(*key).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    pts = pts.where(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))))
    ends = [F.min(F.col("x")[0]), F.max(F.col("x")[0])]
    n, far, lo, hi = pts.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("x", F.abs))), *ends).first()
    noise = F.lit(-1).alias("cluster")
    if not n:
        yield from (keyed.select(*key, noise) for _ in epss)
        return
    found = None
    if (d == 1 or d > UNROLLED) and pts.select("id").distinct().count() == n:
        found = _by_blocks(pts, n, epss, min_samples) if d > 1 else (_on_a_line(pts, lo, hi, n, eps, min_samples) for eps in epss)
    for eps in epss:
        got = next(found) if found is not None else None
        if got is None:
            noise_only = found is not None and d > 1
            got = None if noise_only else _by_cells(pts, n, far, d, eps, min_samples)
        elif d == 1:
            rest = vec.where(~F.coalesce(F.abs(F.col(cols[0]).cast("double")) < F.lit(float("inf")), F.lit(False)))
            yield got.select(*[F.col("id")[k].alias(k) for k in key], "cluster").union(rest.select(*key, noise))
            continue
        if got is None:
            yield keyed.select(*key, noise)
        else:
            yield keyed.join(got.toDF("__id", "__cluster"), "__id", "left").select(*key, F.coalesce("__cluster", F.lit(-1)).alias("cluster"))


def _by_cells(pts: DataFrame, n: int, far: float, d: int, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster) of every row that is not noise, by micro-cells."""
    eps2 = eps * eps
    # sides give way a little to the rounding of far coordinates, so that cells never exceed eps across
    side = eps / math.sqrt(d) * (1 - min(0.5, max(1e-9, far * math.sqrt(d) / eps * 2.0**-50)))
    deal = F.pmod(F.xxhash64("id"), F.lit(n // PART_ROWS + 1)).cast("int")
    pts = pts.withColumn("cell", F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("long"))).withColumn("part", deal)

    tally = checkpoint(pts.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), *_box("x", d)))
    whole = tally.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.min(F.col("lo")[i]) for i in range(d)]).alias("lo"),
                                      F.array(*[F.max(F.col("hi")[i]) for i in range(d)]).alias("hi"))
    cells = checkpoint(positions(whole, ["cell"], "c"))
    parts = checkpoint(tally.select("cell", "part").join(cells.select("cell", "c", "n"), "cell"))
    rows = checkpoint(pts.join(parts, ["cell", "part"]).select("id", "x", "c", "part", "n"))
    pairs = checkpoint(_adjacent(cells, int(eps / side) + 1, d, eps2))

    dense = F.col("n") >= min_samples
    thin = rows.where(~dense)
    sure, hits = _meetings(thin, pairs.where(F.col("a_rows") < min_samples), cells.select("c", "lo", "hi", "n"), rows.select("c", "part", "x"), parts, d, eps2)
    weights = thin.select("id", "n").union(sure.select("id", "n")).union(hits.select("id", F.lit(1).cast("long")))
    known = weights.groupBy("id").agg(F.sum("n").alias("near"))
    thin = checkpoint(thin.join(known, "id"))
    loose = thin.where(F.col("near") < min_samples)
    cores = rows.where(dense).select("id", "x", "c", "part").union(thin.where(F.col("near") >= min_samples).select("id", "x", "c", "part"))
    boxes = checkpoint(cores.groupBy("c").agg(*_box("x", d), F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))

    comps = connected_components(_links(cores, boxes, pairs, side, d, eps2)).withColumnRenamed("node", "c")
    nodes = checkpoint(boxes.select("c", "first").join(comps, "c", "left").select("c", "first", F.coalesce("comp", "c").alias("comp")))
    firsts = nodes.groupBy("comp").agg(F.min("first").alias("first"))
    codes = firsts.join(dense_codes(firsts, "first", "cluster"), "first").select("comp", F.col("cluster").cast("int").alias("cluster"))
    labels = checkpoint(nodes.join(codes, "comp").select("c", "cluster"))

    core_labels = cores.join(parts.select("c", "part").join(labels, "c"), ["c", "part"]).select("id", "cluster")
    sure, hits = _meetings(loose, pairs, boxes.select("c", "lo", "hi").join(labels, "c"), cores.select("c", "part", "x"), parts, d, eps2)
    own = loose.join(labels, "c").select("id", "cluster")
    border = own.union(sure.select("id", "cluster")).union(hits.select("id", "cluster")).groupBy("id").agg(F.min("cluster").alias("cluster"))
    return core_labels.union(border)
