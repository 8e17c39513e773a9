"""The rank table: the nearest points of every point, for manifolds of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.functions import explode_range
from tidelag.operators import neighbors, tiles
from tidelag.operators.embedding import drop_invalid
from tidelag.operators.neighbors import FOUND, MANIFOLD, NEIGHBOURS, UNIT, deal_out, explode_neighbors, nearest_of_all
from tidelag.staging import stage

#: Manifolds of more points than this are cut into boxes of about BOX_POINTS.
SHORT = 1 << 14
BOX_POINTS = 2048
#: Points by which a cell is cut, and cuts below one another at a time.
SAMPLE, DEPTH = 4096, 9
BOX = [*MANIFOLD, "slab", "box"]
RANKED = [*MANIFOLD, "p", "q", "d", "r"]


def rank_neighbors(
    manifold: DataFrame, k_max: int | None, exclude_zero_distance: bool = False, sizes: DataFrame | None = None
) -> DataFrame:
    """The k_max nearest points of every point, in (distance, index) order, all of them if
    ``k_max`` is None. Columns series_id, E, tau, p, q, d, r.

    Points of short manifolds meet all others, block by block. Longer ones are cut into boxes;
    see _by_boxes. Which there are is looked up when this is called, from ``sizes`` (series_id,
    E, tau, n) if given."""
    if k_max is None:
        cells = neighbors.pair_distances(manifold)
        rows = cells.selectExpr(*MANIFOLD, "p", "inline(arrays_zip(q, d))")
        if exclude_zero_distance:
            rows = rows.where("d >= 1e-30D")
        return rows.withColumn("r", F.row_number().over(Window.partitionBy(*MANIFOLD, "p").orderBy("d", "q"))).select(*RANKED)
    longest = (manifold if sizes is None else sizes).agg(F.max("n")).first()[0] or 0
    found = nearest(manifold.where(f"n <= {SHORT}"), k_max, exclude_zero_distance, min(longest, SHORT) > neighbors.TILE)
    ranked = explode_neighbors(found).select(*RANKED)
    if longest <= SHORT:
        return ranked
    return ranked.unionByName(_by_boxes(manifold.where(f"n > {SHORT}"), k_max, exclude_zero_distance).select(*RANKED))


def ranked_arrays(manifold: DataFrame, k_max: int) -> DataFrame:
    """The same as arrays: series_id, E, tau, p, y, q, d, yq for every point, also for those that
    have no neighbours."""
    longest = manifold.agg(F.max("n")).first()[0] or 0
    columns = [*MANIFOLD, "p", "y", "q", "d", "yq"]
    found = nearest(manifold.where(f"n <= {SHORT}"), k_max, False, min(longest, SHORT) > neighbors.TILE).select(*columns)
    if longest <= SHORT:
        return found
    long = manifold.where(f"n > {SHORT}")
    packed = _by_boxes(long, k_max, False).groupBy(*MANIFOLD, "p").agg(F.expr("array_sort(collect_list(struct(r, q, d, yq))) AS near"))
    rows = long.select(*MANIFOLD, F.col("i").alias("p"), "y").join(packed, [*MANIFOLD, "p"], "left")
    none = "CAST(array() AS ARRAY<{}>)"
    kinds = {"q": "BIGINT", "d": "DOUBLE", "yq": "DOUBLE"}
    arrays = [f"coalesce(near.{c}, {none.format(kind)}) AS {c}" for c, kind in kinds.items()]
    return found.unionByName(rows.selectExpr(*MANIFOLD, "p", "y", *arrays))


def nearest(manifold: DataFrame, k: int, exclude_zero_distance: bool = False, several: bool = True) -> DataFrame:
    """The k nearest points of every point as arrays: the columns of knn_in_library, as one draw
    that holds every point. ``several``: manifolds may have more points than a chunk."""
    per = neighbors._per_block()
    points = neighbors._packed(manifold, per, "block").selectExpr(*UNIT[:-1], "-1L AS chunk", "points")
    chunks = neighbors._packed(manifold, str(neighbors.TILE), "chunk")
    chunks = explode_range(chunks, "block", neighbors._block_count()).select(*UNIT[:-1], "chunk", "points")
    rows = deal_out(points.unionByName(chunks), *UNIT[:-1]).sortWithinPartitions(*UNIT[:-1], "chunk")
    found = rows.mapInArrow(tiles.every_kernel(k, exclude_zero_distance), NEIGHBOURS)
    return nearest_of_all(found, str(k)) if several else found.select(*FOUND)


def _by_boxes(manifold: DataFrame, k_max: int, no_zero: bool) -> DataFrame:
    """Ranks of long manifolds. Points are cut into boxes by all their coordinates. A box first
    meets itself, which bounds how far each of its points still has to look; then it meets the
    boxes that come nearer than the widest of these bounds, and of its points those take part
    that the other box comes near enough to. The boxes, and what they find in themselves, are
    staged when this is called.

    Of many copies of one vector only the first k_max + 1 can be anybody's neighbours, so
    only they go into boxes. The other copies share their answer. Copies are found by a hash
    of their numbers as text, and the text, since rows are slow to sort by arrays (0 and -0 are the
    same number)."""
    valid = drop_invalid(manifold).withColumn("_text", F.expr("CAST(transform(v, a -> a + 0D) AS STRING)"))
    valid = valid.withColumn("_hash", F.expr("xxhash64(_text)"))
    same = ["_hash", *MANIFOLD, "_text"]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy("i"))
    firsts = placed = _place(valid.withColumn("_copy", copy).where(f"_copy <= {k_max + 1}"))

    together = placed.select("box", "slab", *MANIFOLD, "i", "y", "v").repartition(*BOX).sortWithinPartitions("box", "slab", *MANIFOLD)
    boxes = neighbors.pack(together, BOX).selectExpr(*BOX, "points AS lib", "array_min(points.i) AS first_i")
    # bounds of every coordinate, from the members of the box
    edge = "transform(sequence(0, E - 1), j -> array_{0}(transform(lib, p -> p.v[j])))"
    boxes = stage(boxes.selectExpr("*", f"{edge.format('min')} AS lo", f"{edge.format('max')} AS hi"))
    kernel = tiles.box_kernel(k_max, no_zero)

    def rank(units: DataFrame) -> DataFrame:
        return units.select(*BOX, "points", "lib", "reach").mapInArrow(kernel, f"{NEIGHBOURS}, slab bigint, box bigint")

    unbound = "CAST(NULL AS ARRAY<STRUCT<i: BIGINT, d: DOUBLE>>) AS reach"
    own = stage(rank(deal_out(boxes.selectExpr("*", "lib AS points", unbound), *BOX)))
    reach = f"CASE WHEN size(d) < {k_max} THEN double('inf') ELSE d[{k_max - 1}] END"
    reached = own.selectExpr(*BOX, "p AS i", f"{reach} AS d", f"coalesce(get(q, {k_max - 1}), 0L) AS q")
    bounds = reached.groupBy(*BOX).agg(F.expr("max(struct(d, q)) AS worst"), F.expr("collect_list(struct(i, d)) AS reach"))
    bounds = stage(bounds)
    meetings = _meetings(boxes.drop("lib"), bounds.drop("reach"))
    here = boxes.select(*BOX, F.col("lib").alias("points")).join(bounds.select(*BOX, "reach"), BOX)
    there = boxes.select(*MANIFOLD, F.col("slab").alias("slab_b"), F.col("box").alias("box_b"), "lib")
    units = meetings.join(here, BOX).join(there, [*MANIFOLD, "slab_b", "box_b"])
    others = rank(deal_out(units, *BOX, "slab_b", "box_b"))

    # numbers come first, as text in front is slow to sort by
    order = Window.partitionBy("p", *MANIFOLD).orderBy("d", "q")
    ranked = (
        explode_neighbors(own.unionByName(others)).drop("r")
        .withColumn("r", F.row_number().over(order)).where(f"r <= {k_max}").select(*RANKED, "yq")
    )
    last = firsts.where(f"_copy = {k_max + 1}").select(*same, F.col("i").alias("_last"))
    rest = valid.select(*same, F.col("i").alias("p")).join(last, same).where("p > _last").drop("_last")
    if no_zero:
        first = firsts.where("_copy = 1").select(*same, F.col("i").alias("p"))
        answer = ranked.join(first, ["p", *MANIFOLD]).drop("p")
    else:
        answer = firsts.where(f"_copy <= {k_max}").selectExpr(*same, "i AS q", "0D AS d", "_copy AS r", "y AS yq")
    return ranked.unionByName(rest.join(answer, same).select(*RANKED, "yq"))


def _place(points: DataFrame) -> DataFrame:
    """Add slab and box, and write the points. A slab is a cell of a first tree of cuts, a box
    one of a second tree inside the slab; the cuts halve a sample of the cell at the median of
    its widest coordinate. Where many points share a coordinate, a cell may stay large; then it
    becomes several boxes of the same place."""
    rows = stage(points.withColumn("slab", F.lit(0).cast("bigint")))
    counts = rows.groupBy(*MANIFOLD, "slab").agg(F.count("*").alias("points"))
    levels = f"CAST(ceil(log2(points / {BOX_POINTS})) AS INT)"
    rows = stage(_cut(rows, counts, f"least({DEPTH}, ({levels} + 1) div 2)", "slab"))
    rows = rows.withColumn("box", F.lit(0).cast("bigint"))
    counts = rows.groupBy(*MANIFOLD, "slab", "box").agg(F.count("*").alias("points"))
    rows = stage(_cut(rows, counts, f"least({DEPTH}, {levels})", "box"))
    counts = rows.groupBy(*BOX).agg(F.expr(f"(count(*) + {2 * BOX_POINTS - 1}) div {2 * BOX_POINTS} AS _parts"))
    parted = rows.join(counts, BOX).withColumn("box", F.expr("box * 1000000000 + pmod(xxhash64(i), _parts)"))
    return stage(parted.drop("_parts"))


def _cut(rows: DataFrame, counts: DataFrame, depth: str, name: str) -> DataFrame:
    """Put each point into a cell of its tree, which replaces column ``name``."""
    keys = [c for c in counts.columns if c != "points"]
    cells = counts.selectExpr(*keys, "points", f"greatest(0, {depth}) AS _depth").where("_depth > 0")
    chosen = rows.join(cells, keys).where(f"pmod(xxhash64(i, v), greatest(1L, points div {SAMPLE})) = 0")
    samples = chosen.groupBy(*keys).agg(F.expr("max(_depth) AS _depth"), F.expr("collect_list(v) AS _sample"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema.fields)
    trees = samples.mapInArrow(tiles.tree_kernel(keys), f"{kinds}, _depth int, _axis array<int>, _at array<double>")
    # a projection for each step down: the same in a lambda would not be compiled
    placed = rows.join(stage(trees), keys, "left").withColumn("_node", F.lit(1))
    for level in range(1, DEPTH + 1):
        down = "2 * _node + IF(get(v, get(_axis, _node - 1)) <= get(_at, _node - 1), 0, 1)"
        placed = placed.selectExpr(*[f"`{c}`" for c in placed.columns if c != "_node"], f"IF({level} <= _depth, {down}, _node) AS _node")
    return placed.withColumn(name, F.expr("CASE WHEN _depth IS NULL THEN 0L ELSE CAST(_node AS BIGINT) END")).select(*rows.columns)


def _meetings(boxes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs of boxes that must meet: BOX, slab_b, box_b. Box b matters to box a if it is
    nearer than the worst k-th neighbour in a, or as near and holds a smaller index."""
    def all_of(how: str, column: str) -> str:
        return f"transform(sequence(0, E - 1), j -> array_{how}(transform({column}, a -> a[j])))"

    slabs = boxes.groupBy(*MANIFOLD, F.col("slab").alias("slab_b")).agg(F.expr("collect_list(lo) AS los"), F.expr("collect_list(hi) AS his"))
    slabs = slabs.selectExpr(*MANIFOLD, "slab_b", f"{all_of('min', 'los')} AS lo_b", f"{all_of('max', 'his')} AS hi_b")
    # Gaps are scaled down by far more than rounding could have added to them.
    close = 1 - 1e-12
    gaps = "zip_with(zip_with(lo_b, hi, (l, h) -> l - h), zip_with(lo, hi_b, (l, h) -> l - h), (x, y) -> greatest(0D, x, y))"
    gap = f"sqrt(aggregate({gaps}, 0D, (s, g) -> s + g * g)) * {close!r}D"
    a = boxes.join(bounds, BOX).join(slabs, MANIFOLD).where(f"{gap} <= worst.d").drop("lo_b", "hi_b", "first_i")
    b = boxes.selectExpr(*MANIFOLD, "slab AS slab_b", "box AS box_b", "first_i", "lo AS lo_b", "hi AS hi_b")
    met = a.join(b, [*MANIFOLD, "slab_b"]).where("NOT (slab = slab_b AND box = box_b)").selectExpr("*", f"{gap} AS gap")
    return met.where("gap < worst.d OR (gap = worst.d AND first_i < worst.q)").select(*BOX, "slab_b", "box_b")
