"""Nearest neighbours on lag vectors, by meetings of point blocks and candidate chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.functions import explode_range
from tidelag.operators import tiles
from tidelag.operators.library import draw_positions, drawn_by, runs_of
from tidelag.spec import Spec
from tidelag.staging import stage

#: Candidates per chunk, and bounds on the points per block. They set the size of the units
#: of work and never the answer.
TILE = 8192
FEW, MANY = 128, 2048
#: (draw, point) answers, library entries and draws that a unit may hold.
ANSWERS, ENTRIES, DRAWS = 1 << 19, 1 << 22, 1024
#: Answers of so many chunks are put together at a time.
TOGETHER = 64
POINTS = 1024
BLOCKS = f"(n + {POINTS - 1}) div {POINTS}"
#: Blocks of a summarised matrix, and coordinates that one of them may hold.
SIDES, ROOM = 32, 1 << 21
TASKS_PER_PARTITION = 2
MANIFOLD = ["series_id", "E", "tau"]
NEIGHBOURS = (
    "series_id string, E int, tau int, L int, sample int, p bigint, y double, "
    "q array<bigint>, d array<double>, m array<int>, yq array<double>, chunk bigint"
)
POINT = ["series_id", "E", "tau", "L", "sample", "p", "y"]
FOUND = [*POINT, "q", "d", "m", "yq"]
HITS = "ARRAY<STRUCT<g: INT, m: INT>>"
DRAW_LIST = "ARRAY<STRUCT<L: INT, size: BIGINT, sample: INT, ticket: BIGINT>>"


def deal_out(units: DataFrame, *keys: str) -> DataFrame:
    """Deal out units of work evenly. Their rows are few and small next to the work in
    them, so neither a broadcast join nor coalescing may decide how many tasks they get."""
    tasks = TASKS_PER_PARTITION * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(tasks, *keys)


def knn_in_library(
    manifold: DataFrame, spec: Spec, k: int | None = None, runs: DataFrame | None = None, sizes: DataFrame | None = None,
    library: DataFrame | None = None, points: DataFrame | None = None, pairs=None,
) -> DataFrame:
    """The k nearest library members of every point (k = E+1 if not given).

    One row per (series_id, E, tau, L, sample, p), with arrays in (distance, index) order:
    q neighbour, d distance, m times counted, yq target of the neighbour. A point is never
    its own neighbour. A point drawn m times fills up to m of the k places.

    Libraries are drawn by ``spec``; ``runs`` (series_id, E, tau, runs: array of (L, samples))
    gives each manifold a grid of its own. Or they are given: ``library`` (series_id, E, tau, L,
    sample, idx, m) names members by time index; m, how often a member counts, is 1 if null;
    equal rows add up, and rows that name no point of the manifold are left out, as are draws
    that have no others.

    Points go in blocks, candidates in chunks; every chunk meets every block, and the nearest of
    the chunks are put together by an aggregate, so a unit of work is one block with one chunk.
    ``spec.strategy`` says what the chunks hold. 'library_first': the members of the draws as a
    table, each with the draws that it belongs to, so blocks x members points are shipped and
    each draw is measured on its own. 'shared': all points, ranked once for all draws, which are
    made again in the task. 'auto' takes the first for the manifolds whose draws have fewer
    members, all together, than there are points. ``sizes`` (series_id, E, tau, n), if known,
    saves a look at the manifold for n; sizes are looked up when this is called. ``points``, if
    given, are the points of the manifold to answer for. ``pairs``: the (E, tau) of manifolds
    without dropped vectors; shared plans of several E then measure each lag once."""
    joint = points is None and pairs is not None and len({tau for _, tau in pairs}) < len(set(pairs))
    points = manifold if points is None else points
    if library is not None:
        members, drawn = _given(manifold, library)
        largest = drawn.agg(F.max(F.expr(LARGEST))).first()[0] or 0
        met = _meet_members(manifold, points, lambda packed: packed.join(drawn.drop("n"), MANIFOLD), _numbered(drawn), spec, k, members)
        return _together(met, spec, k, largest > TILE)
    if sizes is None:
        sizes = manifold.where("pos = 0")
    sizes = sizes.select(*MANIFOLD, "n")

    def with_runs(df: DataFrame) -> DataFrame:
        return df.withColumn("runs", F.expr(runs_of(spec))) if runs is None else df.join(runs.select(*MANIFOLD, "runs"), MANIFOLD)

    def with_draws(df: DataFrame) -> DataFrame:
        return with_runs(df).where("size(runs) > 0").withColumn("draws", F.expr(drawn_by(spec)))

    apart = {"auto": "aggregate(runs, 0L, (s, r) -> s + r.samples * least(CAST(r.L AS BIGINT), n)) < n"}
    apart = apart.get(spec.strategy, str(spec.strategy == "library_first").lower())
    most = "least(n, CAST(array_max(transform(runs, r -> r.L)) AS BIGINT))"
    kinds = with_runs(sizes).where("size(runs) > 0 AND n > 0").groupBy(F.expr(apart).alias("apart")).agg(
        F.max("n").alias("n"), F.max(F.expr(most)).alias("most")
    )
    found = []
    for kind in sorted(kinds.collect(), key=lambda r: r["apart"]):
        def mine(df: DataFrame, wanted: bool = kind["apart"]) -> DataFrame:
            return with_draws(df).where(F.expr(apart) == wanted).drop("runs")

        if kind["apart"]:
            numbered = draw_positions(_numbered(mine(sizes)), spec)
            met = _meet_members(manifold, points, mine, numbered, spec, k)
        elif joint:
            met = _meet_lags(manifold, mine(sizes), pairs, spec, k)
            kind = {"apart": False, "n": kind["n"] + max((E - 1) * tau for E, tau in pairs)}
        else:
            met = _meet_all(manifold, points, mine, spec, k)
        found.append(_together(met, spec, k, (kind["most"] if kind["apart"] else kind["n"]) > TILE))
    if not found:
        return _meet_all(manifold, points, with_draws, spec, k).select(*FOUND)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


LARGEST = "greatest(1L, array_max(transform(draws, t -> t.size)))"


def _per_block() -> str:
    return f"greatest({FEW}L, least({MANY}L, n div 16))"


def _block_count() -> str:
    return f"(n + {_per_block()} - 1) div {_per_block()}"


def _per_group(alone: bool) -> str:
    """Draws in a unit. Where each is on its own, as many as have room in one chunk."""
    if not alone:
        return f"greatest(1L, least({ANSWERS} div {_per_block()}, {ENTRIES} div {LARGEST}))"
    return f"greatest(1L, least({ANSWERS} div {_per_block()}, {DRAWS}L, CASE WHEN n <= {TILE} THEN {DRAWS}L ELSE {TILE} div {LARGEST} END))"


def _group_count(alone: bool) -> str:
    return f"(size(draws) + {_per_group(alone)} - 1) div {_per_group(alone)}"


def pack(rows: DataFrame, keys: list[str], hits: bool = False) -> DataFrame:
    """One row per ``keys`` with the other columns as an array of structs, ``points``; ``hits`` adds
    a field for HITS, null, which would be slow to send row by row. Rows are put together where
    they are, many at a time, and an aggregate is left with few lists. They should come in
    stretches of equal keys, as those of ``embed`` do."""
    columns = [f for f in rows.schema.fields if f.name not in keys]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]
    fields = [f"{f.name}: {f.dataType.simpleString()}" for f in columns] + ([f"hits: {HITS}"] if hits else [])
    kinds.append(f"points ARRAY<STRUCT<{', '.join(fields)}>>")
    parts = rows.mapInArrow(tiles.pack_kernel(keys, [f.name for f in columns], hits), ", ".join(kinds))
    return parts.groupBy(*keys).agg(F.expr("flatten(collect_list(points)) AS points"))


def _packed(manifold: DataFrame, per: str, name: str) -> DataFrame:
    rows = manifold.selectExpr(*MANIFOLD, "n", f"pos div {per} AS {name}", "i", "y", "v")
    return pack(rows, [*MANIFOLD, "n", name], hits=True)


def _point_units(manifold: DataFrame, with_draws, alone: bool) -> DataFrame:
    """A row for each block of points and group of draws; it leads its unit."""
    blocks = with_draws(_packed(manifold, _per_block(), "block"))
    blocks = explode_range(blocks, "grp", _group_count(alone))
    mine = f"slice(draws, CAST(grp * {_per_group(alone)} + 1 AS INT), CAST({_per_group(alone)} AS INT)) AS draws"
    return blocks.selectExpr(*UNIT, "-1L AS chunk", mine, "points")


UNIT = [*MANIFOLD, "n", "block", "grp"]
NO_DRAWS = f"CAST(NULL AS {DRAW_LIST}) AS draws"


def _rank_units(points: DataFrame, chunks: DataFrame, spec: Spec, k: int | None, in_task: bool) -> DataFrame:
    rows = points.unionByName(chunks.selectExpr(*UNIT, "chunk", NO_DRAWS, "points"))
    rows = deal_out(rows, *UNIT).sortWithinPartitions(*UNIT, "chunk")
    kernel = tiles.unit_kernel(
        TILE, k, spec.ties == "include", spec.exclude_zero_distance, spec.distinct_library, spec.replacement, in_task
    )
    return rows.mapInArrow(kernel, NEIGHBOURS)


def _meet_all(manifold: DataFrame, points: DataFrame, with_draws, spec: Spec, k: int | None) -> DataFrame:
    """Every block meets all points."""
    chunks = with_draws(_packed(manifold, str(TILE), "chunk")).selectExpr(*MANIFOLD, "n", "chunk", f"{_group_count(False)} AS _groups", "points")
    chunks = explode_range(explode_range(chunks, "block", _block_count()), "grp", "_groups")
    return _rank_units(_point_units(points, with_draws, False), chunks, spec, k, True)


def _meet_lags(manifold: DataFrame, drawn: DataFrame, pairs, spec: Spec, k: int | None) -> DataFrame:
    """Every block meets all points, for all E of a lag together. Of a time step only the longest
    vector is kept; n is the length of the series here."""
    longer = {(E, tau): min((e for e, t in pairs if t == tau and e > E), default=None) for E, tau in set(pairs)}
    shorter = " ".join(f"WHEN E = {E} AND tau = {tau} THEN i < {(e - 1) * tau}" for (E, tau), e in longer.items() if e)
    rows = manifold.where(f"CASE {shorter} ELSE true END").withColumn("n", F.expr("n + (E - 1) * tau"))
    key = ["series_id", "tau"]
    every = drawn.groupBy(*key).agg(F.expr("sort_array(collect_list(struct(E, n, draws))) AS _of"))
    every = every.selectExpr(*key, "flatten(transform(_of, m -> transform(m.draws, t -> struct(m.E AS E, m.n AS n, t.L, t.size, t.sample, t.ticket)))) AS draws")

    def packed(per: str, name: str) -> DataFrame:
        return pack(rows.selectExpr(*key, "n", f"i div {per} AS {name}", "i", "y", "v"), [*key, "n", name]).join(every, key)

    mine = f"slice(draws, CAST(grp * {_per_group(False)} + 1 AS INT), CAST({_per_group(False)} AS INT)) AS draws"
    unit = [*key, "n", "block", "grp"]
    blocks = explode_range(packed(_per_block(), "block"), "grp", _group_count(False)).selectExpr(*unit, "-1L AS chunk", mine, "points")
    chunks = packed(str(TILE), "chunk").selectExpr(*key, "n", "chunk", f"{_group_count(False)} AS _groups", "points")
    chunks = explode_range(explode_range(chunks, "block", _block_count()), "grp", "_groups")
    none = "CAST(NULL AS ARRAY<STRUCT<E: INT, n: BIGINT, L: INT, size: BIGINT, sample: INT, ticket: BIGINT>>) AS draws"
    units = deal_out(blocks.unionByName(chunks.selectExpr(*unit, "chunk", none, "points")), *unit).sortWithinPartitions(*unit, "chunk")
    kernel = tiles.lag_kernel(k, spec.ties == "include", spec.exclude_zero_distance, spec.distinct_library, spec.replacement)
    return units.mapInArrow(kernel, NEIGHBOURS)


def _numbered(drawn: DataFrame) -> DataFrame:
    """The draws of each manifold (draws) as rows: their group, their number in it (g), and how
    many chunks the members of the group fill."""
    rows = drawn.selectExpr(*MANIFOLD, "n", f"{_per_group(True)} AS _per", f"{LARGEST} AS _largest", "posexplode(draws) AS (_at, _d)")
    return rows.selectExpr(
        *MANIFOLD, "n", "_at div _per AS grp", "CAST(_at % _per AS INT) AS g", f"(least(n, _per * _largest) + {TILE - 1}) div {TILE} AS chunks",
        "_d.L", "_d.size", "_d.sample", "_d.ticket",
    )


def _meet_members(
    manifold: DataFrame, points: DataFrame, with_draws, drawn: DataFrame, spec: Spec, k: int | None, members: DataFrame | None = None
) -> DataFrame:
    """Every block meets the members of its draws only. ``drawn`` has a row per draw and drawn
    point number (pos); or ``members`` has the points of each (L, sample) itself."""
    of_group = [*MANIFOLD, "n", "grp", "chunks"]
    if members is None:
        hits = drawn.groupBy(*of_group, "pos").agg(F.expr("collect_list(struct(g, 1 AS m)) AS hits"))
        held = hits.join(manifold.select(*MANIFOLD, "pos", "i", "y", "v"), [*MANIFOLD, "pos"])
    else:
        named = members.join(drawn.drop("n", "size", "ticket"), [*MANIFOLD, "L", "sample"])
        held = named.groupBy(*of_group, "i").agg(F.first("y").alias("y"), F.first("v").alias("v"), F.expr("collect_list(struct(g, m)) AS hits"))
    chunks = held.groupBy(*MANIFOLD, "n", "grp", F.expr("pmod(xxhash64(i), chunks) AS chunk")).agg(
        F.expr("collect_list(struct(i, y, v, hits)) AS points")
    )
    chunks = explode_range(chunks, "block", _block_count())
    return _rank_units(_point_units(points, with_draws, True), chunks, spec, k, False)


def _given(manifold: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with n, L, sample, i, y, v, m, written; draws of each manifold)."""
    times = F.coalesce(F.col("m"), F.lit(1)) if "m" in library.columns else F.lit(1)
    rows = library.select(
        F.col("series_id").cast("string"), *[F.col(c).cast("int").alias(c) for c in ("E", "tau", "L", "sample")],
        F.col("idx").cast("bigint").alias("i"), times.cast("bigint").alias("m"),
    ).where("m > 0")
    rows = rows.groupBy(*MANIFOLD, "L", "sample", "i").agg(F.sum("m").cast("int").alias("m"))
    members = stage(rows.join(manifold.select(*MANIFOLD, "n", "i", "y", "v"), [*MANIFOLD, "i"]))
    draws = members.groupBy(*MANIFOLD, "n", "L", "sample").agg(F.count("*").alias("size"))
    drawn = draws.groupBy(*MANIFOLD, "n").agg(F.expr("sort_array(collect_list(struct(L, sample, size))) AS draws"))
    return members, drawn.withColumn("draws", F.expr(f"CAST(transform(draws, t -> struct(t.L, t.size, t.sample, 0L AS ticket)) AS {DRAW_LIST})"))


def _together(met: DataFrame, spec: Spec, k: int | None, several: bool) -> DataFrame:
    if not several:
        return met.select(*FOUND)
    return nearest_of_all(met, "(E + 1)" if k is None else str(k), spec.ties == "include")


def nearest_of_all(met: DataFrame, places: str, ties: bool = False) -> DataFrame:
    """Of each point and draw the nearest ``places`` of all chunks. Chunks go TOGETHER at a time,
    so that no row gathers more than that many short lists."""
    room = f"a.have < {places}" + (" OR x.d <= element_at(a.kept, -1).d" if ties else "")
    m = "x.m" if ties else f"least(x.m, {places} - a.have)"
    none = "named_struct('have', 0, 'kept', CAST(array() AS ARRAY<STRUCT<d: DOUBLE, q: BIGINT, m: INT, yq: DOUBLE>>))"
    more = f"named_struct('have', a.have + x.m, 'kept', concat(a.kept, array(named_struct('d', x.d, 'q', x.q, 'm', {m}, 'yq', x.yq))))"
    nearest = f"aggregate(array_sort(near), {none}, (a, x) -> IF({room}, {more}, a), a -> a.kept) AS near"
    key = [c for c in POINT if c != "y"]
    rows = met.selectExpr(*POINT, "chunk", "arrays_zip(d, q, m, yq) AS near")
    for level in ([F.expr(f"chunk div {TOGETHER}").alias("chunk")], []):
        rows = rows.groupBy(*key, *level).agg(F.first("y").alias("y"), F.expr("flatten(collect_list(near)) AS near"))
        rows = rows.selectExpr(*POINT, *(["chunk"] if level else []), nearest)
    return rows.selectExpr(*POINT, *[f"near.{c} AS {c}" for c in ("q", "d", "m", "yq")])


def explode_neighbors(found: DataFrame) -> DataFrame:
    """Neighbour arrays to rows: ..., p, y, r (1 = nearest), q, d, m, yq."""
    rows = found.selectExpr(*POINT, "posexplode(arrays_zip(q, d, m, yq)) AS (_r, _n)")
    return rows.selectExpr(*POINT, "_r + 1 AS r", "_n.q", "_n.d", "_n.m", "_n.yq")


def pair_distances(
    manifold: DataFrame, summarise: bool = False, measure: str = "euclidean", width: str = "E"
) -> DataFrame:
    """The all-pairs matrix in rows of a point and a block of other points: p, q_block, and
    arrays q and d over the points of that block, in the order of q. With ``summarise`` one row
    per point holds pairs, total, low and high instead: each tile is reduced in its task, and
    cells never leave it.

    Both directions of a pair come from one cell. Of two blocks the lower one plays host if the
    sum of their numbers is even, else the higher one, so all have about as many visitors. Cells
    that leave the task come from blocks of POINTS points. For summaries a manifold has at most
    SIDES blocks, as long as one has room for its coordinates (``width`` of each point), so what
    is shipped grows with the points, and not with their square; a meeting is a unit of work."""
    per = str(POINTS)
    if summarise:
        per = f"greatest({POINTS}L, least((n + {SIDES - 1}) div {SIDES}, {ROOM} div greatest(1, {width})))"
    packed = manifold.groupBy(*MANIFOLD, "n", F.expr(f"pos div {per}").alias("block")).agg(F.expr("collect_list(struct(i, y, v)) AS points"))
    unit = [*MANIFOLD, "block", "q_block"]
    hosting = "IF(block <= q_block, (block + q_block) % 2 = 0, (block + q_block) % 2 = 1)"
    if not summarise:
        visits = explode_range(packed.withColumnsRenamed({"block": "q_block", "points": "lib"}), "block", BLOCKS).where(hosting)
        met = deal_out(visits, *MANIFOLD, "block").join(packed.drop("n"), [*MANIFOLD, "block"]).select(*unit, "points", "lib")
        return met.mapInArrow(tiles.matrix_kernel(measure), "series_id string, E int, tau int, p bigint, q_block bigint, q array<bigint>, d array<double>")
    count = f"(n + {per} - 1) div {per}"
    hosts = explode_range(packed, "q_block", count).where(hosting).select(*unit, "points")
    visits = explode_range(packed.withColumnsRenamed({"block": "q_block", "points": "lib"}), "block", count).where(hosting)
    met = deal_out(hosts, *unit).join(visits.select(*unit, "lib"), unit)
    tiled = met.mapInArrow(tiles.summary_kernel(measure), "series_id string, E int, tau int, p bigint, pairs bigint, total double, low double, high double")
    sums = [F.expr(x) for x in ("sum(pairs) AS pairs", "sum(total) AS total", "min(low) AS low", "max(high) AS high")]
    return tiled.groupBy(*MANIFOLD, "p").agg(*sums)
