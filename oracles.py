"""Reference answers in plain SQL, written row by row without any of the engine's tricks."""

from __future__ import annotations

P = 2147483647


def series_events(sid="'all'", every=3600, x="sum", where="event_type IN ('click', 'view')"):
    """Values have two decimals, so their sums are exact. CTEs ending in series(series_id, n, i, x, y) from the events table."""
    if x == "sum":
        def agg(kind):
            return f"coalesce(CAST(sum(CASE WHEN event_type = '{kind}' THEN CAST(value AS DECIMAL(24,2)) END) AS DOUBLE), 0)"
    else:
        def agg(kind):
            v = f"CASE WHEN event_type = '{kind}' THEN CAST(value AS DECIMAL(24,2)) END"
            return f"CAST(sum({v}) AS DOUBLE) / nullif(count({v}), 0)"
    fill = (lambda c: f"coalesce({c}, 0)") if x == "sum" else (lambda c: c)
    return f"""
    binned AS (SELECT {sid} AS series_id, CAST(floor(epoch(ts) / {every}) AS BIGINT) AS slot,
                      {agg('click')} AS x, {agg('view')} AS y
               FROM events WHERE {where} GROUP BY ALL),
    span AS (SELECT series_id, min(slot) AS lo, max(slot) AS hi FROM binned GROUP BY series_id),
    spine AS (SELECT series_id, hi - lo + 1 AS n, lo, unnest(generate_series(lo, hi)) AS slot FROM span),
    series AS (SELECT s.series_id, s.n, s.slot - s.lo AS i, {fill('x')} AS x, {fill('y')} AS y
               FROM spine s LEFT JOIN binned b ON s.series_id = b.series_id AND s.slot = b.slot)"""


def series_counts(table="events", ts="ts", every=3600, y="count(*)"):
    """CTEs ending in series with the number of rows per step as x and ``y`` beside it."""
    return f"""
    binned AS (SELECT 'all' AS series_id, CAST(floor(epoch({ts}) / {every}) AS BIGINT) AS slot,
                      CAST(count(*) AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {table} GROUP BY ALL),
    span AS (SELECT series_id, min(slot) AS lo, max(slot) AS hi FROM binned GROUP BY series_id),
    spine AS (SELECT series_id, hi - lo + 1 AS n, lo, unnest(generate_series(lo, hi)) AS slot FROM span),
    series AS (SELECT s.series_id, s.n, s.slot - s.lo AS i, coalesce(x, 0) AS x, coalesce(y, 0) AS y
               FROM spine s LEFT JOIN binned b ON s.series_id = b.series_id AND s.slot = b.slot)"""


def manifold(E, tau, name="m", source="series", drop_missing=False):
    """CTE name(series_id, E, tau, n, i, pos, y, x0..)."""
    lags = ", ".join(f"lag(x, {j * tau}) OVER (PARTITION BY series_id ORDER BY i) AS x{j}" for j in range(E))
    cols = ", ".join(f"x{j}" for j in range(E))
    keep = " AND ".join(f"x{j} IS NOT NULL" for j in range(E)) if drop_missing else "TRUE"
    return f"""
    {name} AS (SELECT series_id, {E} AS E, {tau} AS tau, count(*) OVER (PARTITION BY series_id) AS n, i,
                      row_number() OVER (PARTITION BY series_id ORDER BY i) - 1 AS pos, y, {cols}
               FROM (SELECT series_id, i, y, {lags} FROM {source}) t
               WHERE i >= {(E - 1) * tau} AND {keep})"""


def grid(L, samples, name="m"):
    """CTE grid_<name>(series_id, E, tau, n, L, size, sample) for one manifold."""
    sizes = f"generate_series({L[0]}, CAST(series_n AS BIGINT), {L[1]})" if isinstance(L, tuple) else f"{list(L)}"
    series_n = "n + (E - 1) * tau"
    return f"""
    grid_{name} AS (SELECT series_id, E, tau, n, L, least(L, n) AS size, sample
               FROM (SELECT *, unnest(generate_series(0, {samples - 1})) AS sample
                     FROM (SELECT *, unnest({sizes}) AS L
                           FROM (SELECT DISTINCT series_id, E, tau, n, {series_n} AS series_n FROM {name}) a) b) c)"""


def _permuted(source, x):
    """Rows of ``source`` (t, n, a, b and a number ``x``) with x mapped once."""
    sql = f"SELECT *, {x} // b AS row, {x} % b AS col FROM ({source}) s0"
    for k in range(6):
        side, other, size = ("row", "col", "a") if k % 2 == 0 else ("col", "row", "b")
        key = f"(t % {P} * {(k + 1) * 7919} + (t >> 31)) % {P}"
        sql = f"SELECT *, ({other} + {key}) % {P} * 48271 % {P} AS u FROM ({sql}) s1"
        add = f"(((u * u + (t >> 31)) % {P} * 69621 % {P}) >> 8)"
        sql = f"SELECT * EXCLUDE (u) REPLACE (({side} + {add}) % {size} AS {side}) FROM ({sql}) s2"
    return f"SELECT * EXCLUDE (row, col), row * b + col AS x2 FROM ({sql}) s3"


def libraries(replacement=True, seed=42, name="m", distinct=False):
    """CTE lib_<name>(series_id, E, tau, L, sample, pos, m)."""
    mixed = f"""
    t0_{name} AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', {seed}, series_id, E, tau, L, sample)), 1, 15) AS BIGINT) AS t
            FROM grid_{name}),
    t1_{name} AS (SELECT *, unnest(generate_series(0, size - 1)) AS j FROM t0_{name}),"""
    if not replacement:
        # the j-th number of a permutation of a x b cells, mapped on until it is below n
        cells = f"SELECT *, greatest(8, (n + a - 1) // a) AS b FROM (SELECT *, greatest(8, CAST(ceil(sqrt(n)) AS BIGINT)) AS a FROM t1_{name}) c"
        columns = "series_id, E, tau, n, L, sample, t, a, b"
        return mixed + f"""
    perm_{name} AS (SELECT {columns}, x2 AS x FROM ({_permuted(cells, 'j')}) p UNION ALL
            SELECT {columns}, x2 AS x FROM ({_permuted(f"SELECT * FROM perm_{name} WHERE x >= n", 'x')}) q),
    lib_{name} AS (SELECT series_id, E, tau, L, sample, x AS pos, CAST(1 AS BIGINT) AS m FROM perm_{name} WHERE x < n)"""
    m = "1" if distinct else "count(*)"
    return mixed + f"""
    t2_{name} AS (SELECT *, (t % {P} + j) * 48271 % {P} AS a FROM t1_{name}),
    t3_{name} AS (SELECT *, (a * a + (t >> 31)) % {P} * 69621 % {P} AS b FROM t2_{name}),
    t4_{name} AS (SELECT *, (b * b + t % {P}) % {P} * 65536 + b % 65536 AS h FROM t3_{name}),
    lib_{name} AS (SELECT series_id, E, tau, L, sample, h % n AS pos, CAST({m} AS BIGINT) AS m FROM t4_{name} GROUP BY ALL)"""


def given_library(rows, name="m"):
    """CTEs for draws that ``rows`` (SQL for series_id, L, sample, idx, m) names by time index."""
    return f"""
    given_{name} AS ({rows}),
    lib_{name} AS (SELECT g.series_id, p.E, p.tau, g.L, g.sample, p.pos, CAST(sum(g.m) AS BIGINT) AS m
            FROM given_{name} g JOIN {name} p ON g.series_id = p.series_id AND g.idx = p.i GROUP BY ALL)"""


def lineitem_series():
    """CTE series: lineitem in the order of its key, price against quantity."""
    return """
    series AS (SELECT 'all' AS series_id, count(*) OVER () AS n, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) - 1 AS i,
        l_extendedprice AS x, l_quantity AS y FROM lineitem)"""


def dist(E, a="a", b="b"):
    return "sqrt(" + " + ".join(f"({a}.x{j} - {b}.x{j}) * ({a}.x{j} - {b}.x{j})" for j in range(E)) + ")"


DRAW = "series_id, E, tau, L, sample"


def knn(E, name="m", ties=False, no_zero=False):
    """CTE knn_<name>(draw, p, y, q, yq, d, m) with m cut to the places left."""
    k = E + 1
    keep = (
        "d <= max(CASE WHEN before < K THEN d END) OVER (PARTITION BY D, p)" if ties else "before < K"
    ).replace("K", str(k)).replace("D,", DRAW + ",")
    m = "m" if ties else f"least(m, {k} - before)"
    zero = "AND d >= 1e-30" if no_zero else ""
    return f"""
    hits_{name} AS (SELECT l.series_id, l.E, l.tau, l.L, l.sample, a.i AS p, a.y, b.i AS q, b.y AS yq, l.m, {dist(E)} AS d
             FROM lib_{name} l JOIN {name} b ON l.series_id = b.series_id AND l.pos = b.pos
             JOIN {name} a ON a.series_id = b.series_id AND a.i <> b.i),
    walk_{name} AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY {DRAW}, p ORDER BY d, q
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
             FROM hits_{name} WHERE d IS NOT NULL {zero}),
    knn_{name} AS (SELECT {DRAW}, p, y, q, yq, d, CAST({m} AS INT) AS m FROM walk_{name} {"QUALIFY" if ties else "WHERE"} {keep})"""


def weights(E, name="m", ties=False, floor=1e-6):
    """CTE w_<name>: knn plus w."""
    base = f"""
    near_{name} AS (SELECT *, min(d) OVER (PARTITION BY {DRAW}, p) AS d1, max(d) OVER (PARTITION BY {DRAW}, p) AS dk
             FROM knn_{name}),
    w0_{name} AS (SELECT *, CASE WHEN d = 0 THEN 1 WHEN d1 <> 0 THEN greatest(exp(-d / d1), {floor}) ELSE {floor} END AS w
           FROM near_{name}),"""
    if not ties:
        return base + f" w_{name} AS (SELECT * FROM w0_{name})"
    return base + f"""
    w1_{name} AS (SELECT *, CAST(sum(m) OVER (PARTITION BY {DRAW}, p) AS DOUBLE) AS total,
                  CAST(sum(CASE WHEN d = dk THEN m ELSE 0 END) OVER (PARTITION BY {DRAW}, p) AS DOUBLE) AS tied FROM w0_{name}),
    w_{name} AS (SELECT * REPLACE (CASE WHEN d = dk AND total > {E + 1} THEN w * (tied + {E + 1} - total) / tied ELSE w END AS w)
          FROM w1_{name})"""


def predictions(name="m"):
    return f"""
    pred_{name} AS (SELECT {DRAW}, p, y, sum(m * w * yq) / sum(m * w) AS y_hat FROM w_{name} GROUP BY ALL)"""


def skill_cte(name="m"):
    """CTE skill_<name>: one row per draw of the grid."""
    return f"""
    fit_{name} AS (SELECT {DRAW}, count(*) AS n_pred, covar_pop(y, y_hat) AS cov, stddev_pop(y) AS sa, stddev_pop(y_hat) AS sb,
                   avg(y) AS ma, avg(y_hat) AS mb, avg(abs(y_hat - y)) AS mae
            FROM pred_{name} WHERE y IS NOT NULL AND y_hat IS NOT NULL GROUP BY ALL),
    skill_{name} AS (SELECT g.series_id, g.E, g.tau, g.L, g.sample, coalesce(n_pred, 0) AS n_pred,
                   CASE WHEN sa > abs(ma) * 1e-12 AND sb > abs(mb) * 1e-12 THEN cov / (sa * sb) ELSE 0 END AS rho, mae
            FROM grid_{name} g LEFT JOIN fit_{name} f ON g.series_id = f.series_id AND g.E = f.E AND g.tau = f.tau
                 AND g.L = f.L AND g.sample = f.sample)"""


def chain(E, tau, L, samples, name="m", source="series", upto="skill", **o):
    """All CTEs of one (E, tau) up to a step."""
    steps = {
        "grid": lambda: manifold(E, tau, name, source, o.get("drop_missing", False)) + "," + grid(L, samples, name),
        "lib": lambda: libraries(o.get("replacement", True), o.get("seed", 42), name, o.get("distinct", False)),
        "knn": lambda: knn(E, name, o.get("ties", False), o.get("no_zero", False)),
        "weights": lambda: weights(E, name, o.get("ties", False)),
        "pred": lambda: predictions(name),
        "skill": lambda: skill_cte(name),
    }
    out = []
    for step, build in steps.items():
        out.append(build())
        if step == upto:
            break
    return ",".join(out)


def sweep(pairs, L, samples, prefix="m", source="series", **o):
    """CTEs ending in <prefix>_skill, the union over several (E, tau)."""
    names = [f"{prefix}_{E}_{tau}" for E, tau in pairs]
    parts = [chain(E, tau, L, samples, n, source, **o) for (E, tau), n in zip(pairs, names)]
    union = " UNION ALL ".join(f"SELECT * FROM skill_{n}" for n in names)
    return ",".join(parts) + f", {prefix}_skill AS ({union})"


SKILL_COLUMNS = (
    "series_id, E, tau, L, sample, n_pred, round(rho, 6) AS rho, round(greatest(0, rho), 6) AS rho_nonneg, round(mae, 6) AS mae"
)


def rolling(source, w, name):
    return f"""
    {name} AS (SELECT * FROM (SELECT series_id, n, i, x, sum(x) OVER (PARTITION BY series_id ORDER BY i
                  ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS rolling_sum FROM {source}) t WHERE i >= {w - 1})"""


def paired(width, ahead, name, source="series"):
    """CTE name(series_id, n, i, x, y): trailing sum against the value ``ahead`` later."""
    return f"""
    {name} AS (SELECT series_id || '|{width}' AS series_id, n - {ahead + width - 1} AS n, i - {width - 1} AS i, s AS x, later AS y
        FROM (SELECT series_id, n, i, sum(x) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS s,
                     lead(x, {ahead}) OVER (PARTITION BY series_id ORDER BY i) AS later FROM {source}) t
        WHERE i >= {width - 1} AND i + {ahead} < n)"""


def scenario(E_list, widths, L, samples):
    """CTEs ending in scen(width, E, tau, L, sample, n_pred, rho, mae)."""
    parts, unions = [], []
    for E in E_list:
        src = f"pair_{E}"
        parts += [paired(w, E, f"pair_{E}_{w}") for w in widths]
        parts.append(f" {src} AS (" + " UNION ALL ".join(f"SELECT * FROM pair_{E}_{w}" for w in widths) + ")")
        parts.append(chain(E, 1, L, samples, f"s{E}", src))
        unions.append(
            f"SELECT CAST(split_part(series_id, '|', 2) AS INT) AS width, split_part(series_id, '|', 1) AS series_id, "
            f"E, tau, L, sample, n_pred, rho, mae FROM skill_s{E}"
        )
    return ",".join(parts) + ", scen AS (" + " UNION ALL ".join(unions) + ")"
