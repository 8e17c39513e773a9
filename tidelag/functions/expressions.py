"""Spark SQL expressions, built as text: one text costs the driver one call, where the same
thing put together from Column objects costs one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

RANGE_STEP = 1 << 14
MIX_PRIME = 2147483647


def seeded_hash(*parts: str) -> str:
    """A 60-bit number that depends on the values alone, not on partitions or tasks."""
    return f"CAST(conv(substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15), 16, 10) AS BIGINT)"


def mix_start(ticket: str, j: str) -> str:
    """First third of a cheap hash of (ticket, j): whole-number operations modulo a prime,
    far cheaper per draw than a digest of text."""
    return f"({ticket} % {MIX_PRIME} + {j}) * 48271 % {MIX_PRIME}"


def mix_middle(ticket: str, x: str) -> str:
    return f"({x} * {x} + shiftright({ticket}, 31)) % {MIX_PRIME} * 69621 % {MIX_PRIME}"


def mix_end(ticket: str, x: str) -> str:
    """A number in [0, 2^47)."""
    return f"({x} * {x} + {ticket} % {MIX_PRIME}) % {MIX_PRIME} * 65536 + {x} % 65536"


#: Rounds of the permutation, the factor of their keys, rows and columns at least, and how often
#: a number may be mapped on until it is in range, a few times first.
PERMUTE_ROUNDS, PERMUTE_STEP, PERMUTE_SIDE, PERMUTE_WALK, PERMUTE_FEW = 6, 7919, 8, 64, 4


def permuted(df: DataFrame, name: str, ticket: str, j: str, n: str) -> DataFrame:
    """Add column ``name``: the ``j``-th number of a permutation of [0, n) that ``ticket`` names.
    No other number of it is needed.

    Numbers are places in a table of a x b cells, the smallest nearly square one with n or more,
    at least 8 x 8. Each round adds a hash of the column to the row or of the row to the column,
    which can be undone, so all rounds together permute the cells. A number that falls on a cell
    beyond n is mapped on until it falls inside; there are fewer such cells than rows, or than
    64. Each step is a projection of its own, since one that is used twice would be computed
    twice."""
    columns = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*columns, f"CAST({ticket} AS BIGINT) AS _pt", f"CAST({j} AS BIGINT) AS _pj", f"CAST({n} AS BIGINT) AS _pn")
    df = df.selectExpr("*", f"greatest({PERMUTE_SIDE}L, CAST(ceil(sqrt(_pn)) AS BIGINT)) AS _pa")
    df = df.selectExpr("*", f"greatest({PERMUTE_SIDE}L, (_pn + _pa - 1) div _pa) AS _pb")
    df = df.selectExpr("*", "_pj div _pb AS _pl", "_pj % _pb AS _pr")
    fixed = [*columns, "_pt", "_pn", "_pa", "_pb"]
    for k in range(PERMUTE_ROUNDS):
        side, other, size = ("_pl", "_pr", "_pa") if k % 2 == 0 else ("_pr", "_pl", "_pb")
        df = df.selectExpr(*fixed, "_pl", "_pr", f"{_permute_key(other, '_pt', str(k))} AS _pu")
        df = df.selectExpr(*fixed, other, f"({side} + {_permute_add('_pu', '_pt')}) % {size} AS {side}")
    df = df.selectExpr(*fixed, "_pl * _pb + _pr AS _px")
    # the same rounds once more as functions of arrays, for the few numbers that need it
    add = _permute_add("u", "_pt")
    moved = f"IF(k % 2 = 0, named_struct('l', (s.l + {add}) % _pa, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {add}) % _pb))"
    key = _permute_key("IF(k % 2 = 0, s.r, s.l)", "_pt", "k")
    once = (
        f"aggregate(sequence(0, {PERMUTE_ROUNDS - 1}), named_struct('l', x div _pb, 'r', x % _pb), "
        f"(s, k) -> element_at(transform(array({key}), u -> {moved}), 1), s -> s.l * _pb + s.r)"
    )
    # most are inside after a few steps, and an aggregate goes through all of its steps
    kept = ["_pt", "_pn", "_pa", "_pb"]
    for steps in (PERMUTE_FEW, PERMUTE_WALK - PERMUTE_FEW):
        walked = f"aggregate(sequence(1, {steps}), _px, (x, i) -> IF(x < _pn, x, {once}))"
        df = df.selectExpr(*columns, *kept, f"IF(_px < _pn, _px, {walked}) AS _px")
    # coalesce: never NULL. The test for NULL that a join on it brings would move down through all
    # the projections, and each would be written out twice in the next.
    return df.selectExpr(*columns, f"coalesce(_px, 0L) AS {name}")


def _permute_key(value: str, ticket: str, k: str) -> str:
    key = f"({ticket} % {MIX_PRIME} * (({k} + 1) * {PERMUTE_STEP}) + shiftright({ticket}, 31)) % {MIX_PRIME}"
    return f"({value} + {key}) % {MIX_PRIME} * 48271 % {MIX_PRIME}"


def _permute_add(u: str, ticket: str) -> str:
    return f"shiftright(({u} * {u} + shiftright({ticket}, 31)) % {MIX_PRIME} * 69621 % {MIX_PRIME}, 8)"


def epoch_seconds(ts: str) -> str:
    """Wall-clock seconds since 1970-01-01, whatever the session time zone."""
    return f"(unix_date(CAST({ts} AS DATE)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60 + CAST(second({ts}) AS INT))"


def explode_range(df: DataFrame, name: str, count: str, deal=None) -> DataFrame:
    """One row per integer in [0, count). Two short sequences instead of one array of
    ``count`` elements keep each row small however long the range is. ``deal``, if given,
    spreads the rows with column _block, one per RANGE_STEP integers, over the tasks."""
    step = RANGE_STEP
    columns = [f"`{c}`" for c in df.columns]
    blocks = df.where(f"({count}) > 0").selectExpr("*", f"explode(sequence(0L, (({count}) - 1) div {step})) AS _block")
    if deal is not None:
        blocks = deal(blocks)
    last = f"least(_block * {step} + {step - 1}, ({count}) - 1)"
    return blocks.selectExpr(*columns, f"explode(sequence(_block * {step}, {last})) AS {name}")


def simplex_weight(d: str, nearest: str, floor: float) -> str:
    """exp(-d / nearest) but never under ``floor``; an exact match weighs 1."""
    low = f"{float(floor)!r}D"
    return f"CASE WHEN {d} = 0 THEN 1D WHEN {nearest} <> 0 THEN greatest(exp(-{d} / {nearest}), {low}) ELSE {low} END"


def pearson(a: str, b: str) -> str:
    """Pearson correlation over rows where both values exist, 0.0 when one side does not
    vary. Spread below 1e-12 of the mean is rounding noise and counts as no variation."""
    both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    sa, sb = f"stddev_pop({a}) {both}", f"stddev_pop({b}) {both}"
    varies = f"{sa} > abs(avg({a}) {both}) * 1e-12D AND {sb} > abs(avg({b}) {both}) * 1e-12D"
    return f"CASE WHEN {varies} THEN try_divide(covar_pop({a}, {b}) {both}, {sa} * {sb}) ELSE 0D END"
