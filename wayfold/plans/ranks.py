"""Ranks and quantiles of growing relations without a task that holds a whole relation or a whole group.

Values are counted first, which partial sums do before anything is shuffled, and cut into ranges. Running sums over the ranges
tell which of them holds a rank, and running sums within a range find it there: both windows are short, however many rows a
group has. All quantiles of all groups come from one set of counts.
"""

from __future__ import annotations

from wayfold.functions import geo
from wayfold.plans.relation import CATALOG

#: Ranges that the values of a whole relation are cut into.
RANGES = 4096
_UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def group_quantiles(name: str, source: str, groups: dict[str, str], values: dict[str, str], picks: dict[str, tuple[str, float, str]], where: str = "TRUE", scale: float = 1.0) -> None:
    """One row for each group with a column for each pick: (value, quantile, kind).

    Kinds: ``between`` interpolates, ``even`` takes the nearest rank with halves to the even one, ``cut`` the rank below.
    Values are cut into ranges of one over ``scale``; nulls don't count. Groups have names other than f, b, v, n, id and nth."""
    own = list(groups)
    cols, on = ", ".join(own), lambda a, b: " AND ".join(f"{a}.{g} = {b}.{g}" for g in own)
    keyed = ", ".join(f"{e} AS {g}" for g, e in groups.items())
    number = {v: i for i, v in enumerate(values)}
    kinds = ", ".join(f"({i})" for i in number.values())
    value = " ".join(f"WHEN {i} THEN {values[v]}" for v, i in number.items())
    CATALOG.add(f"{name}_counts", f"SELECT {cols}, f, v, CAST(floor(v * {scale}) AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n FROM (SELECT {keyed}, t.f, CASE t.f {value} END AS v FROM {{{source}}} CROSS JOIN (VALUES {kinds}) AS t(f) WHERE {where}) WHERE v IS NOT NULL GROUP BY {cols}, f, v", query=False)
    CATALOG.add(f"{name}_ranges", f"SELECT {cols}, f, b, n, CAST(sum(n) OVER (PARTITION BY {cols}, f ORDER BY b {_UPTO}) AS BIGINT) - n AS since, CAST(sum(n) OVER (PARTITION BY {cols}, f) AS BIGINT) AS total FROM (SELECT {cols}, f, b, CAST(sum(n) AS BIGINT) AS n FROM {{{name}_counts}} GROUP BY {cols}, f, b)", query=False)
    rows, ranks, out = [], [], []
    for column, (v, q, kind) in picks.items():
        at = f"{q} * (total - 1)"
        sides = {"between": [f"CAST(floor({at}) AS BIGINT)", f"CAST(ceil({at}) AS BIGINT)"], "even": [geo.half_even(at)], "cut": [f"CAST(floor({at}) AS BIGINT)"]}[kind]
        low = len(rows)
        for side in sides:
            ranks.append(f"WHEN {len(rows)} THEN {side}")
            rows.append(f"({len(rows)}, {number[v]}, {float(q)!r})")
        got = lambda i, x="v": f"max(CASE WHEN id = {i} THEN {x} END)"
        out.append(f"{got(low)} + ({got(low + 1)} - {got(low)}) * {got(low + 1, 'part')} AS {column}" if kind == "between" else f"{got(low)} AS {column}")
    CATALOG.add(f"{name}_wanted", f"SELECT {cols}, f, b, id, rnk - since AS nth, part FROM (SELECT x.*, p.id, CASE p.id {' '.join(ranks)} END AS rnk, p.q * (total - 1) - floor(p.q * (total - 1)) AS part FROM {{{name}_ranges}} x JOIN (VALUES {', '.join(rows)}) AS p(id, f, q) ON p.f = x.f) WHERE rnk >= since AND rnk < since + n", query=False)
    CATALOG.add(name, f"SELECT {cols}, {', '.join(out)} FROM (SELECT {cols}, id, v, part, nth, n, upto FROM (SELECT w.*, c.v, c.n, CAST(sum(c.n) OVER (PARTITION BY {', '.join(f'w.{g}' for g in own)}, w.f, w.b, w.id ORDER BY c.v {_UPTO}) AS BIGINT) AS upto FROM {{{name}_wanted}} w JOIN {{{name}_counts}} c ON {on('c', 'w')} AND c.f = w.f AND c.b = w.b) WHERE nth >= upto - n AND nth < upto) GROUP BY {cols}", query=False)


def ranked_rows(name: str, source: str, value: str, ties: str, descending: bool = True) -> None:
    """All rows of a relation with their place ``rk``, from 1, by a value and then by ``ties``, and their number ``of``."""
    way = "-1.0 * " if descending else ""
    CATALOG.add(f"{name}_bounds", f"SELECT min({way}({value})) AS lo, max({way}({value})) AS hi FROM {{{source}}}", query=False)
    CATALOG.add(f"{name}_placed", f"SELECT s.*, {way}({value}) AS ranked_by, CAST(floor(coalesce(({way}({value}) - lo) / nullif(hi - lo, 0.0), 0.0) * {RANGES}.0) AS BIGINT) AS ranked_in FROM {{{source}}} s CROSS JOIN {{{name}_bounds}}", query=False)
    CATALOG.add(f"{name}_since", f"SELECT b, CAST(sum(n) OVER (ORDER BY b {_UPTO}) AS BIGINT) - n AS since, CAST(sum(n) OVER () AS BIGINT) AS of FROM (SELECT ranked_in AS b, CAST(count(*) AS BIGINT) AS n FROM {{{name}_placed}} GROUP BY ranked_in)", query=False)
    CATALOG.add(name, f"SELECT p.*, w.of, w.since + CAST(row_number() OVER (PARTITION BY p.ranked_in ORDER BY p.ranked_by, {ties}) AS BIGINT) AS rk FROM {{{name}_placed}} p JOIN {{{name}_since}} w ON w.b = p.ranked_in", query=False)
