"""The count tree of operators.draws in DuckDB SQL."""

from __future__ import annotations

from cohortaudit.operators.draws import FIRST, LEAF, SECOND, STEP

#: Levels of splits that the SQL lays out: enough for 2^9 leaves a site.
LEVELS = 9
_ALL = 1 << 64


def _mixed(x: str) -> str:
    times = lambda v, k: f"(({v})::uhugeint * {k}::uhugeint % {_ALL}::uhugeint)::ubigint"
    first = f"list_transform([{x}], lambda v: {times('xor(v, v >> 30)', FIRST)})"
    second = f"list_transform({first}, lambda v: {times('xor(v, v >> 27)', SECOND)})"
    return f"list_transform({second}, lambda v: xor(v, v >> 31))[1]"


def _keyed(node: str) -> str:
    return _mixed(f"((base::uhugeint + (rep::uhugeint * 4294967296::uhugeint + ({node})::uhugeint) * {STEP}::uhugeint) % {_ALL}::uhugeint)::ubigint")


def counts_cte(replicates: int, seed: str, points: str = "pts0", name: str = "counts") -> str:
    """CTEs that end in name(site, patient, rep, n), from points(site, patient, i, n), n being the site's patients."""
    p = name
    out = [f"{p}_n0 as materialized (select site, n, ('0x' || substr(md5('{seed}:' || site), 1, 15))::bigint as base, rep, 1::bigint as node, 0::bigint as lo, ((n + {LEAF - 1}) // {LEAF})::bigint as hi, n::bigint as c from (select distinct site, n from {points}) cross join (select unnest(range(0, {replicates})) as rep))"]
    for k in range(LEVELS):
        out.append(f"""{p}_s{k} as materialized (select *, greatest(0, floor(c * p - 8 * sqrt(c * p * (1 - p)) - 8))::bigint as jlo, least(c, ceil(c * p + 8 * sqrt(c * p * (1 - p)) + 8))::bigint as jhi from (
  select *, (lo + hi) // 2 as mid, (least((lo + hi) // 2 * {LEAF}, n) - lo * {LEAF})::double / (least(hi * {LEAF}, n) - lo * {LEAF})::double as p, ({_keyed("node")} >> 12)::double / 4503599627370496.0::double as u from {p}_n{k} where hi - lo > 1)),
{p}_x{k} as materialized (select site, rep, node, any_value(jlo) + count(*) filter (cdf <= u) as x from (
  select *, sum(w) over (partition by site, rep, node order by j) / sum(w) over (partition by site, rep, node) as cdf from (
    select site, rep, node, jlo, u, j, exp(lgamma(c + 1) - lgamma(j + 1) - lgamma(c - j + 1) + j * ln(p) + (c - j) * ln(1 - p)) as w from (select *, unnest(range(jlo, jhi + 1)) as j from {p}_s{k}))) group by 1, 2, 3),
{p}_m{k} as (select s.*, least(x, jhi) as x from {p}_s{k} s join {p}_x{k} using (site, rep, node)),
{p}_n{k + 1} as materialized (select site, n, base, rep, 2 * node as node, lo, mid as hi, x as c from {p}_m{k} union all select site, n, base, rep, 2 * node + 1, mid, hi, c - x from {p}_m{k} union all select * from {p}_n{k} where hi - lo <= 1)""")
    out.append(f"""{p}_d as (select site, rep, lo * {LEAF} + ({_mixed(f"((h::uhugeint + d::uhugeint * {STEP}::uhugeint) % {_ALL}::uhugeint)::ubigint")} % m::ubigint)::bigint as i from (
  select site, rep, lo, least({LEAF}, n - lo * {LEAF}) as m, {_keyed("2147483648 + lo")} as h, unnest(range(1, c + 1)) as d from {p}_n{LEVELS})),
{name} as materialized (select d.site, p.patient, d.rep::int as rep, count(*) as n from {p}_d d join {points} p on d.site = p.site and d.i = p.i group by 1, 2, 3)""")
    return ",\n".join(out)
