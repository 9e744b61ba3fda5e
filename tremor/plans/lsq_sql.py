"""Least squares as SQL, for the queries' second opinion: regressors are partialled out one after the other.

By Frisch, Waugh and Lovell the coefficient of one regressor is the simple slope between what is left of y and of it once all
others are taken out, and its influence values are products of these two remainders.
"""

from __future__ import annotations

from collections.abc import Sequence


def partial(source: str, keys: Sequence[str], y: str, x: str, controls: Sequence[str] = (), name: str = "q", order: str = "t") -> dict[str, str]:
    """Named steps; `{name}` has keys, t, rx and ry (remainders), n; `{name}b` has keys, b, sxx, n, rss; `{name}p` keys, t, psi."""
    by = ", ".join(keys)
    columns = {"ry": y, "rx": x} | {f"c{k}": c for k, c in enumerate(controls)}
    whole = " and ".join(f"({c}) is not null" for c in columns.values())
    steps = {f"{name}0": f"select {by}, {order} as t, " + ", ".join(f"({c}) - avg({c}) over w as {k}" for k, c in columns.items()) + f" from {source} where {whole} window w as (partition by {by})"}
    left = list(columns)
    for k in range(len(controls)):
        left.remove(f"c{k}")
        steps[f"{name}{k + 1}"] = f"select {by}, t, " + ", ".join(f"{c} - coalesce(sum({c} * c{k}) over w / nullif(sum(c{k} * c{k}) over w, 0), 0) * c{k} as {c}" for c in left) + f" from {name}{k} window w as (partition by {by})"
    steps[name] = f"select * from {name}{len(controls)}"
    steps[f"{name}b"] = f"select {by}, sum(rx * ry) / sum(rx * rx) as b, sum(rx * rx) as sxx, count(*) as n, sum(ry * ry) - sum(rx * ry) * sum(rx * ry) / sum(rx * rx) as rss from {name} group by {by}"
    steps[f"{name}p"] = f"select {by}, t, rx * (ry - b * rx) / sxx as psi, n from {name} join {name}b using ({by})"
    return steps


def hc1(name: str, keys: Sequence[str], regressors: int) -> str:
    """keys, b, se, n with HC1 errors, from the steps of `partial`."""
    by = ", ".join(keys)
    return f"select {by}, b, se, n from {name}b join (select {by}, sqrt(sum(psi * psi) * max(n) / (max(n) - {regressors + 1})) as se from {name}p group by {by}) using ({by})"


def hac(name: str, keys: Sequence[str], lags: int) -> str:
    """keys, b, se, n with Newey-West errors of `lags` lags, from the steps of `partial`."""
    by = ", ".join(keys)
    lagged = ", ".join(f"lag(psi, {m}) over (partition by {by} order by t) as l{m}" for m in range(1, lags + 1))
    weighted = " + ".join(f"{1 - m / (lags + 1)!r} * coalesce(l{m}, 0)" for m in range(1, lags + 1))
    return f"select {by}, b, se, n from {name}b join (select {by}, sqrt(sum(psi * psi) + 2 * sum(psi * ({weighted}))) as se from (select {by}, t, psi, {lagged} from {name}p) group by {by}) using ({by})"
