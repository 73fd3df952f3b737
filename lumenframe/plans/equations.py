"""Linear models as SQL, for side-by-side checks: normal equations of a common table, solved by elimination.

Every function gives the text of common table expressions. A system table has a{i}_{j} and b{i}, and columns of its own are kept.
"""

from __future__ import annotations

from collections.abc import Sequence


def gram(name: str, source: str, features: Sequence[str], targets: Sequence[str], where: str = "true", by: Sequence[str] = ()) -> str:
    """``name``: n, means m{i}, spreads d{i} (one for a constant), scaled products s{i}_{j}, and for each target t its mean mt and products with the features p{i}; one row a target (and ``by``)."""
    k, rows = range(len(features)), []
    group = f" group by {', '.join(by)}" if by else ""
    for t in targets:
        columns = [*by, f"'{t}' as target", "count(*) as n", f"avg({t}) as mt", *(f"avg({f}) as m{i}" for i, f in enumerate(features)), *(f"coalesce(nullif(stddev_pop({f}), 0), 1) as d{i}" for i, f in enumerate(features))]
        columns += [f"covar_pop({features[i]}, {features[j]}) * count(*) as s{i}_{j}" for i in k for j in k] + [f"covar_pop({f}, {t}) * count(*) as p{i}" for i, f in enumerate(features)]
        rows.append(f"select {', '.join(columns)} from {source} where {where}{group}")
    scaled = [f"s{i}_{j} / (d{i} * d{j}) as s{i}_{j}" for i in k for j in k] + [f"p{i} / d{i} as p{i}" for i in k]
    return f"{name} as materialized (select * replace ({', '.join(scaled)}) from ({' union all '.join(rows)}))"


def ridge(name: str, grams: str, features: int, alpha: str) -> str:
    """``name``: the rows of ``grams`` with coefficients c{i} of the plain features and intercept c, for a penalty of ``alpha`` (SQL) on the scaled ones."""
    k = range(features)
    steps = [f"{name}_0 as (select *, {', '.join(f's{i}_{j} + {alpha if i == j else 0} as a{i}_{j}' for i in k for j in k)}, {', '.join(f'p{i} as b{i}' for i in k)} from {grams})"]
    for s in range(features - 1):
        less = [f"a{i}_{j} - a{i}_{s} * a{s}_{j} / a{s}_{s} as a{i}_{j}" for i in range(s + 1, features) for j in range(s + 1, features)] + [f"b{i} - a{i}_{s} * b{s} / a{s}_{s} as b{i}" for i in range(s + 1, features)]
        steps.append(f"{name}_{s + 1} as (select * replace ({', '.join(less)}) from {name}_{s})")
    back = [f"(b{i}{''.join(f' - a{i}_{j} * x{j}' for j in range(i + 1, features))}) / a{i}_{i} as x{i}" for i in reversed(k)]
    steps.append(f"{name}_x as (select *, {', '.join(back)} from {name}_{features - 1})")
    return ", ".join([*steps, plain(name, f"{name}_x", features)])


def plain(name: str, source: str, features: int) -> str:
    """``name``: coefficients x{i} of scaled features as c{i} of plain ones, with the intercept c."""
    k = range(features)
    return f"{name} as materialized (select *, {', '.join(f'x{i} / d{i} as c{i}' for i in k)}, mt - ({' + '.join(f'x{i} / d{i} * m{i}' for i in k)}) as c from {source})"


def lasso(name: str, grams: str, features: int, alpha: float, passes: int = 10_000) -> str:
    """``name``: as ``ridge``, with a penalty on absolute coefficients, by coordinate descent; needs ``with recursive``. ``grams`` has one row."""
    k = range(features)
    move = []
    for i in k:
        r = f"p{i} / n - ({' + '.join(f's{i}_{j} / n * {f'y{j}' if j < i else f'x{j}'}' for j in k if j != i)})"
        move += [f"{r} as r{i}", f"sign(r{i}) * greatest(abs(r{i}) - {alpha}, 0) / (s{i}_{i} / n) as y{i}"]
    step = f"select step + 1 as step, {', '.join(f'y{i}' for i in k)}, greatest({', '.join(f'abs(y{i} - x{i})' for i in k)}) as moved from (select *, {', '.join(move)} from {name}_steps, {grams} where step < {passes} and moved >= 1e-12)"
    first = f"select 0 as step, {', '.join(f'0.0::double as x{i}' for i in k)}, 1.0::double as moved"
    last = f"{name}_x as (select g.*, {', '.join(f'x{i}' for i in k)} from {grams} g, (from {name}_steps order by step desc limit 1))"
    return ", ".join([f"{name}_steps as ({first} union all {step})", last, plain(name, f"{name}_x", features)])


def reading(features: Sequence[str], model: str = "") -> str:
    """The prediction of a row of coefficients."""
    return f"{model}c + " + " + ".join(f"{model}c{i} * {f}" for i, f in enumerate(features))
