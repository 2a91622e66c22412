"""SQL twin of `functions.small_solve.solve_definite`."""

from __future__ import annotations


def sql_solve(source: str, prefix: str, a: list[list[str]], b: list[str], out: list[str]) -> tuple[list[str], str]:
    """Relations that add `out`, the solution of a definite system whose lower triangle a and right side b are columns of
    `source`; one step of the factor a relation.  Returns them and the name of the last."""
    p, last, steps = len(b), source, []
    for j in range(p):
        own = f"sqrt({a[j][j]}" + "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j)) + f") AS l{j}_{j}"
        steps.append(f"{prefix}d{j} AS (SELECT *, {own} FROM {last})")
        below = [f"({a[i][j]}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + f") / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, p)]
        y = f"({b[j]}" + "".join(f" - l{j}_{k} * y{k}" for k in range(j)) + f") / l{j}_{j} AS y{j}"
        steps.append(f"{prefix}c{j} AS (SELECT *, {', '.join([*below, y])} FROM {prefix}d{j})")
        last = f"{prefix}c{j}"
    for j in reversed(range(p)):
        x = f"(y{j}" + "".join(f" - l{k}_{j} * {out[k]}" for k in range(j + 1, p)) + f") / l{j}_{j} AS {out[j]}"
        steps.append(f"{prefix}z{j} AS (SELECT *, {x} FROM {last})")
        last = f"{prefix}z{j}"
    return steps, last
