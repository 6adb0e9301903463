"""Least squares in plain SQL by successive orthogonalisation, as an independent check of the gram solver.

Each step removes one feature from all later ones and from the target (slopes from training rows only)
and adds its share to the fit. A ridge penalty enters as one pseudo-row per feature.
"""

from __future__ import annotations

from emberline.catalog.sqltext import CTES


def ols_ctes(name: str, src: str, xs: dict[str, str], y: str, keys: list[str] | None = None, alpha: float = 0.0, min_n: int = 1, where: str = "true") -> str:
    """Adds the chain to the shared expressions; the last one has event_id, keys, fit. ``xs``: {alias: SQL}."""
    keys = keys or []
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    cols = list(xs)
    CTES[f"{name}_0"] = (
        f"SELECT event_id, is_train, {k}{', '.join(f'({e})::DOUBLE AS {a}' for a, e in xs.items())}, ({y})::DOUBLE AS yv FROM {{{src}}} WHERE {where}"
    )
    mean = lambda c: f"avg({c}) FILTER (WHERE is_train) OVER ({part})"
    CTES[f"{name}_1"] = (
        f"SELECT * FROM (SELECT event_id, is_train, {k}{', '.join(f'{c} - {mean(c)} AS {c}' for c in cols)}, yv - {mean('yv')} AS yv, {mean('yv')} AS fit,"
        f" count(*) FILTER (WHERE is_train) OVER ({part}) AS n FROM {{{name}_0}}) WHERE n >= {min_n}"
    )
    prev = f"{name}_1"
    if alpha:
        pseudo = " UNION ALL ".join(
            f"SELECT {-j - 1} AS event_id, true AS is_train, {k}{', '.join(f'sqrt({alpha}::DOUBLE)' if c == d else '0::DOUBLE' for d in cols)}, 0::DOUBLE, 0::DOUBLE, n FROM (SELECT DISTINCT {k}n FROM {{{name}_1}})"
            for j, c in enumerate(cols)
        )
        CTES[f"{name}_2"] = f"SELECT event_id, is_train, {k}{', '.join(cols)}, yv, fit, n FROM {{{name}_1}} UNION ALL {pseudo}"
        prev = f"{name}_2"
    for i, c in enumerate(cols):
        slope = lambda v: f"coalesce(sum({v} * {c}) FILTER (WHERE is_train) OVER ({part}) / nullif(sum({c} * {c}) FILTER (WHERE is_train) OVER ({part}), 0), 0)"  # noqa: B023, E731
        later = "".join(f"{v} - {slope(v)} * {c} AS {v}, " for v in cols[i + 1 :])
        CTES[f"{name}_s{i}"] = f"SELECT event_id, is_train, {k}{later}yv - {slope('yv')} * {c} AS yv, fit + {slope('yv')} * {c} AS fit, n FROM {{{prev}}}"
        prev = f"{name}_s{i}"
    CTES[name] = f"SELECT event_id, is_train, {k}fit FROM {{{prev}}} WHERE event_id >= 0"
    return name
