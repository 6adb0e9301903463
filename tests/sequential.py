"""The two segmentation rules stated sequentially, for one home-month."""

import numpy as np
import pandas as pd


def brute_force_segments(rows: pd.DataFrame, min_delta: float, max_change: float, max_gap: float) -> list[tuple[int, int]]:
    """Sequential statement of the rule for one home-month: (start, end) row ranges."""
    indoor, outdoor = rows["indoor"].to_numpy(), rows["outdoor"].to_numpy()
    heat, cool = np.nan_to_num(rows["heat_sp"].to_numpy()), np.nan_to_num(rows["cool_sp"].to_numpy())
    on = rows["running"].to_numpy()
    when = rows["minute"].to_numpy()
    ok = ~np.isnan(indoor) & ~np.isnan(outdoor) & ~on
    found, i = [], 0
    while i < len(rows):
        if not ok[i] or abs(indoor[i] - outdoor[i]) < min_delta:
            i += 1
            continue
        j = i + 1
        while j < len(rows) and ok[j] and when[j] - when[j - 1] <= max_gap:
            if max(abs(heat[j] - heat[i]), abs(cool[j] - cool[i])) > max_change:
                break
            j += 1
        found.append((i, j))
        i = j
    return found


def brute_force_responses(rows: pd.DataFrame, min_change: float, tol: float) -> list[tuple[int, int, str]]:
    """Sequential statement of the rule for one home-month: (start, end, kind)."""
    t, h, c = (rows[k].to_numpy(dtype="float64") for k in ("indoor", "heat_sp", "cool_sp"))
    zero = (t == 0) | (h == 0) | (c == 0)
    found, i = [], 1
    with np.errstate(invalid="ignore"):
        while i < len(rows):
            kind = None
            if not zero[i] and not zero[i - 1]:
                if h[i] - h[i - 1] > min_change and t[i] < h[i]:
                    kind, line, goal = "heat_increase", h, h[i]
                elif c[i] - c[i - 1] < -min_change and t[i] > c[i]:
                    kind, line, goal = "cool_decrease", c, c[i]
            if kind is None:
                i += 1
                continue
            j, hit = i, False
            while j < len(rows) and not zero[j] and not (j > i and abs(line[j] - goal) > tol):
                hit = t[j] >= goal if kind == "heat_increase" else t[j] <= goal
                if hit:
                    break
                j += 1
            if hit:
                found.append((i, j, kind))
            i = j + 1
    return found
