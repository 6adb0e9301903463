"""Ordered operations over keyed series that stay exact when one key is very large.

A plain ``Window.partitionBy(key)`` puts a key's whole history in one task. ``Series`` first counts
rows per key (a map-side combined aggregate over the key and position columns only). If no key passes
the limit, the plain window is used: one shuffle, one sort, shared by all calls. If some keys do, their
rows are cut into chunks of about equal row counts, windows run per (key, chunk), and what a chunk needs from its
neighbours comes from a summary table with one row per (key, chunk). Both ways give the same result, null keys,
null values and bursts included; keys join null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.staging import stage
from emberline.session import hot_rows

CHUNK = "_chunk"
CELLS = 64  # cells of equal row counts that a hot key is cut into first


def epoch(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts)).cast("double")


def hash_position(hash_col: str) -> Column:
    """Position in [0, 2^32) of a hexadecimal digest: uniform, so its chunks are even."""
    return F.conv(F.substring(hash_col, 1, 8), 16, 10).cast("double")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which null keys match each other; without keys, ``right`` is one row or none."""
    if not on:
        return left.join(right, F.lit(True), "left")
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(right, match, "left").drop(*[f"_on_{c}" for c in on])


class Series:
    def __init__(self, df: DataFrame, keys: list[str], order: list[str], position: Column, max_rows: int | None = None):
        """``position`` must never decrease along ``order``; chunk borders are placed on it."""
        self.keys = keys
        self.order = order
        limit = max_rows or hot_rows(df.sparkSession)
        # At most total_rows / limit keys can pass this filter. The sketch of positions is mergeable, so no key is gathered.
        grid = F.percentile_approx(position, F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), 10 * CELLS)
        hot = (
            df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_lo"), F.max(position).alias("_hi"), grid.alias("_grid"))
            .where(F.col("_n") > limit)
        )
        self.chunked = not hot.isEmpty()
        if not self.chunked:
            self.df = df
            return
        # Cells hold equal row counts up to ties; one is cut further, evenly in position, when it is still too long.
        cell = F.size(F.filter("_grid", lambda g: g <= position))
        edges = F.concat(F.array("_lo"), F.col("_grid"), F.array("_hi"))
        low, high = F.get(edges, cell), F.get(edges, cell + 1)
        pieces = F.ceil(F.col("_n") / F.lit(limit * CELLS)) * 2
        inner = F.when(high > low, F.least(F.floor((position - low) / (high - low) * pieces), pieces - 1)).otherwise(F.lit(0))
        joined = null_safe_join(df, stage(hot, "hot-keys"), keys)
        self.df = joined.withColumn(CHUNK, F.coalesce((cell * pieces + inner).cast("long"), F.lit(0))).drop("_n", "_lo", "_hi", "_grid")

    # -- plumbing ---------------------------------------------------------------------------------

    @property
    def _cells(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else list(self.keys)

    def _partition(self) -> list:
        return [F.col(c) for c in self._cells] or [F.lit(0)]

    def window(self):
        return Window.partitionBy(*self._partition()).orderBy(*self.order)

    def _reverse(self):
        return Window.partitionBy(*self._partition()).orderBy(*[F.col(c).desc() for c in self.order])

    def _chunk_window(self, reverse: bool = False):
        # One row per chunk: a key's chunk list is bounded by its rows / limit.
        place = F.col(CHUNK).desc() if reverse else F.col(CHUNK)
        return Window.partitionBy(*([F.col(k) for k in self.keys] or [F.lit(0)])).orderBy(place)

    def _attach(self, summary: DataFrame) -> None:
        # The summary (one row per key and chunk) is written out first. Joining it lazily would put a second
        # copy of the whole lineage in the plan, and so double the plan with every operation.
        self.df = null_safe_join(self.df, stage(summary, "chunk-summary"), self._cells)

    def select(self, *cols) -> "Series":
        keep = [*cols, CHUNK] if self.chunked else list(cols)
        self.df = self.df.select(*keep)
        return self

    def with_columns(self, columns: dict[str, Column]) -> "Series":
        self.df = self.df.withColumns(columns)
        return self

    def where(self, condition: Column) -> "Series":
        self.df = self.df.where(condition)
        return self

    def done(self) -> DataFrame:
        return self.df.drop(CHUNK)

    # -- operations -------------------------------------------------------------------------------

    def shift(self, columns: dict[str, tuple[Column, int]]) -> "Series":
        """``{name: (expression, k)}``: the value k rows back (k > 0) or -k rows ahead (k < 0)."""
        if not self.chunked:
            w = self.window()
            self.df = self.df.withColumns(
                {n: F.lag(e, k).over(w) if k > 0 else F.lead(e, -k).over(w) for n, (e, k) in columns.items()}
            )
            return self
        self.df = self.df.withColumns({f"_x_{n}": e for n, (e, _) in columns.items()})
        for back in (True, False):
            part = {n: abs(k) for n, (_, k) in columns.items() if (k > 0) == back}
            if part:
                self._shift_chunked(part, back)
        self.df = self.df.drop(*[f"_x_{n}" for n in columns])
        return self

    def _shift_chunked(self, part: dict[str, int], back: bool) -> None:
        reach = max(part.values())
        fwd, rev = self.window(), self._reverse()
        # _far counts from the border the value comes over, _near from the border facing the donor rows.
        self.df = self.df.withColumns(
            {
                "_far": F.row_number().over(fwd if back else rev),
                "_near": F.row_number().over(rev if back else fwd),
                **{f"_in_{n}": (F.lag if back else F.lead)(f"_x_{n}", k).over(fwd) for n, k in part.items()},
            }
        )
        place = -F.col("_near") if back else F.col("_near")
        edge = (
            self.df.where(F.col("_near") <= reach)
            .groupBy(*self._cells)
            .agg(F.sort_array(F.collect_list(F.struct(place.alias("o"), *[F.col(f"_x_{n}") for n in part]))).alias("_e"))
        )
        span = self._chunk_window()
        span = span.rowsBetween(-reach, -1) if back else span.rowsBetween(1, reach)
        donors = edge.select(*self._cells, F.flatten(F.collect_list("_e").over(span)).alias("_d"))
        self._attach(donors)
        out = {}
        for n, k in part.items():
            at = F.col("_far") - F.lit(k + 1) if back else F.lit(k + 1) - F.col("_far")
            cross = F.try_element_at("_d", F.when(F.col("_far") <= k, at).otherwise(F.lit(1)).cast("int"))[f"_x_{n}"]
            out[n] = F.when(F.col("_far") > k, F.col(f"_in_{n}")).otherwise(cross)
        self.df = self.df.withColumns(out).drop("_far", "_near", "_d", *[f"_in_{n}" for n in part])

    def cumsum(self, columns: dict[str, Column]) -> "Series":
        """Running sums including the current row."""
        run = self.window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.chunked:
            self.df = self.df.withColumns({n: F.sum(e).over(run) for n, e in columns.items()})
            return self
        totals = self.df.groupBy(*self._cells).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in columns.items()])
        before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *self._cells, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in columns]
        )
        self._attach(offsets)

        def joined(n: str, e: Column) -> Column:
            """Null until the first value, as a plain running sum is."""
            own, ahead = F.sum(e).over(run), F.col(f"_o_{n}")
            return F.coalesce(own + ahead, own, ahead)

        self.df = self.df.withColumns({n: joined(n, e) for n, e in columns.items()}).drop(
            *[f"_o_{n}" for n in columns]
        )
        return self

    def row_number(self, name: str = "rn") -> "Series":
        return self.cumsum({name: F.lit(1).cast("long")})

    def total(self, columns: dict[str, Column]) -> "Series":
        """Whole-key sums on every row."""
        if not self.chunked:
            w = Window.partitionBy(*self._partition())
            self.df = self.df.withColumns({n: F.sum(e).over(w) for n, e in columns.items()})
            return self
        sums = self.df.groupBy(*self._cells).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in columns.items()])
        whole = Window.partitionBy(*([F.col(k) for k in self.keys] or [F.lit(0)]))
        self._attach(sums.select(*self._cells, *[F.sum(f"_t_{n}").over(whole).alias(n) for n in columns]))
        return self

    def last_seen(self, columns: dict[str, Column]) -> "Series":
        """Latest non-null value at or before each row."""
        return self._fill(columns, True)

    def next_seen(self, columns: dict[str, Column]) -> "Series":
        """Earliest non-null value at or after each row."""
        return self._fill(columns, False)

    def _fill(self, columns: dict[str, Column], back: bool) -> "Series":
        # Forward looks run backwards: a frame that is open at its far end is re-read for every row.
        upto = (Window.unboundedPreceding, 0)
        run = (self.window() if back else self._reverse()).rowsBetween(*upto)
        if not self.chunked:
            self.df = self.df.withColumns({n: F.last(e, ignorenulls=True).over(run) for n, e in columns.items()})
            return self
        place = F.struct(*self.order)
        extreme = F.max_by if back else F.min_by
        ends = self.df.groupBy(*self._cells).agg(
            *[extreme(e, F.when(e.isNotNull(), place)).alias(f"_s_{n}") for n, e in columns.items()]
        )
        span = self._chunk_window() if back else self._chunk_window(reverse=True)
        span = span.rowsBetween(Window.unboundedPreceding, -1)
        self._attach(
            ends.select(*self._cells, *[F.last(f"_s_{n}", ignorenulls=True).over(span).alias(f"_c_{n}") for n in columns])
        )
        self.df = self.df.withColumns(
            {n: F.coalesce(F.last(e, ignorenulls=True).over(run), F.col(f"_c_{n}")) for n, e in columns.items()}
        ).drop(*[f"_c_{n}" for n in columns])
        return self


def identity(t: DataFrame) -> list[str]:
    """Home and time of a reading, and its event id where the table has one."""
    return [c for c in ("home_id", "ts", "event_id") if c in t.columns]


def telemetry_series(df: DataFrame, by_month: bool = False) -> Series:
    keys = ["home_id", "month"] if by_month else ["home_id"]
    # Readings at one instant follow their event id where the table has one.
    return Series(df, keys, [c for c in ("ts", "event_id") if c in df.columns], epoch("ts"))


def hash_series(df: DataFrame, keys: list[str], unit: str, seed: int) -> Series:
    """Series in a seeded pseudo-random order of ``unit``; digests are the same in any SQL engine."""
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(unit).cast("string"), F.lit(str(seed)))))
    return Series(hashed, keys, ["_h", unit], hash_position("_h"))
