"""Ordered scans per key (previous row, running sum or minimum, forward fill) that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts all rows of a key in one task. That is fine
until one key holds a large part of the table. ``ordered`` counts rows per key first (one column-pruned,
map-side combined aggregate) and runs the plain window over all keys that are not hot. A hot key is cut at
quantiles of its order column into consecutive pieces; the window runs inside each (key, piece), and what
a piece needs from the rows before it (last row, sum so far, last value) comes from a one-row-per-piece
summary that is joined back. Results equal those of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import BROADCAST_BYTES, null_safe_join
from tidemark.session import use_checkpoint_dir

#: A key of more rows is scanned in pieces of about this size; results are the same on either side of it.
ROWS_PER_PIECE = 5_000_000
#: Pieces that one round of cutting makes of a key; larger pieces are cut again.
FANOUT = 1000
#: Rows that a cut point rests on: cuts come from a sample, so no task merges digests of all rows of a key.
ROWS_PER_CUT = 200

#: What a row of keys takes in a broadcast, by estimate.
KEY_BYTES = 200
SEED = 29

PIECE = "__piece"
_CUTS = "__cuts"
_CARRY = "__carry"
_PREV = "__prev"
_N = "__n"


@dataclass(frozen=True)
class Cuts:
    """Cut points of the hot keys, checkpointed so that every use sees the same ones."""

    df: DataFrame
    longest: int
    few: bool
    again: bool


def _find_cuts(df: DataFrame, keys: list[str], order: str, rows: int) -> Cuts | None:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_N))
    hot = counts.filter(F.col(_N) > rows)
    peak, hot_keys = hot.agg(F.max(_N), F.count(F.lit(1))).first()
    if not hot_keys:
        return None
    use_checkpoint_dir(df.sparkSession)
    wanted = math.ceil(peak / rows)
    pieces = min(FANOUT, wanted)
    shares = [i / pieces for i in range(1, pieces)]
    few = hot_keys * KEY_BYTES <= BROADCAST_BYTES
    hot_rows = null_safe_join(df.select(*keys, order), hot, keys, "inner", small=few)
    # a key of n rows needs n / rows cuts, each resting on some hundred rows; cuts never change a result
    chance = F.lit(float(ROWS_PER_CUT)) / F.least(F.lit(float(rows)), F.col(_N) / pieces)
    drawn = hot_rows.filter(F.rand(SEED) < chance)
    # A key needs only n / rows pieces: keep every stride-th quantile, so that the number of
    # cuts over all keys stays below 2 * (all rows / rows per piece).
    stride = F.greatest(F.lit(1), F.floor(F.lit(pieces) * F.lit(rows) / F.col(_N))).cast("int")
    cuts = (
        drawn.groupBy(*keys)
        .agg(
            F.max(_N).alias(_N),
            F.percentile_approx(order, shares, max(10_000, 20 * pieces)).alias(_CUTS),
        )
        .withColumn("__stride", stride)
        .select(
            *keys,
            F.array_distinct(
                F.filter(_CUTS, lambda _, i: (i + 1) % F.col("__stride") == 0)
            ).alias(_CUTS),
        )
    )
    # a hot key the sample missed has no cuts and is one piece
    cuts = null_safe_join(hot.select(*keys), cuts, keys, "left", small=few)
    cuts = cuts.withColumn(_CUTS, F.coalesce(_CUTS, F.array().cast(cuts.schema[_CUTS].dataType)))
    cuts = cuts.checkpoint()
    total, longest = cuts.agg(F.sum(F.size(_CUTS)), F.max(F.size(_CUTS))).first()
    few = hot_keys * KEY_BYTES + total * 8 <= BROADCAST_BYTES
    return Cuts(cuts, longest, few, wanted > FANOUT)


def _piece_number(order: str, longest: int) -> Column:
    """How many cuts lie below the row: binary search in the sorted cut array; null without one."""
    steps = [1 << b for b in reversed(range(max(1, longest).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: at
        + F.when(F.get(F.col(_CUTS), at + step - 1) < F.col(order), step).otherwise(F.lit(0)),
    )


@dataclass(frozen=True)
class Ordered:
    """Rows to scan: ``df`` as they are or, if ``split``, in pieces; ``rest`` holds the other keys."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str
    ties: tuple[str, ...] = ()
    split: bool = False
    cuts: Cuts | None = None
    rest: Ordered | None = None
    rows: int = ROWS_PER_PIECE

    def window(self):
        group = [*self.keys, PIECE] if self.split else self.keys
        return Window.partitionBy(*group).orderBy(self.order, *self.ties)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Change other columns; must keep the rows and the key, order, tie and piece columns."""
        return self._next(change(self.df), self.rest and self.rest.map(change))

    def rearranged(self, change: Callable[[DataFrame], DataFrame], order: str) -> Ordered:
        """Other rows of the same keys, ordered by another column. The hot keys' rows are written once and cut again
        in the new order, as the old cuts need not part it evenly."""
        rest = self.rest and self.rest.rearranged(change, order)
        if self.cuts is None:
            return replace(self, df=change(self.df), order=order, ties=(), rest=rest)
        use_checkpoint_dir(self.df.sparkSession)
        rows = change(self.df).drop(PIECE).checkpoint()
        fresh = ordered(rows, list(self.keys), order, rows=self.rows)
        if not fresh.split:
            return replace(rest, df=rest.df.unionByName(fresh.df))
        plain = replace(rest, df=rest.df.unionByName(fresh.rest.df))
        return replace(fresh, rest=plain)

    def done(self) -> DataFrame:
        rows = self.df.drop(PIECE)
        return rows if self.rest is None else self.rest.done().unionByName(rows)

    def _next(self, df: DataFrame, rest: Ordered | None) -> Ordered:
        return replace(self, df=df, rest=rest)

    def _settled(self) -> DataFrame:
        """Rows to read twice (once for the summary): the hot keys' go to the checkpoint folder first.
        Rows with given pieces come straight from a file and are read again instead."""
        if self.cuts is None:
            return self.df
        use_checkpoint_dir(self.df.sparkSession)
        return self.df.checkpoint()

    def _with_carry(self, df, out: DataFrame, per_piece: Column, over_pieces) -> DataFrame:
        """Join to each row what the earlier pieces of its key hand over."""
        summary = df.groupBy(*self.keys, PIECE).agg(per_piece.alias(_CARRY))
        pieces = Window.partitionBy(*self.keys).orderBy(PIECE)
        carry = summary.withColumn(_CARRY, over_pieces(pieces)).filter(F.col(_CARRY).isNotNull())
        if self.cuts is None:  # given pieces: keys are never null, and the join reuses their shuffle
            return out.join(carry, [*self.keys, PIECE], "left")
        return null_safe_join(out, carry, [*self.keys, PIECE], "left", small=self.cuts.few)

    def previous(self, **columns: str) -> Ordered:
        """Add ``new=source``: the source's value on the previous row of the key, null on the first."""
        rest = self.rest and self.rest.previous(**columns)
        if not self.split:
            lagged = {new: F.lag(src).over(self.window()) for new, src in columns.items()}
            return self._next(self.df.withColumns(lagged), rest)
        df = self._settled()
        packed = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
        out = self._with_carry(
            df,
            df.withColumn(_PREV, F.lag(packed).over(self.window())),
            F.max_by(packed, F.struct(self.order, *self.ties)),
            lambda pieces: F.lag(_CARRY).over(pieces),
        )
        before = F.coalesce(_PREV, _CARRY)
        found = out.withColumns({new: before.getField(new) for new in columns})
        return self._next(found.drop(_PREV, _CARRY), rest)

    def running_sum(self, source: str, new: str) -> Ordered:
        """Add the sum over all rows of the key up to this one (rows of equal order included)."""
        return self.running_sums(**{new: source})

    def running_sums(self, **columns: str) -> Ordered:
        """Add ``new=source`` sums in one pass; sums over null values alone are null."""

        def both(own: Column, carried: Column) -> Column:
            return F.coalesce(own + carried, own, carried)

        return self._running(F.sum, columns, both)

    def running_min(self, source: str, new: str) -> Ordered:
        """Add the smallest value of the key up to this row (rows of equal order included)."""
        return self._running(F.min, {new: source}, F.least)

    def _running(self, how, columns: dict[str, str], both) -> Ordered:
        rest = self.rest and self.rest._running(how, columns, both)
        upto = self.window().rangeBetween(Window.unboundedPreceding, Window.currentRow)
        running = {new: how(source).over(upto) for new, source in columns.items()}
        if not self.split:
            return self._next(self.df.withColumns(running), rest)
        df = self._settled()

        def before(pieces):
            earlier = pieces.rowsBetween(Window.unboundedPreceding, -1)
            return F.struct(*[how(F.col(_CARRY)[new]).over(earlier).alias(new) for new in columns])

        out = self._with_carry(
            df,
            df.withColumns(running),
            F.struct(*[how(source).alias(new) for new, source in columns.items()]),
            before,
        )
        found = {new: both(F.col(new), F.col(_CARRY)[new]) for new in columns}
        return self._next(out.withColumns(found).drop(_CARRY), rest)

    def fill_forward(self, source: str, new: str) -> Ordered:
        """Add the latest non-null value of the key up to and including this row."""
        rest = self.rest and self.rest.fill_forward(source, new)
        upto = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        latest = F.last(source, ignorenulls=True).over(upto)
        if not self.split:
            return self._next(self.df.withColumn(new, latest), rest)
        df = self._settled()
        known = F.when(F.col(source).isNotNull(), F.struct(self.order, *self.ties))
        out = self._with_carry(
            df,
            df.withColumn(new, latest),
            F.max_by(source, known),
            lambda pieces: F.last(_CARRY, ignorenulls=True).over(
                pieces.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        return self._next(out.withColumn(new, F.coalesce(new, _CARRY)).drop(_CARRY), rest)


def _in_pieces(df, keys, order, ties, cuts: Cuts, rows: int) -> Ordered:
    keys = list(keys)
    placed = (
        null_safe_join(df, cuts.df, keys, "inner", small=cuts.few)
        .withColumn(PIECE, _piece_number(order, cuts.longest))
        .drop(_CUTS)
    )
    again = cuts.again
    while again:
        finer = _find_cuts(placed, [*keys, PIECE], order, rows)
        if finer is None:
            break
        again = finer.again
        inside = null_safe_join(placed, finer.df, [*keys, PIECE], "left", small=finer.few)
        number = F.coalesce(_piece_number(order, finer.longest), F.lit(0))
        placed = inside.withColumn(PIECE, F.col(PIECE).cast("bigint") * FANOUT + number).drop(_CUTS)
    return Ordered(placed, tuple(keys), order, tuple(ties), split=True, cuts=cuts, rows=rows)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str] | tuple[str, ...] = (),
    rows: int = ROWS_PER_PIECE,
) -> Ordered:
    """Prepare ordered scans per key. ``order`` is a bigint column, ``ties`` break equal values.

    Keys of more than ``rows`` rows are scanned in pieces of about that size.
    """
    cuts = _find_cuts(df, list(keys), order, rows)
    if cuts is None:
        return Ordered(df, tuple(keys), order, tuple(ties), rows=rows)
    others = null_safe_join(df, cuts.df.select(*keys), list(keys), "left_anti", small=cuts.few)
    rest = Ordered(others, tuple(keys), order, tuple(ties), rows=rows)
    return replace(_in_pieces(df, keys, order, ties, cuts, rows), rest=rest)


def ordered_in_pieces(
    df: DataFrame, keys: list[str], piece: str, order: str, ties: list[str] | tuple[str, ...] = ()
) -> Ordered:
    """As ``ordered`` for rows that already know their piece (for example the split of a file)."""
    placed = df.withColumn(PIECE, F.col(piece))
    return Ordered(placed, tuple(keys), order, tuple(ties), split=True)
