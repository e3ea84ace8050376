"""Equi-join of a large table with a smaller one, safe against hot keys."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the large side. At most
# HOT_SHARE keys can do so, which bounds what is broadcast.
HOT_SHARE = 1000

# Slots of hashed keys that are counted before any key is.
HOT_SLOTS = 1 << 16

# Largest estimated size of a side that is broadcast.
BROADCAST_BYTES = 10 * 1024 * 1024


def fits_broadcast(*tables: DataFrame) -> bool:
    """Whether Catalyst's size estimates of ``tables`` add up to BROADCAST_BYTES at most.

    For stored tables the estimate is their size on disk. Nodes that make more
    rows than they read are not reflected in it, so such plans do not qualify.
    """
    total = 0
    for df in tables:
        if not hasattr(df, "_jdf"):  # a remote session has no plan handle
            return False
        plan = df._jdf.queryExecution().optimizedPlan()
        total += int(str(plan.stats().sizeInBytes()))
        if any(node in plan.toString() for node in ("Generate ", "Expand ")):
            return False
    return total <= BROADCAST_BYTES


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than 1/share of the rows, with the pieces to cut them into.

    Rows are counted per slot of a hash of the key first. A hot key makes its
    slot hot, so keys are counted in hot slots only; without any, nothing but
    the counts of HOT_SLOTS slots is shuffled. At most ``share`` rows come out.
    """
    slotted = df.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(HOT_SLOTS)))
    slots = slotted.groupBy("_slot").agg(F.count("*").alias("_n"))
    total = slots.agg(F.sum("_n")).scalar()
    hot_slots = slots.where(F.col("_n") * share > total).select("_slot")
    counts = (
        slotted.dropna(subset=list(keys))
        .join(F.broadcast(hot_slots), "_slot", "left_semi")
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"))
    )
    pieces = F.ceil(F.col("_n") * share / total).cast("int").alias("_pieces")
    return counts.where(F.col("_n") * share > total).select(*keys, pieces)


def hot_join(
    large: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    sized_by: Sequence[DataFrame] = (),
    counted_on: DataFrame | None = None,
    spread: Sequence[str] = (),
    share: int = HOT_SHARE,
) -> DataFrame:
    """``large`` join ``small`` on equal keys; ``how`` is inner, left, left_semi or left_anti.

    A small side within BROADCAST_BYTES is broadcast: the large side is not
    shuffled, so no key can be hot. Beyond it, both sides are shuffled and each
    hot key is cut into pieces: the rows of the large side are dealt over the
    pieces, the matching rows of the small side are repeated once per piece.
    Every row of the large side keeps exactly one piece, so the result is that
    of the plain join.

    ``sized_by``: stored tables whose sizes bound the small side, where its own
    plan is a join that the estimate multiplies out. ``counted_on``: a stored
    table that holds at least the rows of a derived ``large`` side, to find hot
    keys without computing that side twice. Rows of a stored ``large`` table are dealt by their place in it,
    which spreads identical copies too; a derived one names ``spread`` columns,
    so that a retried task deals each row to the same piece again.
    """
    keys = list(keys)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"hot_join cannot repeat the small side of a {how} join")
    if fits_broadcast(*(sized_by or [small])):
        return large.join(F.broadcast(small), keys, how)
    # At most `share` rows, see hot_keys.
    hot = F.broadcast(hot_keys(large if counted_on is None else counted_on, keys, share))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    place = F.xxhash64(*spread) if spread else F.monotonically_increasing_id()
    # A NULL key matches nothing, so its rows may go anywhere.
    pieces = F.when(no_key, F.lit(share)).otherwise(F.coalesce("_pieces", F.lit(1)))
    dealt = (
        large.withColumn("_place", place)
        .join(hot, keys, "left")
        .withColumn("_piece", F.pmod("_place", pieces).cast("int"))
        .drop("_place", "_pieces")
    )
    repeated = (
        small.join(hot, keys, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return dealt.join(repeated, [*keys, "_piece"], how).drop("_piece")
