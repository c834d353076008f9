"""Packet selection rules.

Time, uniform and decay sampling are narrow.  Count and n-of-N sampling need the
running number of a packet, which ``global_rank`` builds from chunk counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetflow.functions.scalars import hash_fraction, hash_order
from packetflow.operators.filters import capture_filter
from packetflow.operators.ordering import CHUNK, global_rank

# Numbers of the sampling rules in interface settings.
NONE, COUNT, TIME, N_OF_N, UNIFORM, TIME_DECAY = 0, 1, 2, 3, 4, 5
LARGEST_N = 1000


def _positive(**values) -> None:
    for name, value in values.items():
        if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
            raise ValueError(f"{name} must be a positive integer, not {value!r}")


def _scope(scope: str) -> list[str]:
    if scope not in ("interface", "global"):
        raise ValueError(f"scope must be 'interface' or 'global', not {scope!r}")
    return ["interface"] if scope == "interface" else []


def sample_none(df: DataFrame) -> DataFrame:
    return df


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("_t", F.unix_micros("ts"))


def sample_count(
    df: DataFrame, keep: int, skip: int, scope: str = "interface", invert: bool = False, chunk=CHUNK
) -> DataFrame:
    """Keep ``keep`` packets in a row, skip the next ``skip``.

    ``invert`` skips first and keeps the rest, with the phase one packet earlier.
    """
    _positive(keep=keep, skip=skip)
    ranked = global_rank(_timed(df), _scope(scope), chunk=chunk)
    period = keep + skip
    chosen = F.pmod("rank", F.lit(period)) >= keep if invert else F.pmod(F.col("rank") - 1, F.lit(period)) < keep
    return ranked.where(chosen).drop("rank", "_t")


def sample_time(df: DataFrame, keep_s: int, skip_s: int, invert: bool = False) -> DataFrame:
    """Keep packets of the first ``keep_s`` seconds of every ``keep_s + skip_s``."""
    _positive(keep_s=keep_s, skip_s=skip_s)
    phase = F.pmod(F.unix_seconds("ts"), F.lit(keep_s + skip_s))
    return df.where(phase >= keep_s if invert else phase < keep_s)


def _n_of_n_limits(n: int, N: int) -> None:
    _positive(n=n, N=N)
    if N > LARGEST_N or n > N:
        raise ValueError(f"n-of-N needs n <= N <= {LARGEST_N}, not {n} of {N}")


def _pick_in_runs(ranked: DataFrame, by: list[str], n: Column, N: Column, seed: int) -> DataFrame:
    """From runs of N consecutive packets keep n at random; a group is one run, so never more than N rows."""
    runs = ranked.withColumn("_run", F.floor((F.col("rank") - 1) / N)).withColumn("_draw", hash_order(F.col("packet_id"), seed))
    order = Window.partitionBy(*by, "_run").orderBy("_draw", "packet_id")
    return runs.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_run", "_draw", "_place")


def sample_n_of_N(
    df: DataFrame, n: int, N: int, seed: int = 0, scope: str = "interface", chunk=CHUNK
) -> DataFrame:
    _n_of_n_limits(n, N)
    by = _scope(scope)
    ranked = global_rank(_timed(df), by, chunk=chunk)
    return _pick_in_runs(ranked, by, F.lit(n), F.lit(N), seed).drop("rank", "_t")


def sample_uniform(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    if not 0 <= percent <= 100:
        raise ValueError(f"percent must be between 0 and 100, not {percent!r}")
    return df.where(hash_fraction(F.col("packet_id"), seed) < F.lit(percent / 100.0))


def _decay(t: Column, start_s: Column, end_s: Column) -> Column:
    return (
        F.when(t < start_s, F.pow(t / start_s, F.lit(4)))
        .when(t > end_s, F.pow(end_s / t, F.lit(4)))
        .otherwise(F.lit(1.0))
    )


def sample_time_decay(df: DataFrame, start_s: int, end_s: int, seed: int = 0) -> DataFrame:
    """Certain inside [start_s, end_s] (seconds since epoch), fading with the fourth power outside."""
    if start_s < 0 or end_s < start_s:
        raise ValueError(f"need 0 <= start <= end, not {start_s}..{end_s}")
    t = F.unix_seconds("ts").cast("double")
    chance = _decay(t, F.lit(float(start_s)), F.lit(float(end_s)))
    return df.where(hash_fraction(F.col("packet_id"), seed) < chance)


def interface_settings(interfaces: DataFrame | Iterable[dict], most: int = 100_000) -> list[dict]:
    """Interface settings as dicts, one per interface; refused above ``most`` rows, which bounds the broadcast."""
    rows = [row.asDict() for row in interfaces.limit(most + 1).collect()] if isinstance(interfaces, DataFrame) else [dict(row) for row in interfaces]
    if len(rows) > most:
        raise ValueError(f"more than {most} interface settings")
    if len({row["name"] for row in rows}) < len(rows):
        raise ValueError("an interface is listed twice")
    return rows


def _checked(row: dict) -> tuple[str, int, float | None, float | None]:
    rule, p1, p2 = int(row["sampling_type"]), row.get("param1"), row.get("param2")
    if rule in (COUNT, TIME):
        _positive(param1=p1, param2=p2)
    elif rule == N_OF_N:
        _n_of_n_limits(p1, p2)
    elif rule == UNIFORM and not 0 <= p1 <= 100:
        raise ValueError(f"percent must be between 0 and 100, not {p1!r}")
    return row["name"], rule, None if p1 is None else float(p1), None if p2 is None else float(p2)


def sample_by_interface(df: DataFrame, interfaces, seed: int = 0, chunk=CHUNK) -> DataFrame:
    """Apply each interface's own rule.  Packets of unlisted interfaces and unknown rules are dropped.

    The settings are joined on the interface, so their number does not show in the plan.  One branch holds all rules that
    look at a packet alone, one all that need its running number.
    """
    settings = [_checked(row) for row in interface_settings(interfaces)]
    if not settings:
        return df.where(F.lit(False))
    table = df.sparkSession.createDataFrame(settings, "_name string, _rule int, _p1 double, _p2 double")
    joined = df.join(F.broadcast(table), F.col("interface") == F.col("_name"))
    rule, p1, p2 = F.col("_rule"), F.col("_p1"), F.col("_p2")
    rules = {rule for _, rule, *_ in settings}
    branches = []
    if rules - {COUNT, N_OF_N}:
        chance, t = hash_fraction(F.col("packet_id"), seed), F.unix_seconds("ts")
        kept = (
            F.when(rule == NONE, F.lit(True))
            .when(rule == TIME, F.pmod(t, (p1 + p2).cast("long")) < p1)
            .when(rule == UNIFORM, chance < p1 / 100.0)
            .when(rule == TIME_DECAY, chance < _decay(t.cast("double"), p1, p2))
        )
        branches.append(joined.where(kept).select(*df.columns))
    if rules & {COUNT, N_OF_N}:
        ranked = global_rank(_timed(joined.where(rule.isin(COUNT, N_OF_N))), ["interface"], chunk=chunk)
        # Runs of keep + skip, or of N, packets; the first ones stay, in their own order or in a drawn one.
        size = F.when(rule == COUNT, p1 + p2).otherwise(p2)
        runs = ranked.withColumn("_run", F.floor((F.col("rank") - 1) / size))
        order = Window.partitionBy("interface", "_run").orderBy("_own", "_draw", "packet_id")
        drawn = runs.withColumns({"_own": F.when(rule == COUNT, F.col("rank")), "_draw": hash_order(F.col("packet_id"), seed)})
        branches.append(drawn.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= p1).select(*df.columns))
    return reduce(DataFrame.unionByName, branches)


def apply_interfaces(df: DataFrame, interfaces, seed: int = 0, chunk=CHUNK) -> DataFrame:
    """Each interface's own filter, then its own sampling rule."""
    settings = interface_settings(interfaces)
    predicates = {row["name"]: row["filter"] for row in settings if row.get("filter")}
    filtered = capture_filter(df, predicates) if predicates else df
    return sample_by_interface(filtered, settings, seed, chunk)
