"""Windows, islands, running totals and event deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.ranks import keyed_total, neighbours, running_total


def islands(df: DataFrame, key: str, order: list[str], flag: Column, start: str, end: str) -> DataFrame:
    """``key, first, last, rows``: runs of consecutive rows whose flag holds; a run begins where the row before does not hold it."""
    marked = neighbours(df.withColumn("__f", F.coalesce(flag, F.lit(False))), [key], order, ["__f"], -1)
    begins = marked.withColumn("__b", (F.col("__f") & ~F.coalesce("near___f", F.lit(False))).cast("long")).drop("near___f")
    runs = keyed_total(begins, [key], order, "__b", "__g").where("__f")
    return runs.groupBy(key, "__g").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count(F.lit(1)).alias("rows")).drop("__g")


def sliding(df: DataFrame, time: str, value: str, length_s: int, hop_s: int) -> DataFrame:
    """``start, n, mean, most`` of windows at multiples of the hop; partial sums before any row moves."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    k = F.floor(at / F.lit(hop_s * 1_000_000)).cast("long")
    first = F.floor((at - F.lit(length_s * 1_000_000)) / F.lit(hop_s * 1_000_000)).cast("long") + 1
    rows = df.select(F.col(value).alias("v"), F.explode(F.sequence(first, k)).alias("w"))
    return rows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("most")).select((F.col("w") * hop_s).alias("start"), "n", "mean", "most")


def windows(df: DataFrame, track: str, at: str, value: str, length: int, hop: int, last: bool = True) -> DataFrame:
    """``track, start, n, mean, most`` of windows of ``length`` samples every ``hop`` over each track's whole length.

    ``last`` says whether a window that ends just where the track does counts.
    """
    size = df.groupBy(F.col(track).alias("__t")).agg((F.max(at) + 1).cast("long").alias("__n"))
    k = F.col(at).cast("long")
    first = F.greatest(F.lit(0), F.floor((k - length) / hop).cast("long") + 1)
    rows = df.select(track, k.alias("__at"), F.col(value).alias("__v"), F.explode(F.sequence(first, F.floor(k / hop).cast("long"))).alias("__w"))
    end = F.col("__w") * hop + length
    kept = rows.join(size, F.col(track) == F.col("__t")).where(end <= F.col("__n") if last else end < F.col("__n"))
    return kept.groupBy(track, (F.col("__w") * hop).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"), F.max("__v").alias("most"))


def snippets(df: DataFrame, track: str, at: str, vec: str, length: int) -> DataFrame:
    """``track, snippet, pos, mean``: mean vectors of each ``length`` samples of a track, a shorter last one kept."""
    long = df.select(track, F.floor(F.col(at) / length).cast("long").alias("snippet"), F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "__v"))
    return long.groupBy(track, "snippet", "pos").agg(F.avg("__v").alias("mean"))


def tempo_seconds(df: DataFrame, track: str, order: list[str], delta: str, tempo: str, per_beat: int, default: int = 500_000) -> DataFrame:
    """``df`` plus ``seconds``: the time of each event from tick deltas, at the latest ``tempo`` (microseconds a beat; null: unchanged) before it."""
    w = Window.partitionBy(track).orderBy(*order)
    pace = F.coalesce(F.last(tempo, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(default))
    timed = df.withColumn("__d", F.col(delta) * pace / (per_beat * 1e6))
    return timed.withColumn("seconds", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def tumbling_max(df: DataFrame, time: str, value: str, length_s: int) -> DataFrame:
    at = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(length_s * 1_000_000)).cast("long")
    return df.groupBy((at * length_s).alias("start")).agg(F.max(value).alias("most"))


def quantise(value: Column, low: float, high: float, levels: int = 64) -> Column:
    step = (high - low) / levels
    return F.bround((F.greatest(F.lit(low), F.least(F.lit(high), value)) - low) / step) * step + low


def deltas(df: DataFrame, key: str, order: list[str], tick: str) -> DataFrame:
    """``df`` plus ``delta`` (ticks since the row before, 0 for the first) and ``elapsed`` (their running sum)."""
    near = neighbours(df, [key], order, [tick], -1)
    timed = near.withColumn("delta", F.coalesce(F.greatest(F.lit(0), F.col(tick) - F.col(f"near_{tick}")), F.lit(0)).cast("long")).drop(f"near_{tick}")
    return keyed_total(timed, [key], order, "delta", "elapsed")


def within_budget(df: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """The rows from the start whose sizes fit the limit together, with ``label``, a six-digit sequence number; stops at the first that does not."""
    return running_total(df, [order], size).where(F.col("total") <= limit).withColumn("label", F.lpad(F.col("seq").cast("string"), 6, "0"))


def energy_db(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, rms, db, level``: root mean square, decibels, and decibels clipped to -60 .. 0 on a scale from 0 to 1."""
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)))
    out = df.groupBy(key).agg(rms.alias("rms")).withColumn("db", 20 * F.log10(F.col("rms") + 1e-9))
    return out.withColumn("level", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("db") + 60) / 60)))


def pairing(df: DataFrame, key: str, order: str, kind: str, first: str, second: str, carry: str) -> DataFrame:
    """Rows of kind ``first`` that a row of kind ``second`` follows at once, with its ``carry``."""
    led = neighbours(df, [key], [order], list(dict.fromkeys([kind, carry])), 1).withColumn(f"next_{carry}", F.col(f"near_{carry}"))
    return led.where((F.col(kind) == first) & (F.col(f"near_{kind}") == second)).drop(*{f"near_{kind}", f"near_{carry}"})
