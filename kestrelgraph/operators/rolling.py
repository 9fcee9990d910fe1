"""Totals over trailing periods, as a versioned daily state.

The state of a day is yesterday's total, plus what arrived for the day, minus what expires on it. A version adds one
batch of arrivals: for each entity that the batch reaches, yesterday's totals are read from the earlier versions and
joined with the arriving days' and the expiring days' amounts. Only the dates that the batch reaches are recomputed, so
a late row (a correction) costs the dates after it and no others, and entities without arrivals cost nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPANS = (7, 30)


def daily(rows: DataFrame, entity: str, at: str, measures: dict[str, str], *also: str) -> DataFrame:
    """(entity, day, also..., measures): the sums of each entity's days; rows whose entity or time is null are left out.

    A hot entity is combined on the map side; after that no entity has more rows than it has days (for each value of
    also). Nulls count 0.
    """
    day = F.to_date(F.col(f"`{at}`"))
    return (
        rows.select(F.col(f"`{entity}`").alias("entity"), day.alias("day"), *also, *[F.col(f"`{c}`").alias(m) for m, c in measures.items()])
        .where("entity is not null and day is not null")
        .groupBy("entity", "day", *also)
        .agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
    )


def _named(measure: str, span: int) -> str:
    return f"{measure}_{span}"


def averages(totals: DataFrame, measures: Sequence[str], spans: Sequence[int] = SPANS) -> DataFrame:
    """totals with avg_<measure>_<span>, the mean per calendar day of the span."""
    return totals.select("*", *[(F.col(_named(m, s)) / s).alias(f"avg_{_named(m, s)}") for m in measures for s in spans])


class State:
    """The versions of one rolling state, as Parquet tables below a folder of the shared file system.

    ledger holds the daily amounts that each version brought, heads each entity's first and last day as of a version and
    the dates that the version recomputed, if any, totals their rows. A version is its own folder, so readers of an older
    one are not disturbed, and a version that was interrupted is written again.
    """

    def __init__(self, spark: SparkSession, path: str, entity: str, measures: Sequence[str], spans: Sequence[int] = SPANS, version: int = 0):
        self.spark, self.path, self.entity = spark, path, entity
        self.measures, self.spans, self.version = list(measures), list(spans), version
        self.columns = [_named(m, s) for m in self.measures for s in self.spans]

    @property
    def _shapes(self) -> dict[str, str]:
        amounts = lambda names: "".join(f", {n} bigint" for n in names)
        key = f"entity {self.entity}"
        return {
            "ledger": f"{key}, day date{amounts(self.measures)}",
            "totals": f"{key}, day date{amounts(self.columns)}",
            "heads": f"{key}, first_day date, last_day date, from_day date, to_day date",
        }

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={self.version}")

    def read(self, name: str, low: int = 1, high: int | None = None) -> DataFrame:
        """Versions low to high of a table, with their version; without rows if there are none."""
        high = self.version if high is None else high
        shape = f"{self._shapes[name]}, version int"
        if high < low:
            return self.spark.createDataFrame([], shape)
        paths = [f"{self.path}/{name}/version={v}" for v in range(low, high + 1)]
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(shape).parquet(*paths)

    def totals(self, version: int | None = None) -> DataFrame:
        """(entity, day, <measure>_<span>...) as of a version, for every day from an entity's first to its last."""
        rows = self.read("totals", high=version)
        newest = rows.groupBy("entity", "day").agg(F.max_by(F.struct(*self.columns), "version").alias("t"))
        return newest.select("entity", "day", "t.*")

    def _touched(self, low: int, high: int) -> DataFrame:
        return self.read("heads", low, high).where("from_day is not null").select("entity", "from_day", "to_day", "version")

    def recomputed(self) -> DataFrame:
        """(entity, from_day, to_day, version): the dates that each version recomputed."""
        return self._touched(1, self.version)

    def advance(self, arrivals: DataFrame) -> State:
        """The next version, after a batch of arrivals (entity, day, measures); negative amounts take rows back.

        An entity's dates are recomputed from its earliest arriving day (or the day after its last one, if its history
        grows) to its latest arriving day plus the longest span, and never beyond its last day. Null entities and days
        are left out; an empty batch gives a version without rows.
        """
        self.version += 1
        v, reach = self.version, max(self.spans) - 1
        arriving = arrivals.where("entity is not null and day is not null").groupBy("entity", "day").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in self.measures])
        self._write(arriving, "ledger")
        touched = self.read("ledger", v).groupBy("entity").agg(F.min("day").alias("low"), F.max("day").alias("high"))
        old = self.read("heads", v - 1, v - 1).select("entity", "first_day", "last_day") if v > 1 else self.read("heads", high=0).drop("version")
        both = old.join(touched, "entity", "full")
        first, last = F.least("first_day", "low"), F.greatest("high", "last_day")
        begin = F.when(F.col("last_day") < F.col("low"), F.date_add("last_day", 1)).otherwise(F.col("low"))
        end = F.when(F.col("low").isNotNull(), F.least(last, F.greatest(F.date_add("high", reach), F.coalesce("first_day", "high"))))
        self._write(both.select("entity", first.alias("first_day"), last.alias("last_day"), begin.alias("from_day"), end.alias("to_day")), "heads")
        bounds = self._touched(v, v).drop("version")
        edge = bounds.agg(F.min("from_day").alias("low"), F.max("to_day").alias("high")).first()
        if edge.low is None:
            self._write(self.spark.createDataFrame([], self._shapes["totals"]), "totals")
        else:
            self._write(self._recompute(bounds, edge.low, edge.high), "totals")
        return self

    def _recompute(self, bounds: DataFrame, low: dt.date, high: dt.date) -> DataFrame:
        """The totals of the dates in bounds: yesterday's, plus arrivals, minus what expires, day by day."""
        longest, zero = max(self.spans), F.lit(0).cast("bigint")
        pick = lambda keep: [(F.col(m) if keep == 0 else -F.col(m) if s == keep else zero).alias(_named(m, s)) for m in self.measures for s in self.spans]
        ledger = self.read("ledger").where(F.col("day").between(low - dt.timedelta(longest), high))
        near = ledger.join(bounds, "entity").where((F.col("day") >= F.date_sub("from_day", longest)) & (F.col("day") <= F.col("to_day")))
        moves = F.array(*[F.struct(F.date_add("day", s).alias("day"), *pick(s)) for s in (0, *self.spans)])
        flow = near.select("entity", "from_day", "to_day", F.explode(moves).alias("x")).select("entity", "x.*", "from_day", "to_day")
        flow = flow.where(F.col("day").between(F.col("from_day"), F.col("to_day"))).drop("from_day", "to_day")
        before = self.read("totals", high=self.version - 1).where(F.col("day").between(low - dt.timedelta(1), high))
        seed = before.join(bounds, "entity").where(F.col("day") == F.date_sub("from_day", 1)).groupBy("entity", "day").agg(F.max_by(F.struct(*self.columns), "version").alias("t"))
        flow = flow.unionByName(seed.select("entity", "day", "t.*")).withColumn("wanted", F.lit(None).cast("boolean"))
        dates = bounds.select("entity", F.explode(F.sequence("from_day", "to_day")).alias("day"), *[zero.alias(c) for c in self.columns], F.lit(True).alias("wanted"))
        by_day = flow.unionByName(dates).groupBy("entity", "day").agg(*[F.sum(c).alias(c) for c in self.columns], F.bool_or("wanted").alias("wanted"))
        running = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        return by_day.select("entity", "day", "wanted", *[F.sum(c).over(running).alias(c) for c in self.columns]).where("wanted").drop("wanted")


def replay(arrivals: DataFrame, period: str, path: str, measures: Sequence[str], spans: Sequence[int] = SPANS) -> State:
    """The state after all arrivals (entity, day, period, measures), a version for each period in its order.

    Only the distinct periods reach the driver: one short row for each version.
    """
    spark = arrivals.sparkSession
    state = State(spark, path, arrivals.schema["entity"].dataType.simpleString(), measures, spans)
    for (p,) in sorted(tuple(r) for r in arrivals.select(period).distinct().collect()):
        state.advance(arrivals.where(F.col(period) == F.lit(p)))
    return state
