"""Schedules of crawls: when they run, how they are shown, what a run leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import not_empty, trim_ws

#: Names of the days, Sunday first.
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WEEK = 10080


def interval_label(minutes: Column) -> Column:
    hours, days = F.floor(minutes / 60).cast("string"), F.floor(minutes / 1440).cast("string")
    return (
        F.when(minutes == 60, "Hourly").when(minutes == 1440, "Daily").when(minutes == WEEK, "Weekly")
        .when(minutes < 1440, F.concat(F.lit("Every "), hours, F.lit("h"))).otherwise(F.concat(F.lit("Every "), days, F.lit("d")))
    )


def interval_text(minutes: Column, time: Column, day: Column) -> Column:
    """The label with the day of weekly schedules and the time."""
    on_day = F.when((minutes == WEEK) & day.isNotNull(), F.concat(F.lit(" on "), F.get(F.array(*[F.lit(d) for d in DAYS]), day.cast("int")))).otherwise("")
    return F.concat(interval_label(minutes), on_day, F.coalesce(F.concat(F.lit(" at "), not_empty(time)), F.lit("")))


def next_fire(now: Column, minutes: Column, time: Column, day: Column) -> Column:
    """The next firing after ``now``: weekly on its day, else from today's time on by whole periods. Times are UTC."""
    clock = F.split(time, ":")
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), clock[0].cast("int"), clock[1].cast("int"), F.lit(0).cast("decimal(18,6)"))
    ahead = F.pmod(day.cast("int") - (F.dayofweek(now) - 1), F.lit(7))
    on_day = today + F.make_dt_interval(ahead)
    weekly = F.when(on_day <= now, on_day + F.make_dt_interval(F.lit(7))).otherwise(on_day)
    passed = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(today.cast("timestamp"))) / 60e6
    periods = F.ceil(F.greatest(passed, F.lit(0.0)) / minutes)
    periods = F.when(periods * minutes <= passed, periods + 1).otherwise(periods)
    shifted = today + F.make_dt_interval(F.lit(0), F.lit(0), (periods * minutes).cast("int"), F.lit(0).cast("decimal(18,6)"))
    other = F.when(today > now, today).otherwise(shifted)
    return F.when((minutes == WEEK) & day.isNotNull(), weekly).otherwise(other)


def property_label(summary_name: Column, spider: Column, sitemap: Column, list_text: Column, template: Column) -> Column:
    line = F.get(F.filter(F.transform(F.split(list_text, "\n"), trim_ws), lambda x: x != ""), F.lit(0))
    return F.coalesce(not_empty(summary_name), not_empty(spider), not_empty(sitemap), line, not_empty(template), F.lit("–"))


def state(running: Column, enabled: Column) -> Column:
    return F.when(running, "running").when(enabled, "active").otherwise("paused")


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules to start: enabled, not running, with a next run that has come."""
    return schedules.where(F.col("enabled") & ~F.coalesce("running", F.lit(False)) & (F.col("next_run") <= now))


def with_next_run(schedules: DataFrame, alarms: DataFrame) -> DataFrame:
    """Schedules with ``next_run`` from (id, next_run) alarms; NULL for those that are paused or have no alarm."""
    joined = schedules.drop("next_run").join(alarms.select("id", "next_run"), "id", "left")
    return joined.withColumn("next_run", F.when(F.col("enabled"), F.col("next_run")))


def view(schedules: DataFrame, alarms: DataFrame) -> DataFrame:
    """(id, property, interval, last_run, last_stats, next_run, status) as the schedule page shows them.

    schedules: id, minutes, time, day, enabled, running, last_run, name, ok, total (of the last run), spider, sitemap,
    urls (the list's text) and template. A schedule without times is daily, at midnight, on Mondays if weekly.
    """
    c, dash = F.col, F.lit("—")
    time, day = F.coalesce(not_empty(c("time")), F.lit("00:00")), F.coalesce("day", F.lit(1))
    minutes = F.coalesce(F.nullif(c("minutes"), F.lit(0)), F.lit(1440))
    shown = lambda t: F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), dash)
    ran = ~F.coalesce("running", F.lit(False)) & c("total").isNotNull()
    return with_next_run(schedules, alarms).select(
        "id", property_label(c("name"), c("spider"), c("sitemap"), c("urls"), c("template")).alias("property"),
        interval_text(minutes, time, day).alias("interval"), shown(c("last_run")).alias("last_run"),
        F.when(ran, F.format_string("(%d/%d ok)", c("ok"), c("total"))).alias("last_stats"),
        shown(c("next_run")).alias("next_run"), state(c("running"), c("enabled")).alias("status"),
    )


def nested_records(flat: DataFrame) -> DataFrame:
    """The flat records of a scheduled run (url, status, ok, timestamp, title, …) in the form that saved crawls have."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    facts = F.struct("status", "ok", "timestamp", F.lit(False).alias("redirected"), F.lit("").alias("statusText"))
    og = F.struct(F.coalesce("ogTitle", F.lit("")).alias("title"), F.coalesce("ogDescription", F.lit("")).alias("description"))
    rest = [c for c in ("error", "opfs_path") if c in flat.columns]
    return flat.select(F.col("url").alias("href"), facts.alias("fetch"), *[text(c) for c in ("title", "description", "h1", "canonical")], og.alias("og"), *rest)


def upsert(schedules: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with rows of the same id replaced."""
    return schedules.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def remove(schedules: DataFrame, id_: str) -> DataFrame:
    return schedules.where(F.col("id") != id_)


def toggle(schedules: DataFrame, id_: str) -> DataFrame:
    return schedules.withColumn("enabled", F.when(F.col("id") == id_, ~F.col("enabled")).otherwise(F.col("enabled")))


def finish_run(schedules: DataFrame, id_: str, finished: Column, summary: DataFrame) -> DataFrame:
    """Writes a run's summary (one row: total, ok, errors, name) back; no results, no crawl key. Other schedules stay as they are."""
    fields = ("total", "ok", "errors", "name")
    one = F.broadcast(summary.select(F.lit(id_).alias("id"), F.struct(*fields).alias("__run")))
    mine, run = F.col("id") == id_, F.col("__run")
    key = F.when(run["total"] > 0, F.concat(F.lit("crawl-"), F.unix_millis(finished).cast("string")))
    changed = {c: run[c] for c in fields} | {"last_run": finished, "running": F.lit(False), "crawl_key": key}
    return schedules.join(one, "id", "left").withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in changed.items()}).drop("__run")


class JobQueue:
    """Jobs that fire while another runs wait, each once, and start in order when it has finished."""

    def __init__(self):
        self.running: str | None = None
        self.waiting: list[str] = []

    def fire(self, id_: str) -> bool:
        """Whether the job may start now."""
        if self.running is None:
            self.running = id_
            return True
        if id_ != self.running and id_ not in self.waiting:
            self.waiting.append(id_)
        return False

    def finish(self) -> str | None:
        """The job that starts next."""
        self.running = self.waiting.pop(0) if self.waiting else None
        return self.running
