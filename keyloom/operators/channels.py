"""Subscriptions: table ``kv_sub (client, channel)``; messages have a ``channel``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches


def subscribe(subs: DataFrame, rows: DataFrame) -> DataFrame:
    """The subscriptions with more rows (client, channel); one that is there stays alone."""
    return subs.select("client", "channel").union(rows.select("client", "channel")).distinct()


def unsubscribe(subs: DataFrame, rows: DataFrame) -> DataFrame:
    """The subscriptions without some rows; a null channel leaves all of its client."""
    rest = subs.join(rows.where("channel is null").select("client").distinct(), "client", "left_anti")
    return rest.join(rows.select("client", "channel").distinct(), ["client", "channel"], "left_anti").select("client", "channel")


def channels(subs: DataFrame, pattern: str = "*") -> DataFrame:
    """Channels with a subscriber whose name matches a glob."""
    return subs.where(matches(F.col("channel"), pattern)).select("channel").distinct()


def numsub(subs: DataFrame, asked: DataFrame) -> DataFrame:
    """Number of subscribers of each channel asked for, 0 without any."""
    n = subs.groupBy("channel").agg(F.count_distinct("client").alias("n"))
    return asked.select("channel").distinct().join(n, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def delivered(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """Each message once for each subscriber of its channel; messages without one are lost."""
    return messages.join(subs.select("client", "channel").distinct(), "channel")


def delivered_counts(messages: DataFrame, subs: DataFrame, by: str = "client") -> DataFrame:
    """Number of deliveries (``n``) of each client, or by ``channel``: as counting ``delivered``, which has a row for each of them.

    Messages are counted by channel before they meet the subscribers, so the
    join has a row for each subscription.
    """
    sent = messages.groupBy("channel").agg(F.count("*").alias("_n"))
    return subs.select("client", "channel").distinct().join(sent, "channel").groupBy(by).agg(F.sum("_n").alias("n"))
