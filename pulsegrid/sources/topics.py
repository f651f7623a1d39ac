"""Topic subscription: MQTT-style filters over a multi-topic source.

A filter like ``iomt/wearables/+`` matches one level in place of ``+`` (and
any remaining levels in place of a trailing ``#``). Several filters fan in to
one DataFrame (the union of their matches) without a union node.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import TOPIC_FILTERS


def filter_regex(topic_filter: str) -> str:
    parts = []
    for level in topic_filter.split("/"):
        if level == "+":
            parts.append("[^/]+")
        elif level == "#":
            parts.append(".*")
        else:
            parts.append(re.escape(level))
    return "^" + "/".join(parts) + "$"


def topic_matches(topic: Column, filters=TOPIC_FILTERS) -> Column:
    rx = "|".join(f"({filter_regex(f)})" for f in filters)
    return F.coalesce(topic.rlike(rx), F.lit(False))


def topic_segment(topic: Column, n: int) -> Column:
    """1-based topic level, '' when absent."""
    return F.split_part(topic, F.lit("/"), F.lit(n))


def landed_topic(topic: Column, path: Column, filters=TOPIC_FILTERS) -> Column:
    """The body's topic; without one, the topic the landing folders stand for:
    ``.../<channel>/<device>/...`` with a channel of the filters."""
    prefix = filters[0].split("/")[0]
    channels = "|".join(sorted({re.escape(f.split("/")[1]) for f in filters}))
    device = f"/({channels})/([^/]+)/"
    found = F.regexp_extract(path, device, 1)
    return F.coalesce(topic, F.when(found != "", F.concat_ws(
        "/", F.lit(prefix), found, F.regexp_extract(path, device, 2))))


def subscribe(messages: DataFrame, filters=TOPIC_FILTERS, topic_col: str = "topic") -> DataFrame:
    """Messages on any of the filters, with channel (level 2) and topic_device (level 3)."""
    t = F.col(topic_col)
    return (messages.where(topic_matches(t, filters))
            .withColumns({"channel": topic_segment(t, 2),
                          "topic_device": topic_segment(t, 3)}))


def fan_in(*frames: DataFrame) -> DataFrame:
    """Several sources into one processor."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
