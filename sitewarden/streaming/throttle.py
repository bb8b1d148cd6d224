"""The adaptive rate limiter: over a crawl's responses, on a stream, and as a table that a crawl carries from wave to wave.

A 429 or 503 counts if two seconds passed since the last one that counted; it
halves the rate (an unlimited one becomes one a second), not below the floor,
and a Retry-After holds it lower still. The table has ``host, rate, last, free``:
requests a second (0: unlimited), when an answer last counted, and when the next
request may go out. ``schedule`` gives each request its time from it, ``carried``
folds the answers of a wave into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, FLOOR, DEBOUNCE, LONGEST = 1.0, 0.1, 2.0, 300.0
STATUSES = [429, 503]


def step(state: tuple[float, float, int], at: float, retry: float) -> tuple[float, float, int]:
    """The state ``(last that counted, rate, accepted)`` after a bad answer; a rate of 0 is unlimited."""
    last, rate, accepted = state
    if at - last < DEBOUNCE:
        return state
    rate = START if rate == 0 else max(rate / 2, FLOOR)
    if retry > 0:
        rate = min(rate, 1 / min(retry, LONGEST))
    return at, rate, accepted + 1


FRESH = (-1e18, 0.0, 0)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bad answers in order of host and time; a host may go on over many frames, of which one is held at a time."""
    host, state = None, FRESH
    for frame in frames:
        done = []
        for name, at, retry in zip(frame["host"], frame["at"], frame["retry_after"], strict=True):
            if name != host:
                if state is not FRESH:
                    done.append((host, state[1], state[2]))
                host, state = name, FRESH
            state = step(state, at, retry)
        yield pd.DataFrame(done, columns=["host", "rate", "accepted"])
    if state is not FRESH:
        yield pd.DataFrame([(host, state[1], state[2])], columns=["host", "rate", "accepted"])


def per_host(responses: DataFrame) -> DataFrame:
    """``host, rate, accepted`` from ``responses(host, at, seq, status_code, retry_after)``, hosts that never answered so left out."""
    bad = responses.where(F.col("status_code").isin(STATUSES) & F.col("host").isNotNull())
    rows = bad.select("host", F.col("at").cast("double").alias("at"), "seq", F.coalesce(F.col("retry_after").cast("double"), F.lit(0.0)).alias("retry_after"))
    ordered = rows.repartition(F.col("host")).sortWithinPartitions("host", "at", "seq").select("host", "at", "retry_after")
    return ordered.mapInPandas(_fold, "host string, rate double, accepted long")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else FRESH
    rows = pd.concat(list(frames)).sort_values(["at", "seq"])
    for at, retry in zip(rows["at"], rows["retry_after"].fillna(0.0), strict=True):
        now = step(now, at, retry)
    state.update(now)
    yield pd.DataFrame({"host": [key[0]], "rate": [now[1]], "accepted": [now[2]]})


def stream(responses: DataFrame) -> DataFrame:
    """The same on a stream of responses: the state of a host after each batch that touched it."""
    bad = responses.where(F.col("status_code").isin(STATUSES)).select("host", F.col("at").cast("double").alias("at"), "seq", F.col("retry_after").cast("double").alias("retry_after"))
    return bad.groupBy("host").applyInPandasWithState(_advance, "host string, rate double, accepted long", "last double, rate double, accepted long", "update", "NoTimeout")


STATE = "host string, rate double, last double, free double"


def schedule(requests: DataFrame, state: DataFrame, now: float, rate: float = 0.0) -> DataFrame:
    """``requests(host, rank, ...)`` with ``rate``, ``last``, ``free`` and ``send_at``.

    A limited host's requests go out in order of rank, one interval apart, from
    when it is free; an unlimited one's at once. Hosts without a state have the
    rate given. Only limited hosts are numbered: a host is sent as many rows
    as its rate allows while a wave lasts.
    """
    known = state.select(F.col("host").alias("h"), F.col("rate").alias("r"), "last", "free")
    paced = requests.join(known, F.col("host") == F.col("h"), "left").drop("h")
    paced = paced.withColumn("rate", F.coalesce("r", F.lit(float(rate)))).drop("r")
    start = F.greatest(F.lit(float(now)), F.coalesce("free", F.lit(0.0)))
    before = F.row_number().over(Window.partitionBy("host").orderBy("rank")) - 1
    limited = paced.where("rate > 0").withColumn("send_at", start + before / F.col("rate"))
    return limited.unionByName(paced.where("rate = 0").withColumn("send_at", start))


def _carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a host in order: its state (``status`` null), then answers that slow it down; ``upto`` is when its last request went out."""
    host, state, free, upto = None, FRESH, 0.0, None

    def row():
        gone = upto + 1 / state[1] if state[1] > 0 and upto is not None else 0.0
        return (host, state[1], state[0], max(free, gone))

    for frame in frames:
        done = []
        for name, status, rate, last, at, retry, ready, sent in frame.itertuples(index=False):
            if name != host:
                if host is not None:
                    done.append(row())
                host, state, free, upto = name, FRESH, 0.0, None
            if not pd.isna(sent):
                upto = sent
            if pd.isna(status):
                state, free = (FRESH[0] if pd.isna(last) else last, rate, 0), 0.0 if pd.isna(ready) else ready
                continue
            moved = step(state, at, retry)
            if moved is not state:
                free = max(free, at + max(min(retry, LONGEST), 1 / moved[1]))
            state = moved
        yield pd.DataFrame(done, columns=["host", "rate", "last", "free"])
    if host is not None:
        yield pd.DataFrame([row()], columns=["host", "rate", "last", "free"])


def carried(state: DataFrame, answers: DataFrame, rate: float = 0.0) -> DataFrame:
    """The state after ``answers(host, at, seq, sent_at, status_code, retry_after)``; hosts that weren't known start at the rate given.

    Of answers that slow nothing down only the last sending time of each host
    is kept, by partial aggregation; the others go in order through one task a
    host, a frame at a time.
    """
    sent = answers.groupBy("host").agg(F.max("sent_at").alias("sent"))
    known = state.select("host", F.col("rate").alias("r"), "last", F.col("free").alias("ready"))
    number = lambda name: F.lit(None).cast("double").alias(name)
    first = known.join(sent, "host", "full").select("host", F.lit(None).cast("int").alias("status"), F.coalesce("r", F.lit(float(rate))).alias("r"), "last", number("at"), number("retry"), "ready", "sent", F.lit(None).cast("long").alias("seq"))
    bad = answers.where(F.col("status_code").isin(STATUSES)).select(
        "host", F.col("status_code").alias("status"), number("r"), number("last"), F.col("at").cast("double").alias("at"), F.coalesce(F.col("retry_after").cast("double"), F.lit(0.0)).alias("retry"), number("ready"), number("sent"), F.col("seq").cast("long").alias("seq")
    )
    columns = ["host", "status", "r", "last", "at", "retry", "ready", "sent"]
    ordered = first.unionByName(bad).repartition(F.col("host")).sortWithinPartitions(F.col("host"), F.col("status").isNotNull(), "at", "seq").select(*columns)
    return ordered.mapInPandas(_carry, STATE)
