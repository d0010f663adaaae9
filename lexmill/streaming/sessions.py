"""Streams: the lane filter of each session, and compaction of an event log into a snapshot."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.sources.text_tables import parse_events

POSTERIOR = "session string, p_primary double, steps long"
COMMITS = "session string, at long, pos int, word string, previous string"
_TOKEN = regex.compile(r"[\p{L}']+|[.!?]")


def lane_states(steps: DataFrame) -> DataFrame:
    """The lane posterior of each session (session, at, evidence; null evidence is a sentence boundary).

    The state is one number and a count for each session; rows of one micro-batch are taken in the order of
    ``at``, and batches as they come."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, n = state.get if state.exists else (0.5, 0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for e in rows["evidence"]:
            if pd.isna(e):
                p = 0.5 + (p - 0.5) * 0.8
            else:
                mixed = 0.92 * p + 0.08 * (1 - p)
                odds = mixed / (1 - mixed) * math.exp(e)
                p = min(max(odds / (1 + odds), 0.1), 0.9)
            n += 1
        state.update((p, n))
        yield pd.DataFrame({"session": [key[0]], "p_primary": [p], "steps": [n]})

    return steps.groupBy("session").applyInPandasWithState(update, POSTERIOR, "p double, n long", "update", GroupStateTimeout.NoTimeout)


def commits(texts: DataFrame) -> DataFrame:
    """The words that each session (session, at, text) commits, with the word before them in the sentence.

    A word is committed once something follows it: within its text, or with the session's next text.  The state is
    the one word that may still go on.  Texts of one micro-batch are taken in the order of ``at``, and batches as
    they come; a sentence ends at . ! ? and with its text."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get if state.exists and state.get[2] is not None else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for at, text in zip(rows["at"].tolist(), rows["text"].tolist()):
            if pending is not None:
                out.append(pending)
            pending, previous, text = None, None, (text or "").lower().replace("’", "'")
            for pos, m in enumerate(_TOKEN.finditer(text)):
                if m[0] in ".!?":
                    previous = None
                    continue
                row = (at, pos, m[0], previous)
                if m.end() == len(text):
                    pending = row
                else:
                    out.append(row)
                previous = m[0]
        state.update(pending if pending is not None else (None, None, None, None))
        if out:
            yield pd.DataFrame({"session": [key[0]] * len(out)} | {name: [r[k] for r in out] for k, name in enumerate(("at", "pos", "word", "previous"))})

    return texts.groupBy("session").applyInPandasWithState(update, COMMITS, "at long, pos int, word string, previous string", "append", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of log files that are appended to a folder, file by file."""
    return parse_events(spark.readStream.text(path)).filter("ok")


def compact(events: DataFrame, snapshot_path: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]):
    """Fold each micro-batch and merge it into the snapshot.

    Snapshots are written beside each other, named by the batch they include, so a batch that runs again after a
    loss starts from the snapshot before it and overwrites its own: nothing is counted twice."""
    spark = events.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        folded = fold(batch)
        if number > 0:
            folded = merge(spark.read.parquet(f"{snapshot_path}/batch={number - 1}"), folded)
        folded.write.mode("overwrite").parquet(f"{snapshot_path}/batch={number}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def add_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge of snapshots of (word, count)."""
    return old.unionByName(new).groupBy("word").agg(F.sum("count").alias("count"))
