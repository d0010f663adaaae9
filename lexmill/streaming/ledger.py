"""What typing sessions teach: a state machine over a keyboard's own edits, what it sees of a text field, and taps.

A text field may change without the keyboard's doing.  So the keyboard notes each edit that it makes (the text before
the cursor, before and after), and everything that it sees is held against these notes: ``matched`` (an edit is seen,
with those before it), ``stale`` (none is seen yet), ``none`` (nothing was noted) or ``foreign`` (another change).  A
chain of notes that does not fit together, outgrows ``CAPACITY`` or stays unseen ``PATIENCE`` times is given up.

From it follow five kinds of events: ``wc`` a word was committed (with the word before it), ``sa`` a suggestion was
taken for what was typed, ``cr`` a correction was reverted, ``wt`` a word was chosen as it stands, ``ts`` a tap that
belongs to a letter of a committed word.  Foreign changes and sentence ends break the tie to the word before.

Actions (session, seq, kind and what the kind has): ``edit`` (before, after), ``see`` (window, correction, offers),
``tap`` (key, dx, dy), ``choose`` (word), ``revert``.  State is a row and two short lists for each session, whatever
its length; the sessions of a bucket (by a hash, ``BUCKETS`` of them, for good in a stream's checkpoint) are kept together and
written anew when one of them has actions.  Actions of a micro-batch are taken in the order of seq; one whose seq is not above the last one was seen
already (a file that came twice) and is left out; a null seq or session is left out.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPACITY, PATIENCE = 32, 3
BUCKETS = 4096
ACTIONS = "session string, seq long, kind string, window string, before string, after string, word string, correction string, offers array<string>, key string, dx double, dy double"
VERDICTS = "session string, seq long, verdict string"
EVENTS = "session string, seq long, pos int, kind string, a string, b string, dx double, dy double"
_WORD = regex.compile(r"[\p{L}\p{M}'’]+")
_ENDS = (".", "!", "?")


class Ledger:
    """Notes [before, after, times unseen] of edits that were not seen yet."""

    def __init__(self, notes: list[list] | None = None, broken: bool = False):
        self.notes, self.broken = notes or [], broken

    def clear(self, broken: bool = False) -> None:
        self.notes, self.broken = [], broken

    def note(self, before: str, after: str, seen: str | None) -> None:
        if before == after or self.broken:
            return
        start = self.notes[-1][1] if self.notes else seen
        if start is not None and before != start:
            if self.notes or after != seen:  # an edit that was seen before it was noted needs no note
                self.clear(broken=True)
        elif len(self.notes) >= CAPACITY:
            self.clear(broken=True)
        else:
            self.notes.append([before, after, 0])

    def judge(self, window: str, seen: str | None) -> str:
        if self.broken:
            self.clear()
            return "foreign"
        while self.notes and seen is not None and self.notes[0][1] == seen:
            self.notes.pop(0)
        if not self.notes:
            return "none"
        fits = seen is None or self.notes[0][0] == seen
        upto = max((k for k, n in enumerate(self.notes, 1) if n[1] == window), default=0)
        if not fits or not upto and self.notes[0][0] != window:
            self.clear()
            return "foreign"
        self.notes = [[b, a, n + 1] for b, a, n in self.notes[upto:]]
        if self.notes and self.notes[0][2] >= PATIENCE:
            self.clear()
        return "matched" if upto else "stale"


def _word_at_end(window: str) -> str:
    """The word that the cursor stands behind, if any."""
    found = list(_WORD.finditer(window))
    return found[-1][0] if found and found[-1].end() == len(window) else ""


class Session:
    """One session: ``step`` takes an action and gives its verdict and its events (kind, a, b, dx, dy)."""

    #: What is kept besides ledger and taps.
    FIELDS = ("last_seq", "seen", "typing", "correction", "offers", "previous", "original", "applied", "chosen", "broken")

    def __init__(self, values: tuple | None = None, notes: list[list] | None = None, taps: list[tuple] | None = None):
        self.last_seq, self.seen, self.typing, self.correction, self.offers, self.previous, self.original, self.applied, self.chosen, broken = values or (-1, None, "", None, "", None, None, None, None, False)
        self.ledger, self.taps = Ledger(notes, broken), taps or []

    def values(self) -> tuple:
        return tuple(self.ledger.broken if f == "broken" else getattr(self, f) for f in self.FIELDS)

    def step(self, row) -> tuple[str | None, list[tuple]]:
        self.last_seq = int(row.seq)
        if row.kind == "edit":
            self.ledger.note(row.before or "", row.after or "", self.seen)
        elif row.kind == "tap" and row.key:
            self.taps.append((row.key.lower(), float(row.dx), float(row.dy)))
            del self.taps[:-64]  # more letters than a word has; the oldest belong to words that are gone
        elif row.kind == "choose" and row.word and row.word != self.chosen:
            self.chosen = row.word
            return None, [("wt", row.word, None, None, None)]
        elif row.kind == "revert" and self.original is not None:
            event = ("cr", self.original, self.applied, None, None)
            self.previous, self.original, self.applied = self.original, None, None
            return None, [event]
        elif row.kind == "see":
            return self._see(row.window or "", row.correction, row.offers)
        return None, []

    def _see(self, window: str, correction: str | None, offers) -> tuple[str, list[tuple]]:
        verdict = self.ledger.judge(window, self.seen)
        grows = self.seen is not None and (window.startswith(self.seen) or self.seen.startswith(window))
        typing, events = _word_at_end(window), []
        if verdict == "foreign" or verdict == "none" and not grows:
            self.ledger.clear()
            self.taps.clear()
            self.previous = self.original = self.applied = None
        else:
            if window != self.seen:  # a correction can be reverted at once or not at all
                self.original = self.applied = None
            if self.typing and not typing and verdict != "stale" and len(window) >= len(self.typing):
                events = self._commit(window)
        if verdict != "stale":
            self.typing = typing
        self.seen, self.correction, self.offers = window, correction, "\n".join([] if offers is None else list(offers))
        return verdict, events

    def _commit(self, window: str) -> list[tuple]:
        found = _WORD.findall(window)
        if not found:
            return []
        word, typed, events = found[-1], self.typing, []
        if word != typed and word in [self.correction, *self.offers.split("\n")]:
            events.append(("sa", typed, word, None, None))
            if word == self.correction:
                self.original, self.applied = typed, word
        else:
            if word == self.chosen:
                self.chosen = None
            else:
                events.append(("wc", word, self.previous, None, None))
            letters = list(word.lower())
            if word == typed and len(self.taps) >= len(letters):
                events += [("ts", key, None, dx, dy) for (key, dx, dy), c in zip(self.taps[-len(letters) :], letters) if key == c]
        self.taps.clear()
        self.previous = None if window.rstrip().endswith(_ENDS) else word
        return events


_FIELDS = ("session", "seq", "kind", "window", "before", "after", "word", "correction", "offers", "key", "dx", "dy")
_Action = namedtuple("_Action", _FIELDS)


def _by_session(batches: Iterator[pd.DataFrame]) -> dict[str, list[_Action]]:
    """The actions of each session in order of seq, with None for what is missing."""
    out: dict[str, list[_Action]] = {}
    for batch in batches:
        columns = [batch[c].tolist() for c in _FIELDS]
        columns[-2:] = [[None if x != x else x for x in c] for c in columns[-2:]]
        for row in map(_Action._make, zip(*columns)):
            out.setdefault(row.session, []).append(row)
    for rows in out.values():
        rows.sort(key=lambda r: r.seq)
    return out


def _run(actions: DataFrame, rows_of: Callable[[str, _Action, str | None, list[tuple]], list[tuple]], schema: str, buckets: int) -> DataFrame:
    """A stateful group is a bucket of sessions, since a group costs some milliseconds however little is in it."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, out = json.loads(state.get[0]) if state.exists else {}, []
        for name, rows in _by_session(batches).items():
            values, notes, taps = kept.get(name, (None, None, None))
            session = Session(values, notes, taps)
            for row in rows:
                if row.seq > session.last_seq:
                    out += rows_of(name, row, *session.step(row))
            kept[name] = session.values(), session.ledger.notes, session.taps
        state.update((json.dumps(kept),))
        if out:
            yield pd.DataFrame(out, columns=columns)

    rows = actions.filter("session IS NOT NULL AND seq IS NOT NULL").select(F.pmod(F.xxhash64("session"), F.lit(buckets)).alias("bucket"), *_FIELDS)
    return rows.groupBy("bucket").applyInPandasWithState(update, schema, "sessions string", "append", GroupStateTimeout.NoTimeout)


def verdicts(actions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """session, seq and verdict of every ``see`` among ``actions``, a stream."""
    return _run(actions, lambda key, row, verdict, events: [] if verdict is None else [(key, row.seq, verdict)], VERDICTS, buckets)


def learning_events(actions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The events of ``actions``, a stream: session, seq, pos, kind, a, b, dx, dy."""
    return _run(actions, lambda key, row, verdict, events: [(key, row.seq, k, *e) for k, e in enumerate(events)], EVENTS, buckets)


#: Where state of this kind is kept.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
