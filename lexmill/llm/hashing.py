"""Words and their hashes, vectorised."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from lexmill.llm.memory import claim, trim

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def split_words(text: str | None, lower: bool) -> list[bytes]:
    """Words of a text in UTF-8, split at ASCII white space; ``lower`` lower-cases A-Z alone."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; to hash one anew takes less than to look it up among some 100,000."""
    claim("word hashes", lambda: None)  # other memories of words go
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` hashes, put together from runs of powers of two."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out, have, power, width = np.zeros(n, np.uint64), 0, h, 1
    while width <= k:
        if k & width:
            out = mix(out * _M2 + power[have : have + n])
            have += width
        if 2 * width <= k:
            power = mix(power[:-width] * _M1 + power[width:])
        width *= 2
    return out


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(keys)]]).tolist()))


def by_run(batches, key: str, handle: Callable):
    """``handle(table)`` for the rows of each run of equal keys in sorted batches; yields what it returns
    unless that is None.  Only the rows of one run are held."""
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        for a, b in runs(keys):
            if held and keys[a] != last:
                out = handle(pa.Table.from_batches(held))
                held = []
                if out is not None:
                    yield out
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        out = handle(pa.Table.from_batches(held))
        held = []
        if out is not None:
            yield out
    trim()
