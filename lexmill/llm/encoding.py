"""Encoding of whole texts with a public tokenizer file, a batch of texts at a time.

The vocabulary's pre-tokenizer drops white space and never joins what stands on both sides of it, so
the words of a text, and the letter runs, digits and signs within a word, are encoded independently of
each other.  Words are cut at ASCII white space; each distinct word is encoded once per worker by the
``tokenizers`` library (its pieces likewise), and found again by a 64-bit hash in a table of fixed size,
for all words of a batch at once.  Under a pre-tokenizer of another kind each text is one such word.

The hash only proposes a word: the bytes of every word are compared with those of the known one that it found, all
words of a batch in one pass, and a word that differs is encoded by itself.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from lexmill.llm.memory import claim

TOKENIZER_FILE = "word_bpe_49k.json"
#: Words and pieces kept per worker.  Those beyond it are encoded anew in each batch; the result is the same.
CACHE_WORDS, CACHE_PIECES = 1_000_000, 200_000
#: Bytes of the words kept per worker.
CACHE_BYTES = 32 << 20
#: Bytes of text that are looked up at once.
BATCH_BYTES = 1 << 20

#: Words of these letters are cut as the pre-tokenizer cuts them; others go to the library.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def vocabulary_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
    return up, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        splitter = str(self._tokenizer.pre_tokenizer)
        self._by_word = "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in splitter and "invert=True" in splitter
        self._pieces: dict[str, bytes] = {}
        self._limit, self._piece_limit = cache_words, cache_pieces
        self._slots = 1 << max(4, (2 * cache_words - 1).bit_length())
        self._keys = np.zeros(self._slots, np.uint64)
        self._entry = np.zeros(self._slots, np.int32)
        self._start, self._length, self._pool = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32)
        self._at, self._size, self._bytes = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint8)
        self._known = self._used = self._spelled = 0

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit bytes."""
        return self.encode_batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin and the last ones end; null is empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        ids, bounds, at = [], [np.zeros(1, np.int64)], 0
        while at < len(texts):  # as many texts as fit a batch, one at least
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1)
            part, ends = self._look_up(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            ids.append(part)
            bounds.append(bounds[-1][-1] + ends)
            at = to
        return np.concatenate(ids), np.concatenate(bounds)

    def _look_up(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, and where those of each text end."""
        inside = ~_SPACE[raw] if self._by_word else np.ones(len(raw), bool)
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]  # texts that touch without white space between them
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        up, down = _powers(1 << max(20, len(raw).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
        h = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h[h == 0] = 1
        entry = self._find(h)
        missing = np.flatnonzero(entry < 0)
        kept = self._known, self._used, self._spelled
        if len(missing):
            _, where, of = np.unique(h[missing], return_index=True, return_inverse=True)
            order = np.argsort(where, kind="stable")  # in the order of the text
            where, rank = missing[where[order]], np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            entry[missing] = self._known + rank[of]
            kept = self._add(raw, first[where], last[where], h[where])
        wrong = self._differ(raw[inside], last - first, entry)
        if len(wrong):  # words whose hash is that of another word
            spelled: dict[bytes, int] = {}
            entry[wrong] = self._known + np.array([spelled.setdefault(raw[a:b].tobytes(), len(spelled)) for a, b in zip(first[wrong].tolist(), last[wrong].tolist())])
            self._append(list(spelled))
        size = self._length[entry].astype(np.int64)
        ends = np.cumsum(size)
        ids = self._pool[np.repeat(self._start[entry] - (ends - size), size) + np.arange(int(ends[-1]))]
        self._known, self._used, self._spelled = kept  # words beyond the limit are forgotten
        upto = np.searchsorted(first, offsets[1:], side="left")
        return ids, np.concatenate([[0], ends])[upto]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash in the table, -1 where there is none."""
        entry = np.full(len(h), -1, np.int32)
        at = (h & np.uint64(self._slots - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self._keys[at]
            hit = key == h[left]
            entry[left[hit]] = self._entry[at[hit]]
            on = ~hit & (key != 0)
            left, at = left[on], (at[on] + 1) & (self._slots - 1)
        return entry

    def _differ(self, letters: np.ndarray, sizes: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which words, whose bytes follow each other in ``letters``, are not those of their entries."""
        ends = np.cumsum(sizes)
        same = sizes == self._size[entry]
        known = np.repeat(np.where(same, self._at[entry], 0) - (ends - sizes), sizes) + np.arange(len(letters))
        other = np.flatnonzero((self._bytes[np.minimum(known, len(self._bytes) - 1)] != letters) & np.repeat(same, sizes))
        same[np.searchsorted(ends, other, side="right")] = False
        return np.flatnonzero(~same)

    def _append(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words and append them; ends of their ids and of their bytes."""
        found = [self._word(w.decode("utf-8", "surrogatepass")) for w in words]
        ids, size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (found, words))
        ids //= 4
        n, used, spelled = self._known + len(found), self._used + int(ids.sum()), self._spelled + int(size.sum())
        while n > len(self._start):
            self._start, self._length, self._at, self._size = (np.resize(x, 2 * len(x)) for x in (self._start, self._length, self._at, self._size))
        while used > len(self._pool):
            self._pool = np.resize(self._pool, 2 * len(self._pool))
        while spelled > len(self._bytes):
            self._bytes = np.resize(self._bytes, 2 * len(self._bytes))
        self._pool[self._used : used] = np.frombuffer(b"".join(found), "<i4")
        self._bytes[self._spelled : spelled] = np.frombuffer(b"".join(words), np.uint8)
        id_ends, byte_ends = self._used + np.cumsum(ids), self._spelled + np.cumsum(size)
        self._start[self._known : n], self._length[self._known : n] = id_ends - ids, ids
        self._at[self._known : n], self._size[self._known : n] = byte_ends - size, size
        self._known, self._used, self._spelled = n, used, spelled
        return id_ends, byte_ends

    def _add(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray) -> tuple[int, int, int]:
        """Encode new words and append them; those that the table has room for are entered.  Returns how many
        words, ids and bytes may stay."""
        text = raw.tobytes()
        known, used, spelled = self._known, self._used, self._spelled
        id_ends, byte_ends = self._append([text[a:b] for a, b in zip(first.tolist(), last.tolist())])
        stay = max(0, min(len(h), self._limit - known, int(np.searchsorted(byte_ends, CACHE_BYTES, side="right"))))
        entries, h = np.arange(known, known + stay, dtype=np.int32), h[:stay]
        at = (h & np.uint64(self._slots - 1)).astype(np.int64)
        left = np.arange(stay)
        while len(left):
            free = np.flatnonzero(self._keys[at] == 0)
            slot, who = np.unique(at[free], return_index=True)
            done = free[who]
            self._keys[slot], self._entry[slot] = h[left[done]], entries[left[done]]
            on = np.ones(len(left), bool)
            on[done] = False
            left, at = left[on], at[on]
            taken = self._keys[at] != 0
            at[taken] = (at[taken] + 1) & (self._slots - 1)
        return (known + stay, int(id_ends[stay - 1]), int(byte_ends[stay - 1])) if stay else (known, used, spelled)

    def _word(self, word: str) -> bytes:
        if self._by_word and _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self._pieces.get(p) or self._piece(p) for p in _PIECE.findall(word.lower())])
        return self._library(word)

    def _piece(self, piece: str) -> bytes:
        ids = self._library(piece)
        if len(self._pieces) < self._piece_limit and len(piece) <= 40:
            self._pieces[piece] = ids
        return ids

    def _library(self, text: str) -> bytes:
        return _bytes(self._tokenizer.encode(text, add_special_tokens=False).ids)


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _forget() -> None:
    _encoder.cache_clear()
    _powers.cache_clear()


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its memory of words outlives a task."""
    claim("encoder", _forget)
    return _encoder(path)


def encode_with_end(enc: Encoder, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``encode_batch`` with ``end_id`` after each text."""
    ids, bounds = enc.encode_batch(texts)
    return np.insert(ids, bounds[1:], np.int32(end_id)), bounds + np.arange(len(bounds))


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES):
    """The batch in runs of rows of about ``most`` bytes of text, one row at least."""
    sizes = batch.column(column).nbytes // max(1, batch.num_rows)
    step = max(1, most // max(1, sizes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
