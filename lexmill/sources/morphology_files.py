"""Compact binary files of word forms: lemmas with features (``LEMA``) and paradigms (``PAR1``).

Both keep all strings in one pool and fixed-size records in sections behind each other, so any range of records can be
read alone.  A scan takes a file or a folder of files, plans a task for each range of records, reads the bytes of
its sections and, of the pool, what its records point to; it gives the long table.  Writers deal the long table out by
ranges of its sort key and write files of bounded size for each range, complete in themselves: the order within a file is that
of UTF-8 bytes, as look-ups by halving need it.

Strings are at most 255 bytes long, which the format gives; longer ones, and null keys, are refused by an error.
Damaged files (wrong magic, version, or length) are refused as well.  A file that is read as a whole beforehand is
none: only its header is looked at for planning.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Magics, codes of features and record layouts of the two formats.
LEMA, PAR1 = 0x4C454D41, 0x50415231
POS = ("no", "so", "lo", "ao", "fs", "fn", "st", "to", "gr", "uh")
CASES = (None, "nf", "þf", "þgf", "ef")
GENDERS = (None, "kk", "kvk", "hk")
NUMBERS = ("et", "ft")
_GROUP = np.dtype({"names": ["at", "size", "pos", "gender", "first", "count"], "formats": ["<u4", "u1", "u1", "u1", "<u4", "<u4"], "offsets": [0, 4, 5, 6, 8, 12], "itemsize": 16})
_ENTRY = np.dtype({"names": ["group", "at", "size", "bundle"], "formats": ["<u4", "<u4", "u1", "<u2"], "offsets": [0, 4, 8, 9], "itemsize": 12})
_FORM = np.dtype({"names": ["at", "size", "first", "count"], "formats": ["<u4", "u1", "<u4", "<u4"], "offsets": [0, 4, 8, 12], "itemsize": 16})
_HEADER = 32

FORMS = "form string, lemma string, pos string, case string, gender string, number string"
PAIRS = "w1 string, w2 string, frequency bigint"
PARADIGMS = "lemma string, pos int, gender int, form string, bundle int"


class FormatError(ValueError):
    """A file that is not what it should be."""


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _files(path: str) -> list[str]:
    store, root = _opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class Layout:
    """Where the sections of a file begin: ``at[name]``; (name, bytes, aligned) behind the header in order."""

    def __init__(self, sections: list[tuple[str, int, bool]]):
        self.at, place = {}, _HEADER
        for name, size, aligned in sections:
            place = (place + 3) // 4 * 4 if aligned else place
            self.at[name] = place
            place += size
        self.end = place


def _header(f, magic: int, versions: tuple[int, ...]) -> list[int]:
    raw = f.read_at(min(_HEADER, f.size()), 0)
    if len(raw) < _HEADER:
        raise FormatError(f"{len(raw)} bytes are no header")
    head = np.frombuffer(raw, "<u4").tolist()
    if head[0] != magic or head[1] not in versions:
        raise FormatError(f"magic {head[0]:#x} in version {head[1]} is not known")
    return head


def lema_layout(f) -> tuple[Layout, dict[str, int]]:
    _, version, pool, lemmas, words, entries, pairs, _ = _header(f, LEMA, (1, 2))
    layout = Layout(
        [("pool", pool, False), ("lemma at", 4 * lemmas, False), ("lemma size", lemmas, False), ("word at", 4 * words, True), ("word size", words, False), ("first", 4 * (words + 1), True), ("entries", 4 * entries, False)]
        + [("w1 at", 4 * pairs, False), ("w1 size", pairs, False), ("w2 at", 4 * pairs, True), ("w2 size", pairs, False), ("frequency", 4 * pairs, True)]
    )
    if f.size() < layout.end:
        raise FormatError(f"{layout.end} bytes are needed, {f.size()} are there")
    return layout, {"version": version, "pool": pool, "lemmas": lemmas, "words": words, "entries": entries, "pairs": pairs}


def par1_layout(f) -> tuple[Layout, dict[str, int]]:
    _, _, pool, groups, entries, forms, least, _ = _header(f, PAR1, (1,))
    layout = Layout([("pool", pool, False), ("groups", 16 * groups, False), ("entries", 12 * entries, False), ("forms", 16 * forms, False), ("order", 4 * entries, False)])
    if f.size() < layout.end:
        raise FormatError(f"{layout.end} bytes are needed, {f.size()} are there")
    return layout, {"pool": pool, "groups": groups, "entries": entries, "forms": forms, "least": least}


def _array(f, at: int, start: int, stop: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(f.read_at((stop - start) * kind.itemsize, at + start * kind.itemsize), kind)


def _strings(f, pool: int, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The pool's strings at the places, from one read of the span that they lie in."""
    if not len(at):
        return pa.array([], pa.string())
    low, high = int(at.min()), int((at.astype(np.int64) + size).max())
    raw = np.frombuffer(f.read_at(high - low, pool + low), np.uint8)
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    place = np.repeat(at.astype(np.int64) - low - (ends - size), size) + np.arange(int(ends[-1]))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[place].tobytes())])


def _named(names: tuple, codes: np.ndarray) -> pa.Array:
    known = np.minimum(codes, len(names))
    return pa.array([*names, None], pa.string()).take(pa.array(known))


def _by_lemma(f, layout: Layout, lemma: np.ndarray) -> pa.Array:
    """Spellings of lemmas by number; those asked for lie between the least and the greatest of them."""
    if not len(lemma):
        return pa.array([], pa.string())
    low, high = int(lemma.min()), int(lemma.max()) + 1
    at, size = _array(f, layout.at["lemma at"], low, high, "<u4"), _array(f, layout.at["lemma size"], low, high, "u1")
    numbers, of = np.unique(lemma, return_inverse=True)
    return _strings(f, layout.at["pool"], at[numbers - low], size[numbers - low]).take(pa.array(of))


def lema_forms(f, start: int, stop: int) -> pa.RecordBatch:
    """Forms of the words with numbers from ``start`` to ``stop``, a row for each of their entries."""
    layout, counts = lema_layout(f)
    at, size = _array(f, layout.at["word at"], start, stop, "<u4"), _array(f, layout.at["word size"], start, stop, "u1")
    first = _array(f, layout.at["first"], start, stop + 1, "<u4").astype(np.int64)
    entry = _array(f, layout.at["entries"], int(first[0]), int(first[-1]), "<u4")
    form = _strings(f, layout.at["pool"], at, size).take(pa.array(np.repeat(np.arange(stop - start), np.diff(first))))
    if counts["version"] == 1:
        features = [pa.nulls(len(entry), pa.string())] * 3
    else:
        features = [_named(CASES, entry >> 4 & 7), _named(GENDERS, entry >> 7 & 3), _named(NUMBERS, entry >> 9 & 1)]
    lemma = _by_lemma(f, layout, (entry >> (4 if counts["version"] == 1 else 10)).astype(np.int64))
    return pa.RecordBatch.from_arrays([form, lemma, _named(POS, entry & 15), *features], names=["form", "lemma", "pos", "case", "gender", "number"])


def lema_pairs(f, start: int, stop: int) -> pa.RecordBatch:
    layout, _ = lema_layout(f)
    words = [_strings(f, layout.at["pool"], _array(f, layout.at[f"{w} at"], start, stop, "<u4"), _array(f, layout.at[f"{w} size"], start, stop, "u1")) for w in ("w1", "w2")]
    return pa.RecordBatch.from_arrays([*words, pa.array(_array(f, layout.at["frequency"], start, stop, "<u4").astype(np.int64))], names=["w1", "w2", "frequency"])


def par1_entries(f, start: int, stop: int) -> pa.RecordBatch:
    """Paradigm entries with numbers from ``start`` to ``stop``."""
    layout, _ = par1_layout(f)
    entry = _array(f, layout.at["entries"], start, stop, _ENTRY)
    numbers, of = np.unique(entry["group"].astype(np.int64), return_inverse=True)
    low, high = (int(numbers[0]), int(numbers[-1]) + 1) if len(numbers) else (0, 0)
    group = _array(f, layout.at["groups"], low, high, _GROUP)[numbers - low]
    lemma = _strings(f, layout.at["pool"], group["at"], group["size"]).take(pa.array(of))
    form = _strings(f, layout.at["pool"], entry["at"], entry["size"])
    numbers_of = [pa.array(group[c][of].astype(np.int32)) for c in ("pos", "gender")]
    return pa.RecordBatch.from_arrays([lemma, *numbers_of, form, pa.array(entry["bundle"].astype(np.int32))], names=["lemma", "pos", "gender", "form", "bundle"])


class Records(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        super().__init__(None)
        self.file, self.start, self.stop = file, start, stop


class _Scan(DataSourceReader):
    def __init__(self, options: dict, layout, total: str, read):
        self.path, self.most = options["path"], int(options.get("rangerecords", 100_000))
        self.layout, self.total, self.records = layout, total, read

    def partitions(self) -> list[InputPartition]:
        store, _ = _opened(self.path)
        out = []
        for file in _files(self.path):
            with store.open_input_file(file) as f:
                n = self.layout(f)[1][self.total]
            out += [Records(file, a, min(a + self.most, n)) for a in range(0, n, self.most)]
        return out or [Records("", 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if part.stop > part.start:
            store, _ = _opened(self.path)
            with store.open_input_file(part.file) as f:
                yield self.records(f, part.start, part.stop)


class MorphologyFiles(DataSource):
    """``spark.read.format("morphology_files").load(path)``: the forms; with option section = "pairs" the word pairs."""

    @classmethod
    def name(cls) -> str:
        return "morphology_files"

    def _pairs(self) -> bool:
        return self.options.get("section", "forms") == "pairs"

    def schema(self) -> str:
        return PAIRS if self._pairs() else FORMS

    def reader(self, schema) -> DataSourceReader:
        return _Scan(self.options, lema_layout, "pairs", lema_pairs) if self._pairs() else _Scan(self.options, lema_layout, "words", lema_forms)


class ParadigmFiles(DataSource):
    """``spark.read.format("paradigm_files").load(path)``: a row for each entry of each group."""

    @classmethod
    def name(cls) -> str:
        return "paradigm_files"

    def schema(self) -> str:
        return PARADIGMS

    def reader(self, schema) -> DataSourceReader:
        return _Scan(self.options, par1_layout, "entries", par1_entries)


class _Pool:
    """Strings of a file, each once."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.size = 0

    def add(self, text: str) -> tuple[int, int]:
        raw = text.encode()
        if len(raw) > 255:
            raise FormatError(f"a string of {len(raw)} bytes is too long")
        place = self.at.get(raw)
        if place is None:
            place = self.at[raw] = self.size
            self.size += len(raw)
        return place, len(raw)

    def raw(self) -> bytes:
        return b"".join(self.at)


def _assembled(head: list[int], sections: list[tuple[bytes, bool]]) -> bytes:
    out = bytearray(np.array(head, "<u4").tobytes())
    for raw, aligned in sections:
        if aligned:
            out += b"\0" * (-len(out) % 4)
        out += raw
    return bytes(out)


def lema_file(rows: list[tuple], pairs: list[tuple] = (), version: int = 2) -> bytes:
    """The file of rows (form, lemma, pos, case, gender, number), sorted by form, and of pairs (w1, w2, frequency)."""
    pool, lemmas, words, entries = _Pool(), {}, [], []
    first: list[int] = []
    for form, lemma, pos, case, gender, number in rows:
        if not words or words[-1][0] != form:
            words.append((form, *pool.add(form)))
            first.append(len(entries))
        code = lemmas.setdefault(lemma, len(lemmas))
        kind = POS.index(pos) if pos in POS else 15
        features = 0 if version == 1 else CASES.index(case) << 4 | GENDERS.index(gender) << 7 | (number == "ft") << 9
        entries.append(code << (4 if version == 1 else 10) | features | kind)
    spelled = [pool.add(x) for x in lemmas]
    both = [[pool.add(p[k]) for p in pairs] for k in (0, 1)]
    u4 = lambda x: np.array(list(x), "<u4").tobytes()
    u1 = lambda x: bytes(list(x))
    return _assembled(
        [LEMA, version, pool.size, len(lemmas), len(words), len(entries), len(pairs), 0],
        [(pool.raw(), False), (u4(a for a, _ in spelled), False), (u1(n for _, n in spelled), False), (u4(w[1] for w in words), True), (u1(w[2] for w in words), False), (u4([*first, len(entries)]), True), (u4(entries), False)]
        + [(u4(a for a, _ in both[0]), False), (u1(n for _, n in both[0]), False), (u4(a for a, _ in both[1]), True), (u1(n for _, n in both[1]), False), (u4(p[2] for p in pairs), True)],
    )


def par1_file(rows: list[tuple], least: int = 0) -> bytes:
    """The file of rows (lemma, pos, gender, form, bundle), sorted by lemma, pos and gender."""
    pool, groups, entries = _Pool(), [], []
    for lemma, pos, gender, form, bundle in rows:
        if not groups or groups[-1][0] != (lemma, pos, gender):
            groups.append([(lemma, pos, gender), *pool.add(lemma), len(entries), 0])
        groups[-1][4] += 1
        entries.append((len(groups) - 1, *pool.add(form), bundle))
    order = sorted(range(len(entries)), key=lambda k: rows[k][3].encode())
    forms: list[list[int]] = []
    for n, k in enumerate(order):
        if not n or rows[k][3] != rows[order[n - 1]][3]:
            forms.append([*entries[k][1:3], n, 0])
        forms[-1][3] += 1
    table = lambda kind, x: np.array([tuple(r) for r in x], kind).tobytes()
    return _assembled(
        [PAR1, 1, pool.size, len(groups), len(entries), len(forms), least, 0],
        [(pool.raw(), False), (table(_GROUP, ((at, size, pos, gender, first, count) for (_, pos, gender), at, size, first, count in groups)), False), (table(_ENTRY, entries), False), (table(_FORM, forms), False), (np.array(order, "<u4").tobytes(), False)],
    )


#: Rows of a file at which it ends with its key: what a task holds does not grow with what it is dealt.
FILE_ROWS = 100_000


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[list[tuple]]:
    """The rows in runs of ``most`` or a little more, cut where one of the first ``keys`` columns changes."""
    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 10_000).columns)):
                if len(held) >= most and row[:keys] != held[-1][:keys]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _write(rows: DataFrame, path: str, keys: list[str], make, most: int | None = None) -> None:
    """Files of rows, which begin with the ``keys``; those of a task follow each other in its range."""
    most = most or FILE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, held in enumerate(_runs(batches, len(keys), most)):
            store, root = _opened(path)
            store.create_dir(root, recursive=True)
            part = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(make(held))
            store.move(part, f"{root}/part-{TaskContext.get().partitionId():05}-{k:05}")  # a task that runs again writes the same file
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["file"])

    rows.repartitionByRange(*keys).sortWithinPartitions(*rows.columns).mapInArrow(run, "file string").count()


def write_forms(forms: DataFrame, path: str, version: int = 2) -> None:
    """Write forms (form, lemma, pos, case, gender, number) as files of about the size of a shuffle partition each."""
    columns = ["form", "lemma", "pos", "case", "gender", "number"]
    _write(forms.select(*columns), path, ["form"], lambda rows: lema_file(rows, version=version))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Write word pairs (w1, w2, frequency)."""
    _write(pairs.select("w1", "w2", "frequency"), path, ["w1", "w2"], lambda rows: lema_file([], rows))


def write_paradigms(paradigms: DataFrame, path: str) -> None:
    """Write paradigms (lemma, pos, gender, form, bundle); a lemma's groups lie in one file."""
    _write(paradigms.select("lemma", "pos", "gender", "form", "bundle"), path, ["lemma"], par1_file)
