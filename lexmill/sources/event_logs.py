"""Append-only event logs as a stream: read on from where each log was left, whatever happened to it since.

A log is a folder with a file for each generation, ``generation=N``: a header line, ``#gen`` and N, then a line for each
event.  Writers append to the last generation.  Who has folded a log's first part into a snapshot starts the next
generation without it; its header may say at which byte of the generation before its first line stood, and a reader
that was further goes on behind that, so nothing comes twice.  Without such a note a reader starts at the header.

The offset of the stream is the generation and byte of each log.  A line counts once its end is there.  A batch reads
files by ranges of bytes, so a long log spreads over tasks; generations before the one that was read to the end
are needed until then and may be deleted afterwards (option ``prune``).

Paths are opened by ``pyarrow.fs``: a local or mounted folder, or an address that it knows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "log string, generation bigint, at bigint, value string"
HEADER = "#gen"
_BLOCK = 1 << 16


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def generations(path: str) -> dict[str, list[int]]:
    """The generations of each log in a folder, in order."""
    store, root = _opened(path)
    out: dict[str, list[int]] = {}
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path.removeprefix(root).strip("/").split("/")
        if f.type == fs.FileType.File and len(parts) == 2 and parts[1].startswith("generation=") and parts[1][11:].isdigit():
            out.setdefault(parts[0], []).append(int(parts[1][11:]))
    return {log: sorted(numbers) for log, numbers in sorted(out.items())}


def _file(root: str, log: str, generation: int) -> str:
    return f"{root}/{log}/generation={generation}"


def header(store: fs.FileSystem, file: str) -> tuple[int, int | None]:
    """Where the lines of a generation begin, and which byte of the generation before that is."""
    with store.open_input_file(file) as f:
        line = f.read(min(f.size(), 256)).split(b"\n", 1)[0]
    fields = line.decode("utf-8", "replace").split("\t")
    if fields[0] != HEADER:
        return 0, None
    return len(line) + 1, int(fields[2]) if len(fields) > 2 and fields[2].isdigit() else None


def ended(store: fs.FileSystem, file: str) -> int:
    """The byte behind the last whole line."""
    with store.open_input_file(file) as f:
        at = f.size()
        while at > 0:
            low = max(0, at - _BLOCK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


class Range(InputPartition):
    """Lines that begin within some bytes of a generation."""

    def __init__(self, log: str, generation: int, start: int, stop: int, first: bool):
        super().__init__(None)
        self.log, self.generation, self.start, self.stop, self.first = log, generation, start, stop, first


def _ranges(log: str, generation: int, start: int, stop: int, most: int) -> list[Range]:
    return [Range(log, generation, a, min(a + most, stop), a == start) for a in range(start, stop, most)]


def lines(path: str, part: Range) -> Iterator[tuple[str, int, int, str]]:
    store, root = _opened(path)
    with store.open_input_file(_file(root, part.log, part.generation)) as f:
        at = part.start
        if not part.first:  # a line that began before belongs to the range before
            at -= 1
        f.seek(at)
        reader = io.BufferedReader(f, _BLOCK)
        if not part.first:
            at += len(reader.readline())
        while at < part.stop:
            line = reader.readline()
            if not line.endswith(b"\n"):
                break
            if line != b"\n":
                yield part.log, part.generation, at, line[:-1].decode("utf-8", "replace")
            at += len(line)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("rangebytes", 8 << 20))

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.path)
        out = []
        for log, numbers in generations(self.path).items():
            file = _file(root, log, numbers[-1])
            out += _ranges(log, numbers[-1], header(store, file)[0], ended(store, file), self.most)
        return out or [Range("", 0, 0, 0, True)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.stop > part.start:
            yield from lines(self.path, part)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most, self.prune = options["path"], int(options.get("rangebytes", 8 << 20)), options.get("prune", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"logs": "{}"}

    def latestOffset(self) -> dict:
        store, root = _opened(self.path)
        at = {log: [numbers[-1], ended(store, _file(root, log, numbers[-1]))] for log, numbers in generations(self.path).items()}
        return {"logs": json.dumps(at, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, root = _opened(self.path)
        before, out = json.loads(start["logs"]), []
        for log, (generation, stop) in json.loads(end["logs"]).items():
            begin, moved = header(store, _file(root, log, generation))
            known = before.get(log)
            if known is not None and known[0] == generation:
                begin = max(begin, known[1])
            elif known is not None and moved is not None and known[0] == generation - 1:
                if known[1] < moved and store.get_file_info(_file(root, log, known[0])).type == fs.FileType.File:
                    out += _ranges(log, known[0], max(known[1], header(store, _file(root, log, known[0]))[0]), moved, self.most)  # what nobody had read yet
                begin += max(0, known[1] - moved)
            out += _ranges(log, generation, begin, stop, self.most)
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        yield from lines(self.path, part)

    def commit(self, end: dict) -> None:
        if self.prune:
            store, root = _opened(self.path)
            have = generations(self.path)
            for log, (generation, _) in json.loads(end["logs"]).items():
                for old in have.get(log, []):
                    if old < generation:
                        store.delete_file(_file(root, log, old))


class EventLogs(DataSource):
    """``spark.readStream.format("event_logs").load(folder)``: log, generation, at and value of each line."""

    @classmethod
    def name(cls) -> str:
        return "event_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _write_generation(store: fs.FileSystem, root: str, log: str, generation: int, values, after: int | None) -> None:
    """A generation as a whole: what the one before has from byte ``after`` on, then ``values``."""
    file = _file(root, log, generation)
    store.create_dir(f"{root}/{log}", recursive=True)
    with store.open_output_stream(file + ".part") as out:
        out.write((f"{HEADER}\t{generation}" + ("" if after is None else f"\t{after}") + "\n").encode())
        if after is not None:
            with store.open_input_file(_file(root, log, generation - 1)) as old:
                old.seek(after)
                while block := old.read(1 << 20):
                    out.write(block)
        for value in values:
            out.write(value.encode("utf-8", "surrogatepass") + b"\n")
    store.move(file + ".part", file)


def middle(store: fs.FileSystem, file: str, share: float) -> int:
    """The byte behind the line in which a share of a file's bytes ends."""
    start, stop = header(store, file)[0], ended(store, file)
    with store.open_input_file(file) as f:
        at = start + int((stop - start) * share)
        if at == start:
            return start
        f.seek(at - 1)
        return at - 1 + len(io.BufferedReader(f, _BLOCK).readline())


def write_generation(values: DataFrame, path: str, generation: int, folded: float | None = None) -> None:
    """Write a generation of each log (log, seq, value), in the order of seq, by one task for each log.

    With ``folded`` each goes on from the generation before without the first lines, so large a share of its bytes.
    A task that runs again writes the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        held: list[str] = []
        log = None

        def flush() -> None:
            after = None if folded is None else middle(store, _file(root, log, generation - 1), folded)
            _write_generation(store, root, log, generation, held, after)
            held.clear()

        for batch in batches:
            for name, value in zip(batch.column("log").to_pylist(), batch.column("value").to_pylist()):
                if log is not None and name != log:
                    flush()
                log = name
                held.append(value)
        if log is not None:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["log"])

    values.select("log", "seq", "value").repartition("log").sortWithinPartitions("log", "seq").mapInArrow(run, "log string").count()


def append(path: str, log: str, values: list[str], whole: bool = True) -> None:
    """Append lines to a log's last generation as its writer does; with ``whole`` false the last one has no end yet."""
    store, root = _opened(path)
    file = _file(root, log, generations(path)[log][-1])
    with store.open_append_stream(file) as out:
        out.write(("\n".join(values) + ("\n" if whole else "")).encode("utf-8", "surrogatepass"))
