"""Binary word-form files: literal bytes, round trips in ranges, damaged files."""

from __future__ import annotations

import random
import struct

import pyarrow as pa
import pytest

from lexmill.sources import morphology_files as M
from lexmill.storage import shared_path


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(M.MorphologyFiles)
    spark.dataSource.register(M.ParadigmFiles)
    return spark


def opened(raw):
    return pa.BufferReader(raw)


def test_literal_bytes_of_forms():
    """A file put together by hand, one word with two entries and a pair."""
    pool = "hesturhestar".encode()
    raw = struct.pack("<8I", 0x4C454D41, 2, len(pool), 1, 2, 3, 1, 0) + pool + struct.pack("<IB", 0, 6)
    raw += b"\0" * (-len(raw) % 4) + struct.pack("<2I", 6, 0) + bytes([6, 6])
    raw += b"\0" * (-len(raw) % 4) + struct.pack("<3I", 0, 1, 3) + struct.pack("<3I", 1 << 4 | 1 << 7 | 1 << 9, 1 << 4 | 1 << 7, 2 << 4 | 1 << 7 | 15)
    raw += struct.pack("<IB", 0, 6) + b"\0" * (-(len(raw) + 5) % 4)
    raw += struct.pack("<IB", 6, 6)
    raw += b"\0" * (-len(raw) % 4) + struct.pack("<I", 77)
    rows = [tuple(r.values()) for r in M.lema_forms(opened(raw), 0, 2).to_pylist()]
    assert rows == [("hestar", "hestur", "no", "nf", "kk", "ft"), ("hestur", "hestur", "no", "nf", "kk", "et"), ("hestur", "hestur", None, "þf", "kk", "et")]
    assert M.lema_pairs(opened(raw), 0, 1).to_pylist() == [{"w1": "hestur", "w2": "hestar", "frequency": 77}]
    made = M.lema_file([(*r[:2], r[2], *r[3:]) for r in rows], [("hestur", "hestar", 77)])
    assert [tuple(r.values()) for r in M.lema_forms(opened(made), 0, 2).to_pylist()] == rows


def test_literal_bytes_of_paradigms():
    pool = "orðorða".encode()
    raw = struct.pack("<8I", 0x50415231, 1, len(pool), 1, 2, 2, 5, 0) + pool + struct.pack("<IBBBxII", 0, 4, 0, 2, 0, 2)
    raw += struct.pack("<IIBHx", 0, 0, 4, 0) + struct.pack("<IIBHx", 0, 4, 5, 7)
    raw += struct.pack("<IBxxxII", 0, 4, 0, 1) + struct.pack("<IBxxxII", 4, 5, 1, 1) + struct.pack("<2I", 0, 1)
    rows = [("orð", 0, 2, "orð", 0), ("orð", 0, 2, "orða", 7)]
    assert [tuple(r.values()) for r in M.par1_entries(opened(raw), 0, 2).to_pylist()] == rows
    assert M.par1_file(rows, 5) == raw


def random_forms(n=700):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abdðeéiöþ") for _ in range(rng.randint(1, 5))) for _ in range(90)]
    return sorted({(rng.choice(stems) + rng.choice(["", "i", "ar"]), rng.choice(stems), rng.choice([*M.POS, None]), rng.choice(M.CASES), rng.choice(M.GENDERS), rng.choice(M.NUMBERS)) for _ in range(n)}, key=lambda r: (r[0].encode(), str(r)))


def test_round_trip_in_ranges(sources):
    spark, rows = sources, random_forms()
    for version in (1, 2):
        path = shared_path(spark, "lema")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        M.write_forms(spark.createDataFrame(rows, M.FORMS), path, version)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(M._files(path)) > 1
        for size in (7, 10**6):
            got = [tuple(r) for r in spark.read.format("morphology_files").option("rangeRecords", size).load(path).collect()]
            want = rows if version == 2 else [(*r[:3], None, None, None) for r in rows]
            assert sorted(got, key=str) == sorted(want, key=str)
    pairs = sorted({(a[0], b[0], k) for k, (a, b) in enumerate(zip(rows, rows[9:]))})
    path = shared_path(spark, "pairs")
    M.write_pairs(spark.createDataFrame(pairs, M.PAIRS), path)
    assert sorted(tuple(r) for r in spark.read.format("morphology_files").option("section", "pairs").option("rangeRecords", 50).load(path).collect()) == pairs
    assert spark.read.format("morphology_files").load(shared_path(spark, "nothing")).count() == 0


def test_paradigms_round_trip(sources):
    spark, rng = sources, random.Random(5)
    rows = sorted({(f"l{rng.randint(0, 60)}é", rng.randint(0, 1), rng.randint(0, 2), f"f{rng.randint(0, 99)}ö", rng.randint(0, 511)) for _ in range(900)})
    path = shared_path(spark, "par1")
    M.write_paradigms(spark.createDataFrame(rows, M.PARADIGMS), path)
    for size in (11, 10**6):
        assert sorted(tuple(r) for r in spark.read.format("paradigm_files").option("rangeRecords", size).load(path).collect()) == rows
    store, _ = M._opened(path)
    for file in M._files(path):  # the index by form: each form's entries, in the order of bytes
        with store.open_input_file(file) as f:
            layout, n = M.par1_layout(f)
            own = [tuple(r.values()) for r in M.par1_entries(f, 0, n["entries"]).to_pylist()]
            forms, order = M._array(f, layout.at["forms"], 0, n["forms"], M._FORM), M._array(f, layout.at["order"], 0, n["entries"], "<u4")
            names = M._strings(f, layout.at["pool"], forms["at"], forms["size"]).to_pylist()
            assert names == sorted(set(r[3] for r in own), key=str.encode)
            for name, first, count in zip(names, forms["first"].tolist(), forms["count"].tolist()):
                assert {own[k][3] for k in order[first : first + count]} == {name}


def test_damaged_files_are_refused(sources):
    good = M.lema_file(random_forms(20))
    for raw in (b"", good[:31], b"XXXX" + good[4:], good[:4] + b"\x09" + good[5:], good[:-1]):
        with pytest.raises(M.FormatError):
            M.lema_layout(opened(raw))
    with pytest.raises(M.FormatError):
        M.par1_layout(opened(M.par1_file([("a", 0, 0, "b", 1)])[:-2]))
    with pytest.raises(M.FormatError):
        M.lema_file([("x" * 300, "x", "no", None, None, "et")])


def test_files_of_a_task_are_bounded(sources, monkeypatch):
    """A task ends a file at a number of rows, never within a key, and all files together hold every row."""
    spark = sources
    monkeypatch.setattr(M, "FILE_ROWS", 50)
    pairs = [(f"w{i:04}", f"v{i % 7}", i + 1) for i in range(1000)]
    path = shared_path(spark, "bounded")
    M.write_pairs(spark.createDataFrame(pairs, M.PAIRS).coalesce(1), path)
    assert sorted(tuple(r) for r in spark.read.format("morphology_files").option("section", "pairs").load(path).collect()) == pairs
    store, _ = M._opened(path)
    sizes = []
    for file in M._files(path):
        with store.open_input_file(file) as f:
            sizes.append(M.lema_layout(f)[1]["pairs"])
    assert max(sizes) <= 50 and sum(sizes) == 1000
    runs = list(M._runs(iter([M.pa.RecordBatch.from_pylist([{"k": i // 30, "v": i} for i in range(100)])]), 1, 50))
    assert [len(r) for r in runs] == [60, 40] and [r[0] for r in runs] == [(0, 0), (2, 60)]
