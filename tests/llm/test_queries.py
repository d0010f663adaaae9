"""The registered queries and the pipeline on the smallest tables, against brute force where it is cheap."""

from __future__ import annotations

import collections
import hashlib
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import encoding, fm_quality, qgram_decontam, queries
from lexmill.llm.common import crc_mod


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    if name.startswith(("op11_", "op12_", "op13_")):
        return  # test_oracle compares their rows
    table, key = ("pages", "page_id") if name.startswith("op9_") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect()}
    assert ids >= {r[key] for r in rows}
    if not name.startswith("op4_"):
        assert ids == {r[key] for r in rows}


def columns_of(found, names):
    return sorted(tuple(r[n] for n in names) for r in found)


def by_sql(frame, name, kind="documents"):
    """The oracle's rows for a frame of ``kind``."""
    con = duckdb.connect()
    con.register(kind, frame.toArrow())
    out = con.sql(queries.ORACLE_SQL[name])
    return [dict(zip(out.columns, r)) for r in out.fetchall()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    kind = "conversations" if name.startswith(("op12_", "op13_")) else "documents"
    got, want = (collections.Counter(tuple(r[n] for n in df.columns) for r in rows) for rows in (df.collect(), by_sql(spark.read.parquet(f"{data}/{kind}.parquet"), name, kind)))
    assert got == want


def test_pipeline_stages(spark, data, tmp_path):
    """Each stage against SQL or brute force on what it was given."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], data).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    texts = [{r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for t in tables[:-1]]
    assert all(t.columns == docs.columns for t in tables[:-1]) and all(0 < len(b) <= len(a) for a, b in zip(texts, texts[1:]))

    # quality: those that the machine, trained on the stage's own input, scores as good
    machine = fm_quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet").filter(crc_mod(F.col("doc_id"), 3) != 1))
    assert {r.doc_id for r in fm_quality.score(docs, machine, F.lit(False)).filter("predicted = 1").collect()} == set(texts[1])
    # near duplicates: the least of each component of all links
    assert {r["doc_id"] for r in by_sql(tables[1], "op7_chosen_path") if r["kept"]} == set(texts[2])
    # substrings: what all windows leave
    for r in by_sql(tables[2], "op6_fm_index"):
        if r["n_words"] and r["n_removed"] == r["n_words"]:
            assert r["doc_id"] not in texts[3]
        elif r["n_removed"]:
            assert hashlib.sha256(texts[3][r["doc_id"]].encode()).hexdigest() == r["kept_sha256"]
        else:
            assert texts[3][r["doc_id"]] == texts[2][r["doc_id"]]
    # benchmark: no whole item is left, and what shares no twelve characters with any item stays
    items = [qgram_decontam.normal(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    grams = {t[i : i + 12] for t in items for i in range(len(t) - 11)}
    for i, text in texts[3].items():
        own = qgram_decontam.normal(text)
        if any(t in own for t in items):
            assert i not in texts[4]
        if not any(own[k : k + 12] in grams for k in range(len(own) - 11)):
            assert i in texts[4]
    # packing: every id once, no sequence too long
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(encoding.vocabulary_path()), tables[-1].collect()
    want = {}
    for i, text in texts[4].items():
        ids = (library.encode(text, add_special_tokens=False).ids if text else []) + [0]
        want |= {(i, k): (2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for k, part in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    seats: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seats.get(r.sequence_id, 0)
        seats[r.sequence_id] = r.offset + r.length
    assert max(seats.values()) <= 2048


def test_pipeline_takes_odd_rows(spark, data, tmp_path):
    """Nulls, empties, repeats, a very long text and no rows at all go through every stage."""
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    long = " ".join(f"w{k}" for k in range(30_000))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "short text", "en", "s", 10), (3, "short text", "en", "s", 10), (3, "other text of the same id", "en", "s", 25), (None, "no id", "en", "s", 5), (4, long, "en", "s", len(long))]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{k}")
            stage(spark, docs, data).write.parquet(path)
            docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= {r[0] for r in rows} and (rows or not ids)
