"""Operators 11 to 13 against brute force on small fixtures with nulls, empties, ties, repeats and hot groups."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexmill.llm import collocations, ordering, prefix_trie, reply_trees

DOCS = "doc_id long, text string, lang string, rank string, phrase string"
CONV = "conv_id long, turn long, role string, text string, depth string, path string"


# ---- phrases
def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", lower)]


def brute_phrases(docs, max_n, least, top, share=100):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in docs:
        for ws in pieces(text):
            n[lang or "und"] += len(ws)
            for i in range(len(ws)):
                for k in range(1, max_n + 1):
                    if i + k <= len(ws):
                        f[lang or "und"][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_docs(seed=3, n=150):
    rng = random.Random(seed)
    hot = ["the"] * 6
    words = hot + ["of", "a", "b", "c", "dé", "É", "x\x01y", "the\x00", "Zebra", "ﬁ", "日本"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(0, 60))), ["en", "fr", None][i % 3], "r", "p") for i in range(n)]
    rows += [(900, None, "en", "", ""), (901, "", None, "", ""), (902, " .,; ", "en", "", ""), (903, "new york " * 40, "en", "", ""), (None, "new york city", "en", "", ""), (903, "new york " * 40, "en", "", "")]
    return rows


@pytest.mark.parametrize("max_n,least,top,share", [(5, 4, 2000, 100), (3, 2, 7, 100), (5, 3, 50, 60), (2, 1, 40, 100)])
def test_phrases_equal_brute_force(spark, max_n, least, top, share):
    rows = phrase_docs()
    got = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), max_n, least, top, share).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, max_n, least, top, share)


def test_phrases_over_many_ranges_and_small_chunks(spark, monkeypatch):
    """Phrases that go on in other ranges are counted whole; a chunk of a few texts gives the same rows."""
    rows = phrase_docs(5, 250)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = collocations.collocations(spark.createDataFrame(rows, DOCS), 4, 5, 100).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 4, 5, 100)


def test_phrase_scores_are_exact(spark):
    """Products beyond 64 bits, and a tie of cuts after rounding down."""
    big = 3_000_000_000_000_007
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 4).alias("n"), F.lit(big + 11).alias("l"), F.lit(big + 2).alias("r"))
    exact = {c: F.col(c).cast("decimal(16,0)").alias(c) for c in ("a", "n", "l", "r")}
    got = row.select(F.struct(*exact.values()).alias("x")).select(F.expr("(x.a * x.n * 1000) div (x.l * x.r)").alias("s")).first().s
    assert got == 1000 * big * (big + 4) // ((big + 11) * (big + 2))


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b " + "y" * 300 + " c " * 20 + "z" * 90 + " ", "en", "", "")] * 120 + [(1, "a b c " * 20_000, "en", "", "")]  # a piece of 60,000 words
    assert sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, DOCS)).collect()) == brute_phrases(rows, 5, 100, 2000)


@pytest.mark.parametrize("coded,langs", [(1, 0), (5, 1), (100, 2)])
def test_phrases_whatever_has_codes(spark, monkeypatch, coded, langs):
    monkeypatch.setattr(collocations, "CODED", coded)
    monkeypatch.setattr(collocations, "CODED_LANGS", langs)
    rows = phrase_docs(8, 120)
    assert sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, DOCS), 5, 3, 60).collect()) == brute_phrases(rows, 5, 3, 60)


# ---- positions
def test_numbered_spreads_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(None if k == 3 else k, rng.randint(0, 10**6)) for k in [7] * 4000 + list(range(200)) + [3] * 50]
    frame = spark.createDataFrame(rows, "k long, v long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.numbered(frame, "k", [F.asc("v")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = collections.defaultdict(list)
    for r in got:
        held[r.k].append((r.pos, r.v))
    assert len(got) == len(rows)
    for k, own in held.items():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for x, v in rows if x == k)


# ---- reply trees
def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rng = random.Random(2)
    parts = list(reply_trees.CONTROL) + ["<", "[", "\\", "\\\\", "s>", "/INST]", "|im_end|>", "<\\s>", "[\\\\INST]", "x\n", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(600)] + ["</s>[INST] ok [/INST]"]
    for raw, safe, role in spark.createDataFrame([(t,) for t in texts], "t string").select("t", reply_trees.escaped(F.col("t")), reply_trees.escaped_role(F.col("t"))).collect():
        assert not any(c in safe or c in role for c in reply_trees.CONTROL) and "\n" not in role
        assert reply_trees.unescaped(safe) == raw and reply_trees.unescaped_role(role) == raw


def brute_paths(messages, branches):
    by_id, replied = {m[0]: m for m in messages}, {m[1] for m in messages}
    out = collections.defaultdict(list)
    for m in messages:
        if m[0] in replied:
            continue
        path, at = [m[0]], m
        while at[1] in by_id and len(path) <= len(messages):
            at = by_id[at[1]]
            path.append(at[0])
        if len(path) <= len(messages):
            out[path[-1]].append((-sum(by_id[x][4] or 0 for x in path), -len(path), m[0], path[::-1]))
    return {root: sorted(v)[:branches] for root, v in out.items()}


def random_forest(seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        parent = None if i < 3 else f"m{rng.randint(max(0, i - 40), i - 1):03d}"
        rows.append((f"m{i:03d}", parent, rng.choice(["user", "assistant", None, "sy\nstem<"]), rng.choice(["hi <s>", "", None, "a\nb", "[/INST]"]), float(rng.randint(0, 3)) if i % 5 else None))
    rows += [("lost", "nowhere", "user", "a reply to nothing", 1.0), ("ring1", "ring2", "user", "x", 1.0), ("ring2", "ring1", "user", "x", 1.0), ("hung", "ring1", "user", "x", 1.0)]
    rows += [(f"c{i:04d}", f"c{i - 1:04d}" if i else None, "assistant" if i % 2 else "user", f"turn {i} </s>", 0.0) for i in range(700)]  # a deep one
    return rows


@pytest.mark.parametrize("branches", [1, 3, None])
def test_paths_equal_brute_force(spark, branches):
    rows = random_forest()
    frame = spark.createDataFrame(rows, "message string, parent string, role string, text string, score double").repartition(3).cache()
    got = reply_trees.formatted(frame, branches).collect()
    want = brute_paths(rows, branches)
    by_id = {m[0]: m for m in rows}
    assert {r.root for r in got} == set(want) and "ring1" not in want
    for r in got:
        k = [w[2] for w in want[r.root]].index(r.path)
        total, _, _, path = want[r.root][k]
        assert (r.total, r.n_turns) == (-total, len(path)) and r.rank == (None if branches is None else k + 1)
        assert reply_trees.turns_of(r.text) == [(by_id[m][2] or "", by_id[m][3] or "") for m in path]
        assert [reply_trees.unescaped(r.text[s.start : s.end]) for s in r.spans] == [by_id[m][3] or "" for m in path if by_id[m][2] == "assistant"]
    assert len(got) == sum(map(len, want.values()))


def odd_conversations():
    rng = random.Random(6)
    rows = []
    for c in list(range(0, 60)) + [None, 100, 119, 41, -3]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["same", "other words", "", None, "x <|im_end|>\n"]), "d", "p"))
    rows += [(200, None, "user", "null turn", "", ""), (200, 0, "user", "zero", "", ""), (200, 0, "user", "zero", "", ""), (200, 0, "assistant", "tie", "", ""), (201, 3, "assistant", "w " * 200_000, "", "")]
    rows += [(300 + k, t, "user", f"copy {t}", "", "") for k in range(40) for t in range(3)]
    rows += [(500, t, "user" if t % 2 else "assistant", f"long {t}", "", "") for t in range(900)]
    return rows


def ordered(rows, with_null):
    held = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None or with_null:
            held[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    return {c: [(x[3], x[5]) for x in sorted(v)] for c, v in held.items()}


def test_formatted_conversations(spark, monkeypatch):
    monkeypatch.setattr(reply_trees, "BLOCK_TURNS", 7)
    rows = odd_conversations()
    got = {r.conv_id: r for r in reply_trees.digests(reply_trees.written(spark.createDataFrame(rows, CONV).repartition(4))).collect()}
    want = ordered(rows, True)
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert reply_trees.digests(reply_trees.written(spark.createDataFrame([], CONV))).count() == 0


# ---- prefix trie
def brute_trie(rows):
    own = ordered(rows, False)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])
        rebuilt[c] = base[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            nodes[tuple(rebuilt[c][:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        n = (len(members) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += n
            leaves[p[:d]] += p not in kids
    ends = lambda p: ",".join(str(c) for c in nodes[p] if len(rebuilt[c]) == len(p))
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in nodes.items())


def trie_rows(spark, rows):
    found = prefix_trie.shared_trie(spark.createDataFrame(rows, CONV).repartition(4))
    return sorted(tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 5)  # long conversations are run in many blocks
    monkeypatch.setattr(prefix_trie, "PIECE", 3)  # and the ids of copies travel in many pieces
    assert trie_rows(spark, odd_conversations()) == brute_trie(odd_conversations())


def test_trie_of_little(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "x", "", "")]) == []
    one = [(7, 1, None, None, "", "")]
    assert trie_rows(spark, one) == brute_trie(one)
