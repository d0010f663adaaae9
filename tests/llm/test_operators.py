"""Each operator against a brute-force version on small fixtures with nulls, empties, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chosen_path, components, encoding, fm_index, fm_quality, html_diff, katz, langid, mcd_rules, orc_tokens, packing, qgram_decontam, substring_dedup
from lexmill.llm.common import crc_mod, shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def corpus(seed=1):
    """Documents with copies, near copies, shared passages, periodic texts, empties, nulls and a very long word."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    passage = prose(rng, 30)
    rows = [base, base, base.replace(" ", "  "), base + " extra", prose(rng, 60) + " " + passage, passage + " " + prose(rng, 45), "la " * 70, "la " * 25, "one two three " * 20, "", None, " \t\n", "word", "a b c d", "x" * 5000, prose(rng, 300)]
    edited = base.split()
    edited[50] = "changed"
    rows += [" ".join(edited), base.upper(), "É " + base, prose(rng, 20) + "\n" + prose(rng, 20) + "\n" + prose(rng, 20)]
    rows += [prose(rng, rng.randint(1, 90)) for _ in range(20)]
    return [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", len(t or ""), "clash") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


# ---- encoding, packing and files
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.vocabulary_path())


def test_encoder_equals_library(library):
    enc = encoding.Encoder(encoding.vocabulary_path(), 5, 5)
    texts = [t for _, t, *_ in corpus()] + ["Don't I'VE é!'s '' '!a_b ²3 42 straße Straße", "a<|endoftext|>b <|startoftext|>", "É Σας İ ﬁ ｈ", "\x1c x\x85y\xa0z w", "日本語 テスト", "'re're 're"]
    for t in texts:
        want = np.array(library.encode(t, add_special_tokens=False).ids if t else [], "<u4").tobytes()
        assert enc.encode(t) == want, t


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_encoder_tells_words_of_one_hash_apart(library, monkeypatch):
    """Words that polynomials modulo 2^64 confuse, and words under a hash that only knows their length."""
    pair = [thue_morse(n, *ab) for n in (512, 1024, 2048, 4096) for ab in ("ab", "ba")]
    texts = pair + [" ".join(pair), "ab ba ab", "ba", "the teh eth\nhet", "the", None, "x y z xy yx the"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids if t else [], "<u4").tobytes() for t in texts]
    for weights, limits in ((encoding._BYTE, (100_000, 1000)), (np.ones(256, np.uint64), (100_000, 1000)), (np.ones(256, np.uint64), (2, 2))):
        monkeypatch.setattr(encoding, "_BYTE", weights)
        enc = encoding.Encoder(encoding.vocabulary_path(), *limits)
        for _ in range(2):
            assert [enc.encode(t) for t in texts] == want
            ids, bounds = enc.encode_batch(pa.array(texts, pa.string()))
            assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])] == want


def test_token_files(spark, docs, empty, library):
    got = {r.doc_id: r for r in orc_tokens.token_files(docs).withColumn("crc", orc_tokens.ids_crc32("ids")).collect()}
    start = 0
    for i, t, *_ in sorted(corpus()):
        ids = (library.encode(t, add_special_tokens=False).ids if t else []) + [1]
        r = got[i]
        assert (r.start, r.n_tokens, list(r.ids), r.crc) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert orc_tokens.token_files(empty).count() == 0
    twice = spark.createDataFrame([(None, "a"), (5, "b c"), (5, "b c"), (5, "a")], "doc_id long, text string")
    rows = orc_tokens.token_files(twice).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 5, 5, 5] and rows[-1].start + rows[-1].n_tokens == sum(r.n_tokens for r in rows)


def test_token_files_prune(spark, docs):
    path = shared_path(spark, "prune")
    orc_tokens.write_token_ids(docs, path)
    plan = orc_tokens.read_token_ids(spark, path).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_token_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path):
    """What the files themselves say: row index stride, several stripes, integer encodings, Bloom filters."""
    from pyarrow import orc

    rng = random.Random(3)
    df = spark.createDataFrame([(i, prose(rng, 40)) for i in range(44_000)], "doc_id long, text string").coalesce(1)
    sizes = {}
    for name, columns in (("with", "doc_id"), ("without", "")):
        path = str(tmp_path / name)
        orc_tokens.write_token_ids(df, path, stripe_bytes=1 << 18, row_stride=2000, bloom_columns=columns)
        files = [orc.ORCFile(f) for f in sorted((tmp_path / name).glob("*.orc"))]
        assert all(f.row_index_stride == 2000 for f in files) and sum(f.nrows for f in files) == 44_000
        assert max(f.nstripes for f in files) > 1
        ids = sum(len(x) for f in files for x in f.read(columns=["ids"]).column("ids").to_pylist())
        sizes[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.orc"))
        assert sizes[name] < 4 * ids  # run-length encoding takes less than 32 bits an id
    assert sizes["with"] > sizes["without"]
    plain = spark.read.schema(orc_tokens.SCHEMA).orc(str(tmp_path / "with")).filter("doc_id = 777")
    assert plain.count() == 1


def test_packing(docs, empty, spark):
    got = packing.packed_digests(docs, capacity=64).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 64) + 1
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == {i for i, *_ in corpus()}
    for rows in by_doc.values():
        rows.sort(key=lambda r: r.piece)
        assert [r.start for r in rows] == [64 * k for k in range(len(rows))] and all(r.length == 64 for r in rows[:-1])
    assert packing.packed_digests(empty).count() == 0


def test_packed_sequences_hold_every_id(docs, empty, library):
    got = packing.packed_sequences(docs, capacity=64).collect()
    parts = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_tokens <= 64 and [p.offset for p in r.pieces] == np.cumsum([0] + [p.length for p in r.pieces])[:-1].tolist()
        parts |= {(p.doc_id, p.piece): ids[p.offset : p.offset + p.length].tolist() for p in r.pieces}
    for i, t, *_ in corpus():
        ids = (library.encode(t, add_special_tokens=False).ids if t else []) + [0]
        assert sum((parts.pop((i, k)) for k in range(-(-len(ids) // 64))), []) == ids
    assert not parts and packing.packed_sequences(empty).count() == 0


def test_fullest_is_exact():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 90)
        reach = {0}
        for k, n in counts.items():
            reach |= {r + k * j for r in reach for j in range(n + 1)}
        found = packing.fullest(counts, room)
        assert sum(k * n for k, n in found.items()) == max(r for r in reach if r <= room)
        assert all(n <= counts[k] for k, n in found.items())


def test_plan_uses_up_the_histogram():
    histogram = {2048: 3, 1000: 10, 700: 7, 48: 9, 3: 1}
    used = collections.Counter()
    for times, combination in packing.slack_plan(histogram, 2048):
        assert sum(k * n for k, n in combination.items()) <= 2048
        for k, n in combination.items():
            used[k] += n * times
    assert used == histogram


# ---- language model
def brute_katz(rows, held):
    """Scores by the definition: a table for each order, contexts of up to two tokens, begin marks in front."""
    uni, grams, tokens = collections.Counter(), (collections.Counter(), collections.Counter()), collections.Counter()
    texts = {i: [None, *w] for i, w in rows}
    for i, w in texts.items():
        if not held[i]:
            uni.update(w[1:])
            for k in range(1, len(w)):
                for n in (1, 2):
                    if k >= n:
                        grams[n - 1][tuple(w[k - n : k]), w[k]] += 1
                        tokens[tuple(w[k - n : k])] += 1

    def counts(c):
        n = collections.Counter(min(v, katz.K + 2) for v in c.values())
        return [n.get(r, 0) for r in range(katz.K + 2)] + [len(c), sum(c.values())]

    words, tables = katz.Words(counts(uni)), [katz.Discounts(counts(g)) for g in grams]
    single = {w: float(words.probability(np.array([c]))[0]) for w, c in uni.items()}
    assert abs(sum(single.values()) + words.unknown - 1) < 1e-9
    after = collections.defaultdict(list)
    for g in grams:
        for h, w in g:
            after[h].append(w)
    known = {}

    def mass(h, w):
        return float(tables[len(h) - 1].mass(np.array([grams[len(h) - 1][h, w]]))[0])

    def context(h):
        if h not in known:
            kept = sum(mass(h, w) for w in after[h])
            bottom = tokens[h] if tokens[h] - kept > 1e-9 * tokens[h] else tokens[h] + 1
            known[h] = bottom, (1 - kept / bottom) / (1 - sum(probability(h[1:], w) for w in after[h]))
        return known[h]

    def probability(h, w):
        if not h:
            return single.get(w, words.unknown)
        if not tokens[h]:
            return probability(h[1:], w)
        bottom, alpha = context(h)
        return mass(h, w) / bottom if grams[len(h) - 1][h, w] else alpha * probability(h[1:], w)

    for h in list(tokens):  # each context's probabilities sum to one
        assert abs(sum(probability(h, w) for w in [*uni, "never seen"]) - 1) < 1e-6
    base = {w: math.log10((uni[w] + 0.1) / (sum(uni.values()) + 0.1 * (len(uni) + 1))) for i, t in rows for w in t}
    return {i: (held[i], len(w), sum(v in uni for v in w), sum(uni.values()), sum(base[v] for v in w), sum(math.log10(probability(tuple(texts[i][max(0, k - 2) : k]), texts[i][k])) for k in range(1, len(texts[i])))) for i, w in rows}


@pytest.mark.parametrize("hot", [5, 10**9])
def test_katz(docs, empty, hot):
    got = {r.doc_id: r for r in katz.score_texts(docs, modulus=4, buckets=5, hot_tokens=hot).collect()}
    rows = [(i, (t or "").encode().lower().split() + ["</s>"]) for i, t, *_ in corpus()]
    want = brute_katz(rows, {i: zlib.crc32(str(i).encode()) % 4 == 0 for i, _ in rows})
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 and abs(r.score - w[5]) < 1e-6
    assert katz.score_texts(empty).count() == 0


def test_katz_rows(spark):
    """Rows without id, repeated ids with other texts, a very long text, clashing names; training only or none."""
    long = " ".join(f"w{k % 977}" for k in range(150_000))
    rows = [(None, "a b c", "x"), (None, None, "x"), (7, "a b c d", "x"), (7, "a b c d", "x"), (7, "other words here", "y"), (8, long, "z"), (9, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string").withColumns({"payload": F.lit(1), "bucket": F.lit(2), "answers": F.lit(3)})
    got = katz.score_texts(df, modulus=2, buckets=3).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").split()) + 1) for i, t, _ in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    first, second, _ = sorted((r.score, r.n_tokens) for r in got if r.doc_id == 7 and r.n_tokens == 5) + [None]
    assert first == second
    held = katz.score_texts(df, modulus=1, buckets=3).collect()  # nothing to learn from
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in held)


# ---- duplicates
def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    want = union_find(pairs, {n for p in pairs for n in p if p[0] != p[1]})
    got = {r.doc_id: r.component_id for r in components.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == want


def near_corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = list(corpus())
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy), "en", "s", 0, ""))
    return rows


def test_near_duplicates(spark, empty):
    rows = near_corpus()
    got = {r.doc_id: r for r in chosen_path.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union_find(pairs, ids)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in ids}
    assert chosen_path.near_duplicates(empty).count() == 0


def test_large_nodes_branch_and_split(spark, monkeypatch):
    """Nodes above a tiny limit branch to the last depth and are then compared in blocks, and nothing is missed."""
    rows = near_corpus()
    monkeypatch.setattr(chosen_path, "NODE_MEMBERS", 4)
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.undo()
    want = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_sketches_of_large_sets():
    """Disjoint sets of any size agree in about one byte of 256; similar ones in about their similarity."""
    rng = np.random.default_rng(5)
    for size in (5, 300, 3000, 20_000):
        sets = [rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(8)]
        marks = [np.frombuffer(chosen_path.sketch(chosen_path.minwise(x)), np.uint8) for x in sets]
        assert np.mean([(marks[i] == marks[j]).mean() for i in range(8) for j in range(i)]) <= 0.01
        near = np.concatenate([sets[0][: size * 9 // 10], sets[1][: size // 10]])
        both = (np.frombuffer(chosen_path.sketch(chosen_path.minwise(near)), np.uint8) == marks[0]).mean()
        assert abs(both - len(np.intersect1d(near, sets[0])) / len(np.union1d(near, sets[0]))) < 0.2


def test_near_duplicate_rows(spark):
    """Rows without id, an id with several sets, a very long text, clashing names, ties."""
    rng = random.Random(8)
    text, other = prose(rng, 60), prose(rng, 60)
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(None, text), (3, text), (3, text), (2, text), (3, other), (9, other), (5, long), (4, long + " more"), (6, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "sig1": F.lit("a"), "shingles": F.lit(0.5)})
    got = sorted((r.doc_id or 0, r.n_shingles > 0, r.component_id or 0) for r in chosen_path.near_duplicates(df).collect())
    assert got[0] == (0, True, 0) and [g for g in got if g[0] in (4, 5)] == [(4, True, 4), (5, True, 4)]
    assert [g for g in got if g[0] == 6] == [(6, False, 6)] * 2 and [g for g in got if g[0] == 2] == [(2, True, 2)]
    assert {g[2] for g in got if g[0] == 9} <= {2, 3} and {g[2] for g in got if g[0] == 3} <= {2, 3}


def test_first_of_each(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "doc_id long, component_id long")
    assert sorted(r.doc_id for r in chosen_path.first_of_each(df, labels).collect()) == [1, 3, 3]


def brute_repeats(rows, width):
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t, *_ in [(r[0], r[1] or "") for r in rows]):
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone[s : s + width] = [True] * width
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("width", [3, 8, 20])
def test_substring_dedup(docs, empty, width):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.remove_repeats(docs, width, shards=3)).collect()}
    assert got == brute_repeats(corpus(), width)
    assert substring_dedup.remove_repeats(empty, width).count() == 0


def test_long_periodic_texts(spark):
    """A text that repeats a line is one stretch of any length, beside other repeats of the same shard."""
    rng = random.Random(5)
    line, passage = "one two three four five six seven eight nine ten ", prose(rng, 40)
    texts = [prose(rng, 50) + " " + passage, line * 7000 + passage, "la " * 70_000, passage + " " + prose(rng, 50), prose(rng, 200), line * 3, "la " * 30 + prose(rng, 30)]
    rows = [(i, t, "en", "s", len(t), "") for i, t in enumerate(texts)]
    found = substring_dedup.digest(substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(2), 20, shards=1))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == brute_repeats(rows, 20)


def test_kept_text(docs):
    got = {r.doc_id: r for r in substring_dedup.with_kept_text(docs).collect()}
    want = brute_repeats(corpus(), 20)
    for i, t, *_ in corpus():
        n, gone, sha = want[i]
        if n and n == gone:
            assert i not in got
        elif gone:
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == sha and got[i].n_chars == len(got[i].text)
        else:
            assert got[i].text == t
    assert list(next(iter(got.values())).asDict()) == [c.split()[0] for c in SCHEMA.split(", ")]


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(0)
    for depth in (1, 3, 5):
        text = rng.integers(1, 5, 300)
        index = fm_index.FMIndex(np.concatenate([text, [0]]), depth)
        pattern = np.concatenate([text[40:80], rng.integers(1, 7, 40)])
        which, at, group = index.matches(pattern, np.array([len(pattern)]), depth)
        found = dict(zip(at.tolist(), group.tolist()))
        whole = [tuple(text[i : i + depth]) for i in range(len(text) - depth + 1)]
        for i in range(len(pattern) - depth + 1):
            here = tuple(pattern[i : i + depth])
            if i in found:
                places = index.order[index.group == found[i]]
                assert all(tuple(text[p : p + depth]) == here for p in places) and len(places) == whole.count(here)
        assert all(i in found for i in range(40 - depth + 1))


def test_suffix_order_sorts_again_only_what_ties(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 3, 60), np.zeros(9, np.int64), np.array([5]), np.tile([1, 2, 3], 20), rng.integers(0, 70_000, 50), np.arange(40)[::-1].copy()]
    for text in texts:
        for depth in (1, 2, 3, 5, 7, 20, 100):
            order, new = fm_index.suffix_order(text, depth)
            want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
            assert order.tolist() == want
            heads = [text[i : i + depth].tolist() for i in want]
            assert new.tolist() == [k == 0 or heads[k] != heads[k - 1] for k in range(len(heads))]
    taken, sort = [], np.argsort
    monkeypatch.setattr(fm_index.np, "argsort", lambda x, **k: taken.append(len(x)) or sort(x, **k))
    fm_index.suffix_order(rng.permutation(2000), 20)
    assert sum(taken) <= 2 * 2000


def test_stretches_of_documents_end_to_end():
    from lexmill.llm.hashing import window_hashes

    rng, gram = np.random.default_rng(2), substring_dedup.GRAM
    docs = [rng.integers(0, 4, n).astype(np.uint64) for n in (0, 30, 5, 19, 20, 21, 200, 0, 7)] + [np.tile(np.arange(3, dtype=np.uint64), 30)]
    n, h = np.array([len(d) for d in docs]), np.concatenate(docs)
    of, key, first, last = substring_dedup.stretches(window_hashes(h, gram), n, 20)
    got = list(zip(of.tolist(), key.tolist(), (first - (np.cumsum(n) - n)[of]).tolist(), (last - (np.cumsum(n) - n)[of]).tolist()))
    want = []
    for d, doc in enumerate(docs):
        grams = window_hashes(doc, gram)
        for i in range(len(doc) - 19):
            least = int(grams[i : i + 13].min())
            if want and want[-1][:2] == (d, least):
                want[-1] = (*want[-1][:3], i)
            else:
                want.append((d, least, i, i))
    assert got == want
    twice = substring_dedup._repeating(window_hashes(h, gram), n, of, key, gram)
    assert sorted(twice.tolist()) == sorted(k for d, k, _, _ in want if window_hashes(docs[d], gram).tolist().count(k) > 1)
    assert all(len(x) == 0 for x in substring_dedup.stretches(window_hashes(h[:3], gram), np.array([3]), 20))


# ---- decontamination
def edits_to_part(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_banded_alignment_is_exact():
    rng = random.Random(3)
    for _ in range(150):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(10, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(b))
            b[p : p + 1] = rng.choice([[], [rng.choice("abcd")], [b[p], rng.choice("abcd")]])
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 6))) + "".join(b) + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 6)))
        got, want = qgram_decontam.banded(qgram_decontam._codes(a), qgram_decontam._codes(t), 8)[0], edits_to_part(a, t)
        assert got == want or got > 8 and want > 8


def test_leaks(spark, empty):
    rng = random.Random(6)
    items = [(k, prose(rng, 35)) for k in range(8)] + [(8, "tiny bit"), (9, None), (10, "")]
    dirty = items[2][1].split()
    dirty[10] = "zzz"
    texts = [prose(rng, 50), prose(rng, 20) + "\n " + items[0][1].upper() + " " + prose(rng, 10), items[1][1], " ".join(dirty), "x tiny bit y", "tiny bits", None, "", items[3][1][: len(items[3][1]) // 2], items[4][1] + " " + items[4][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in qgram_decontam.leaks(docs, bench).collect())
    want = []
    for d, t in enumerate(texts):
        for k, item in items:
            a, b = qgram_decontam.normal(item), qgram_decontam.normal(t)
            if a and len(a) >= 12 and edits_to_part(a, b) <= int(0.05 * len(a)):
                want.append((d, k))
    want += [(4, 8), (9, 4)]
    assert found == sorted(want)
    small = qgram_decontam.leaks(docs, bench, block_chars=300)
    assert sorted((r.doc_id, r.item_id) for r in small.collect()) == found
    assert sorted(r.doc_id for r in qgram_decontam.without_leaks(docs, small).collect()) == sorted(set(range(len(texts))) - {d for d, _ in found})
    assert qgram_decontam.leaks(empty, bench).count() == 0
    assert qgram_decontam.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_with_an_edit():
    """Every edit within the budget is found, whatever the item's length and wherever the edit is."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    for length in range(12, 61):
        item = ("q" + "".join(rng.choice(letters) for _ in range(length - 2)).strip() + "z").replace("  ", " ab")
        item = qgram_decontam.normal(item)
        budget = int(qgram_decontam.ERROR_RATE * len(item))
        search = qgram_decontam.Search([(1, item)], qgram_decontam.Q, qgram_decontam.ERROR_RATE, None)
        for at in range(len(item)):
            for edited in (item[:at] + "#" + item[at + 1 :], item[:at] + item[at + 1 :], item[:at] + "#" + item[at:]):
                text = qgram_decontam.normal("some words before " + edited + " and some after")
                found = search.matches(text)
                want = edits_to_part(item, text) <= budget
                assert bool(found) == want, (length, at, edited)


def test_leaks_of_passages(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, 35, [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"])) for k in range(6)] + [(6, "abcdefghijklmnopqrstu"), (7, "short but not so short item of its own")]
    edited = items[2][1].split()
    for k in (7, 15, 23, 31):
        edited[k] = "zzzz"
    half = items[0][1][len(items[0][1]) // 2 :]
    texts = [prose(rng, 20) + " " + half, items[1][1][30:110], " ".join(edited), prose(rng, 10) + " " + " ".join(items[3][1].split()[1:-1]) + " " + prose(rng, 5), items[4][1][:40], "abcdefghijZlmnopqrstu", prose(rng, 200), items[5][1], items[7][1]]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in qgram_decontam.leaks(docs, bench, passage=qgram_decontam.PASSAGE).collect())
    assert found == [(0, 0), (1, 1), (2, 2), (3, 3), (5, 6), (7, 5), (8, 7)]
    assert found == sorted((r.doc_id, r.item_id) for r in qgram_decontam.leaks(docs, bench, passage=qgram_decontam.PASSAGE, block_chars=300).collect())


# ---- rules
def test_statistics(docs):
    got = {r.doc_id: r for r in mcd_rules.statistics(docs).collect()}
    for i, t, *_ in corpus():
        t = t or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_outliers(spark, empty):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "abcdef" for b in "ghijkl" for c in "mnopqrst"]
    rows = [(i, prose(rng, rng.randint(60, 200), vocabulary), "en", "s", 0, "") for i in range(150)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng, 80, vocabulary).split()), "en", "s", 0, "") for i in range(20)]
    rows += [(2000, prose(rng, 70, vocabulary), None, None, 0, "")]
    got = {r.doc_id: r for r in mcd_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[1000 + i].kept for i in range(20)) and got[2000].kept
    # the estimate agrees with the same steps in numpy
    f = mcd_rules.statistics(spark.createDataFrame(rows, SCHEMA)).filter("not base_failed and _lang = 'en'").toPandas()
    x = f[list(mcd_rules.FEATURES)].to_numpy()
    floor = np.diag(np.square(mcd_rules.FLOORS))
    q1, m, q3 = (np.sort(x, 0)[int(np.ceil(p * len(x))) - 1] for p in (0.25, 0.5, 0.75))
    scale = (q3 - q1) / 1.349
    clipped = np.clip((x - m) / np.maximum(scale, mcd_rules.FLOORS), -2, 2) * np.maximum(scale, mcd_rules.FLOORS)
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    ends = []
    for start in (np.diag(scale**2) + floor, np.cov(clipped.T, bias=True) + floor):
        at, cov = m, start
        for _ in range(3):
            d = dist(at, cov)
            inside = x[d <= np.sort(d)[int(np.ceil(0.75 * len(x))) - 1]]
            at, cov = inside.mean(0), np.cov(inside.T, bias=True) * mcd_rules.SHARE_FACTOR + floor
        ends.append((round(np.log(np.linalg.det(cov)) / 2, 9), len(ends), at, cov))
    _, _, m, cov = min(ends, key=lambda e: e[:2])
    inside = x[dist(m, cov) <= mcd_rules.REWEIGHT_QUANTILE]
    m, cov = inside.mean(0), np.cov(inside.T, bias=True) * mcd_rules.REWEIGHT_FACTOR + floor
    assert np.allclose([got[i].distance for i in f["doc_id"]], dist(m, cov), rtol=0.05, atol=0.05)
    assert mcd_rules.judge(empty).count() == 0


# ---- classifiers
def test_quality(spark, data, empty):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 3) == 1
    machine = fm_quality.fit(docs, labels.filter(~held))
    rows = fm_quality.score(docs, machine, held).join(labels, "doc_id").collect()
    right = [r.predicted == r.quality for r in rows if r.held_out]
    assert sum(right) >= 0.9 * len(right) and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(None, None, None), (1, "", 5), (1, "", 5), (2, "x" * 100_000, None)], "doc_id long, text string, n_chars long")
    assert fm_quality.score(odd, machine, F.lit(False)).count() == 4
    assert fm_quality.fit(docs, labels.limit(0)) is None and fm_quality.score(odd, None, F.lit(False)).filter("score = 0.5").count() == 4
    assert fm_quality.score(empty, machine, F.lit(False)).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=(fm_quality.SIZE, 4)).astype(np.float32) * 0.1, rng.normal(size=fm_quality.SIZE).astype(np.float32)
    at, x = fm_quality.vector("some words and some more #words", None)
    z = 0.3 + float(w[at] @ x) + sum(float(v[at[i]] @ v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(fm_quality.Machine(0.3, w, v).score(at, x) - 1 / (1 + math.exp(-z))) < 1e-4


def test_language(spark, data, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.filter(~held))
    rows = langid.predict(docs, model, held).join(docs, "doc_id").collect()
    right = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(right) >= 0.95 * len(right)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (3, "123 !?"), (None, "the and of")], "doc_id long, text string")
    got = langid.predict(odd, model, F.lit(False)).collect()
    assert [r.lang_pred for r in got[:4]] == ["und"] * 4 and got[4].lang_pred in model.languages and all(0 <= r.score <= 1 for r in got)
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert {r.lang_pred for r in langid.predict(odd, None, F.lit(False)).collect()} == {"und"}
    assert langid.predict(empty, model, F.lit(False)).count() == 0


# ---- pages
def test_blocks():
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a>Menu</a></ul></nav><header>Top</header><main><h1>Head &amp; line</h1><p>One\n  <b>two<p>three&#33; &lt;x&gt;<div class='comments'>said</div><aside>side</aside><table><tr><td>c1<td>c2</table><p>last</main><footer>&copy;</footer>"
    assert [x for x, k in html_diff.blocks(page) if k == 2] == ["Head & line", "One two", "three! <x>", "c1", "c2", "last"]
    assert html_diff.blocks(None) == [] and html_diff.blocks("") == [] and [x for x, _ in html_diff.blocks("a < b <p>c<")] == ["a < b", "c<"]


def test_names_of_elements():
    def kinds(page):
        return {x: k for x, k in html_diff.blocks(page)}

    for name in ("has-sidebar", "post share-enabled", "layout_with_menu", "entry-header", "content no-sidebar"):
        assert kinds(f"<div class='{name}'><p>x</div>") == {"x": 1}
        assert kinds(f"<main class='{name}'><p>x</main>") == {"x": 2}
    for name in ("sidebar", "post site-footer", "main_nav", "comments", "cookie-notice", "share-buttons", "ad-slot"):
        assert kinds(f"<div class='{name}'><p>x</div>") == {"x": 0}
        assert kinds(f"<article id='{name}'><p>x</article>") == {"x": 2}
        assert kinds(f"<div class='{name}'><p>w<div><article>x</article></div>y</div><div class='{name}'>z</div>") == {"w": 1, "x": 2, "y": 1, "z": 0}
    assert kinds("<article><header class='header entry-header'><h1>Head</h1></header>x<div class='related'>y</div></article>") == {"Head": 2, "x": 2, "y": 0}
    assert kinds("<article><p>so <math><mi>a</mi><mo>=</mo><annotation>\\a=b</annotation><mi>b</mi></math> holds</article>") == {"so a=b holds": 2}


def test_shared_lines():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(html_diff.shared_lines(a, b))
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


def test_pages_lose_their_frame(spark):
    frame = "<div>Site name</div><div>{}</div><div>All rights reserved</div>"
    rows = [(i, f"http://h.org/a/{i}", f"<html><body>{frame.format(f'Own text {i}')}</body></html>") for i in range(6)]
    rows += [(10, "http://h.org/b/1", "<body><nav>Menu</nav><article><h1>T</h1><p>same</article>"), (11, "http://h.org/b/2", "<body><nav>Menu</nav><article><h1>T</h1><p>same</article>")]
    rows += [(12, None, None), (13, "::bad", ""), (14, "http://alone.org/", "<p>x</p>"), (14, "http://alone.org/", "<p>x</p>")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = collections.defaultdict(list)
        for r in html_diff.main_text(df).collect():
            got[r.page_id].append(r.text)
        assert all(got[i] == [f"Own text {i}"] for i in range(6))
        assert got[10] == got[11] == ["T\nsame"] and got[12] == got[13] == [""] and got[14] == ["x", "x"]
    assert html_diff.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_keep_what_they_share(spark):
    """Pages that quote one sentence keep it; a line of links that three pages share goes, and only by their pairing."""
    article = "<body><p>Frame</p><article><h1>Head {0}</h1><p>Own {0}<p>A <a href=x>quoted</a> sentence.<p><a href=y>Share</a> <a href=z>Print</a></article></body>"
    rows = [(i, f"http://q.org/a/{i}", article.format(i)) for i in range(3)] + [(9, "http://r.org/a/9", article.format(9))]
    got = {r.page_id: r.text for r in html_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head {i}\nOwn {i}\nA quoted sentence." for i in range(3))
    assert got[9] == "Frame\nHead 9\nOwn 9\nA quoted sentence.\nShare Print"


def brute_main_text(rows):
    """Pairs by comparing each page with all of its host, and lines by the full table of common subsequences."""
    pages = [(k, *html_diff.address(url), [x for x in html_diff.blocks(page) if x[1]]) for k, (_, url, page) in enumerate(rows)]
    order = sorted((p for p in pages if p[3]), key=lambda p: (p[1], p[2]))
    runs = []
    for p in order:
        if runs and runs[-1][0][1] == p[1] and [x for x, _ in runs[-1][0][3]] == [x for x, _ in p[3]]:
            runs[-1].append(p)
        else:
            runs.append([p])

    def common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        return table[0][0]

    def prefix(a, b):
        return len(a) if a == b else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    out = {k: [] for k, *_ in pages}
    for at, run in enumerate(runs):
        near = []
        for step in (1, 2):
            for j in (at - step, at + step):
                if 0 <= j < len(runs) and runs[j][0][1] == run[0][1] and [x for x, _ in runs[j][0][3]] != [x for x, _ in run[0][3]]:
                    other = runs[j][-1] if j < at else runs[j][0]
                    near.append((-prefix(run[0][2] if j < at else run[-1][2], other[2]), len(near), [x for x, _ in other[3]]))
        for p in run:
            lines = [x for x, _ in p[3]]
            out[p[0]] = (p[3], lines, min(near)[2] if near else None)
    return pages, out, common


def test_whole_pages_against_brute_force(spark):
    """Each page loses as many open lines as the longest common subsequence with its nearest page has, all of them shared."""
    rng = random.Random(12)
    lines = [f"line {k}" for k in range(7)]
    rows = [(k, f"http://h{k % 3}.org/{rng.choice('ab')}/{rng.choice('xyz')}{k:02}", "<body>" + "".join(f"<div>{x}</div>" for x in rng.choices(lines, k=rng.randint(0, 6))) + f"<div>own {rng.randint(0, 30)}</div></body>") for k in range(60)]
    pages, want, common = brute_main_text(rows)
    got = {r.page_id: r.text.split("\n") if r.text else [] for r in html_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    changed = 0
    for k, _, _, _ in pages:
        _, own, other = want[k]
        lost = common(own, other) if other else 0
        assert len(own) - len(got[k]) == lost
        rest = iter(own)
        assert all(x in rest for x in got[k])
        changed += lost > 0
    assert changed > 10


def test_runs_of_copies_have_one_partner(spark):
    frame = "<body><div>Menu</div><p>{}</p><div>Legal</div></body>"
    rows = [(i, f"http://c.org/a/{i:02}", frame.format("copied text")) for i in range(12)] + [(20, "http://c.org/b/1", frame.format("other text")), (21, "http://c.org/b/0", "")]
    rng = random.Random(3)
    rows += [(100 + i, f"http://h{i % 2}.org/{i // 40}/{i:03}", frame.format(rng.choice("abc")) + rng.choice(["", "<p>more"])) for i in range(80)]
    results = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found = html_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
            results.append({r.page_id: r.text for r in found.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1]
    assert {i: t for i, t in results[0].items() if i < 100} == {i: "copied text" for i in range(12)} | {20: "other text", 21: ""}


def test_differencing_acts_on_articles(spark):
    page = "<body><div>Menu</div><article><h1>Title {0}</h1><p>Body of page {0}, which is longer than its template</p><p><a href='/s'>Share this page</a></p></article></body>"
    teasers = "<body><div>Menu</div><article>Teaser {0}</article><div>The plain body of {0}</div></body>"
    rows = [(i, f"http://t.org/a/{i}", page.format(i)) for i in range(4)] + [(10 + i, f"http://u.org/a/{i}", teasers.format(i)) for i in range(3)]
    version = "<body><article><h1>News</h1><p>The same long story on each of these pages</p><p>version {}</p></article></body>"
    rows += [(20 + i, f"http://v.org/a/{i}", version.format(i)) for i in range(4)]
    got = {r.page_id: r.text for r in html_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"Title {i}\nBody of page {i}, which is longer than its template" for i in range(4)]
    assert [got[10 + i] for i in range(3)] == [f"Teaser {i}\nThe plain body of {i}" for i in range(3)]
    assert [got[20 + i] for i in range(4)] == [f"News\nThe same long story on each of these pages\nversion {i}" for i in range(4)]
