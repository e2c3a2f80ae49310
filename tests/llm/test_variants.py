"""Periodic runs, SimHash groups and spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqflow.llm import catalog, periodic_runs, recompression, simhash, spelling


def pairs_of(edge):
    return [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]


# 11 --------------------------------------------------------------------------------------------

def brute_runs(w):
    best = {}
    for q in range(len(w) // 4, 0, -1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                best[start, i + q] = q
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def text_with_runs(rng, letters=3):
    w = []
    for _ in range(rng.randint(0, 5)):
        period = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        w += rng.choice([period, (period * 12)[:rng.randint(1, 70)]])
    return w


def test_common_extensions_equal_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        w = text_with_runs(rng, 2)
        if len(w) < 2:
            continue
        g = recompression.Grammar(np.array([-1, *w, -2], np.int64))
        places = [(i, j) for i in range(len(w) + 1) for j in range(len(w) + 1) if i != j]
        a, b = np.array(places).T + 1
        for (i, j), ahead, back in zip(places, g.extend(a, b).tolist(), g.extend(a, b, -1).tolist()):
            assert w[i:i + ahead] == w[j:j + ahead] and w[i - back:i] == w[j - back:j]
            assert max(i, j) + ahead == len(w) or w[i + ahead] != w[j + ahead]
            assert min(i, j) == back or w[i - back - 1] != w[j - back - 1]


@pytest.mark.parametrize("candidates", [5, 1 << 20])
def test_runs_equal_brute_force(monkeypatch, candidates):
    monkeypatch.setattr(periodic_runs, "CANDIDATES", candidates)
    rng = random.Random(5)
    for _ in range(80):
        docs = [text_with_runs(rng) for _ in range(rng.randint(1, 6))]
        found = periodic_runs.find_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs], np.int64))
        got = defaultdict(list)
        for of, *r in zip(*(v.tolist() for v in found)):
            got[of].append(tuple(r))
        assert [got[i] for i in range(len(docs))] == [brute_runs(d) for d in docs]


def test_periodic_runs_on_edges(edge, none):
    rows = periodic_runs.periodic_runs(edge)
    assert rows.count() == edge.count() and periodic_runs.periodic_runs(none).count() == 0
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in rows.collect())
    want = Counter()
    for i, t in pairs_of(edge):
        w = (t or "").encode().split()
        want[i, len(w), tuple(brute_runs(w)), "w" if i == 8 else b" ".join(w).decode()] += 1
    assert got == want


def test_periodic_runs_query_digests(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{x}" for x in text_with_runs(rng, 4))) for i in range(60)] + [(60, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.op11(spark, str(tmp_path)).collect()}
    for i, t in docs:
        w = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs, r = brute_runs(w), got[i]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        sha = lambda x: __import__("hashlib").sha256(x.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{size},{q}\n" for s, size, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))


# 12 --------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(keys, near):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for i in keys:
        for j in keys:
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64)
        pairs.append((x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9)))))
    counts = lambda x: [(x >> s & 3).bit_count() for s in range(0, 64, 2)]
    p, q = simhash._embed(np.array(pairs, np.uint64).T)
    for (x, y), d in zip(pairs, np.bitwise_count(p ^ q).tolist()):
        assert d == sum(abs(a - b) for a, b in zip(counts(x), counts(y))) <= (x ^ y).bit_count()
    signed = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x, _ in pairs], "fp long")
    assert [r.e for r in signed.select(simhash.embedding(F.col("fp")).alias("e")).collect()] == p.astype(np.int64).tolist()
    masks = simhash.grid_masks(3)
    for x, y in pairs:
        if (x ^ y).bit_count() <= 3:
            a, b = simhash._embed(np.array([x, y], np.uint64)).tolist()
            assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("cell_rows", [32, 4096])
def test_near_links_connect_what_is_near(spark, cell_rows):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    signed = {int(np.uint64(x).astype(np.int64)): x for x in fps}
    rows = spark.createDataFrame([(k,) for k in signed], "fp long").repartition(3)
    links = {(r.a, r.b) for r in simhash.near_links(rows, 3, cell_rows).collect()}
    want = brute_groups(sorted(signed), lambda i, j: (signed[i] ^ signed[j]).bit_count() <= 3)
    linked = brute_groups(sorted(signed), lambda i, j: (i, j) in links)
    assert linked == want and len(set(want.values())) > 100


def test_simhash_groups_on_edges(spark, edge, none, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, edge.where("doc_id IS NOT NULL").select("doc_id", "text").distinct()):
        fps = {i: brute_fingerprint(t) for i, t in pairs_of(df)}
        want = brute_groups(sorted(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()} == {
            i: (f"{fps[i]:016x}", want[i]) for i in fps}
    rows = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(edge).collect())
    zero = "0" * 16
    assert sum(rows.values()) == edge.count() and simhash.simhash_groups(none).count() == 0
    assert rows[None, zero, 3] == rows[3, zero, 3] == rows[4, zero, 3] == 1 and rows[6, f"{brute_fingerprint('one'):016x}", 6] == 2
    assert rows[None, f"{brute_fingerprint('alpha beta gamma delta epsilon zeta'):016x}", 1] == 1


# 13 --------------------------------------------------------------------------------------------

def one_edit(u, v):
    u, v = sorted((u, v), key=len)
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute_spelling(rows, slip):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % slip else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_composition_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 30))})
        m = spelling.Acceptor(words)
        got = [tuple(sorted(p)) for p in spelling.compose_one_edit(m)]
        assert sorted(got) == [(u, v) for u in words for v in words if u < v and one_edit(u, v)]


def test_acceptor_is_minimal():
    m = spelling.Acceptor(sorted(a + b for a in ("un", "re", "") for b in ("do", "dos", "tie", "ties")))
    live, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in live:
            live.add(s)
            todo += m.arcs[s].values()
    languages = {}
    def ends(s):  # noqa: E306
        return frozenset([""] * m.final[s]) | {c + e for c, t in m.arcs[s].items() for e in ends(t)}
    for s in live:
        assert languages.setdefault(ends(s), s) == s


@pytest.mark.parametrize("partition_letters", [1, 12, 200_000])
def test_spelling_groups_equal_brute_force(spark, partition_letters):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 14))) for _ in range(25)] + ["x" * 40, "x" * 41]
    words = ["zymurgist"] * 400 + ["zymurgis"] * 60 + ["zymurgi"] * 8   # a form that has a form
    for s in stems:
        for times in (150, 25, 5):
            k = rng.randrange(len(s))
            words += [rng.choice([s[:k] + s[k + 1:], s[:k] + "b" + s[k:], s[:k] + "ÿ" + s[k + 1:]])] * times
        words += [s.upper() if s.isascii() else s] * 20
    rng.shuffle(words)
    rows = [(i % 50 if i % 7 else None, "; ".join(words[k:k + 40])) for i, k in enumerate(range(0, len(words), 40))] + [(1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = spelling.spelling_groups(df, slip=23, partition_letters=partition_letters).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_spelling(rows, 23)
    assert any(r.form and r.root != r.form for r in got)


def test_spelling_on_edges(edge, none):
    assert spelling.spelling_groups(none).count() == 0
    assert {tuple(r) for r in spelling.spelling_groups(edge, occurrences=3).collect()} == {("epsilon", None, "epsilon", 3, 0, None)}
    with pytest.raises(ValueError):
        spelling.spelling_groups(none, letters=5)


def test_packing_numbers_needs_little_memory():
    import tracemalloc
    from seqflow.llm.elias_fano import pack, unpack
    values = np.random.default_rng(1).integers(0, 1 << 40, 100_001).astype(np.uint64)
    tracemalloc.start()
    data = pack(values, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # a number took 40 words of eight bytes
    spare = np.append(np.frombuffer(data, np.uint8), np.zeros(9, np.uint8))
    assert (unpack(spare, np.arange(len(values)), 40) == values).all()


def test_pairs_are_added_up_as_they_come(monkeypatch):
    import pyarrow as pa
    from seqflow.llm import lm_trie as L
    rng = np.random.default_rng(2)
    blobs, want = [], {}
    for _ in range(9):
        first, second = (rng.integers(1, 30, 200).astype(np.uint64) for _ in range(2))
        _, a, b, n = L._add_up(first, second)
        for pair in zip(first.tolist(), second.tolist()):
            want[pair] = want.get(pair, 0) + 1
        blobs.append(L._pair_blob(a, b, n))
    rows = []
    add_up = L._add_up
    monkeypatch.setattr(L, "_add_up", lambda *c: rows.append(len(c[0])) or add_up(*c))
    monkeypatch.setattr(L, "MERGE_PAIRS", 300, raising=False)
    out = L._merge(pa.table({"shard": pa.array([3] * 9, pa.int32()), "blob": pa.array(blobs, pa.binary())}))
    first, second, n = L._read_pairs(out.column("blob")[0].as_py())
    assert dict(zip(zip(first.tolist(), second.tolist()), n.tolist())) == want
    assert max(rows) < 9 * 150  # not all at once
