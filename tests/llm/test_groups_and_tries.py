"""Hard negatives, SuperMinHash groups and the prefix trie, against plain versions over awkward cases; all twins of the corpus queries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from compare import compare, connect
from samples import LOWER, empty, words

from hazeline.llm import catalog, negative_mining, prefix_trie, superminhash
from hazeline.llm.negative_mining import Cells, Codebooks, best_in, hard_negatives
from hazeline.llm.superminhash import near_duplicates, signatures

SMALL = "/root/testdata/sf0.001"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no given tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twins(spark, name):
    assert compare(catalog.QUERIES[name](spark, SMALL), connect(SMALL), catalog.ORACLES[name]) == []


def test_ids_cost_no_python_numbers(spark, rows):
    """Encoding with ids holds little more than encoding without them: the packed ids are the column's values."""
    import tracemalloc

    import pyarrow as pa
    from public_tokenizers import path

    from hazeline.llm import sentencepieces

    encode = []
    frame = type("F", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, f, schema: encode.append(f)})()
    texts = [(t or "").encode() for _, t in rows if t and len(t) < 5000] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    peaks = []
    for with_ids in (False, True):
        sentencepieces.encode_pieces(frame, path("piece_bpe_32k.model"), with_ids=with_ids)
        for _ in encode[-1](iter([batch])):  # fills the stores
            pass
        tracemalloc.start()
        for out in encode[-1](iter([batch])):
            if with_ids:
                assert [len(x) for x in out.column("ids").to_pylist()] == out.column("n_tokens").to_pylist()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 100 << 20


@pytest.mark.parametrize("text", ["x@" + "a." * 20_000 + "org", "a" * 80_000 + "1", "Mr. " + "X" + "y" * 80_000, "1@" * 40_000, "mail z@" + "b" * 80_000])
def test_long_runs_are_searched_in_bounded_steps(spark, text):
    import time

    from hazeline.llm.surrogates import replace_personal_data

    table = spark.createDataFrame([(1, text), (2, "mail an ute.x@post.example.org, danke"), (None, None)], "doc_id long, text string")
    replace_personal_data(table.limit(0), "key").collect()
    started = time.time()
    got = {r.doc_id: r for r in replace_personal_data(table, "key").collect()}
    assert time.time() - started < 30
    assert got[2].n_entities == 1 and "ute.x@post" not in got[2].text and got[None].text is None


# Hard negatives ----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score double, shard long, cell int"


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        x = centres[i % 6] + 0.3 * rng.normal(size=8)
        rows.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), int(rng.integers(0, 10))))
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(250)]  # copies of one vector
    rows += [(2000, rows[3][1][:5], 1), (2001, [], 2), (2100, None, 1), (2101, [0.1, None], 1), (2102, [float("nan")] * 8, 1),
             (2103, [float("inf")] + [0.0] * 7, 2), (2104, rows[1][1], None), (None, rows[7][1], 4), (100, rows[9][1], 5), (2200, [0.0] * 8, 3),
             (2300, [1e30, -1e30] + [0.0] * 6, 2), (12, rows[12][1], rows[12][2])]
    return rows


def plain_negatives(rows, relabel_every=7):
    meant = []
    for vec_id, x, label in rows:
        if x is not None and label is not None and all(v is not None and np.isfinite(v) for v in x):
            q = [max(-2**25, min(2**25, int(np.floor(256 * float(np.float32(v)))))) for v in x]
            meant.append((vec_id, q, (label + 1) % 10 if vec_id is not None and vec_id % relabel_every == 0 else label))
    out = []
    for a in meant:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[1], r[1])), r[0] is None, r[0] or 0, r) for r in meant if r is not a), key=lambda t: t[:3])
        scored = [(-s, r) for s, _, _, r in scored]
        for p, r in [(s, r) for s, r in scored if r[2] == a[2] and r[0] != a[0]][:5]:
            inside = [(s, n) for s, n in scored if n[2] != a[2] and 30 * p <= 100 * s <= 90 * p][:10]
            out += [(a[0], r[0], k, n[0], p, s) for k, (s, n) in enumerate(inside, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [2048, 40])
def test_hard_negatives(spark, monkeypatch, shard):
    monkeypatch.setattr(negative_mining, "LEAST_SHARD", shard)
    monkeypatch.setattr(negative_mining, "MOST_SHARD", shard)
    monkeypatch.setattr(negative_mining, "BLOCK_ANCHORS", shard // 10)
    rows = vectors()
    table = spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], VECTORS).repartition(4)
    assert collected(hard_negatives(table, relabel_every=7)) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives(spark.createDataFrame([], VECTORS), relabel_every=7).collect() == []
    unusable = spark.createDataFrame([(100, None, 1, 0.0, 0, 0), (200, [1.0], None, 0.0, 0, 0)], VECTORS)
    assert hard_negatives(unusable).collect() == []


def test_walk_visits_cells_in_order_and_stops_early():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 16)) * 200
    x = (np.repeat(centres, 50, axis=0) + rng.normal(size=(800, 16)) * 5).astype(int)
    books = Codebooks(negative_mining.codebook(x[:, :8].astype(float), 16), negative_mining.codebook(x[:, 8:].astype(float), 16))
    (i, _), (j, _) = negative_mining.nearest(x[:, :8], books.first), negative_mining.nearest(x[:, 8:], books.second)
    table = pa.table({"cell": (i * 16 + j).astype(np.int32), "vec_id": np.arange(800), "label": np.zeros(800, np.int64), "row": np.arange(800),
                      "vector": pa.array([v.astype("<i4").tobytes() for v in x], pa.binary())})
    cells = Cells(table, books)
    q = x[3].astype(float)
    walk = list(cells.by_bound(q, 8))
    bounds = [b for b, _ in walk]
    assert bounds == sorted(bounds, reverse=True) and sum(s.stop - s.start for _, s in walk) == 800
    assert all((cells.x[s] @ q).max() <= b + 1e-6 for b, s in walk)
    seen = []
    original = cells.by_bound
    cells.by_bound = lambda *a: (seen.append(c) or c for c in original(*a))
    best = best_in(cells, 8, q, 3, 3, 0, True, [-(1 << 62)], [1 << 62], 5)
    scores = x @ x[3]
    want = sorted((-int(s), k) for k, s in enumerate(scores) if k != 3)[:5]
    assert [(-s, k) for _, s, k in best] == want
    assert len(seen) < len(walk) / 2


# SuperMinHash ------------------------------------------------------------------------------------------------------

def in_turn(shingles, places):
    """The published form: one shingle after the other, exchanges in a list."""
    out = [None] * places
    for d in shingles:
        order = list(range(places))
        for step in range(places):
            fraction, k = superminhash._draw(np.array([d], np.uint64), step, places)
            order[step], order[int(k[0])] = order[int(k[0])], order[step]
            value = step << 32 | int(fraction[0])
            if out[order[step]] is None or value < out[order[step]]:
                out[order[step]] = value
    return out


def test_signatures_are_those_of_the_sequential_form():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 60, 400)]
    got = signatures(np.repeat(np.arange(5), [len(s) for s in sets]), np.concatenate(sets), 6)
    assert [r.tolist() for r in got[:5]] == [in_turn(s, 128) for s in sets]
    assert (got[5] == np.iinfo(np.uint64).max).all()


def test_estimates_vary_less_than_independent_minima():
    rng = np.random.default_rng(2)
    found = []
    for _ in range(150):
        x = rng.integers(0, 2**63, 360).astype(np.uint64)
        got = signatures(np.repeat([0, 1], 240), np.r_[x[:240], x[120:]], 2)
        found.append((got[0] == got[1]).mean())
    similarity = 120 / 360
    assert abs(np.mean(found) - similarity) < 0.01
    assert np.std(found) < 0.9 * (similarity * (1 - similarity) / 128)**0.5


def plain_groups(rows, width, percent):
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[s:s + width]) for s in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    members = defaultdict(list)
    for a in range(len(rows)):
        members[root(a)].append(rows[a][0])
    out = []
    for a, (doc_id, _) in enumerate(rows):
        ids = [i for i in members[root(a)] if i is not None]
        low = min(ids) if ids else None
        out.append((doc_id, len(sets[a]), low, doc_id == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_near_duplicates(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(superminhash, "BLOCK_SHINGLES", block)
    assert collected(near_duplicates(docs)) == plain_groups(rows, 4, 80)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(empty(spark)).collect() == []


def test_few_texts_are_shuffled_for_candidates(spark, monkeypatch):
    """The sieve lets every chosen text through, the repeated and the short ones too, and few others; also with a few bits only."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 50 = 1, 'x', concat('text ', id DIV 3)) AS text").union(
        spark.createDataFrame([(None, None), (None, "text 7")], "doc_id long, text string"))
    chosen = docs.where("text = 'x' OR doc_id % 100 = 0").selectExpr("xxhash64(text) AS rep_hash", "text")
    texts = {r.text for r in chosen.collect()}
    want = collected(docs.where(docs.text.isin(*texts)))
    for most in (superminhash.MOST_SIEVE_BITS, superminhash.PAGE_BITS):
        monkeypatch.setattr(superminhash, "MOST_SIEVE_BITS", most)
        got = collected(superminhash.sieved(docs, chosen.select("rep_hash")))
        assert [r for r in got if r[1] in texts] == want
        assert len(want) <= len(got) < len(want) + 120
    # In the plan the sieve lies below the join that shuffles texts.
    plan = superminhash.texts_of(docs, docs.where("doc_id < 5").selectExpr("struct(doc_id, xxhash64(text) AS text_hash) AS rep"))
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join, sieve = (next(i for i, x in enumerate(lines) if "Join" in x and y in x) for y in ("rep_hash", "page"))
    assert join < sieve and lines[join].index("Join") < lines[sieve].index("Join")


def test_union_find_keeps_what_is_connected(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "MOST_NODES", 20)
    rng = random.Random(4)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)]
    trees = [tuple(r) for r in superminhash.union_find(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()]

    def parts(edges):
        up = {}
        for a, b in edges:
            ra, rb = a, b
            while up.get(ra, ra) != ra:
                ra = up[ra]
            while up.get(rb, rb) != rb:
                rb = up[rb]
            up[ra], up[rb] = rb, rb
        groups = defaultdict(set)
        for x in up:
            r = x
            while up[r] != r:
                r = up[r]
            groups[r].add(x)
        return sorted(sorted(g) for g in groups.values() if len(g) > 1)

    assert parts(trees) == parts(pairs)


# Prefix trie -------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, path string, shard int, words int"


def turns(seed=2):
    rng = random.Random(seed)
    said = ["ja", "nein  doch", "", "a b\tc", "é \x0b ß"]
    rows = []
    for c in range(120):
        for t in range(rng.choice([0, 1, 2, 3, 5])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(said)))
    rows += [(c, t, "user", "copy") for c in range(200, 290) for t in range(3)]  # copies of one conversation
    rows += [(300, t, "user", str(t % 3)) for t in range(100)] + [(301, t, "user", str(t % 3)) for t in range(99)]  # long ones
    rows += [(302, None, "user", "first"), (302, 0, None, None), (302, 1, "", ""), (303, 0, "user", None), (None, 0, "user", "nobody"),
             (-40, 0, "user", "below"), (-39, 0, "user", "zero"), (-39, 1, "user", "x " * 5000)]
    rng.shuffle(rows)
    return rows


def plain_trie(rows, every=20, most=3):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    for c in own:
        own[c].sort()
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1) if every else 0
        base = c - (abs(c) % every) * (1 if c >= 0 else -1) if every else c
        rebuilt[c] = tuple(x[2:] for x in own.get(base, [])[:h]) + tuple(x[2:] for x in t[h:])
    members, kids, leaves, saved, out = defaultdict(list), defaultdict(list), {}, {}, []
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0)
        ends = ",".join(str(c) for c in sorted(members[k]) if rebuilt[c] == k)
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,columns", [(4096, 32), (25, 4)])
def test_prefix_trie(spark, monkeypatch, shard, columns):
    monkeypatch.setattr(prefix_trie, "LEAST_SHARD", shard)
    monkeypatch.setattr(prefix_trie, "MOST_SHARD", shard)
    monkeypatch.setattr(prefix_trie, "COLUMNS", columns)
    rows = turns()
    table = spark.createDataFrame([(*r, "?", 1, 2) for r in rows], TURNS).repartition(4)
    assert collected(prefix_trie.prefix_trie(table, every=20, most=3)) == plain_trie(rows)
    assert collected(prefix_trie.prefix_trie(table)) == plain_trie(rows, every=0)


def test_prefix_trie_of_equal_and_empty_conversations(spark):
    rows = [(20, 0, "user", "a"), (21, 0, "user", "b")]  # 21 takes over what it can from 20
    rows += [(c, 0, "user", "same") for c in range(1000, 1003)]
    table = spark.createDataFrame([(*r, "?", 1, 2) for r in rows], TURNS)
    assert collected(prefix_trie.prefix_trie(table, every=20, most=3)) == plain_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS), every=20, most=3).collect() == []


def test_repeated_turns_count_as_turns(spark):
    rows = [(7, 1, "user", "a"), (7, 1, "user", "a"), (8, 1, "user", "a")]
    got = collected(prefix_trie.prefix_trie(spark.createDataFrame([(*r, "?", 1, 2) for r in rows], TURNS)))
    assert [(r[0], r[1], r[3]) for r in got] == [(7, 0, 2), (7, 1, 2), (7, 2, 1)]


def test_signatures_of_much_text_take_little_memory(spark, monkeypatch):
    """Six megabytes in one record batch: what the signatures hold at once is bounded by a part of it."""
    import tracemalloc

    import pyarrow as pa

    found = {}

    class Docs:
        def mapInArrow(self, run, schema):
            found["run"] = run

    monkeypatch.setattr(superminhash, "text_of", lambda *_: Docs())
    superminhash.document_signatures(None, 4)
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1500)).encode() for _ in range(2000)]
    numbers = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, pa.array(texts, pa.binary()), numbers], names=["doc_id", "text", "text_hash"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in found["run"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 80 << 20, peak / (1 << 20)
