"""The ten operators against brute force on small fixtures, with odd rows among them."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import co_training, common, hilbert_ann, hmm_scoring, line_dedup, minhash_dedup, packing, quality_rules, secret_scan, soft_mixing, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, kept string"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared lines, nulls, empty and long ones, and a repeated row."""
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta,", "été", "the", "of", "and", "x1", "#tag", "zeta.", "Straße"] + [f"w{i}" for i in range(200)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [line(6) for _ in range(4)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append("\n".join([line(r.randrange(5, 60)), r.choice(shared), line(8)]))
        elif kind == 1:
            texts.append(texts[i - 1])
        elif kind == 2:
            w = texts[i - 2].split(" ")
            w[len(w) // 2] = "changed"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(r.choice(["", None, "one", "two words", " \t ", "\n\n", "a b a b a b a b"]))
        elif kind == 4:
            texts.append("  " + shared[0].upper() + " \n" + line(30) + "\n" + shared[1])
        else:
            texts.append(line(5) + " " + " ".join(["again and again"] * 20))
    texts[-1] = line(6000)
    rows = [(i, t, r.choice(["en", None]), r.choice(["a", "b", None]), len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# op 1


def test_hmm_forward_is_the_sum_over_all_paths():
    r = np.random.default_rng(0)
    model = hmm_scoring.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), r.random((5, 2)) + 0.1)
    sequences = [[0, 1, 2, 3], [4], [2, 2, 1]]
    got = model.forward(np.concatenate(sequences), np.array([4, 1, 3]))
    for seq, log in zip(sequences, got):
        alpha = model.start * model.ratio[seq[0]]
        for c in seq[1:]:
            alpha = (alpha @ model.move) * model.ratio[c]
        assert math.isclose(log, math.log(alpha.sum()), rel_tol=1e-12)


def test_hmm_expected_counts():
    r = np.random.default_rng(1)
    model = hmm_scoring.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.3, 0.7]]), r.random((3, 2)) + 0.2)
    seq = [0, 2, 1, 1]
    starts, moves, emits, _ = model.expect(np.array(seq), np.array([4]))
    want_s, want_m, want_e, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for path in np.ndindex(2, 2, 2, 2):
        p = model.start[path[0]] * model.ratio[seq[0], path[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.ratio[c, b]
        total += p
        want_s[path[0]] += p
        for a, b in zip(path, path[1:]):
            want_m[a, b] += p
        for c, s in zip(seq, path):
            want_e[c, s] += p
    for got, want in ((starts, want_s), (moves, want_m), (emits, want_e)):
        assert np.allclose(got, want / total, atol=1e-5)


def test_hmm_scores(docs, spark):
    got = {r.doc_id: r for r in hmm_scoring.score(docs, chunk_tokens=300).collect()}
    tokens = {r.doc_id: [w.encode() for w in words_of(ascii_lower(r.text or ""))] + [b""] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(tokens)
    for i, ws in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert got[i].score < 0
    better = [got[i].score > got[i].base_score for i in tokens if not held[i] and len(tokens[i]) > 3]
    assert sum(better) > 0.9 * len(better)


def test_hmm_score_matches_plain_sums(spark):
    """Training and scores against forward and backward sums in plain loops."""
    r, states = random.Random(3), 3
    texts = {i: " ".join(r.choice("the cat sat on a mat and ran far away today".split() + [f"rare{i}"]) for _ in range(r.randrange(0, 14))) for i in range(40)}
    got = {x.doc_id: x for x in hmm_scoring.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), states=states, iterations=3, chunk_tokens=40).collect()}
    tokens = {i: [w.encode() for w in words_of(t)] + [b""] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    n, v, once = sum(c.values()), len(c), sum(k == 1 for k in c.values())
    size = hmm_scoring.CLASSES
    cls = lambda w: zlib.crc32(w) % size if w in c else size
    p0 = np.zeros(size + 1)
    for w, k in c.items():
        p0[cls(w)] += (k + 1) / (n + v + 1)
    p0[-1] = 1 / (n + v + 1)
    unseen = min(max(once / n, p0[-1]), 0.5)
    model, before = hmm_scoring.first_model(states), -math.inf
    start, move, ratio = model.start, model.move, model.ratio

    def sums(words):
        """(forward, backward) of ratios, unscaled."""
        b = [ratio[cls(w)] for w in words]
        f = [start * b[0]]
        for x in b[1:]:
            f.append((f[-1] @ move) * x)
        back = [np.ones(states)]
        for x in b[:0:-1]:
            back.append(move @ (x * back[-1]))
        return b, f, back[::-1]

    for _ in range(3):
        starts, moves, emits, log = np.ones(states), np.ones((states, states)), np.zeros((size + 1, states)), 0.0
        for i in train:
            b, f, back = sums(tokens[i])
            total = f[-1].sum()
            log += math.log(total)
            for t, w in enumerate(tokens[i]):
                emits[cls(w)] += f[t] * back[t] / total
                if t:
                    moves += f[t - 1][:, None] * move * (b[t] * back[t])[None] / total
            starts += f[0] * back[0] / total
        log /= emits.sum()
        seen = p0[:-1] / (1 - p0[-1])
        ratio = np.ones_like(emits)
        ratio[:-1] = (emits[:-1] / np.maximum(seen, 1e-300)[:, None] + hmm_scoring.PRIOR) / (emits.sum(0) + hmm_scoring.PRIOR) * (1 - unseen) / (1 - p0[-1])
        ratio[-1] = unseen / p0[-1]
        start, move = starts / starts.sum(), moves / moves.sum(1, keepdims=True)
        if log - before < hmm_scoring.SETTLED:
            break
        before = log
    for i, words in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        assert math.isclose(got[i].score, base + math.log10(sums(words)[1][-1].sum()), rel_tol=1e-4, abs_tol=1e-3), i


def test_hmm_empty(empty):
    assert hmm_scoring.score(empty).count() == 0


# op 2


def test_url_keys(spark):
    rows = spark.createDataFrame([("http://A.b.Example.com:80/x/y?q",), ("nonsense",), (None,), ("https://u@host.org",)], "url string")
    keys = [r[0] for r in rows.select(url_filter.url_keys(F.col("url"))).collect()]
    assert keys == [["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x", "a.b.example.com/x/y"], [], [], ["host.org"]]


def test_url_intervals(spark):
    entries = spark.createDataFrame([("h.com", "add", "2024-01-05", "spam"), ("h.com", "remove", "2024-01-10", "spam"), ("h.com", "add", "2024-02-01", "malware"), ("h.com", "add", None, "x"), (None, "add", "2024-01-01", "x")], "key string, action string, since string, category string").withColumn("since", F.to_date("since"))
    days = ["2024-01-04", "2024-01-05", "2024-01-09", "2024-01-10", "2024-02-01", None]
    captures = spark.createDataFrame([(i, "http://www.h.com/p", d, "clash") for i, d in enumerate(days)] + [(9, None, "2024-01-06", "clash")] * 2, "page_id int, url string, fetch_date string, is_listed string").withColumn("fetch_date", F.to_date("fetch_date"))
    got = sorted((r.page_id, r.is_listed, r.categories) for r in url_filter.listed(captures, entries).collect())
    assert got == [(0, False, []), (1, True, ["spam"]), (2, True, ["spam"]), (3, False, []), (4, True, ["malware"]), (5, False, []), (9, False, []), (9, False, [])]
    assert url_filter.listed(captures.limit(0), entries).count() == 0 and url_filter.listed(captures, entries.limit(0)).where("is_listed").count() == 0


def test_url_deep_paths(spark):
    entries = spark.createDataFrame([(k, "add", "2024-01-05", c) for k, c in [("h.com/a/b/c/d", "four"), ("h.com/a/b/c/d/e/f/g", "seven"), ("h.com/x", "one")]], "key string, action string, since string, category string").withColumn("since", F.to_date("since"))
    urls = ["http://h.com/a/b/c", "http://h.com/a/b/c/d", "http://h.com/a//b/c/d/e?q", "http://h.com/a/b/c/d/e/f/g/h", "http://h.com/a/b/c/dd", "http://h.com/x/y/z/u/v", "http://h.com"]
    captures = spark.createDataFrame([(i, u, "2024-01-06") for i, u in enumerate(urls)], "page_id int, url string, fetch_date string").withColumn("fetch_date", F.to_date("fetch_date"))
    got = {r.page_id: (r.categories, r.n_active) for r in url_filter.listed(captures, entries).collect()}
    assert got == {0: ([], 0), 1: (["four"], 1), 2: (["four"], 1), 3: (["four", "seven"], 2), 4: ([], 0), 5: (["one"], 1), 6: ([], 0)}
    domains_only = url_filter.listed(captures, entries.withColumn("key", F.lit("h.com")).limit(1))
    assert all(r.n_active == 1 for r in domains_only.collect())
    deep = spark.createDataFrame([("http://h.com/" + "/".join("abcdefgh"),)], "url string")
    assert len(deep.select(url_filter.url_keys(F.col("url"))).first()[0]) == 9


def test_url_days_and_addresses(spark):
    rows = [("h.com", "add", "2024-01-05", "a"), ("h.com", "remove", "2024-01-05", "a"), ("[2001:db8::1]", "add", "2024-01-01", "six"), ("10.0.0.1", "add", "2024-01-01", "four")]
    entries = spark.createDataFrame(rows, "key string, action string, since string, category string").withColumn("since", F.to_date("since"))
    urls = ["http://h.com/", "http://u:p@[2001:DB8::1]:80/x", "http://10.0.0.1/x", "http://[::1]/"]
    captures = spark.createDataFrame([(u, "2024-01-06", 1, 2) for u in urls], "url string, fetch_date string, _keys int, key int").withColumn("fetch_date", F.to_date("fetch_date"))
    got = {r.url: (r.categories, r._keys, r.key) for r in url_filter.listed(captures, entries).collect()}
    assert got == {u: (c, 1, 2) for u, c in zip(urls, [[], ["six"], ["four"], []])}  # of one day's entries the removal comes last


# op 3


def line_model(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    key = lambda x: ascii_lower(x.strip(SPACES))
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or gone.get(key(x), i) <= i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def cleaned(index, docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in index.clean(docs).collect()), key=repr)


def test_line_dedup(docs, empty, spark):
    assert cleaned(line_dedup.LineIndex.build(docs), docs) == line_model([(r.doc_id, r.text) for r in docs.collect()])
    assert line_dedup.LineIndex.build(empty).clean(empty).count() == 0
    odd = spark.createDataFrame([(None, "a line that is long enough"), (7, "a line that is long enough"), (7, "a line that is long enough"), (8, "A line that is LONG enough "), (9, "a line that is long enough\nx")], "doc_id long, text string")
    got = cleaned(line_dedup.LineIndex.build(odd), odd)
    assert got == line_model([(r.doc_id, r.text) for r in odd.collect()])


def state(index):
    refs = sorted(map(tuple, index.refs.collect()))
    counts = sorted((r.k1, r.k2, r.n_docs, r.keep_doc) for r in index.counts.collect())
    shared = {(r.k1, r.k2) for r in index.counts.where("n_docs >= 3").collect()}
    filters = {r.shard: line_dedup.CuckooFilter.load(r.blob) for r in index.filters.collect()}
    for k1, k2 in shared:
        assert filters[k1 % index.shards].contains(np.array([k2]).view(np.uint64)).all()
    return refs, counts, sorted((r.shard, r.n_keys) for r in index.filters.collect())


def test_inserting_twice_changes_nothing(docs, spark):
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    start, rest = line_dedup.LineIndex.build(docs.where("doc_id % 3 != 0"), shard_keys=4), docs.where("doc_id % 3 = 0")
    once = start.insert(rest)
    twice = once.insert(rest).insert(docs)
    whole = line_dedup.LineIndex.build(docs)
    for index in (once, twice):
        assert rows(index.refs.select("k1", "k2", "doc_id")) == rows(whole.refs) and rows(index.counts.select("k1", "k2", "n_docs", "keep_doc")) == rows(whole.counts)
    cleaned = lambda index: sorted((x.doc_id, x.n_dropped) for x in index.clean(docs).collect())
    assert cleaned(twice) == cleaned(whole)
    gone = twice.delete(rest.select("doc_id"))
    assert rows(gone.counts.select("k1", "k2", "n_docs", "keep_doc")) == rows(start.counts)


def test_bulk_deletion_leaves_the_rest():
    r = np.random.default_rng(2)
    keys = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    keys[100:140] = keys[60:100]  # equal marks in one bucket
    made = line_dedup.CuckooFilter(8000)
    assert made.insert(keys)
    assert made.delete(keys[:2500]) and made.contains(keys[2500:]).all()
    assert (made.table != 0).sum() == 2500 and made.contains(keys[:2500]).mean() < 0.05
    assert not made.delete(np.array([12345], np.uint64)) or made.contains(keys[2500:]).mean() > 0.999


def test_line_index_is_reversible(docs):
    first, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    start = line_dedup.LineIndex.build(first, shard_keys=1)
    both = start.insert(rest)
    whole = line_dedup.LineIndex.build(docs, shard_keys=1)
    assert start.shards > 1 and state(both)[:2] == state(whole)[:2]
    again = both.delete(rest.select("doc_id"))
    assert state(again) == state(start) == state(again.compact())
    assert cleaned(both, docs) == cleaned(whole, docs)
    # the largest ids go, so other documents keep the lines
    late = both.delete(docs.where("doc_id >= 40").select("doc_id"))
    assert cleaned(late, docs.where("doc_id < 40")) == line_model([(r.doc_id, r.text) for r in docs.where("doc_id < 40").collect()])


def test_cuckoo_filter():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 63, 50_000, np.uint64))
    made = line_dedup.CuckooFilter.build(keys)
    assert made.contains(keys).all() and made.contains(r.integers(0, 1 << 63, 20000, np.uint64)).mean() < 0.01
    assert (made.table != 0).sum() == len(keys) and made.table.size < 4 * len(keys)
    more = r.integers(0, 1 << 63, 50, np.uint64)
    assert made.insert(more) and made.contains(keys).all() and made.contains(more).all() and made.delete(more)
    again = line_dedup.CuckooFilter.load(made.dump())
    assert again.delete(keys[:2000]) and again.contains(keys[2000:]).all()
    assert again.delete(keys[2000:]) and not again.table.any() and not again.delete(keys[:1])
    assert not line_dedup.CuckooFilter(4).insert(keys[:64])
    same = np.full(6, keys[0])
    assert line_dedup.CuckooFilter(64).insert(same)


# op 4


def test_hilbert_curve_visits_neighbours():
    cells = np.array(list(np.ndindex(8, 8, 8)))
    keys = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(400, 16)).astype(np.float32)
    v[50:90] = v[3]
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)]
    odd = [(1000, None, "c"), (1050, [0.0] * 16, "c"), (1100, [float("nan")] + [1.0] * 15, "c"), (1150, [None] + [1.0] * 15, "c"), (1200, [], "c"), (None, v[0].tolist(), "c"), rows[5]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank string")
    got = hilbert_ann.neighbours(table, F.col("vec_id") % 50 == 0, share=0.3, block=32).collect()
    u = v.astype(float)
    norms = np.sqrt((u * u).sum(1))
    hit = total = 0
    for q in range(0, 400, 50):
        s = u @ u[q] / (norms * norms[q])
        s[q] = -9
        want = np.lexsort((np.arange(400), -s.round(12)))[:5]
        own = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [x[0] for x in own] == [1, 2, 3, 4, 5]
        assert all(math.isclose(s[i], x, rel_tol=1e-12) for _, i, x in own)
        hit, total = hit + len({x[1] for x in own} & set(want)), total + 5
    assert {x.query_id for x in got} == set(range(0, 400, 50)) and hit / total >= 0.9
    assert sorted((x.rank, x.vec_id) for x in got if x.query_id == 50) == [(1, 3), (2, 51), (3, 52), (4, 53), (5, 54)]
    assert hilbert_ann.neighbours(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_as_shipped(spark):
    """Recall at the shipped settings, on doubles that single precision would change, with a stray length and scaled copies."""
    r = np.random.default_rng(5)
    v = r.normal(size=(2000, 64))
    v[7], v[8] = v[50] * 2, v[50] * 0.5
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, [1.0] * 70), (5050, [1e300] * 64)]
    # lengths far out of the range of squares change nothing, of queries and of candidates
    rows += [(20_000, (v[100] * 1e-200).tolist()), (20_050, (v[150] * 1e200).tolist()), (20_001, (v[200] * 1e-300).tolist()), (20_003, (v[250] * 2.0**1000).tolist())]
    got = hilbert_ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    norms, hit = np.sqrt((v * v).sum(1)), 0
    for q in range(0, 2000, 50):
        s = v @ v[q] / (norms * norms[q])
        s[q] = -9
        own = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        twin = {100: 20_000, 150: 20_050, 200: 20_001, 250: 20_003}.get(q)
        assert twin is None or own[0][1] == twin and abs(own[0][2] - 1) < 1e-12
        own = [x for x in own if x[1] != twin]
        assert len(own) >= 4 and all(abs(s[i] - x) < 1e-12 for _, i, x in own if i < 2000)
        hit += len({i for _, i, _ in own} & set(np.argsort(-s)[: 5 - (twin is not None)]))
    assert hit / 196 >= 0.9
    far = {x.query_id: [] for x in got}
    for x in sorted(got, key=lambda x: x.rank):
        far[x.query_id].append((x.vec_id, x.score))
    assert far[20_000][0][0] == 100 and far[20_050][0][0] == 150 and len(far[20_000]) == len(far[20_050]) == 5
    assert all(0.2 < s <= 1 + 1e-12 for q in (20_000, 20_050) for _, s in far[q])
    assert [x.vec_id for x in sorted((x for x in got if x.query_id == 50), key=lambda x: x.rank)][:2] == [7, 8]


# op 5


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    want = {r.doc_id: np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in docs.collect()}
    pieces = packing.pack(docs.repartition(3), path, capacity=256, cut_sizes=(128, 64)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.length == len(p.ids) // 4 > 0 and p.doc_tokens == len(want[p.doc_id])
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == want[doc].tobytes()
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and sum(p.length for p in own) <= 256
    assert by_doc.keys() == want.keys()
    assert sum(map(len, want.values())) / (256 * len(by_sequence)) > 0.9
    assert packing.pack(empty, path).count() == 0


def test_packing_leaves_the_session_alone(spark):
    before = dict(spark.conf.getAll)
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert packing.pack(docs, packing.default_tokenizer()).count() == 2 and dict(spark.conf.getAll) == before


def test_chunks_are_put_together(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("aé🐉 \n") for _ in range(r.choice([0, 1, 15, 16, 17, 700])))) for i in range(80)] + [(None, None), (200, "z" * 9_000)]
    monkeypatch.setattr(packing, "CHUNK", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    chunks = docs.select("doc_id", F.posexplode(packing._chunked(common.text_bytes("text"))).alias("n", "part"))
    c = chunks.collect()
    chunks = pa.RecordBatch.from_pydict({"doc_id": pa.array([x.doc_id for x in c], pa.int64()), "n": pa.array([x.n for x in c], pa.int32()), "part": pa.array([bytes(x.part) for x in c], pa.binary())})
    for size in (1, 3, 50, 10_000):
        batches = (chunks.slice(at, size) for at in range(0, chunks.num_rows, size))
        got = [(i, t.decode()) for ids, texts in packing._whole(batches) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
        assert got == [(i, t or "") for i, t in rows]
    assert list(packing._whole(iter([]))) == []


def test_chunks_of_a_long_text_cost_no_copy_each(spark):
    docs = spark.range(1).select(F.repeat(F.concat(F.lit("é2345678"), F.col("id").cast("string")), 800_000).cast("binary").alias("text")).repartition(1)
    began = time.monotonic()
    parts = docs.select(F.explode(packing._chunked(F.col("text"))).alias("part")).agg(F.count("*"), F.sum(F.octet_length("part"))).first()
    assert tuple(parts) == (-(-8_000_000 // packing.CHUNK), 8_000_000)
    assert time.monotonic() - began < 15  # a copy of the text for each part would be over 100 GB


def test_words_of_letters_go_straight_to_the_model(monkeypatch):
    r = random.Random(9)
    encoder = packing.WordEncoder(packing.default_tokenizer())
    assert encoder.direct
    letters = [c for c in map(chr, range(256)) if c.isalpha() and c not in "ªºµß"]
    words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 12))) for _ in range(4000)]
    want = encoder.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    monkeypatch.setattr(encoder, "_batch", lambda texts: pytest.fail("split and aligned"))
    assert encoder.encode([" ".join(words).encode()])[0].tolist() == want


def test_packing_odd_texts():
    r = random.Random(3)
    parts = ["a", "É", "é", "ß", "İ", "'s", "don't", "1", "²", "…", ".", ",", " ", "\n", "́", "ﬁ", "中", "<|endoftext|>", "<|ENDOFTEXT|>", "≠", "\x1c", "\x85", "-"]
    parts += ["`", "\u1fef", "word", "word,"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(3000)]
    # with room for all words, and forgetting them again and again
    for encoder in (packing.WordEncoder(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer(), cache_words=50)):
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            for text, ids in zip(part, encoder.encode([t.encode() for t in part])):
                assert list(ids) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# op 6


def labelled(spark):
    r = random.Random(5)
    prose = lambda: " ".join(r.choice(["the", "of", "and", "house", "river", "walks", "green", "in", "a"]) for _ in range(60))
    junk = lambda: " ".join(r.choice(["BUY!!", "the***", "in%%%", "|", "$$$"]) for _ in range(60))
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        insult = " idiot moron clown" * 3 if i % 11 == 1 else ""
        rows.append((i, junk() if bad else prose() + insult, "en", "s1", 300, 1, "x"))
        if i < 160:
            labels.append((i, 0 if bad else 1, 1 if i % 11 == 1 and not bad else 0))
    rows += [(900, None, None, None, None, 1, "x"), (901, "", "en", "s1", 0, 1, "x"), rows[0]]
    labels += [(3, None, None), (5000, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_co_training_sends_texts_in_small_batches(spark, monkeypatch):
    """Texts of thousands of documents go to Python in batches of some MB, and come back as they were."""

    def watched(task):
        def run(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 8 << 20, batch.nbytes
                    yield batch

            yield from task(small())

        return run

    monkeypatch.setattr(co_training, "lean", watched)
    r = random.Random(5)
    words = [f"w{i}" for i in range(500)] + ["été", "Straße"]
    rows = [(i, " ".join(r.choices(words, k=900)), "en", i) for i in range(3000)]
    rows += [(3000, None, None, None), (3001, "", "en", 1), (None, "no id", "en", 2), (3002, None, "fr", 3), (3003, "é" * 300, "fr", 4), (3004, "long " * 1_500_000, "fr", 5), (3004, "twice", "fr", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, p_page long").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 3000, 3)], "doc_id long, quality int, toxic int")
    got = co_training.classify(docs, labels, columns=("doc_id", "text", "lang", "p_page"))
    assert got.columns == ["doc_id", "text", "lang", "p_content", "p_page", "p_quality", "kept"]
    got = got.collect()
    key = lambda x: tuple((v is not None, v) for v in x[:3])
    assert sorted(map(key, got)) == sorted(map(key, rows))
    assert all(0 <= x.p_page <= 1 and x.kept == (x.p_quality >= co_training.KEEP) for x in got)


def test_co_training(spark):
    docs, labels = labelled(spark)
    got = co_training.classify(docs, labels).collect()
    assert len(got) == 243
    for r in got:
        assert 0 <= r.p_quality <= 1
        if 160 <= r.doc_id < 240:  # held out
            assert r.kept == (r.doc_id % 4 != 0)
    none = co_training.classify(docs, labels.limit(0))
    assert none.where("kept").count() == 243
    assert co_training.classify(docs.limit(0), labels).count() == 0


def co_training_model(docs, labels, rounds, passes):
    """p_content, p_page and p_quality of each row, densely and one document at a time."""
    W, S, P = co_training.WORD_SLOTS, co_training.SHAPE_SLOTS, co_training.PAGE_SLOTS
    crc = lambda x: zlib.crc32(x.encode())

    def shape(w):
        kind = lambda c: "A" if re.match("[A-ZÀ-ÖØ-Þ]", c) else "a" if re.match("[a-zß-öø-ÿ]", c) else "0" if c in "0123456789" else c
        out = ""
        for c in map(kind, w):
            out += "" if out and out[-1] == c else c
        return out

    def content(t):
        x, w = np.zeros(W + S + 1), words_of(t)
        for k in w:
            x[crc(ascii_lower(k)) % W] += 1
            x[W + crc(shape(k)) % S] += 1
        x[-1] = sum(a == b for a, b in zip(w, w[1:]))
        return x / max(len(w), 1)

    def page(r):
        x, raw = np.zeros(P), (r.text or "").encode()
        lines, size = raw.count(b"\n") + 1, len(raw) if r.n_chars is None else max(r.n_chars, 0)
        for name in (f"l:{r.lang}", f"s:{r.source}", f"n:{int(np.log2(size + 1))}", f"k:{int(np.log2(lines))}", f"w:{int(np.log2(size / lines + 1))}"):
            x[crc(name) % P] += 1
        return x

    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    X = [np.array([content(r.text) for r in docs]), np.array([page(r) for r in docs])]
    ids = sorted({r.doc_id for r in docs if r.doc_id in labels})
    first = [next(i for i, r in enumerate(docs) if r.doc_id == d) for d in ids]
    y = np.array([labels[d] for d in ids])
    free = np.array([r.doc_id not in labels for r in docs])
    order = [i for c in (0, 1) for i in range(len(y)) if y[i] == c]
    held = order[::3]
    own = [i for i in range(len(y)) if i not in held]
    L = [x[first] for x in X]
    state = [[np.zeros(x.shape[1]), 0.0, np.full(x.shape[1], 1e-8), 1e-8] for x in X]

    def labelled_gradient(m, x, t):
        w = np.where(t == 1, 0.5 / (t == 1).sum(), 0.5 / (t == 0).sum())
        off = w * (sig(x @ m[0] + m[1]) - t)
        return x.T @ off, off.sum()

    def step(m, g, gb):
        g = g + 1e-4 * m[0]
        m[2], m[3] = m[2] + g * g, m[3] + gb * gb
        m[0], m[1] = m[0] - g / np.sqrt(m[2]), m[1] - 0.3 * gb / np.sqrt(m[3])

    for m, x in zip(state, L):
        for _ in range(80):
            step(m, *labelled_gradient(m, x[own], y[own]))
    calibrate = lambda: [co_training.platt(x[held] @ m[0] + m[1], y[held]) for m, x in zip(state, L)]
    for _ in range(rounds):
        p = [sig(a * (x @ m[0] + m[1]) + b) for (a, b), m, x in zip(calibrate(), state, X)]
        for _ in range(passes):
            moves = []
            for v in (0, 1):
                m, other = state[v], p[1 - v]
                g, gb = labelled_gradient(m, L[v][own], y[own])
                taught = [np.flatnonzero(free & (other <= 0.05)), np.flatnonzero(free & (other >= 0.95))]
                if all(len(t) for t in taught):
                    both = [(X[v][t].T @ (sig(X[v][t] @ m[0] + m[1]) - c) / len(t), (sig(X[v][t] @ m[0] + m[1]) - c).mean()) for c, t in enumerate(taught)]
                    g, gb = (g + (both[0][0] + both[1][0]) / 2) / 2, (gb + (both[0][1] + both[1][1]) / 2) / 2
                moves.append((g, gb))
            for m, move in zip(state, moves):
                step(m, *move)
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    z = [a * (x @ m[0] + m[1]) + b for (a, b), m, x in zip(calibrate(), state, X)]
    return sig(z[0]), sig(z[1]), sig(z[0] + z[1] - prior), sum(map(len, taught)) if rounds else 0


def test_co_training_matches_a_dense_model(spark):
    """Labels that follow both views with noise, few of them, and many unlabelled documents of which both views are sure."""
    r = random.Random(12)
    rows, labels = [], {}
    for i in range(300):
        good = r.random() < 0.6
        bank = ["river", "Walks", "green", "the", "of", "a1"] if good == (r.random() < 0.98) else ["BUY!!", "now%%", "the", "of", "zz"]
        text = " ".join(r.choice(bank) for _ in range(r.randrange(3, 40))) + ("\nnow now now" if not good else "")
        rows.append((i, text, "en", "blog" if good == (r.random() < 0.98) else "spam", len(text), 1, "x"))
        if i < 60:
            labels[i] = int(good)
    rows += [(400, None, None, None, None, 1, "x"), (401, "  ", "en", "blog", -5, 1, "x"), rows[5], rows[250]]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    table = spark.createDataFrame([*labels.items(), (7, None), (9999, 1)], "doc_id long, quality int")
    features = co_training.featured(docs, co_training._sampled(docs, table, "doc_id", 3000), columns=("doc_id", "n_lines"))
    model = co_training.train(features)
    got = {x.doc_id: (x.p_content, x.p_page, x.p_quality) for x in co_training.score_features(features, model, ("doc_id", "n_lines")).collect()}
    collected = docs.collect()
    *want, taught = co_training_model(collected, labels, co_training.ROUNDS, co_training.PASSES)
    assert taught > 20
    for i, x in enumerate(collected):
        assert np.allclose(got[x.doc_id], [c[i] for c in want], atol=1e-6), x
    again = {x.doc_id: (x.p_content, x.p_page, x.p_quality) for x in co_training.score(docs.withColumnRenamed("n_lines", "p_page"), model).collect()}
    assert all(np.allclose(again[k], got[k], atol=1e-9) for k in got)
    before = co_training_model(collected, labels, 0, 0)
    assert not np.allclose(before[1], want[1], atol=1e-3)


# op 7


def test_soft_mixing(spark):
    docs, labels = labelled(spark)
    mixed = soft_mixing.mix(docs, labels, {"clean": 0.7, "low": 0.2, "toxic": 0.1})
    rows = mixed.collect()
    assert len(rows) == 243 and all(r.rate >= 0 and math.isclose(sum(r.posterior), 1, rel_tol=1e-9) for r in rows)
    total = sum(r.n_tokens for r in rows)
    for k, want in enumerate((0.7, 0.2, 0.1)):
        assert math.isclose(sum(r.n_tokens * r.posterior[k] * r.rate for r in rows) / total, want, abs_tol=0.02)
    assert soft_mixing.mix(docs.limit(0), labels).count() == 0
    assert soft_mixing.mix(docs, labels.limit(0)).count() == 243


def projected_gradient(n, p, weights, passes=20_000):
    """Rates by plain projected gradient with the safe step, and the sums they reach."""
    target, x = np.array(weights) * n.sum(), np.ones(len(n))
    scale = (n[:, None] * p * p).sum(0)
    safe = 1 / np.linalg.eigvalsh((n[:, None] * p).T @ p / np.sqrt(np.outer(scale, scale)))[-1]
    for _ in range(passes):
        x = np.maximum(0, x - safe * (p @ (((n * x) @ p - target) / scale)))
    return x, (n * x) @ p


@pytest.mark.parametrize("weights", [[0.5, 0.3, 0.2], [0.1, 0.1, 0.8], [0.85, 0.1, 0.05]])
def test_rates_are_those_of_projected_gradient(spark, weights):
    r = np.random.default_rng(0)
    n, p = r.integers(1, 50, 60).astype(float), r.dirichlet([0.4, 0.4, 0.4], 60)
    members = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "id int, n_tokens long, posterior array<double>")
    fit = soft_mixing.fit_rates(members, weights)  # as shipped
    got = np.array([x.r for x in members.withColumn("r", soft_mixing.rate(fit.steps)).orderBy("id").collect()])
    want = np.ones(60)
    for g in fit.steps:
        want = np.maximum(0, want - p @ np.array(g))
    assert np.allclose(got, want, atol=1e-9) and (got >= 0).all() and (got == 0).any() == (want == 0).any()
    sums = (n * got) @ p
    assert np.allclose(sums, fit.sums) and fit.met and np.abs(sums / n.sum() - weights).max() < 1e-3
    # least squares without a residual have many solutions: both reach the same domain tokens, by moves along the memberships
    plain, plain_sums = projected_gradient(n, p, weights)
    assert np.allclose(sums / n.sum(), plain_sums / n.sum(), atol=2e-3)
    assert np.corrcoef(got, plain)[0, 1] > 0.9


def test_unmet_targets_are_told(spark):
    members = spark.createDataFrame([(10, [0.9, 0.1]), (20, [0.8, 0.2])], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="not met"):
        fit = soft_mixing.fit_rates(members, [0.1, 0.9])
    assert not fit.met
    n, p = np.array([10.0, 20.0]), np.array([[0.9, 0.1], [0.8, 0.2]])
    scale = 1 / np.sqrt((n[:, None] * p * p).sum(0))
    a, b = (n[:, None] * p * scale).T, np.array([3.0, 27.0]) * scale
    loss = lambda x: float(((a @ x - b) ** 2).sum())
    # the least over nonnegative rates is the least over the four sets of rates held at 0
    tried = [np.zeros(2), np.linalg.lstsq(a, b, rcond=None)[0]]
    for i in range(2):
        one = np.zeros(2)
        one[i] = a[:, i] @ b / (a[:, i] @ a[:, i])
        tried.append(one)
    best = min(loss(x) for x in tried if (x >= 0).all())
    got = float((((np.array(fit.sums) - np.array([3.0, 27.0])) * scale) ** 2).sum())
    assert best * (1 - 1e-9) <= got <= best * (1 + 1e-3)


def test_posteriors_match_a_count(spark):
    """The two decisions of the classifier, by hand, on all rows of the labelled table."""
    docs, labels = labelled(spark)
    model = soft_mixing.train(docs, labels)
    rows = {x.doc_id: x for x in soft_mixing.memberships(docs, model).collect()}
    own = {x.doc_id: (x.quality, x.toxic) for x in labels.collect() if x.quality is not None}
    names = {i: "toxic" if t == 1 else "low" if q == 0 else "clean" for i, (q, t) in own.items()}
    texts = {x.doc_id: x.text for x in docs.collect()}
    names = {i: d for i, d in names.items() if i in texts}
    words = {i: set(words_of((t or "").lower())) for i, t in texts.items()}
    size = Counter(names[x.doc_id] for x in docs.collect() if x.doc_id in names)  # repeated rows count each
    held = lambda w, d: sum(w in words[x.doc_id] for x in docs_rows if names.get(x.doc_id) == d)
    docs_rows = docs.collect()
    d1 = sum(len(words[x.doc_id]) for x in docs_rows if names.get(x.doc_id) == "toxic") + 1
    d0 = sum(len(words[x.doc_id]) for x in docs_rows if names.get(x.doc_id) in ("clean", "low")) + 1

    def marks(w, d, rest):
        n1, n = held(w, d), held(w, d) + sum(held(w, x) for x in rest)
        lift = n1 * (size[d] + sum(size[x] for x in rest)) / (n * size[d]) if n else 0
        return n >= 5 and lift > 3 and n1 * math.log(lift) > 12

    toxic = {w for w in set().union(*words.values()) if marks(w, "toxic", ("clean", "low"))}
    assert toxic == {"idiot", "moron", "clown"}
    a = {w: ((held(w, "toxic") + 0.5) / d1, (held(w, "clean") + held(w, "low") + 0.5) / d0) for w in toxic}
    for i in (1, 12, 40, 200, 901):
        odds = math.log((size["toxic"] + 1) / (size["clean"] + size["low"] + 1)) - len(words[i]) * sum(x - y for x, y in a.values()) + sum(math.log(a[w][0] / a[w][1]) for w in toxic & words[i])
        assert math.isclose(rows[i].posterior[2], 1 / (1 + math.exp(-odds)), rel_tol=1e-9)
    assert model.weights and all(rows[i].posterior[1] > 0.5 for i in texts if i < 240 and i % 4 == 0)


# op 8


def near_model(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words_of(ascii_lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, shingle=k, percent=percent).collect()}
    assert got == near_model([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def test_near_duplicates_of_a_large_group(spark):
    """Chains of small changes: links between texts that are no bucket's hub must not be lost."""
    r = random.Random(4)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        if i % 5 == 0:
            base = [w if r.random() > 0.004 else f"n{r.randrange(9999)}" for w in base]
        rows.append((i, " ".join(w if r.random() > 0.012 else f"v{r.randrange(9999)}" for w in base)))
    rows += [(500, None), (501, "")]
    table = spark.createDataFrame(rows + [(None, "a b c d")], "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(table, shingle=3, percent=85).collect()}
    assert got.pop(None)[1:] == (None, True)
    assert got == near_model(rows, 3, 85)


def _memory_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(n) for n in re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read())) / 1024


def test_workers_give_memory_back(monkeypatch):
    """What a task took is not kept by its Python worker, and the words it knows are bounded."""
    tasks = []

    class Docs:
        mapInArrow = lambda self, task, schema: tasks.append(task)

    monkeypatch.setattr(minhash_dedup, "_parts", lambda docs: docs, raising=False)
    minhash_dedup._sketches(Docs(), 5)
    made = lambda b: pa.RecordBatch.from_arrays([pa.array(range(b, b + 500)), pa.array([0] * 500), pa.array([" ".join(hashlib.md5(b"%d %d" % (i, k)).hexdigest() for k in range(200)).encode() for i in range(b, b + 500)])], ["doc_id", "number", "part"])
    batches = (made(b) for b in range(0, 3000, 500))
    before = _memory_mb()
    assert sum(x.num_rows for x in tasks[0](batches)) == 3000
    assert _memory_mb() - before < 30
    shingler = minhash_dedup.Shingler(5)
    for at in range(0, 700_000, 100_000):
        shingler.sets([" ".join(map(str, range(at, at + 100_000))).encode()])
    assert len(shingler.known) <= 400_000


def test_near_duplicates_empty(empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("together, block, pairs", [(10_000, 1024, 7), (40, 4, 50)])
def test_small_buckets_are_compared_together(spark, monkeypatch, together, block, pairs):
    r = random.Random(together + block)
    monkeypatch.setattr(minhash_dedup, "HUB_ROUNDS", 0)  # all is left over
    for name, value in (("TOGETHER", together), ("BLOCK", block), ("PAIRS", pairs)):
        monkeypatch.setattr(minhash_dedup, name, value)
    texts = []
    for _ in range(30):
        base = [str(r.randrange(10_000)) for _ in range(60)]
        for _ in range(r.choice([1, 2, 3, 9])):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                own[r.randrange(60)] = str(r.randrange(10_000))
            texts.append(" ".join(own))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got.collect()} == near_model(rows, 3, 85)


def test_prune_bounds_keep_links():
    r = np.random.default_rng(0)
    for n, least in minhash_dedup.prune_bounds(0.85, miss=1e-4):
        assert (r.binomial(n, 0.85, 200_000) < least).mean() < 1e-3


# op 9


def secret_texts():
    r = random.Random(8)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    prose = " ".join(r.choice(["thereafter", "información", "Geschwindigkeit", "compute_checksum", "internationalization", "src/main/loader.py", "2024-01-05", "build-17", "x86_64", "Section4.2", "UTF-8", "README"]) for _ in range(5000))
    planted = mixed(32)
    return [prose, f"Étude token = \"{hexes(40)}\" fin", f"SECRET:'{mixed(12)}' password=short api-key=x", "AK" + "IA" + mixed(14).upper(), f"x{hexes(31)} {hexes(64)}", f"see {planted} here", "", None, "ſecret=abcdefghij", "token=token=abcdefghij", prose], planted


def test_secret_scan(spark):
    texts, planted = secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(2)) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
    assert got[5].spans == f"markov:4:{4 + len(planted)}"
    assert got[0].n_markov == got[10].n_markov == 0


def test_secret_models_on_held_out_strings(spark):
    texts, _ = secret_texts()
    model = secret_scan.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    r = random.Random(9)
    needed = secret_scan.MARGIN + secret_scan.PRIOR_LOG_ODDS
    strings = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)) for _ in range(300)]
    assert sum(model.score(s) > needed for s in strings) >= 297
    ordinary = ["internationalizationinformation", "Geschwindigkeitsgeschwindigkeit", "compute_checksum_information"]
    assert not any(model.score(s) > needed for s in ordinary)


def test_copied_secrets_do_not_vouch_for_themselves(spark):
    r = random.Random(10)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    n = len(texts)
    secrets = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)) for _ in range(3)]
    texts += [f"copied {s} passage" for s in secrets[:2]] * 1500 + [" ".join(secrets[2:] * 2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs))).where("n_markov > 0").collect()
    assert {x.doc_id: x.n_markov for x in got if x.doc_id >= n} == {**{i: 1 for i in range(n, n + 3000)}, n + 3000: 2000}


def test_secret_ratios_match_a_count(spark):
    """Spans and ratios from dictionaries of pairs, by occurrence and by distinct string, each token left out of its own counts."""
    texts, _ = secret_texts()
    r = random.Random(21)
    pick = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    twice = pick(20)
    texts = [t and t[:6000] for t in texts] + [f"{pick(15)} {pick(16)} ends", f"a {twice} b {twice}", f"{twice}", f"{pick(18)}token={pick(9)}", f"é{pick(30)}é", f"AK{'IA'}{pick(14).upper()}", "token=abcdefgh12345678,x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.end, s.score) for s in x.spans if s.kind == "markov"] for x in secret_scan.scan(docs, secret_scan.train(docs)).collect()}
    alphabet = set(secret_scan.TOKEN.decode())
    split = lambda t: [m for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t)]
    random_, ordinary, tokens = [], [], defaultdict(list)
    for i, t in enumerate(texts):
        t, at = t or "", 0
        spans = sorted([(m.start(), m.end(), m.group(2)) for m in secret_scan.ASSIGN.finditer(t) if len(m.group(2)) >= 8] + [(m.start(), m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16] + [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9a-f]{32,}", t)])
        for start, end, value in [*spans, (len(t), len(t), None)]:
            for m in split(t[at:start]) if start > at else ():
                ordinary.append(m.group())
                if len(m.group()) >= secret_scan.LEAST:
                    tokens[i].append((at + m.start(), at + m.end(), m.group()))
            at = max(at, end)
            if value is not None:
                random_.append(value)

    def model(ran, ordi):
        pairs = lambda ts: Counter((a, b) for t in ts for a, b in zip(t, t[1:]))
        R, O = pairs(ran), pairs(ordi)
        printable = [chr(c) for c in range(32, 127)]
        p = {(a, b): R[a, b] + (secret_scan.UNIFORM if a in alphabet and b in alphabet else 0) + 1e-3 for a in printable for b in printable}
        row, total = Counter(), Counter()
        for (a, _), n in p.items():
            row[a] += n
        for (a, _), n in O.items():
            total[a] += n

        def score(t):
            mine = pairs([t])
            from_ = Counter()
            for (a, _), n in mine.items():
                from_[a] += n
            return sum(math.log(p[a, b] / row[a]) - math.log((O[a, b] - mine[a, b] + 0.5) / (total[a] - from_[a] + 0.5 * 95)) for a, b in zip(t, t[1:]))

        return score

    often, once = model(random_, ordinary), model(set(random_), set(ordinary))
    needed = secret_scan.MARGIN + secret_scan.PRIOR_LOG_ODDS
    for i in range(len(texts)):
        want = [(a, b, max(often(t), once(t))) for a, b, t in tokens[i]]
        want = [x for x in want if x[2] > needed]
        assert [x[:2] for x in got[i]] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got[i]], [x[2] for x in want])
    n = len(secret_texts()[0])
    assert len(got[n]) == len(got[n + 4]) == 1 and got[n][0][0] == 16  # none below LEAST


# op 10


def test_quality_rules(docs, empty, spark):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for r in docs.collect():
        t, w = r.text or "", words_of(r.text)
        lines = [x for x in t.split("\n") if words_of(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        row = got[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (row.kept and row.base_failed)
    assert quality_rules.apply_rules(empty).count() == 0
    plan = quality_rules.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_mixing_is_native(spark):
    docs, labels = labelled(spark)
    plan = soft_mixing.mix(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert json.dumps(soft_mixing.TARGETS)


# odd rows and names


def test_repeated_rows_null_ids_and_clashing_names(spark, empty):
    """Every operator that reads texts: the same row twice, null ids, null and empty texts, columns named like its own."""
    text = "the quick brown fox jumps over the lazy dog and a token = abcdefgh1234 " + " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (4, text + " more")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    docs = plain
    for c in ("word", "kind", "chunk", "k1", "k2", "shard", "d1", "id", "band", "bucket", "n_words", "spans", "_words", "_lines", "_body", "_lost", "_lost_id", "_distinct", "_marks", "_keys", "posterior", "rate", "p_quality", "_y", "_id", "domain", "m", "x"):
        docs = docs.withColumn(c, F.lit("own"))
    key = lambda r: (r is None, r or 0)

    scores = hmm_scoring.score(docs).collect()
    assert sorted((r.doc_id for r in scores), key=key) == sorted((r[0] for r in rows), key=key)
    assert len({r.base_score for r in scores if r.doc_id == 1}) == 1 and all(r.n_tokens == 1 for r in scores if r.doc_id in (2, 3))
    c = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words_of(ascii_lower(t or "")), ""])
    assert {r.train_tokens for r in scores} == {sum(c.values())}

    cleaned_rows = line_dedup.LineIndex.build(docs).clean(docs)
    assert cleaned_rows.count() == 7 and cleaned_rows.where("_lost = 'own' and k1 = 'own' and n_dropped = 0").count() == 7

    pieces = packing.pack(docs, packing.default_tokenizer()).collect()
    assert sum(p.doc_id == 1 and p.start == 0 for p in pieces) == 2 and sum(p.doc_id is None and p.start == 0 for p in pieces) == 2
    assert {p.doc_tokens for p in pieces if p.doc_id in (2, 3)} == {1}

    near = minhash_dedup.near_duplicates(docs, shingle=3, percent=85).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in near), key=repr) == sorted([(1, 1, True), (1, 1, True), (None, None, True), (None, None, True), (2, 2, True), (3, 3, True), (4, 1, False)], key=repr)

    found = secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs))).collect()
    assert [r.n_assign for r in sorted(found, key=lambda r: key(r.doc_id))] == [1, 1, 0, 0, 1, 1, 0] or sorted(r.n_assign for r in found) == [0, 0, 0, 1, 1, 1, 1]
    assert secret_scan.digest(secret_scan.scan(empty, secret_scan.train(empty))).count() == 0

    ruled = quality_rules.apply_rules(docs).collect()
    assert len(ruled) == 7 and all(r._body == r._words == "own" for r in ruled)

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert co_training.classify(docs, labels).where("_y = 'own' and p_quality between 0 and 1").count() == 7
    mixed = soft_mixing.mix(docs, labels).collect()
    assert len(mixed) == 7 and all(r._words == r._marks == r.domain == "own" and r.rate >= 0 for r in mixed)
