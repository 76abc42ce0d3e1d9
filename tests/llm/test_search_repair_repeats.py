"""Ranked search, conversation repair and repeated strings against brute force, with odd rows among them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import glr_repair, max_sketch, suffix_dedup

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


# ranked search


def ranked(docs, items, k):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            if not bag:
                continue
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 20 * m)) for w in set(terms_of(text)) if bag[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def library():
    r = random.Random(3)
    words = ["alpha", "Beta", "été", "Straße", "x1", "the"] * 4 + [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(r.choice(words) + r.choice(["", ".", ",", "\n"]) for _ in range(r.choice([1, 5, 40, 200])))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(80)] + [(7, docs[7][1])]  # copies, and a repeated row
    docs += [(500, None), (501, ""), (502, "... \t--"), (503, "a" * 70_000 + " alpha"), (504, " ".join(["beta"] * 30_000)), (None, docs[9][1])]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(20)]
    items += [(3, "alpha ALPHA alpha"), (30, None), (31, ""), (32, "unheard of"), (33, docs[7][1]), (None, "beta w5")]
    return docs, items


@pytest.mark.parametrize("block", [256, 7])
def test_search(spark, library, block):
    docs, items = library
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item_id string").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(x) for x in max_sketch.search(d, q, k=10, block=block).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(map(str, got)) == sorted(map(str, ranked(docs, items, 10)))
    assert max_sketch.search(d.limit(0), q).count() == 0 and max_sketch.search(d, q.limit(0)).count() == 0


def test_bounds_are_never_below_scores(library):
    docs, _ = library
    counted = max_sketch.Counted(pa.array([(t or "").encode() for _, t in docs], pa.binary()))
    r = np.random.default_rng(0)
    impacts = r.integers(1, 1000, len(counted.pairs))
    words = counted.words.to_pylist()
    sketches = max_sketch.Sketches(counted, impacts, max_sketch.term_hashes(words), width=1)
    weights = r.integers(0, 50, (4, len(words))).astype(float)
    bounds = sketches.bounds(np.arange(len(docs)), max_sketch.term_hashes(words), weights)
    codes = np.arange(len(words))
    exact = np.stack([max_sketch.rescore(counted, impacts, np.arange(len(docs)), codes, w) for w in weights], axis=1)
    assert (bounds >= exact).all() and (bounds > exact).any()


# conversation repair


def mended(rows):
    """(cost, audit, repaired rows) by plain recursion over rows (role, text, must go, truncated) and role states."""
    moves = {"0": "su", "s": "u", "a": "u", "u": "a"}

    @cache
    def best(i, state):
        ways = []
        if i == len(rows):
            if state in "0a":
                ways.append((0, "", ()))
        else:
            role, text, must_go, cut = rows[i]
            cost, audit, rest = best(i + 1, state)
            ways.append((cost + 3, "D" + audit, rest))
            for x in moves[state] if not must_go else ():
                cost, audit, rest = best(i + 1, x)
                if role[:1] == x:
                    ways.append((cost + cut, "K" + audit, ((role, text), *rest)))
                if x in "ua":
                    ways.append((cost + cut + 2, "R" + audit, (({"u": "user", "a": "assistant"}[x], text), *rest)))
        for x in moves[state]:
            if x in "ua" and depth[0] < 3:
                depth[0] += 1
                cost, audit, rest = insert(i, x)
                depth[0] -= 1
                ways.append((cost + 2, "I" + audit, (({"u": "user", "a": "assistant"}[x], ""), *rest)))
        return min(ways) if ways else (10**9, "~", ())

    depth = [0]
    insert = lambda i, x: best.__wrapped__(i, x)  # noqa: E731  depth differs, so not remembered

    return best(0, "0")


def described(turns):
    """The whole result of one conversation, from rows (turn, role, text) after damage."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    seen, judged, counts = set(), [], Counter()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        blank, again, cut = not bare, (role, text) in seen, bool(bare) and bare[-1] not in ".!?"
        seen.add((role, text))
        counts["blank" if blank else "duplicate" if again else "truncated" if cut else "fine"] += 1
        judged.append((role, text, blank or again, int(cut)))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    known = [t for t, _, _ in rows if t is not None]
    cost, audit, out = mended(tuple(judged))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def talks(seed, n):
    r = random.Random(seed)
    texts = ["Hi.", "yes", "No!", "", " \t", "Why?  \n", "and so", None, "Fine."]
    rows = []
    for c in range(n):
        for turn in range(r.choice([1, 2, 4, 7, 12])):
            rows.append((c, r.choice([turn, turn, turn, turn + 3, None]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), r.choice(texts) if r.random() < 0.3 else f"text {r.randrange(99)}{r.choice(['.', '', '?'])}"))
        rows += rows[-1:] * (c % 3 == 0)
    return rows


def test_repair(spark):
    rows = talks(1, 120) + [(None, 0, "user", "No id."), (None, None, None, None)] + [(500, t, "ua"[t % 2] + "x", "long. " * 50_000) for t in range(4)]
    turns = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(3)
    got = {x.conv_id: tuple(x)[1:] for x in glr_repair.repair(turns).collect()}
    own = defaultdict(list)
    for c, *rest in rows:
        own[c].append(tuple(rest))
    assert got.keys() == own.keys()
    for c, x in own.items():
        assert got[c] == described(x), c
    assert glr_repair.repair(turns.limit(0)).count() == 0


def test_damage_and_repair(spark):
    rows = talks(2, 60) + [(1000, t, "user", "gone?") for t in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: tuple(x)[1:] for x in glr_repair.repair(glr_repair.damaged(turns), gone="gone").collect()}
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{c}:{turn if turn is not None else ' '}".encode()) % 20
        kept = own[c]
        if fault:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
            kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    assert got == {c: described(x) for c, x in own.items()}
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) == described([])


def test_long_conversation_is_read_in_parts():
    r = random.Random(5)
    rows = [(r.choice("suaut"), "", r.random() < 0.2, int(r.random() < 0.2)) for _ in range(600)]
    repair = glr_repair.Repair(glr_repair.Table())
    for role, _, must_go, cut in rows:
        repair.read(role, must_go, bool(cut))
    assert max(len(x.audit) for x in repair.tops.values()) < 200 and len(repair.tops) <= len(repair.table.states)
    import sys

    sys.setrecursionlimit(10_000)
    assert repair.best() == mended(tuple(rows))[:2]


# repeated strings


def kept_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone)), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return out


def repeating(seed=5, n=320):
    r = random.Random(seed)
    hot, texts = "The common line that is in very many of the documents here.", []
    word = lambda: r.choice(["ab", "c", "dé", "zz", f"w{r.randrange(40)}"]) + r.choice(["", "x", "yy"])
    for i in range(n):
        k, t = i % 8, " ".join(word() for _ in range(r.randrange(1, 60)))
        texts.append({1: texts[-1] if texts else t, 2: (texts[-2] or "")[:40] + "!" + (texts[-2] or "")[41:] if i > 1 else t, 3: t[:30] + hot + t[30:], 4: r.choice(["", None, "a" * r.randrange(1, 99), "ab" * 50]), 5: t + hot[5:35] + t[::-1], 6: t[:50] + hot + hot + t[50:]}.get(k, t))
    return [*texts, "x\0" * 40, "x\0" * 40 + "\0\0", "\0" * 100, None, None]


@pytest.mark.parametrize("length, token, buckets", [(24, 8, 4), (64, 48, 4), (24, 8, 60)])
def test_repeats(spark, length, token, buckets):
    texts = repeating()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", buckets)  # with many, groups of like regions spread over them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.createDataFrame([(i if i % 50 else None, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, marks string, key long").repartition(6)
    try:
        got = sorted(map(str, (tuple(x) for x in suffix_dedup.remove_repeats(docs, length=length, token=token).collect())))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == sorted(str((i if i % 50 else None, *x)) for i, x in enumerate(kept_bytes(texts, length)))


def test_repeats_as_shipped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {x.doc_id: y for x, y in zip(rows, kept_bytes([x.text for x in rows], 200))}
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_long_text_goes_in_blocks(spark, monkeypatch):
    text = "".join(random.Random(1).choice("abcde ") for _ in range(9_000))
    texts = [text, "z" + text[3_000:7_000] + "q", "é" * 5_000]
    data = np.frombuffer(text.encode(), np.uint8)
    whole = suffix_dedup.regions(data, np.array([0]), np.array([len(data)]), 64, 16)
    assert whole[1].sum() == len(data) - 63 and (np.diff(whole[0]) == whole[1][:-1]).all()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1_000)
    parts = [suffix_dedup.regions(data[a[0] : b[0]], a - a[0], b - a[0], 64, 16) for a, b in suffix_dedup._blocks(np.array([len(data)]), 64)]
    assert sum(p[1].sum() for p in parts) == len(data) - 63
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.remove_repeats(docs, length=64, token=16).collect()}
    assert [got[i] for i in range(3)] == kept_bytes(texts, 64)


def test_multikey_order():
    r = np.random.default_rng(0)
    rows = r.integers(0, 3, (500, 16), np.uint8)
    order = suffix_dedup.multikey_order(rows.view(">u8").astype(np.uint64))
    assert [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)
    common = suffix_dedup._common(rows[order])
    assert all(c == next((i for i in range(16) if rows[a, i] != rows[b, i]), 16) for a, b, c in zip(order, order[1:], common[1:]))
