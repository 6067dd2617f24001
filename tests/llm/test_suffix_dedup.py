"""Removal of repeats against every string of 400 bytes, and the suffix array against sorted suffixes."""

import collections
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from stareflow.llm import suffix_dedup as dedup


def covered(raws, length=400):
    """For each text the bytes that a repeated string covers."""
    seen = collections.Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def wanted(raws):
    out = []
    for raw, gone in zip(raws, covered(raws)):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), len(dedup.runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out


def removed(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_are_in_order(seed):
    rng = random.Random(seed)
    parts = ["ab" * 60, "x" * 90, "\0\0\1", "é日", "".join(rng.choice("ab") for _ in range(300)), "".join(rng.choice("abcdefgh ") for _ in range(700))]
    texts = [rng.choice(parts).encode() + rng.choice(parts).encode() for _ in range(25)] + [b"q"]
    data = b"".join(t + b"\xff" for t in texts)
    symbols = np.array([0 if b == 255 else b + 1 for b in data], np.int16)
    order = dedup.suffix_array(symbols, dedup.Strings(symbols))
    assert sorted(order.tolist()) == list(range(len(data)))
    plain = bytes((symbols - 0).astype(np.uint8).tolist())
    suffixes = [plain[i : i + dedup.LENGTH] for i in order.tolist()]
    assert all(a <= b for a, b in zip(suffixes, suffixes[1:]))
    strings = dedup.Strings(symbols)
    a, b = order[:-1], order[1:]
    shared = strings.common(a, b, 0, True)
    for x, y, n in list(zip(a.tolist(), b.tolist(), shared.tolist()))[::7]:
        assert plain[x : x + n] == plain[y : y + n] and (n == dedup.LENGTH or max(x, y) + n >= len(data) or plain[x + n] != plain[y + n])


def test_windows_of_a_task():
    rng = random.Random(5)
    noise = [bytes(rng.randrange(256) for _ in range(700)) for _ in range(5)]
    texts = [noise[0], noise[1] + noise[0][100:550], noise[2], noise[3][:399], noise[3], b"z" * 1200, b"abc" * 300, b"", noise[4][:400], noise[4][:400]]
    for flags, gone, t in zip(dedup.repeated_windows(texts), covered(texts), texts):
        mine = np.zeros(len(t), bool)
        for i in np.flatnonzero(flags):
            mine[i : i + 400] = True
        assert (mine == gone).all()


def test_query_equals_brute_force(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    raws = [(r["text"] or "").encode() for r in rows]
    want = sorted((r["doc_id"], *w) for r, w in zip(rows, wanted(raws)))
    got = sorted(tuple(r) for r in dedup.op11_suffix_dedup(spark, sf).collect())
    assert got == want and sum(w[2] for w in want) > 1000


def test_odd_texts_and_hot_keys(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnop é日\n"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    short, passage = noise(250), noise(420)
    texts = [None, "", "a", "x" * 399, "x" * 400, "y" * 401, "\0" * 900, "ab!" * 4000, noise(3000)]
    texts += [noise(rng.randrange(500)) + short + noise(rng.randrange(500)) for _ in range(60)]
    texts += [noise(rng.randrange(500)) + passage + noise(rng.randrange(500)) for _ in range(40)]
    texts += [texts[-1], texts[-1], texts[8]]
    rows = [(i if i % 9 else None, t, "s", 3, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seg string, row int, key string")
    want = sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, wanted([(t or "").encode() for t in texts])))
    assert removed(dedup.without_repeats(df)) == want
    assert removed(dedup.without_repeats(df, hot=3)) == want
    assert removed(dedup.without_repeats(df.limit(0))) == []


def test_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    line = "".join(rng.choice("abcdef ") for _ in range(977)) + "\n"
    long = "".join(rng.choice("abcdefghij") for _ in range(1_500_000)) + line * 1500
    copy = long[1_048_000 : 1_049_200]  # across the border of two blocks
    df = spark.createDataFrame([(1, long), (2, "head " + copy)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in dedup.without_repeats(df).collect()}
    assert got == {1: [(1_048_000, 1_049_200), (1_500_000, len(long))], 2: [(5, 1205)]}
