import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gaugeframe.llm import suffix_dedup, unit_dedup


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup_counts_words_of_passages_below_its_length(spark, hot):
    rng = random.Random(30)
    new = lambda n: ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    passage = new(51)
    lists = [new(rng.randint(0, 30)) + passage + new(rng.randint(0, 30)) for _ in range(8)] + [new(200), new(20) + passage[:50] + new(20), [], passage[1:] + new(3), passage]
    texts = [" ".join(x) if i % 2 else "\n ".join(x) for i, x in enumerate(lists)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, hot=hot, shard_bytes=5000, passage=51).collect()}
    seen = Counter(tuple(x[i : i + 51]) for x in lists for i in range(len(x) - 50))
    want = [len({j for i in range(len(x) - 50) if seen[tuple(x[i : i + 51])] > 1 for j in range(i, i + 51)}) for x in [*lists, []]]
    assert [got[i].n_repeated for i in range(len(texts))] == want and sum(want) >= 9 * 51
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == suffix_dedup.brute_force(texts, 400)
    assert all(r.n_removed == 0 for r in got.values())


@pytest.mark.parametrize("coded", [False, True])
def test_suffix_dedup_sorts_only_the_cells_that_digests_leave_open(monkeypatch, coded):
    rng = random.Random(31)
    dtype, length, gram = (np.uint32, 51, 16) if coded else (np.uint8, 400, 64)
    made = lambda n: np.array([rng.randrange(1 << 24 if coded else 256) for _ in range(n)], dtype)
    texts = []
    for _ in range(40):
        base = made(5 * length)
        near = base.copy()
        near[rng.randrange(len(base))] ^= 1
        texts += [base, near, np.concatenate([made(9), base[length : 2 * length + 30], made(length)])]
    raw, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    w = suffix_dedup.windows(raw, offsets, length, gram)
    kinds = {}
    for i in range(len(w["m"])):
        kinds.setdefault(int(w["mh"][i]), {}).setdefault(int(w["wh"][i]), []).append(i)
    some = [(v[0], len(v)) for x in kinds.values() if len(x) > 1 for v in x.values()]
    at = np.array([i for i, _ in some])
    cut = [raw[offsets[w["doc"][i]] + w["a"][i] : offsets[w["doc"][i]] + w["b"][i] + length].tobytes() for i in at]
    shard = pa.table({"_key": w["doc"][at], "_digest": at, "mh": w["mh"][at].view(np.int64), **{x: w[x][at] for x in "mab"}, "c": [n for _, n in some], "bytes": pa.array(cut, pa.binary())})
    sorted_ = []
    blocks = suffix_dedup.suffix_blocks
    monkeypatch.setattr(suffix_dedup, "suffix_blocks", lambda t, *more: sorted_.append(len(t)) or blocks(t, *more))
    got = {(r["_key"], s) for r in suffix_dedup._sorted(length, 1 << 12, coded)(shard).to_pylist() for s in range(r["a"], r["b"] + 1)}
    seen = Counter(x[i : i + length].tobytes() for x in texts for i in range(len(x) - length + 1))
    want = {(int(w["doc"][i]), s) for i, n in some if n == 1 for s in range(w["a"][i], w["b"][i] + 1) if seen[texts[w["doc"][i]][s : s + length].tobytes()] > 1}
    assert got == want and len(want) > 500
    assert 0 < sum(sorted_) < sum(map(len, cut)) / 3


def test_suffix_dedup_bisects_passages_at_words(spark, monkeypatch):
    rng = random.Random(32)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    passage = new(70)
    lists = [new(60) + passage + new(60) for _ in range(20)]
    counts = []
    kept = suffix_dedup.stored

    def stored(df, what="step"):
        out = kept(df, what)
        counts.extend([out.count()] if what == "cells" else [])
        return out

    monkeypatch.setattr(suffix_dedup, "stored", stored)
    df = spark.createDataFrame(list(enumerate(map(" ".join, lists))), "doc_id long, text string")
    got = suffix_dedup.dedup(df, hot=2, length=1000, passage=51).collect()
    assert [r.n_repeated for r in got] == [70] * 20
    assert 0 < sum(counts) <= 20 * 20


def test_unit_dedup_finds_passages_that_are_no_unit(spark):
    rng = random.Random(33)
    new = lambda n: ["".join(rng.choice("abcdefghijÉ") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    passage = new(60)
    passage[20] += "."
    lists = [new(rng.randint(5, 30)) + passage + new(rng.randint(5, 30)) for _ in range(6)] + [new(200), new(9) + passage[:50] + new(9), [], [x.upper() for x in passage[9:]], 3 * passage[:30]]
    texts = [" ".join(x) if i % 2 else "\n ".join(x) for i, x in enumerate(lists)] + [None, " \n"]
    ids = [None, *range(1, len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, ["mine"] * len(texts), strict=True)), "doc_id long, text string, passage_spans string")
    plain = {r.doc_id: r for r in unit_dedup.dedup_units(df, unit="sentence", min_words=1, min_chars=1000).collect()}
    assert all(r.n_repeated == 0 and r.passage_spans == "mine" and "n_passage_words" not in r for r in plain.values())
    got = {r.doc_id: r for r in unit_dedup.dedup_units(df, unit="sentence", min_words=1, min_chars=1000, passage=51).collect()}
    lowered = [[w.lower() for w in x] for x in lists] + [[], []]
    seen = Counter(tuple(x[i : i + 51]) for x in lowered for i in range(len(x) - 50))
    for i, x in zip(ids, lowered, strict=True):
        want = {j for k in range(len(x) - 50) if seen[tuple(x[k : k + 51])] > 1 for j in range(k, k + 51)}
        assert {j for s in got[i].passage_spans for j in range(s.start, s.end)} == want and got[i].n_passage_words == len(want), i
        assert (got[i].n_units, got[i].n_removed, got[i].kept_text) == (plain[i].n_units, 0, plain[i].kept_text)
    assert [got[i].n_passage_words > 0 for i in ids] == [True] * 6 + [False] * 3 + [True] * 2 + [False] * 2
