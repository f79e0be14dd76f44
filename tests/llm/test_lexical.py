"""Ranked search against brute force: cuts of posting lists, one shard's search, whole tables and odd rows."""

import math
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from docbasin.llm import lexical
from docbasin.llm.common import read

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n, words = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in own:
            m = 10 + (90 * sum(c.values()) * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def error(scores, ends):
    begin, total = 0, 0
    for e in ends:
        block = scores[begin : e + 1]
        total += max(block) * len(block) - sum(block) + lexical.BLOCK_COST * max(scores)
        begin = e + 1
    return total


def test_cuts_have_the_least_error_of_all_cuts():
    rng = np.random.default_rng(3)
    lists = [rng.integers(1, 100, n) for n in (1, 2, 5, 9, 8, 3)]
    last, owner = lexical.cut_blocks(np.concatenate(lists), np.array([len(x) for x in lists]))
    begin = 0
    for i, x in enumerate(lists):
        mine = [int(e) - begin for e in last[owner == i]]
        assert mine[-1] == len(x) - 1
        every = [[*c, len(x) - 1] for r in range(len(x)) for c in combinations(range(len(x) - 1), r)]
        assert error(x.tolist(), mine) == min(error(x.tolist(), e) for e in every)
        begin += len(x)


def test_blocks_are_skipped_and_the_result_is_exact(monkeypatch):
    rng = np.random.default_rng(5)
    n, lists = 4000, []
    for size in (3, 50, 1500, 4000):
        docs = np.sort(rng.choice(n, size, replace=False))
        lists.append((docs, rng.integers(1, 50, size) * (1 + 400 * (docs // 100 == 7))))
    counts = np.array([len(d) for d, _ in lists])
    docs, scores = np.concatenate([d for d, _ in lists]), np.concatenate([s for _, s in lists])
    last, _ = lexical.cut_blocks(scores, counts)
    begin = np.concatenate([[0], last[:-1] + 1])
    opened = []
    real = np.bincount
    monkeypatch.setattr(lexical.np, "bincount", lambda x, w=None, m=0: (opened.append(len(x)), real(x, w, m))[1])
    found, total = lexical.best_of(10, n, docs, scores, begin, last, np.maximum.reduceat(scores, begin))
    want = real(docs, scores, n).astype(int)
    order = sorted(range(n), key=lambda d: (-want[d], d))[:10]
    assert found.tolist() == order and total.tolist() == [want[d] for d in order]
    assert sum(opened[2:]) < len(docs) / 4  # postings looked at


ODD = [(5, "Alpha beta, beta!"), (3, "ALPHA beta beta"), (9, "alpha beta beta"), (9, "alpha beta beta"), (None, "alpha beta beta"), (1, None), (2, ""), (4, "..."), (6, "Éa été ÉTÉ x_y"), (7, "gamma " * 4000 + "alpha"), (8, "\x00tail\x00alpha")]
ITEMS = [(1, "alpha BETA beta"), (1, "gamma"), (2, None), (3, "été"), (4, "nowhere"), (None, "x tail"), (5, "")]


@pytest.mark.parametrize("docs_a_shard", [1 << 16, 3])
def test_odd_rows(spark, monkeypatch, docs_a_shard):
    monkeypatch.setattr(lexical, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 2 if docs_a_shard == 3 else 1000)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0 if docs_a_shard == 3 else 1 << 26)
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in ODD], "doc_id long, text string, term string, n int")
    items = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, doc_id int")
    for k in (10, 2):
        got = sorted(map(tuple, lexical.search(lexical.index(docs), items, k).collect()), key=str)
        assert got == brute(ODD, ITEMS, k)
    assert lexical.search(lexical.index(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.index(docs), items.limit(0)).count() == 0


def test_query_equals_its_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = sorted(tuple(r) for r in lexical.op11_lexical(spark, sf_dir).collect())
    assert got == sorted(con.execute(lexical.OP11_SQL).fetchall())
    docs = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    assert sorted(got, key=str) == brute(docs, items)
