"""The secret scan against a brute-force version of its contract and of its battery of tests."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from docbasin.llm import secrets
from docbasin.llm.common import read

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(found)


def shown(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def tokens(text):
    out, at = [], 0
    for m in [*re.finditer(secrets.BASE, text or ""), None]:
        end = m.start() if m else len(text or "")
        out += [(at + t.start(), t[0]) for t in re.finditer(secrets.CANDIDATE, (text or "")[at:end])]
        at = m.end() if m else end
    return out


def battery(token):
    s = token.rstrip("=")
    for name, alphabet, pattern, equal in secrets.ENCODINGS:
        if re.fullmatch(f"[{pattern}]+", s) and not s.isdigit():
            break
    else:
        return None
    n, k = len(s), len(alphabet)
    if n < 20:
        return None
    chi = k / n * sum(v * v for v in Counter(s).values()) - n
    spread = 2 / (9 * (k - 1))
    uniform = ((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    d = k * equal - 1
    ordinary = (chi - (k - 1 + n * d)) / math.sqrt(2 * (k - 1) + 4 * n * d)
    high = [alphabet.index(c) >= k // 2 for c in s]
    ones, zeros = sum(high), n - sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * ones * zeros / n + 1
    of_runs = (runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)) if ones and zeros else math.inf
    v = [alphabet.index(c) + 1 for c in s]
    below = n * sum(x * x for x in v) - sum(v) ** 2
    r = (n * sum(a * b for a, b in zip(v, v[1:] + v[:1])) - sum(v) ** 2) / below if below else math.inf
    serial = (r + 1 / (n - 1)) / (n / ((n - 1) * math.sqrt(n - 2)))
    p = 0.5 * math.erfc(-ordinary / math.sqrt(2))
    step = 0 if ordinary >= 0 else min(math.floor(-100 * math.log10(p)), secrets.LAST)
    passes = uniform <= secrets.ONE_SIDED and abs(of_runs) <= secrets.TWO_SIDED and abs(serial) <= secrets.TWO_SIDED
    return (name, int(math.log2(n))), step, passes


def brute(rows):
    classes = defaultdict(dict)
    for _, text in rows:
        for _, t in tokens(text):
            if b := battery(t):
                classes[b[0]][t] = b[1]
    least = {}
    for c, held in classes.items():
        good = [s for s in set(held.values()) if 10 ** (-s / 100) * len(held) <= secrets.RATE * sum(x >= s for x in held.values())]
        if good:
            least[c] = min(good)
    out = []
    for d, text in rows:
        spans = base(text)
        for at, t in tokens(text):
            if (b := battery(t)) and b[2] and b[0] in least and b[1] >= least[b[0]]:
                spans.append((at, 3, at + len(t)))
        spans.sort()
        kinds = Counter(k for _, k, _ in spans)
        out.append((d, kinds[0], kinds[1], kinds[2], hashlib.sha256(shown([x for x in spans if x[1] < 3]).encode()).hexdigest(), shown(spans)))
    return Counter(out)


def rows_of(frame):
    return Counter(tuple(r) for r in frame.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect())


def digest(docs):
    base_only = F.filter("spans", lambda s: s.kind < 3)
    counts = [F.size(F.filter("spans", secrets._of_kind(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(secrets.KINDS)]
    return secrets.secrets(docs).select("doc_id", *counts, F.sha2(secrets.listed(base_only), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


WORDS = ["thelongestwordthatanyonewouldeverwrite", "international-organisation-of-standards", "src/main/resources/configuration/default", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "ABABABABABABABABABABABABABABABAB", "20261128045600000000001234", "qwertyuiopqwertyuiopqwertyuiopqwertyuiop"]


def odd_rows():
    rng = random.Random(11)
    made = ["".join(rng.choices(alphabet, k=n)) for _, alphabet, _, _ in secrets.ENCODINGS for n in (32, 40, 64, 128)]
    rows = [(1, None), (2, ""), (3, "plain words"), (None, "é password = 'abcdef' 漢"), (4, "token: short token=api_key: abcdef secret=token: abcdefg"), (5, "PassWord:xyz123 PASSWD = q API_KEY=\"A.b-c_d=\" apikey=123456"), (5, "twice AKIA" + "Q" * 16 + " AKIA123 AKIAAKIA" + "Z" * 12), (6, "deadbeef" * 3 + " " + "deadbeef" * 2 + "dead")]
    rows += [(7, "Key toKen: abcdefgh paſsword=abcdefgh"), (8, "line\npassword\n: abcdef\ntoken:\tabcdefg")]
    rows += [(100 + i, f"{'\U0001f600' * (i % 3)} holds {t} here{'=' * (i % 4)}") for i, t in enumerate(made)]
    rows += [(200 + i, f"about {w} and {w}x") for i, w in enumerate(WORDS)]
    rows += [(300, " ".join(f"token={'k' * 6}{i} mid{i} {made[i % len(made)]}" for i in range(700)))]
    return [*rows, rows[0], rows[4], rows[30]]


def test_odd_rows_and_planted_tokens(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, spans int, token string")
    want = brute(rows)
    assert rows_of(digest(docs)) == want
    found = Counter(r[0] for r in want if "random:" in r[5])
    assert sum(d is not None and 100 <= d < 200 for d in found) >= 20  # of 28; short hexadecimal ones are too near to numbers
    assert not any(d is not None and 200 <= d < 300 for d in found)
    assert digest(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = secrets.op12_secrets(spark, sf_dir)
    assert rows_of(got) == brute([(r.doc_id, r.text) for r in docs.collect()])


def sql_rows(con, columns):
    want = con.execute(secrets.OP12_SQL)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")]
    return Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got = secrets.op12_secrets(spark, sf_dir)
    assert rows_of(got) == sql_rows(con, got.columns)
    odd = duckdb.connect()
    odd.execute("create table documents (doc_id bigint, text varchar)")
    odd.executemany("insert into documents values (?, ?)", odd_rows())
    assert sql_rows(odd, got.columns) == brute(odd_rows())


def test_long_texts_take_linear_time(spark):
    texts = ["token: abcdefg " * 20000, "ab12" * 100_000, "password " + " " * 500_000, "token " * 50_000, "A" * 300_000 + "=", "x" * 19 + " " + "deadbeef" * 40_000]
    began = time.time()
    got = digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_assign", "n_hex", F.length("spans").alias("chars")).collect()
    assert {r.doc_id: (r.n_assign, r.n_hex) for r in got} == {0: (20000, 0), 1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 1)}
    assert time.time() - began < 60
