"""The operators on DataFrames: odd rows, and the queries against brute force on a small table."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from docbasin.llm import bpe, decontam, langid, lm, mainhtml, mpeg, neardup, pii, queries, toxicity, urlrules
from docbasin.llm.common import among, bitmap, read

WIDE = "doc_id long, text string, lang string, source string, score double, id long, token string, component string"


@pytest.fixture(scope="module")
def docs(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    longer = " ".join(f"w{i}" for i in range(30_000))
    rows = [(0, base, "en", "a"), (1, base, "en", "a"), (1, base, "en", "a"), (2, base + " more", None, None), (3, "", "fr", "b"), (4, None, "fr", "b"), (None, base, "en", "a"), (5, "été où ça", "fr", "a"), (6, longer, "en", "c"), (7, longer + " tail", "en", "c"), (8, "  \n\t ", "de", "a"), (9, "the idiot " * 5, "en", None), (10, "!!! 123", "en", "a")]
    return spark.createDataFrame([(*r, 1.0, 7, "t", "c") for r in rows], WIDE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], WIDE)


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_odd_rows_and_empty_tables(spark, docs, none):
    path, pattern = tokenizer()
    labels = spark.createDataFrame([(1, 0), (9, 1), (9, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels)
    items = spark.createDataFrame([(1, "six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "été où ça"), (None, "x"), (1, "six seven eight nine ten eleven twelve")], "item_id long, text string")
    known = langid.profiles(docs)
    for table, n in ((docs, 13), (none, 0)):
        assert bpe.encode(table, path, pattern, ids=True).count() == n
        assert bpe.tokens(table, path, pattern).count() == n
        assert mpeg.digest(table).count() == n and mpeg.probe(mpeg.store(table)).count() == n
        assert pii.detect(table).count() == n and pii.redacted(table).columns == table.columns and pii.redacted(table).count() == n
        assert toxicity.score(table, chain).count() == n and toxicity.clean(table, chain).columns == table.columns
        assert langid.identify(table, known).count() == n and langid.identify(table, {}).count() == n
        assert neardup.classes(table).count() == n
        assert lm.score(table, lm.F.col("doc_id") % 2 == 0).count() == n
        decontam.contained(table, items).collect()
    assert {(r.doc_id, r.item_id) for r in decontam.contained(docs, items).collect()} == {(0, 1), (1, 1), (2, 1), (5, 4)}
    assert decontam.contained(docs, items.limit(0)).count() == 0
    assert toxicity.fit(none, labels.limit(0)).weights.sum() == 0 and langid.profiles(none) == {}


def test_near_copies_odd_rows(docs):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.classes(docs).collect()}
    assert {(0, 18, 0, True), (1, 18, 0, False), (2, 19, 0, False), (3, 0, 3, True), (4, 0, 4, True), (8, 0, 8, True), (6, 29998, 6, True), (7, 29999, 6, False), (5, 1, 5, True), (None, 18, 0, False)} <= rows


def components(ids, edges):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("settings", [{}, {"HUB_ROUNDS": 0, "CELL_BYTES": 2000, "SMALL_BYTES": 1000}, {"HUB_ROUNDS": 1, "SMALL_BYTES": 0, "CELL_BYTES": 5000, "BROADCAST_IDS": 0}])
def test_near_copies_equal_all_pairs(spark, monkeypatch, settings):
    import random

    rng, rows = random.Random(4), []
    for family in range(6):
        base = [f"f{family}x{i}" for i in range(60)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = f"new{rng.randrange(4)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, f"lonely text number {i} of its own kind {i * 7}") for i in range(20)]
    for k, v in settings.items():
        monkeypatch.setattr(neardup, k, v)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == components(list(sets), edges)


def test_long_chains_of_links(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 120)] + [(500, 400), (400, 500)], "a long, b long")
    found = {r.id: r.component for r in neardup.components(pairs).collect()}
    assert all(found[i] == 0 for i in range(121)) and found[500] == found[400] == 400


def test_containment_both_ways_of_joining(spark, sf_dir, monkeypatch):
    want = sorted(decontam.op3_decontam(spark, sf_dir).collect())
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    assert sorted(decontam.op3_decontam(spark, sf_dir).collect()) == want and want


def test_language_model_counts_by_hand(spark, sf_dir):
    rows = {r.doc_id: r for r in lm.op4_lm(spark, sf_dir).collect()}
    texts = {r.doc_id: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) if w] + [None] for r in read(spark, sf_dir, "documents").collect()}
    train = {d for d in texts if crc32(str(d).encode()) % 10}
    c = Counter(w for d in train for w in texts[d])
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for d, ws in texts.items():
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, d not in train)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), abs_tol=1e-6)
    held = [r for d, r in rows.items() if d not in train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_scores_by_hand_and_other_way(spark):
    texts = {1: "a b a c", 2: "a b b", 3: "a b d", 4: None, 11: "q a b"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    train = lm.F.col("doc_id") < 10
    got = {r.doc_id: r.score for r in lm.score(table, train).collect()}
    again = {r.doc_id: r.score for r in lm.score(table, train, broadcast_words=0).collect()}
    seq = {d: ["<s>", *(t or "").split(), "</s>"] for d, t in texts.items()}
    uni = Counter(w for d, s in seq.items() if d < 10 for w in s[1:])
    context, pair = Counter(w for d, s in seq.items() if d < 10 for w in s[:-1]), Counter(p for d, s in seq.items() if d < 10 for p in zip(s, s[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    for d, s in seq.items():
        want = 0.0
        for a, b in zip(s, s[1:], strict=False):
            p = (uni[b] + 0.1) / (n + 0.1 * (v + 1))
            x = lm.FLOOR + (1 - lm.FLOOR) * lm.HALF / (lm.HALF + context[a]) if context[a] else 1.0
            want += math.log10(x * p + ((1 - x) * pair[a, b] / context[a] if context[a] else 0))
        assert math.isclose(got[d], want, abs_tol=0.01 * len(s)) and math.isclose(again[d], got[d], abs_tol=1e-4)


def test_url_rules_equal_a_scan(spark):
    urls = ["http://a.example.org/es/x?q", "https://EXAMPLE.org/en/12", "ftp://org/", "http://org", "http://x.com/fr/a#b", "http://com/de/", "http://x.com", "nothing", None, "http://notexample.org/es/", "http://a.b.c.example.org:80/es/", "://", "http://x.com/de", "http://.org/a", "http://x.com/de/?a"] + [f"http://h{i % 7}.example.{t}/{p}/{i}" for i in range(60) for t in ("org", "com") for p in ("es", "en", "de", "fr")]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    rules = [*urlrules.RULES, ("h1.example.org", "/", "block"), ("example.org", "/e", "allow"), (None, "/", "block"), ("org", "/", "allow")]
    for partitions in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        assert len(found) == len(urls) + 1
        for r in found:
            rest = urls[r.page_id].split("://", 1)[1] if urls[r.page_id] and "://" in urls[r.page_id] else ""
            host, path = re.match(r"[^/?#]*", rest).group().lower(), re.match(r"[^/?#]*([^?#]*)", rest).group(1)
            fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=(0, 0, None, "allow"))
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[3])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert urlrules.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert urlrules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is not null").count() == 0


def test_pages(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (3, "u", "<p>x", 3), (None, "u", "<p>x", 4)], "page_id long, url string, html string, text int")
    assert mainhtml.extract(pages).count() == 4 and mainhtml.extract(pages.limit(0)).count() == 0
    found = mainhtml.op5_mainhtml(spark, sf_dir).collect()
    assert len(found) == read(spark, sf_dir, "pages").count() and all(r.n_chars == len(r.text) for r in found)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = langid.op6_langid(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in lang) / len(lang) > 0.97 and all(0 <= r.score <= 1 for r in lang)
    found = queries.QUERIES["op1_toxicity"](spark, sf_dir).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    truth = {r.doc_id: r.toxic for r in read(spark, sf_dir, "labels").collect()}
    known = [r for r in found if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in known) / len(known) > 0.85


def test_pipeline_by_stages(spark, sf_dir):
    import corpus_pipeline

    docs, seen = read(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.names == docs.schema.names
        seen[name] = (docs, out)
        docs = out
    before, after = seen["minhash_near_dedup"]
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in before.collect() for w in [(r.text or "").lower().split()] if w}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    own = components(list(sets), edges)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if own.get(r.doc_id, r.doc_id) == r.doc_id}
    before, after = seen["benchmark_decontamination"]
    assert after.count() <= before.count()
    before, after = seen["pii"]
    assert before.count() == after.count() and all(r.n_chars == len(r.text or "") for r in after.collect())
    texts = {r.doc_id: r.text for r in seen["pii"][1].collect()}
    tok = bpe.tokenizer(*tokenizer())
    for r in docs.collect():
        assert tok.decode(r.token_ids).decode() == (texts[r.doc_id] or "") and r.n_tokens == len(r.token_ids)


def test_rows_of_scanning_queries_by_hand(spark, sf_dir):
    import hashlib
    import zlib

    import tiktoken

    path, pattern = tokenizer()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in read(spark, sf_dir, "documents").collect()}

    def sha(data):
        return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()

    for r in bpe.op10_bpe(spark, sf_dir).collect():
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r.doc_id]))
    for r in mpeg.op9_mpeg(spark, sf_dir).collect():
        data = texts[r.doc_id].encode()
        whole = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), sha(whole), zlib.crc32(whole[-32:]))
        assert len(r.seek) == len(whole) // 576 and abs(r.seconds - len(r.seek) * 1152 / 48000) < 1e-9 and r.seek == sorted(r.seek) and r.seek[-1] < r.media_bytes
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(d := re.sub(r"\D", "", s)) <= 19 and pii.luhn(d), "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15}
    for r in pii.op8_pii(spark, sf_dir).collect():
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, texts[r.doc_id]) if ok[k](m.group())]
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(r.spans.split(",")) | {""} and r.n_spans == len([s for s in r.spans.split(",") if s])


def test_stages_judge_rows_not_ids(spark, sf_dir):
    import corpus_pipeline

    base, clean, more = " ".join(f"b{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    item = read(spark, sf_dir, "benchmark").first().text
    docs = spark.createDataFrame([(0, base), (1, base), (1, clean), (5, more), (5, more), (None, base), (6, item), (6, "harmless words of six"), (None, f"x {item} y")], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs.limit(6), sf_dir).collect())
    assert kept == [(0, base), (1, clean), (5, more)]
    found = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert found.columns == docs.columns and sorted((r.text for r in found.collect())) == sorted([base, base, base, clean, more, more, "harmless words of six"])


def test_short_items_inside_long_documents(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma yy zz"), (2, "alpha beta gamma"), (3, "alpha gamma beta"), (4, None), (None, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha, beta gamma!"), (2, "zz"), (3, ""), (4, "alpha beta gamma yy zz extra")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contained(docs, items).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_decontamination_keeps_few_shingles_of_documents_for_a_thousand_items(spark):
    """What is left of the documents' shingles before they become rows, and every contained item found."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(15, 60)))) for i in range(1000)]
    docs = [(d, " ".join(rng.choices(words, k=800) + (items[d][1].split() if d < 60 else []) + rng.choices(words, k=200))) for d in range(120)]
    docs_table, items_table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contained(docs_table, items_table).collect()}
    assert found == {(d, d) for d in range(60)}
    worded = decontam.worded(items_table, "item_id")
    sketch = decontam.sketches(worded, 5, 80).distinct().cache()
    bitmap, bits = decontam.seen_bits(sketch.select("hash").distinct(), sketch.select("hash").distinct().count())
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    hashes = decontam.worded(docs_table, "doc_id").select(F.explode(decontam.shingle_hashes(F.col("words"), 5)).alias("h"))
    kept = hashes.where(F.getbit(F.get(bitmap, F.shiftright(low, 6).cast("int")), F.col("h").bitwiseAND(F.lit(63)).cast("int")) == 1)
    assert kept.count() < 0.1 * hashes.count()


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_among_ids_and_the_others(spark, most):
    values = [-(1 << 40), -65, -64, -1, 0, 1, 62, 63, 64, 127, (5 << 33) + 63, (5 << 33) + 64, None]
    rows = spark.createDataFrame([(v, f"t{i}") for i, v in enumerate(values)] + [(63, "again")], "`row number` long, text string")
    ids = spark.createDataFrame([(v,) for v in (-(1 << 40), -64, 0, 63, 127, (5 << 33) + 63, None, 9_999)], "id long")
    within, outside = among(rows, "row number", ids, most), among(rows, "row number", ids, most, others=True)
    assert within.columns == outside.columns == rows.columns
    assert sorted(r.text for r in within.collect()) == sorted(["t0", "t2", "t4", "t7", "t9", "t10", "again"])
    assert sorted(r.text for r in outside.collect()) == sorted(["t1", "t3", "t5", "t6", "t8", "t11", "t12"])


def test_dropped_rows_come_to_the_driver_as_bits(spark):
    import corpus_pipeline

    rows = spark.range(0, 640_000, 1, 4).withColumnRenamed("id", corpus_pipeline.ROW)
    gone = rows.where(F.col(corpus_pipeline.ROW) % 3 == 0)
    kept = corpus_pipeline.without(rows.withColumn("n", F.col(corpus_pipeline.ROW)), gone)
    assert kept.agg(F.count("*"), F.sum(F.col("n") % 3)).first()[:] == (426_666, 426_666 // 2 * 3)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "bit_or" in plan  # words of 64 rows, not rows
    assert bitmap(gone).count() == 10_000
