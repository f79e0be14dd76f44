"""Alignment of two tokenizers against a brute-force version of its contract."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docbasin.llm import align
from docbasin.llm.common import read

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """doc_id, text -> the contract's columns, by comparing all token pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    names, values = {i: t for t, i in a.get_vocab().items()}, align.byte_values()
    held = []
    for doc_id, text in rows:
        sides = []
        for ids, own in ((a.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(values[c] for c in names[i])), (b.encode(text or ""), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            at, spans = 0, []
            for i in ids:
                spans.append((i, at, at + len(own(i))))
                at += len(own(i))
            sides.append((spans, b"".join(own(i) for i in ids)))
        ok = text and all(joined == (" " + text).encode() for _, joined in sides)
        held.append((doc_id, sides[0][0] if ok else [], sides[1][0] if ok else []))
    links, groups = [], []
    for _, x, y in held:
        links.append([(i, j) for i, s, e in x for j, t, u in y if s < u and t < e])
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        cut = [0, *ends]
        groups.append([(",".join(str(i) for i, s, e in x if lo <= s and e <= hi), ",".join(str(i) for i, s, e in y if lo <= s and e <= hi)) for lo, hi in zip(cut, ends)])
    count = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return Counter((d, len(x), len(y), len(g), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join("|".join(p) for p in g).encode()).hexdigest() if g else "") for (d, x, y), own, g in zip(held, links, groups))


ODD = [(1, None), (2, ""), (3, " "), (4, "Hello world"), (5, "two  blanks"), (6, "<|endoftext|> <s> </s> <unk>"), (7, "été 漢字 \U0001f600 naïve"), (8, "tab\tand\nline\r\n"), (9, "▁ sign"), (4, "Hello world"), (None, "no id"), (10, "ﬁ ligature ｆｕｌｌ"), (11, "a\x00b"), (12, "x" * 3000), (13, "Hello " * 500)]


def test_odd_rows_repeated_rows_and_other_columns(spark):
    docs = spark.createDataFrame([(d, t, 5, "p") for d, t in ODD], "doc_id long, text string, links int, pair string")
    got = Counter(tuple(r) for r in align.alignment(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == brute(ODD)
    assert align.alignment(docs.limit(0), A, B).count() == 0


@pytest.mark.parametrize("share", [align.HOT_SHARE, 50])
def test_query_rows(spark, sf_dir, monkeypatch, share):
    """All rows of the table; with a low bound most pairs go by the shuffled join."""
    monkeypatch.setattr(align, "HOT_SHARE", share)
    docs = read(spark, sf_dir, "documents")
    short = docs.where(F.length("text") < 1500)  # the brute-force version compares all pairs of tokens
    got = align.alignment(short, A, B)
    rows = [(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_query_covers_every_document(spark, sf_dir):
    got = align.op13_align(spark, sf_dir)
    assert got.count() == read(spark, sf_dir, "documents").count()
    assert got.where("n_links <> n_a + n_b - n_groups or n_best > n_links").count() == 0


WORDS = ["the", "cat's", "I'll", "42", "1,000", "naïve", "été", "漢字", "\U0001f600", " ", "a b", "　", "", "", "\n", "x\n", "\ny", "\tz", "--", "<s>", "<|endoftext|>", "é", "́", "\x00", "q" * 40, "¿que?"]


def test_words_cut_at_blanks_give_the_whole_texts_tokens(spark):
    """Each different word is tokenised once, and its tokens are those that it has in the whole text."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) for _ in range(400)] + ["the cat " * 200, "the ▁ cat", " ", "  "]
    assert align.apart(A, B)
    per_text, codes, dictionary = align.words(pa.array([None, "", *texts]), True)
    assert per_text[:2].tolist() == [0, 0] and len(dictionary) < len(codes) / 2
    held = iter(dictionary.take(pa.array(codes)).to_pylist())
    assert ["".join(next(held) for _ in range(n)) for n in per_text[2:]] == [f" {t}" if t else "" for t in texts]
    rows = list(enumerate(texts))
    got = align.alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_many_pieces_and_batches(spark, monkeypatch):
    """Pieces of a few texts and batches of two rows, with texts that are not given back between others."""
    monkeypatch.setattr(align, "PIECE_BYTES", 500)
    monkeypatch.setattr(align, "OUT_ROWS", 2)
    rows = [(d, f"{t} {n}" if t and n % 3 else t) for n in range(5) for d, t in ODD]
    got = align.alignment(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
