"""The operators' own functions against brute force, without Spark."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from docbasin.llm import bpe, langid, lm, mainhtml, mpeg, neardup, pii, toxicity
from docbasin.llm.common import hash_words, pieces, words

TEXTS = ["The  cat\tsat on\x0bthe mat", "", None, "ÀÉ à b Über", "x", "a b", " lead and trail \n"]


def test_words_are_runs_of_other_bytes_lowered():
    per, index, dictionary = words(pa.array(TEXTS, pa.string()))
    flat = [dictionary[int(i)].as_py() for i in index]
    want = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in TEXTS]
    assert per.tolist() == [len(w) for w in want] and flat == [w for ws in want for w in ws]


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": [None, "a" * 50, "", "b" * 200, "c"], "k": [1, 2, 3, 4, 5]})
    out = list(pieces([batch, batch.slice(0, 0)], limit=60))
    assert [x for p in out for x in p["k"].to_pylist()] == [1, 2, 3, 4, 5] and len(out) > 1


def test_hashes_of_words_tell_them_apart_and_need_no_neighbours():
    rng = random.Random(2)
    many = sorted({"".join(rng.choice("abé漢\0") for _ in range(rng.randint(0, 6))) for _ in range(5000)})
    hashes = hash_words(pa.array(many))
    assert len(set(hashes.tolist())) == len(many) and (hash_words(pa.array(["", *many]).slice(1)) == hashes).all()
    assert len(hash_words(pa.array([], pa.string()))) == 0 and hash_words(pa.array(["", ""])).tolist() == [hash_words(pa.array([""]))[0]] * 2


# Byte-level BPE


@pytest.fixture(scope="module")
def tok():
    tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.tokenizer(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def test_bpe_equals_tiktoken(tok):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tok.fst.ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("abcdefgtheioanr \n  .,1239ßéаж漢🎉​'ś") for _ in range(rng.randint(0, 80)))
        assert tok.encode(text) == other.encode_ordinary(text)
    for text in ("a" * 5000, " " * 3000, "=-" * 900, "thetion" * 700):
        assert tok.encode(text) == other.encode_ordinary(text)
        assert tok.decode(tok.encode(text)) == text.encode()


def test_bpe_transducer_equals_merging_with_small_tables(tok):
    fst = bpe.Transducer(tok.fst.ranks, max_states=50)
    rng = random.Random(5)
    for _ in range(200):
        data = "".join(rng.choice("ethionrs ") for _ in range(rng.randint(1, 40))).encode()
        assert list(fst.encode(data)) == fst.merged(data)
    long = b"ethionrs" * 200
    assert list(fst.encode(long)) == fst.merged(long)


def test_streaming_decode_gives_whole_characters(tok):
    text = "naïve 漢字 🎉 end"
    ids, decoder = tok.encode(text), bpe.StreamingDecoder(tok.fst.bytes_of)
    parts = [decoder.feed([i]) for i in ids]
    assert "".join(parts) + decoder.finish() == text and "�" not in "".join(parts)
    raw = bpe.StreamingDecoder([bytes([b]) for b in range(256)], max_moves=100)
    assert raw.feed([0xE2, 0x28, 0xC3]) + raw.finish() == "�(�"
    rng = random.Random(6)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x8E, 0x89, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        cut = rng.randint(0, len(data))
        assert raw.feed(data[:cut]) + raw.feed(data[cut:]) + raw.finish() == data.decode(errors="replace")


# MPEG audio


@pytest.mark.parametrize("text", ["", "a", "x" * 575, "y" * 576, "é" * 700, "\xff\xfa\xc4\x00" * 500])
def test_payload_comes_back(text):
    data = mpeg.write([text.encode()])[0]
    audio = mpeg.parse(data)
    back = mpeg.payload(data, audio)
    assert back == mpeg.padded(text.encode()) and len(back) % 576 == 0 and back
    assert audio.skipped == 0 and audio.bad_crc == 0 and audio.table["frames"] == len(audio.offsets) and audio.table["tag_ok"]
    assert int(audio.tags["TXXX:bytes"]) == len(text.encode())
    assert audio.seconds * 48000 == 1152 * len(audio.offsets)


@pytest.mark.parametrize("text", ["x" * 506 + "TAG", "x" * 506 + "TAG" + "y" * 67, "y" * 576 * 3 + "x" * 506 + "TAGged", "é" * 253 + "TAG"])
def test_letters_of_a_tag_inside_the_payload_are_payload(text):
    data = mpeg.write([text.encode()])[0]
    audio = mpeg.parse(data)
    assert mpeg.payload(data, audio) == mpeg.padded(text.encode()) and audio.skipped == 0
    assert len(audio.offsets) == audio.table["frames"] and not any(k.startswith("id3v1") for k in audio.tags)
    tagged = mpeg.parse(data + b"TAG" + b"Song".ljust(125, b"\0"))
    assert tagged.offsets == audio.offsets and tagged.tags["id3v1:title"] == "Song" and tagged.skipped == 0


def _frame(rate_index: int, protected: bool = False) -> bytes:
    head = bytes([0xFF, 0xFA if protected else 0xFB, rate_index << 4, 0])
    h = mpeg.header(int.from_bytes(head, "big"))
    return head + b"\x11" * (h.length - 4)


def test_variable_bitrates_junk_and_tags():
    frames = [_frame(9), _frame(10), _frame(11), _frame(9)]
    data = b"junk\xff\xe0junk" + b"".join(frames[:2]) + b"\x00noise" + b"".join(frames[2:]) + b"TAG" + b"Song".ljust(125, b"\0")
    audio = mpeg.parse(data)
    assert [data[o : o + 2] for o in audio.offsets] == [b"\xff\xfb"] * 4
    assert [h.kbps for h in audio.headers] == [128, 160, 192, 128] and audio.tags["id3v1:title"] == "Song"
    assert audio.samples == 4 * 1152 and audio.skipped == 10 + 6
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff" * 50).offsets == []


def bitwise_crc(bits: str) -> int:
    c = 0xFFFF
    for bit in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ int(bit) else 0)
    return c


@pytest.mark.parametrize(
    ("head", "bits"),
    [
        (bytes([0xFF, 0xFE, 0x90, 0x00]), lambda b: 32 * 2 * 4),  # Layer I, stereo
        (bytes([0xFF, 0xFE, 0x90, 0xC0]), lambda b: 32 * 4),  # Layer I, one channel
        (bytes([0xFF, 0xFE, 0x90, 0x50]), lambda b: 8 * 2 * 4 + 24 * 4),  # Layer I, joint from the eighth subband
        (bytes([0xFF, 0xFC, 0x10, 0xC0]), lambda b: 26 + 2 * sum(int(b[i : i + w], 2) > 0 for i, w in zip([0, 4, *range(8, 26, 3)], [4, 4] + [3] * 6, strict=True))),  # Layer II, 32 kbit/s, one channel
    ],
)
def test_checksums_of_layers_one_and_two(head, bits):
    h = mpeg.header(int.from_bytes(head, "big"))
    body = bytes(random.Random(3).randrange(256) for _ in range(h.length - 6))
    text = "".join(f"{x:08b}" for x in head[2:4])
    field = "".join(f"{x:08b}" for x in body)
    crc = bitwise_crc(text + field[: bits(field)]).to_bytes(2, "big")
    good, bad = mpeg.parse((head + crc + body) * 3), mpeg.parse((head + bytes([crc[0] ^ 1, crc[1]]) + body) * 3)
    assert (len(good.offsets), good.bad_crc, bad.bad_crc) == (3, 0, 3)
    assert good.seconds * h.hz == 3 * h.samples


def test_other_tables_and_tags():
    table = bytearray(_frame(9))
    table[36:62] = b"VBRI" + bytes([0, 1, 0, 9, 0, 75]) + (2000).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes([0, 2, 0, 3, 0, 1, 0, 1])
    table[62:64] = bytes([5, 6])
    audio = mpeg.parse(bytes(table) + _frame(9) * 2)
    assert audio.table["kind"] == "VBRI" and (audio.table["frames"], audio.table["bytes"], audio.table["toc"]) == (2, 2000, [15, 18]) and len(audio.offsets) == 2
    frame = b"TT2" + bytes([0, 0, 5]) + b"\x00Song"
    old = b"ID3\x02\x00\x00" + bytes([0, 0, 0, len(frame)]) + frame
    assert mpeg.parse(old + _frame(9) * 2).tags == {"TT2": "Song"}
    frame = b"TIT2" + bytes([0, 0, 0, 4, 0, 0]) + b"\x00A\xff\x00B"  # 4 bytes before each 255 got a zero behind it
    extended = bytes([0, 0, 0, 6]) + bytes(6) + frame
    tag = b"ID3\x03\x00\xc0" + bytes([0, 0, 0, len(extended)]) + extended
    audio = mpeg.parse(tag + _frame(9) * 2)
    assert audio.tags == {"TIT2": "A\xffB"} and audio.offsets[0] == len(tag)


def test_damage_is_noticed():
    data = bytearray(mpeg.write([b"hello" * 300])[0])
    audio = mpeg.parse(bytes(data))
    data[audio.offsets[1] + 10] ^= 1
    assert mpeg.parse(bytes(data)).bad_crc == 1
    data = bytearray(mpeg.write([b"hello" * 300])[0])
    data[audio.offsets[1] + 100] ^= 1
    again = mpeg.parse(bytes(data))
    frames = [(bytes(data)[o : o + h.length], h.length) for o, h in zip(again.offsets, again.headers, strict=True)]
    assert mpeg.music_crc([frames])[0] != again.table["music_crc"]


def test_music_crc_is_the_bytewise_one():
    c, data = 0, bytes(range(256)) * 3
    for b in data:
        c = c >> 8 ^ mpeg.MUSIC_CRC[(c ^ b) & 255]
    assert mpeg.music_crc([[(data[:100], 100), (data[100:], len(data) - 100)]]) == [c] and mpeg.music_crc([[]]) == [0]


# PII

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(d := re.sub(r"\D", "", s)) <= 19 and pii.luhn(d),
        "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m.group())] for k, p in PLAIN.items()}


def test_plain_patterns_equal_their_definition():
    rng = random.Random(1)
    samples = ["a@b.c@d.e", "x..y@z.co", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (269) 555-3296 4524132264652876", "4111-1111 1111 1111", "00001.2.3.004"]
    samples += ["".join(rng.choice("ab1234.@+-() 5") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for text in samples:
        assert pii.plain(text) == brute(text), text


@pytest.mark.parametrize("unit", ["1", "0", "1.", "a", "@", "+1", "1 ", "a@", "0" * 5000 + ".", "x [at] y.com ", "x\u200b@y.com ", "one two ", " ", "[ ", "a dot b" + " " * 9000 + "x", "at  ", "plus  "])
def test_long_runs_take_linear_time(unit):
    def seconds(n):
        text = unit * (n // len(unit))
        began = time.process_time()
        pii.find(text)
        return time.process_time() - began

    seconds(20_000)
    small, large = min(seconds(20_000) for _ in range(3)), seconds(200_000)
    assert large < 30 * small + 0.5


def test_maps_of_rewritten_text_equal_those_of_characters():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30)))
        tape, plain = pii.Tape(text), [(c, i, i + 1) for i, c in enumerate(text)]
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(plain) + 1), min(len(plain) + 1, 2 * rng.randint(0, 3))))
            edits = [(b, e, rng.choice(["", "X", "YZ"])) for b, e in zip(cuts[::2], cuts[1::2], strict=False)]
            after, at = [], 0
            for b, e, new in [*edits, (len(plain), len(plain), "")]:
                after += plain[at:b] + [(c, plain[b][1], plain[e - 1][2]) for c in new]
                at = e
            tape, plain = tape.rewrite(edits), after
            assert tape.text == "".join(c for c, _, _ in plain)
            for b in range(len(plain)):
                e = rng.randint(b + 1, len(plain))
                assert tape.source(b, e) == (plain[b][1], plain[e - 1][2])


def test_merging_keeps_the_base_and_the_longest_others():
    rng = random.Random(10)
    for _ in range(300):
        base = [(k * 10, k * 10 + rng.randint(1, 9)) for k in rng.sample(range(10), 3)]
        more = [(b, b + rng.randint(1, 15)) for b in rng.sample(range(100), 8)]
        want = sorted(base)
        for s in sorted(set(more), key=lambda s: (s[0] - s[1], s[0])):
            if all(s[1] <= x or s[0] >= y for x, y in want):
                want = sorted([*want, s])
        assert pii.merge(base, more) == want


@pytest.mark.parametrize(
    ("text", "kind", "hit"),
    [
        ("write to jane.doe (at) mail1 (dot) example (dot) com now", "email", "jane.doe (at) mail1 (dot) example (dot) com"),
        ("write to jane [at] example.com now", "email", "jane [at] example.com"),
        ("or jane at example dot com please", "email", "jane at example dot com"),
        ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("ip one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 10[.]0[.]0[.]7 up", "ip", "10[.]0[.]0[.]7"),
        ("card ４１１１ １１１１ １１１１ １１１１ end", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("pay four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("call +1 five five five 2 3 4 five six seven", "phone", "+1 five five five 2 3 4 five six seven"),
        ("call plus one two one two five five five zero one nine nine", "phone", "plus one two one two five five five zero one nine nine"),
        ("+1 (269) five five five 3296 4524132264652876", "phone", "+1 (269) five five five 3296"),
    ],
)
def test_disguises_are_undone_in_place(text, kind, hit):
    _, every = pii.find(text)
    assert hit in [text[b:e] for b, e in every[kind]]


@pytest.mark.parametrize("hit", ["jane at example.com", "jane at mail1.example.co.uk", "jane arroba example.com", "jane [at] example.com", "jane at example dot com", "jane_at_example_dot_com", "jane at mail dot example.com", "jane (at) example [.] com", "jane@example point com"])
def test_a_disguise_is_found_with_and_without_other_hints(hit):
    for text in (f"write to {hit}, now", f"a moot point here; write to {hit}, now", f"write to {hit}, now or [at] noon"):
        assert hit in [text[b:e] for b, e in pii.find(text)[1]["email"]], text
    for text in ("it fell at 3.5 percent", "met at 9.30pm", "a moot point met at 9.30 then"):
        assert not pii.find(text)[1]["email"], text


def test_clean_prose_has_no_spans_and_base_ones_stay():
    for text in ("The at of, one two or three dots at the end.", "Ménage à trois, Über 12 points", "", "I met five at one point"):
        assert not any(pii.find(text)[1].values()), text
    text = "a.b@c.de and 4111111111111111"
    base, every = pii.find(text)
    assert all(s in every[k] for k in base for s in base[k])
    assert pii.redact(text, every) == "[EMAIL] and [CARD]"


# HTML


def page_text(html):
    trees, nodes = mainhtml.model(), mainhtml.parse(html)
    for n, v in zip(nodes[1:], trees.log_odds(mainhtml.features(nodes)).tolist(), strict=True):
        n.logit = v
    return " ".join(mainhtml.decode(nodes)), nodes


def test_main_text_of_plain_pages():
    prose = " ".join(["Some longer sentence of the article, with words."] * 6)
    html = f'<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav><div class="ad">Buy it.</div><article><h1>Head &amp; tail</h1><p><b>First.<br><p>{prose}</p></article><footer>&copy; me</footer></body>'
    assert page_text(html)[0] == f"Head & tail First. {prose}"
    for odd in ("", "<", "plain", "<![foo<p>x", "<p" * 50, "</p></div>" * 20, "<div>" * 3000):
        page_text(odd)


def test_decoding_has_no_contradictions_and_good_leaves():
    rng, f1 = np.random.default_rng(77), []
    for _ in range(60):
        _, nodes = page_text(mainhtml.specimen(rng))
        want, have = set(), set()
        for n in nodes[1:]:
            n.label = "1" if n.tag in ("html", "body") else n.parent.label or "0" if n.label is None or n.parent.label == "0" else n.label
            if n.tag == "#text":
                path, at = True, n
                while at:
                    path, at = path and at.kept, at.parent
                want |= {id(n)} if n.label == "1" else set()
                have |= {id(n)} if path else set()
        f1.append(2 * len(want & have) / max(1, len(want) + len(have)))
    assert np.mean(f1) > 0.9


def test_decoding_is_the_best_of_all_labellings():
    rng = random.Random(4)
    for _ in range(60):
        root = mainhtml.Node("#root", None)
        nodes = [root]
        for k in range(rng.randint(1, 8)):
            node = mainhtml.Node(rng.choice(["div", "#text"]), rng.choice([n for n in nodes if n.tag != "#text"]))
            node.logit, node.words, node.text = rng.uniform(-3, 3), rng.randint(0, 9), [f"t{k}"] if node.tag == "#text" else []
            nodes.append(node)
        order, todo = [], [root]
        while todo:
            n = todo.pop()
            order.append(n)
            todo.extend(reversed(n.kids))
        weight = [n.logit * (1 + np.log1p(n.words) if n.tag == "#text" else 1) for n in order]
        best = max((sum(w if k else -w for w, k in zip(weight[1:], (m >> i & 1 for i in range(len(order) - 1)), strict=True)), m) for m in range(1 << (len(order) - 1)) if all(order.index(n.parent) == 0 or m >> (order.index(n.parent) - 1) & 1 or not m >> i & 1 for i, n in enumerate(order[1:])))
        kept = {id(n) for i, n in enumerate(order[1:]) if best[1] >> i & 1}
        assert mainhtml.decode(order) == [n.text[0] for n in order if id(n) in kept and n.tag == "#text"]


#: Pages written by hand, in markups that `specimen` doesn't make, and their main text.
BY_HAND = [
    ("<body><div id=top-menu><a href=/>Home</a> | <a href=/b>Blog</a></div><div class='post-body entry'><h2>On tea</h2><p>{0}<p>{1}</div><div class=site-footer>All rights reserved.</div>", "On tea {0} {1}"),
    ("<html><body><header><h1>Daily News</h1></header><main><section><h1>Storm</h1><p>{0}</p><figure><figcaption>{1}</figcaption></figure></section></main><aside class=related><ul><li><a href=1>More storms</a></li></ul></aside></body></html>", "Storm {0} {1}"),
    ("<div class='{2} sidebar'><p>{1}</p></div><article><p>{0}</p><p>{0}</p></article>", "{0} {0}"),
    ("<noscript><p>{1}</p><article><h1>Open</h1><p>{0}</p><p>{0}</p></article>", None),
]


def test_pages_written_by_hand():
    first, second = " ".join(["Leaves are picked by hand in spring."] * 8), " ".join(["Water is boiled, then left to cool."] * 7)
    for html, want in BY_HAND:
        text = page_text(html.format(first, second, "pad" * 400))[0]
        assert text == want.format(first, second) if want else first in text, html[:60]


@pytest.mark.parametrize("unit", [("<div>", "</p>"), ("<ul><div>", "<li></li>"), ("<b>", "</div>"), ("<a ", ""), ("<!-- ", ""), ("</a ", ""), ("<a href='x", ""), ("<p>&#", "")])
def test_parsing_takes_linear_time(unit):
    def seconds(n):
        began = time.process_time()
        mainhtml.parse(unit[0] * n + unit[1] * n)
        return time.process_time() - began

    seconds(500)
    assert seconds(20_000) < 40 * max(seconds(1000), 0.002) + 0.5


@pytest.mark.parametrize("tag", ["ul", "ol"])
def test_a_list_of_links_inside_an_article_stays(tag):
    first, second = " ".join(["Leaves are picked by hand in spring."] * 8), " ".join(["Water is boiled, then left to cool."] * 7)
    menu = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav>"
    refs = f"<{tag}><li><a href='/1'>Ref one</a></li><li><a href='/2'>Ref two</a></li></{tag}>"
    html = f"<html><body>{menu}<article><h1>On tea</h1><p>{first}</p>{refs}<p>{second}</p></article><footer><p>(c) us</p></footer></body></html>"
    assert page_text(html)[0] == f"On tea {first} Ref one Ref two {second}"


def test_a_tag_that_is_never_closed_ends_the_page_as_text():
    assert mainhtml.closed("<p>a</p> b") == "<p>a</p> b" and mainhtml.closed("<p>a <b") == "<p>a <b" and mainhtml.closed("") == ""
    assert mainhtml.closed("<p>a <b c <d") == "<p>a <b c &lt;d"


# Language ID, toxicity, near-duplicates, language model


def test_trigrams_by_hand():
    doc, gram, grams = langid.trigrams(pa.array(["Ab cd", None, "x", "ab", "c ab"], pa.string()))
    assert [tuple(chr(p) if p else "" for p in grams[g]) for g in gram] == [("a", "b", ""), ("", "c", "d"), ("", "a", "b")] and doc.tolist() == [0, 0, 4]


def trigrams_of(text):
    s = re.sub("[^a-zà-ÿα-ω漢字仮名]+", "\0", text)
    return [t for t in (s[i : i + 3] for i in range(len(s) - 2)) if t[1] != "\0"]


@pytest.mark.parametrize("block", [4096, 3])
def test_bundles_are_sums_of_bound_letters(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    texts = ["der hund läuft", "le chien, court", "漢字仮名 漢字", "", "αβγ δεζ", "x"]
    doc, gram, grams = langid.trigrams(pa.array(texts, pa.string()))
    have = langid.bundles(doc, gram, None, grams, len(texts))
    v = {c: langid.letters(np.array([ord(c)]))[0].astype(int) for c in set("".join(texts)) | {"\0"}}
    for i, text in enumerate(texts):
        want = sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in trigrams_of(text)), np.zeros(langid.DIMENSIONS, int))
        assert (have[i] == want).all(), text


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    chain = toxicity.Chain(np.zeros(1), np.log(np.array([[0.8, 0.2], [0.4, 0.6]])), np.log(np.array([0.9, 0.1])), np.zeros(3))
    lengths = [1, 4, 2, 5]
    e = rng.normal(size=sum(lengths))
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    p, xi, x0 = toxicity.forward_backward(e, first, chain, pairs=True)
    at, want = 0, []
    for n in lengths:
        weight = {}
        for path in np.ndindex(*[2] * n):
            w = np.exp(chain.start[path[0]] + sum(e[at + i] * y for i, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            weight[path] = w
        total = sum(weight.values())
        want += [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
        at += n
    assert np.allclose(p, want) and np.isclose(xi.sum(), len(e) - 4) and np.isclose(x0.sum(), 4)


def test_shingles_are_sets():
    texts = ["a b c a b c", "a b", "a", "", None, "A B C a b c"]
    per, value = neardup.shingles(pa.array(texts, pa.string()), 3)
    assert per.tolist() == [3, 1, 1, 0, 0, 3]
    assert value[:3].tolist() == value[-3:].tolist() and (np.diff(value[:3].astype(object)) > 0).all()


def test_matches_needed_bounds_the_miss():
    from math import comb

    for t in (0.8, 0.85):
        k = neardup.matches_needed(t)
        assert sum(comb(64, i) * t**i * (1 - t) ** (64 - i) for i in range(k)) <= 1e-9 < sum(comb(64, i) * t**i * (1 - t) ** (64 - i) for i in range(k + 1))


@pytest.mark.parametrize("n", [1, 5, 5000])
def test_elias_fano_and_trie(n):
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
    n, low_bits, low, high = lm.EliasFano.encode(values, 1 << 40)
    ef = lm.EliasFano(n, low_bits, low, high)
    assert (ef.access(np.arange(n)) == values).all()
    asked = np.concatenate([rng.integers(0, 1 << 40, 1000).astype(np.uint64), values, values + np.uint64(1), np.array([0, 1 << 40], np.uint64)])
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
    dense = np.sort(rng.integers(0, n + 1, n)).astype(np.uint64)
    assert (lm.EliasFano(*lm.EliasFano.encode(dense, n + 1)).access(np.arange(n)) == dense).all()
    contexts = rng.integers(0, 1 << 32, max(1, n // 20)).astype(np.uint64)
    keys = np.unique(contexts[rng.integers(0, len(contexts), n)] << np.uint64(32) | rng.integers(0, 1 << 32, n).astype(np.uint64))
    logs = -rng.random(len(keys)) * 5
    trie = lm.Trie(keys, logs)
    assert np.abs(trie.log10(keys) - logs).max() < 1 / 4096
    others = np.concatenate([keys + np.uint64(1), keys ^ np.uint64(1 << 40), rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    assert np.isinf(trie.log10(np.setdiff1d(others, keys))).all()
