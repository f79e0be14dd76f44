import pytest

from docbasin.functions import requests as r


def test_queries_and_literals():
    assert r.clean_queries(" late  returns ", ["LATE returns", "other", "x", "dropped"]) == ["late returns", "other", "x"]
    for bad in ("", "  ", None, "x" * 1001):
        with pytest.raises(ValueError):
            r.clean_queries(bad)
    assert r.literals(['what of "late returns" and EQ-17', "AB-1"]) == ["late returns", "EQ-17"]


def test_filters():
    assert r.clean_filters({"document_ids": "d1", "filenames": [" a ", ""], "odd": 1, "date_from": " 2026 "}) == {"document_ids": ["d1"], "filenames": ["a"], "date_from": "2026"}
    assert r.clean_filters({"filenames": []}) is None and r.clean_filters(None) is None


def test_intent_and_keys():
    assert r.numeric_intent("What is the total?") and not r.numeric_intent("Who wrote it?")
    assert r.load_bearing("Not in 2024, never v1.2") == ["2024", "never", "not", "v1.2"]
    assert r.scope_key("c", a=1, b=2) == r.scope_key("c", b=2, a=1) != r.scope_key("c", a=2, b=2)


def test_pages():
    assert r.speech_pages([(250, "b"), (3, " a ")]) == ["[00:03] a", "[04:10] b"]
    assert [i for i, _ in r.review_sample(["x"] * 20)] == [1, 2, 3, 7, 12, 16] and len(r.review_sample(["x" * 9], chars=3)[0][1]) == 3
