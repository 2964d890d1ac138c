"""Hand-computed cases of the step-by-step functions."""

import json

import pytest

from tessera.functions import references as rf
from tessera.functions import sequential as sq


def test_window_chunks():
    assert sq.window_chunks(None) == [] == sq.window_chunks("  \n ")
    assert sq.window_chunks("a  b\nc") == ["a b c"]
    text = " ".join(f"w{i:03}" for i in range(600))
    out = sq.window_chunks(text, 1200, 150)
    assert all(len(c) <= 1200 for c in out) and out[0] == text[:1199]
    assert out[1].startswith(text[1050:1060].strip()) and out[-1].endswith("w599")
    assert sq.window_chunks("x" * 2500, 1000, 100) == ["x" * 1000, "x" * 1000, "x" * 700]


def test_structured_chunks():
    assert sq.structured_chunks("a\r\nb\n\n\n\nc ") == ["a\nb\n\nc"]
    text = "\n\n".join(f"block {i}\n" + "line " * 20 for i in range(12))
    out = sq.structured_chunks(text, 300, 40)
    assert all(len(c) <= 300 for c in out) and out[0].startswith("block 0")
    assert "block 11" in out[-1] and len(out) > 4
    assert sq.structured_chunks("word " * 100, 50, 0) == [("word " * 10).strip()] * 10


def test_wrap_and_last_lines():
    assert sq.wrap_line("aaa bbb ccc", 7) == ["aaa", "bbb ccc"] or sq.wrap_line("aaa bbb ccc", 7) == ["aaa bbb", "ccc"]
    assert sq.wrap_line("abcdefgh", 3) == ["abc", "def", "gh"]
    assert sq.last_lines("a\nbb\nccc", 6) == "bb\nccc" and sq.last_lines("long line", 3) == "long line" and sq.last_lines("a", 0) == ""


def test_block_chunks():
    out = sq.block_chunks(["one", "two", "three"], "H", 9)
    assert out == ["H\none\ntwo", "H\nthree"]
    assert sq.block_chunks([], "H", 9) == []


@pytest.mark.parametrize(
    ("text", "limit", "want"),
    [
        ("short", 10, "short"),
        ("abc", 0, ""),
        ("Is this one. And then some more words", 20, "Is this one."),
        ("some words here that go on", 20, "some words here"),
        ("a" * 30, 20, "a" * 20),
        ("본문은 이렇게 길게 쓰고 제3조 내용", 18, "본문은 이렇게 길게 쓰고"),
    ],
)
def test_cut_at_boundary(text, limit, want):
    assert sq.cut_at_boundary(text, limit) == want


def test_context_packing_skips_and_goes_on(spark):
    rows = [("q", "a", 1, "prec", "x" * 60), ("q", "b", 2, "law", "y" * 50), ("q", "c", 3, "law", "z" * 30), ("q", "d", 4, "odd", ""), ("r", "e", 1, "law", None)]
    hits = spark.createDataFrame(rows, "query_id string, source_id string, rank int, doc_type string, text string")
    got = [(r.query_id, r.source_id, r.place, r.n_chars) for r in sq.pack_context(hits, 0, 100).orderBy("query_id", "place").collect()]
    assert got == [("q", "b", 1, 50), ("q", "c", 2, 30)]  # 60 more do not fit
    got = [r.source_id for r in sq.pack_context(hits, 0, 115).orderBy("query_id", "place").collect()]
    assert got == ["b", "c"]
    assert [r.source_id for r in sq.pack_context(hits, 0, 0).orderBy("place").collect()] == ["b", "c", "a"]


def test_article_refs():
    keys = lambda s: [r["key"] for r in rf.article_refs(s)]
    assert keys("제3조부터 제5조까지") == ["3", "4", "5"]
    assert keys("제9조의2") == ["9-2"]
    assert keys("제10조의2 내지 제10조의4") == ["10-2", "10-3", "10-4"]
    assert keys("제5조부터 제3조까지") == ["5", "3"]
    r = rf.article_refs("제7조 제2항 제3호")[0]
    assert (r["key"], r["paragraph"], r["item"], r["subitem"]) == ("7", "2", "3", None)
    assert rf.article_refs("no article") == []


LAW = {"name": "시험법 시행령", "level": "시행령", "root": "시험법"}
FAMILY = [{"name": "시험법", "level": "법"}, {"name": "시험법 시행령", "level": "시행령"}, {"name": "시험법 시행규칙", "level": "시행규칙"}]
ORDER = ["1", "2", "3", "4"]


def refs(text, article="4"):
    return [(r["type"], r["target"], r["articles"], r["status"], r["confidence"]) for r in rf.law_references(text, LAW, article, ORDER, FAMILY)]


def test_law_references():
    assert refs("같은 법 제9조에 따라") == [("relative_scope", "시험법", ["9"], "resolved", 0.9)]
    assert refs("이 영 제2조") == [("relative_scope", "시험법 시행령", ["2"], "resolved", 0.9)]
    assert refs("민법 제750조") == [("explicit_law_article", "민법", ["750"], "unresolved_external", 0.45)]
    assert refs("시험법 제3조") == [("explicit_law_article", "시험법", ["3"], "resolved", 0.95)]
    assert refs("전조의 규정") == [("previous_article", "시험법 시행령", ["3"], "resolved", 0.92)]
    assert refs("전조의 규정", "1") == []
    assert refs("제1조부터 제3조까지") == [("same_law_article", "시험법 시행령", ["1", "2", "3"], "resolved", 0.9)]
    assert refs("") == refs(None) == []


@pytest.mark.parametrize(("name", "noise"), [("민법", False), ("", True), ("제3조 법", True), ("특례(법)", True), ("법 시행령", True), ("장관은 정하는 법", True), ("가 나 다 라법", True)])
def test_noise_names(name, noise):
    assert rf.is_noise_name(name) is noise


def test_json_in_text():
    assert sq.first_json('x ```json\n{"a": 1}\n``` {"b": 2}') == {"a": 1}
    assert sq.first_json('x {bad} {"b": {"c": [1]}} y') == {"b": {"c": [1]}}
    assert sq.first_json("none") == {} == sq.first_json(None)
    assert list(sq.recursive_strings(json.loads('{"a": [" x  y ", {"b": "z"}, 3, ""]}'))) == ["x y", "z"]


def test_links():
    clean = lambda u: sq.clean_link(u, frozenset({"OC"}))
    assert clean("http://h/p?oc=1&b=x y&OC=2#f") == "http://h/p?b=x+y#f"
    assert clean("http://h/p?a=") == "http://h/p?a=" and clean("http://h/p") == "http://h/p" and clean("  ") is None


def test_tables():
    text = "┌───┬───┐\n│ a │ b │\n├───┼───┤\n│ 1 │   │ \n│ 2 │ 3 │ 4 │\n└───┴───┘\nplain"
    assert sq.box_table(text) == [["a", "b"], ["1", ""], ["2", "3"]]
    assert sq.markdown_table([["a", "b"], ["1", ""]]) == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert sq.box_table(None) == [] and sq.markdown_table([]) == ""
    assert sq.pdf_text_score("a\tb\nc") > sq.pdf_text_score("a b c")


def test_micro_batches():
    assert sq.micro_batches([3, 3, 3, 20, 1], 2, 10) == [0, 0, 1, 2, 3]
    assert sq.micro_batches([], 2, 10) == []
