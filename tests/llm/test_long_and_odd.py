"""Odd markup, words of any length, and texts with very many spans."""

import random
import time

import pytest

from tallyforge.llm import html_text, pii, toxicity


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title=don't>hello world</p><p>second para</p>", ["hello world", "second para"]),
        ('<p data-x=5">kept</p><p>two</p>', ["kept", "two"]),
        ("<a title=it's href=x>visible</a> tail isn't lost? <b>more</b>", ["visible tail isn't lost? more"]),
        ('<p title="a > b" class=\'c > d\'>one</p>', ["one"]),
        ("<p a = 'x' b=c\"d>one<p it's>two", ["one", "two"]),
        ("<style>.js .x{display:none}</style><body class=js><p class=x>gone</p><p>stays", ["stays"]),
        ("<html class=js><style>.js .x{display:none}</style><body class=b><p class=x>gone</p><p>stays", ["stays"]),
        ("<body style=display:none>gone", []),
        ("<html style='visibility:hidden'>gone<b style='visibility:visible'>seen</b>", ["seen"]),
        ("<style>ul > .x{display:none} div > p > i{display:none}</style><ul><li><b class=x>a</b></ul><ul><div class=x>gone</div></ul><div><p>b<i>gone</i><b><i>c</i></b></p></div>", ["a", "bc"]),
        ("<style>.a > .b .c{display:none}</style><div class=a><div class=b><div class=b><i class=c>gone</i>x</div></div></div>", ["x"]),
        ("<ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>", ["kanji"]),
    ],
)
def test_markup(page, want):
    got = [x.strip() for x in html_text.page_text(page)[0].split("\n") if x.strip()]
    assert [x.removeprefix("- ").removeprefix("* ").removeprefix("• ") for x in got] == want


def test_cells_from_above_keep_their_column():
    text = html_text.page_text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>")[0]
    lines = [x for x in text.split("\n") if x.strip()]
    assert [x.index(c) for x, c in zip(lines, "bce", strict=True)] == [lines[0].index("b")] * 3 and lines[1].strip() == "c"


def test_many_rules_and_elements_are_quick():
    sheet = "".join(f".c{i} .d{i}{{display:none}}\n" for i in range(1500))
    page = f"<style>{sheet}</style><div class=c7>" + "".join(f"<p class=d{i % 1500}>x{i}</p>" for i in range(4000)) + "</div>"
    began = time.perf_counter()
    text = html_text.page_text(page)[0]
    assert time.perf_counter() - began < 2
    assert "x7\n" not in text and "x8" in text and text.count("x") == 4000 - 3


def test_words_differ_after_any_byte():
    a, b = "x" * 100 + "a", "x" * 100 + "b"
    _, _, one = toxicity.word_buckets([a])
    _, _, two = toxicity.word_buckets([b])
    assert (one[0, :4] == two[0, :4]).all() and one[0, 4] != two[0, 4]


def test_scripts_without_spaces_are_read_to_the_end():
    r = random.Random(1)
    text = "".join(chr(0x4E00 + r.randrange(500)) for _ in range(300))
    n, doc, buckets = toxicity.word_buckets([text, text[:-1] + "鿿", "no change here"])
    assert (doc == 0).sum() == len({text[i : i + 3] for i in range(298)})
    assert set(buckets[doc == 0][:, 4]) != set(buckets[doc == 1][:, 4]) and (doc == 2).sum() == 3


def test_many_addresses_take_time_in_proportion():
    text = " ".join(f"n{i}@host{i % 7}.org" for i in range(100_000))
    base = pii.base_spans(text)
    extra = [(0, s + 1, e + 1) for _, s, e in base[::2]] + [(3, len(text), len(text) + 5)]
    began = time.perf_counter()
    spans = pii.merged(base, extra)
    assert time.perf_counter() - began < 2 and len(spans) == len(base) + 1


def test_merged_spans_against_all_pairs():
    r = random.Random(2)
    for _ in range(300):
        some = lambda n: [(r.randrange(4), s, s + r.randrange(1, 9)) for s in (r.randrange(60) for _ in range(n))]
        base, more = some(r.randrange(8)), some(r.randrange(8))
        want = sorted(set(base) | {x for x in more if not any(x[1] < e and s < x[2] for _, s, e in base)})
        assert pii.merged(base, more) == want


def test_short_runs_of_groups_are_no_cards():
    model = pii.trained_crf()
    found = dict(zip(("phone", "card"), (pii.all_spans(model, ["please call 020 7946 0958 today", "paid with 4111 1111 1111 1111 today"])), strict=True))
    kinds = lambda spans: {pii.KINDS[k] for k, _, _ in spans}
    assert "card" not in kinds(found["phone"][1]) and kinds(found["card"][1]) == {"card"}
