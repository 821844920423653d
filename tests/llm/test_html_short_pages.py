"""Short pages in named wrappers, parts of articles with names, deep nesting, and the clustering by hand."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest

from orrery.llm.html_extract import content_threshold, extract_text, smoothed_ratios

SENTENCE = "Some words of a text that is short. "


@pytest.mark.parametrize("length", [20, 30, 100, 190, 199, 201, 1000])
@pytest.mark.parametrize("wrapper", ["<body><form id=aspnetForm>%s</form>", '<body class="page has-sidebar comments">%s', "<body><nav><a href=x>Home</a>%s", "<body><nav><ul><li><a href=x>Home</a></ul></nav><form>%s</form><aside>See also</aside>"])
def test_a_page_in_a_named_wrapper_keeps_its_text_at_any_length(wrapper, length):
    text = (SENTENCE * 40)[:length].strip()
    assert text in extract_text(f"<html>{wrapper % f'<div><p>{text}</p></div>'}</html>")


def test_nothing_but_menus_is_empty():
    assert extract_text("<body><nav><a href=x>Home</a> <a href=y>News</a></nav></body>") == ""
    assert extract_text("<body></body>") == extract_text(None) == extract_text("<nav></nav>") == ""


def test_parts_of_an_article_with_names_stay():
    long = f"<p>{SENTENCE * 30}</p>"
    page = f"""<article><h1>T</h1><p class=byline>By A. Writer</p>{long}<p>Let <math><mi>x</mi><annotation>\\x</annotation></math> be.</p>
    <div class=share><p>{SENTENCE * 3}</p></div><div class=menu><p>Soup with bread, then fish of the day and a pear for all guests.</p></div>{long}
    <div class=share-buttons><a href=x>Tell all</a><a href=y>Send</a></div><form><p>{SENTENCE * 3}</p></form></article>"""
    got = extract_text(page).split("\n\n")
    assert got[1] == "By A. Writer" and "Let x be." in got and any(x.startswith("Soup") for x in got) and got.count((SENTENCE * 3).strip()) == 1 and "Tell all" not in " ".join(got)


def test_copyright_without_a_name_goes():
    long = f"<p>{SENTENCE * 30}</p>"
    got = extract_text(f"<body><div><div>{long}{long}</div><div>Copyright 2024 Example Inc.</div></div></body>")
    assert "Copyright" not in got and got.count("\n\n") == 1


def test_deep_nesting_takes_time_by_its_size():
    began = time.time()
    assert extract_text("<div>" * 100_000 + "deep text" + "</div>" * 100_000) == "deep text"
    page = "".join(f"<div class='part comments' id=n{i}><p>{SENTENCE}</p>" for i in range(20_000))
    assert extract_text(page).startswith(SENTENCE.strip()) and extract_text(page.replace("part comments", "part")).count("\n\n") == 19_999
    assert extract_text("<p>a</p>" + "<div>" * 50_000 + "</b></i></u>" * 50_000) == "a"
    assert time.time() - began < 60


def test_ratios_and_threshold_by_hand():
    rng = random.Random(5)
    for n in (1, 2, 5, 40):
        sizes, tags = [rng.choice([3, 20, 400, rng.randrange(1, 900)]) for _ in range(n)], [rng.randrange(0, 9) for _ in range(n)]
        ratio = [s / max(t, 1) for s, t in zip(sizes, tags, strict=True)]
        weight = [math.exp(-(k * k) / 2) for k in range(-3, 4)]
        want = [sum(w * ratio[min(n - 1, max(0, i + k))] for k, w in zip(range(-3, 4), weight, strict=True)) / sum(weight) for i in range(n)]
        got = smoothed_ratios(np.array(sizes), np.array(tags))
        assert np.allclose(got, want)
        logs, best = sorted(math.log1p(x) for x in want), None
        for i in range(1, n):
            if logs[i] == logs[i - 1]:
                continue
            low, high = logs[:i], logs[i:]
            spread = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            if best is None or spread > best[0] * (1 + 1e-12):
                best = (spread, math.expm1(low[-1]))
        assert content_threshold(np.array(want)) == pytest.approx(best[1] if best else -1.0)
