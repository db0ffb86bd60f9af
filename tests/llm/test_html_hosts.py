"""What a host repeats is boilerplate whatever the host's size and groups."""

import numpy as np
import pytest

from rasterloom.llm import html


@pytest.mark.parametrize(("pages", "group_tokens"), [(60, 200_000), (300, 200_000), (300, 500)])
def test_banner_goes_from_hosts_of_any_size(spark, pages, group_tokens):
    banner = "<div>Read all of our daily news in one place today</div>"
    rows = [(k, f"http://b.org/{k}", f"<body>{banner * (k < 10)}<div>Story {k} of {k * 7} tells {k * 3} things</div></body>") for k in range(pages)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_tokens=group_tokens).collect()}
    assert found == {k: f"Story {k} of {k * 7} tells {k * 3} things" for k in range(pages)}


def template_host(rng, n: int, host: str, article: bool) -> list[tuple[int, str, str, str]]:
    """(page_id, url, html, main text): a banner and a closing note on every page, a licence line on a third of them."""
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 5000, k))
    banner, note = "Welcome to the one and only herald of the northern valley", "Write to the desk if you found any mistake in this story"
    licence = "This text may be shared under the terms of the public licence number four"
    out = []
    for k in range(n):
        blocks = [word(12), word(60), *([licence] if k % 3 == 0 else []), word(30)]
        body = "".join(f"<p>{b}</p>" for b in (banner, *blocks, note))
        own = f"<article>{body}</article>" if article else f"<div>{body}</div>"
        # without an article the licence is on many pages, and so boilerplate
        out.append((k, f"http://{host}/{k}", f"<body><nav><a>x</a></nav>{own}</body>", "\n\n".join(b for b in blocks if article or b != licence)))
    return out


@pytest.mark.parametrize("group_tokens", [200_000, 2_000])
def test_template_text_goes_and_shared_passages_stay(spark, group_tokens):
    rng = np.random.default_rng(3)
    pages = [(1000 * h + k, url, page, text) for h, (name, a) in enumerate((("a.org", True), ("b.org", False), ("c.org", True))) for k, url, page, text in template_host(rng, 60, name, a)]
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in html.extract(frame, group_tokens=group_tokens).collect()}
    hit = sum(got[p].text == text for p, _, _, text in pages)
    assert hit >= 0.99 * len(pages) and sum(r.boilerplate for r in got.values()) == len(pages)


def test_runs_against_brute_force(spark):
    """Which tokens go, from counts of all runs by plain dictionaries."""
    rng = np.random.default_rng(4)
    pages = template_host(rng, 40, "d.org", True)
    streams = ["".join(("\x1d" if a else "\x1e") + t for a, t in html.blocks_of(p[2])).removeprefix("\x1e") for p in pages]
    seen: dict[tuple, set[int]] = {}
    for k, s in enumerate(streams):
        words = html._words(s)
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), set()).add(k)
    for s, mask in zip(streams, html.repeated(streams), strict=True):
        words, want = html._words(s), [False] * len(html._words(s))
        for i in range(len(words) - 7):
            if len(seen[tuple(words[i : i + 8])]) >= 30:
                want[i : i + 8] = [True] * 8
        assert [w for w, x, m in zip(words[1:], want[1:], mask, strict=True) if len(w) > 1 and x != m] == []


def test_small_hosts_and_copies(spark):
    text = "Nine words stand in this one short paragraph here"
    page = f"<article><p>{text}</p></article>"
    rows = [(k, "http://s.org/1", page) for k in range(30)] + [(100, None, page), (101, "http://t.org", None), (None, "odd", f"<p>{text}</p>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 33
    assert {r.text for r in got if r.page_id != 101} == {text} and [r.text for r in got if r.page_id == 101] == [""]


def test_near_copies_of_an_article_stay_whole(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(k, f"http://n.org/{k}", f"<article><p>{text}</p><p>copy number {k} ends here</p></article>") for k in range(40)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {k: f"{text}\n\ncopy number {k} ends here" for k in range(40)}
