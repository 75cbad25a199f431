import html
import math
import random
import re

import numpy as np
import pytest

from knotwork.llm import html_extract as X


def page(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["stone", "river", "under", "green", "light", "walk"]) + str(rng.randint(0, 99)) for _ in range(n))
    menu = "".join(f'<li><a href="/{i}">nav{i}</a></li>' for i in range(8))
    text = [words(rng.randint(25, 60)) for _ in range(rng.randint(3, 7))]
    body = "".join(f"<p>{t}</p>" for t in text)
    made = f"<!DOCTYPE html><html><head><title>A &amp; B</title><script>var x='<p>no</p>';</script></head><body><nav><ul>{menu}</ul></nav><article>{body}</article><footer><ul>{menu}</ul></footer></body></html>"
    return made, " ".join(text).split()


def test_content_is_found():
    right = kept = wanted = 0
    for seed in range(60):
        made, gold = page(seed)
        title, content, *_ = X.extract(made)
        assert title == "A & B" and "no" not in content.split()
        got = content.split()
        right += len(set(got) & set(gold))
        kept += len(set(got))
        wanted += len(set(gold))
    assert right / kept > 0.95 and right / wanted > 0.95


def test_smoothing_and_threshold_are_what_they_say():
    rng = np.random.default_rng(1)
    p, x = X.HtmlParams(), rng.random(12)
    for i in range(12):
        near = range(max(0, i - 3), min(12, i + 4))
        weight = np.array([np.exp(-0.5 * (j - i) ** 2) for j in near])
        assert abs(X.smooth(x, p)[i] - (weight * x[list(near)]).sum() / weight.sum()) < 1e-12
    s = np.sort(x)
    inside = [s[:k].var() * k + s[k:].var() * (12 - k) for k in range(1, 12)]
    assert X.cluster_threshold(x)[0] == s[int(np.argmin(inside)) + 1]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain text"), (4, "u", "<p>broken <b>mark-up"), (5, "u", "<script>only()</script>"), (None, "u", "<p>x</p>"),
            (6, "u", "<p>" + "long text " * 50000 + "</p>"), (6, "u", "<br>" * 3), (7, "u", "<head><title>T<body><p>hello</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as title", "2 as content")
    found = X.extract_pages(df).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found if r["page_id"] != 6}
    assert by[1]["content"] is None and by[2]["content"] == "" and by[3]["content"] == "plain text" and by[4]["content"] == "broken mark-up"
    assert by[5]["content"] == "" and by[None]["content"] == "x"
    assert max(len(r["content"]) for r in found if r["page_id"] == 6) == 499999
    assert X.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "title", "content"),
    [
        ("<head><title>T</title><p>hello there</p>", "T", "hello there"),
        ("<title>T</title><meta charset=x>bare text", "T", "bare text"),
        ("<html><head><title>T</title><script>x</script>\n<div>a</div></head><body><p>b", "T", "a\nb"),
        ("<p>intro text<select><option>one<p>after it", "", "intro textone\nafter it"),
        ("<p>intro <select><option>one</select>text<p>after it", "", "intro text\nafter it"),
        ("<p>one<noscript>no<p>two<p>three", "", "oneno\ntwo\nthree"),
        ("<p>one<noscript><p>no</p></noscript> two<p>three", "", "one two\nthree"),
        ("<p>a<textarea>b<svg>c</svg><iframe>d</iframe><p>e", "", "ab\ne"),
        ("<head><noscript>x<p>hello", "", "x\nhello"),
        ("<title>never closed<p>text", "", "never closed\ntext"),
        ("<title>T</title><p>x<svg><title>icon</title></svg>y", "T", "xy"),
        ("<p>a<script>var x = 1;<p>code", "", "a"),
        ("<select>" * 300 + "deep", "", "deep"),
        ("<head>" * 3 + "x</select></head>", "", "x"),
    ],
)
def test_unclosed_and_implied_ends(page, title, content):
    assert "\n".join(text for text, _ in X.read(page).lines if text) == content
    assert X.extract(page)[0] == title and X.extract(page)[1]


def plain(page, p=X.HtmlParams()):
    """``extract`` of a well-formed page by expressions and double loops."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    found = re.search(r"(?s)<title>(.*?)</title>", page)
    title = " ".join(html.unescape(found[1]).split()) if found else ""
    page = re.sub(r"(?s)<head>.*?</head>", "<head>", page)
    page = re.sub(r"(?s)<(script|style)\b[^>]*>.*?</\1>", r"<\1>", page)
    lines, text, tags = [], "", 0

    def end():
        nonlocal text, tags
        if text.split() or tags:
            lines.append((" ".join(text.split()), tags))
        text, tags = "", 0

    for tag, data in re.findall(r"(<[^>]*>)|([^<]+)", page):
        if data:
            for i, piece in enumerate(html.unescape(data).split("\n")):
                if i:
                    end()
                text += piece
            continue
        closing, name = re.match(r"<(/?)\s*([a-zA-Z0-9]+)", tag).groups()
        if name in X.BLOCKS and not closing:
            end()
        tags += 1
        if name in X.BLOCKS and closing:
            end()
    end()
    if not lines:
        return title, "", 0, 0, 0.0
    ratio = [len(t) / max(1, n) for t, n in lines]
    level = []
    for i in range(len(ratio)):
        near = [j for j in range(len(ratio)) if abs(i - j) <= p.radius]
        weight = [math.exp(-0.5 * ((i - j) / p.sigma) ** 2) for j in near]
        level.append(math.log1p(sum(w * ratio[j] for w, j in zip(weight, near)) / sum(weight)))
    best = None
    for k in sorted(set(level))[1:]:
        low, high = [x for x in level if x < k], [x for x in level if x >= k]
        mean = lambda v: sum(v) / len(v)
        inside = sum((x - mean(low)) ** 2 for x in low) + sum((x - mean(high)) ** 2 for x in high)
        if best is None or inside < best[0] - 1e-9:
            best = inside, k, mean(low), mean(high)
    every = best is None or math.expm1(best[3]) < p.contrast * math.expm1(best[2])
    kept = [t for (t, _), x in zip(lines, level) if t and (every or x >= best[1])]
    return title, "\n".join(kept), sum(1 for t, _ in lines if t), len(kept), 0.0 if every else math.expm1(best[1])


def test_pages_against_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    found = X.extract_pages(pages).collect()
    assert len(found) == len(sources) >= 50
    same = 0
    for r in found:
        want = plain(sources[r["page_id"]])
        assert r["title"] == want[0] and r["n_lines"] == want[2] and bool(r["content"]) == bool(want[2])
        same += (r["content"], r["kept_lines"]) == (want[1], want[3]) and abs(r["threshold"] - want[4]) < 1e-6
    assert same >= len(found) - 1  # equal sums of squares may fall on either side of rounding
