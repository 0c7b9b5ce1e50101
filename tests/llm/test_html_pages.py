"""Held-out pages of many layouts: every block is known to be main text or not."""

import random
import time

import pytest

from marklens.llm import html_text

WORDS = "river stone amber field quiet winter harbour signal copper meadow lantern orchard violet engine paper sparrow".split()


def words(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def furniture(rng):
    """(before, after): markup around the main text with the texts that must not come out."""
    link = lambda: f'<a href="/{rng.randrange(99)}">{words(rng, rng.choice((1, 1, 2, 3)))} L{rng.randrange(10**9)}</a>'
    links = lambda n: "".join(f"<li>{link()}</li>" for _ in range(n))
    before = [
        f"<nav><ul>{links(rng.randrange(1, 7))}</ul></nav>",
        f"<header><div>{words(rng, 2)} F1</div>{link()}</header>",
        f'<div class="navbar">{link()} {link()} {link()}</div>',
        f"<div><ul>{links(rng.randrange(3, 7))}</ul></div>",
    ]
    after = [
        f"<footer><p>{words(rng, rng.choice((3, 12, 40)))} F2</p></footer>",
        f'<div id="footer"><p>{words(rng, 9)} F3</p></div>',
        f'<aside><h3>{words(rng, 2)} F4</h3><ul>{links(4)}</ul><p>{words(rng, 25)} F4</p></aside>',
        f'<div class="comments"><p>{words(rng, 30)} F5</p><p>{words(rng, 6)} F5</p></div>',
        f"<form><label>{words(rng, 2)} F6</label><button>go F6</button></form>",
        f'<div class="cookie-notice">{words(rng, 14)} F7</div>',
        f"<div><ul>{links(5)}</ul></div>",
        f"<script>var x = '{words(rng, 3)} F8';</script>",
        f"<style>.x {{ content: 'F9' }}</style>",
    ]
    return "".join(rng.sample(before, rng.randrange(1, 3))), "".join(rng.sample(after, rng.randrange(1, 5)))


def page(seed):
    rng = random.Random(seed)
    length = rng.choice((8, 15, 20, 32, 60, 120))
    main = []
    for i in range(rng.randrange(2, 8)):
        if i == 0 or rng.random() < 0.2:
            main.append(("h1" if i == 0 else "h2", words(rng, rng.randrange(2, 8)) + f" M{i}"))
        main.append(("p", words(rng, max(4, int(length * rng.uniform(0.7, 1.3)))) + f" M{i}b"))
    inner = "".join(f"<{t}>{x}</{t}>\n" for t, x in main)
    before, after = furniture(rng)
    shape = rng.choice(("bare", "div", "section", "article", "main", "table", "open"))
    inner = {
        "bare": inner, "div": f'<div class="content">{inner}</div>', "section": f"<section>{inner}</section>", "article": f"<article>{inner}</article>",
        "main": f"<main>{inner}</main>", "table": f"<table><tr><td>{inner}</td></tr></table>", "open": inner.replace("</p>", ""),
    }[shape]
    return f"<html><head><title>{words(rng, 3)} F0</title></head><body>{before}{inner}{after}</body></html>", [x for _, x in main]


def test_held_out_pages():
    nodes = html_text.grow(*html_text.labelled())
    found = right = wanted = whole = 0
    for seed in range(400):
        html, main = page(seed)
        out = [b for b in html_text.main_text(html, nodes).split("\n\n") if b]
        found += len(out)
        wanted += len(main)
        right += len(set(out) & set(main))
        whole += out == main
    print(f"precision {right / found:.4f}, recall {right / wanted:.4f}, whole pages {whole} of 400")
    assert right / found >= 0.98 and right / wanted >= 0.98


P = "<p>" + " ".join(["plain"] * 60) + "</p>"


@pytest.mark.parametrize(("html", "want"), [
    ("<h1>A title here</h1>" + "".join(f"<p>{'w' * 3} {i} {'word ' * 30}</p>" for i in range(5)) + "<footer>foot note here</footer>", 6),
    ("".join(f"<p>{'word ' * 19}{i}</p>" for i in range(3)), 3),
    ("<nav><a href=/>home</a></nav>" + "".join(f"<p>{'word ' * 59}{i}</p>" for i in range(3)), 3),
    ("".join(f"<p>{'word ' * 59}{i}</p>" for i in range(3)) + f"<footer>{'foot ' * 40}</footer>", 3),
    (f"<video src=a>{P}{P}", 2), (f"<object data=a>{P}{P}", 2), (f"<svg>{P}{P}", 2), (f"<svg/>{P}{P}", 2),
    (f"{P}<script src=a.js/>var program = 1;</script>{P}", 2), (f"{P}<script>no end {P}", 1), ("<p>hid</p" * 0 + "", 0),
])
def test_blocks_kept(html, want):
    out = html_text.main_text(f"<html><body>{html}</body></html>", html_text.grow(*html_text.labelled()))
    assert len([b for b in out.split("\n\n") if b]) == want
    assert "foot" not in out and "home" not in out and "program" not in out


@pytest.mark.parametrize("tag", ["<svg>", "<button>", "<select>", "<video>", "<p>x</p>", "<div class=a>"])
def test_time_follows_the_length(tag):
    nodes = html_text.grow(*html_text.labelled())
    times = []
    for n in (10_000, 40_000):
        start = time.perf_counter()
        html_text.main_text(tag * n, nodes)
        times.append(time.perf_counter() - start)
    assert times[1] < 10 * times[0] + 0.5
