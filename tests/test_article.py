import random

import pytest

from crawlspark.functions.article import article, article_of
from crawlspark.sources import snapshot

LONG = "one two three four five six seven eight nine ten eleven twelve, and so it goes on and on."


def page(*parts):
    return "<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>"


def test_an_article_without_its_tag():
    menu = "<div class=m><ul>" + "".join(f"<li><a href=/{i}>a link to somewhere else number {i}</a></li>" for i in range(30)) + "</ul></div>"
    text = f"<div><div class=x><h1>Head</h1><p>{LONG}</p><p>Second &amp; {LONG}<p>unclosed {LONG}</div></div>"
    content, paragraphs = article_of(page("<nav>menu words that are not for reading here</nav>", menu, text, "<footer>foot</footer>", "<script>var t='</p>'</script>"))
    assert content == f"Head {LONG} Second & {LONG} unclosed {LONG}"
    assert paragraphs == [LONG, f"Second & {LONG}", f"unclosed {LONG}"]


def test_siblings_of_the_best():
    intro, ad = f"<p>{' '.join(['intro'] * 45)}</p>", "<div>an ad of a few words</div>"
    content, _ = article_of(page(f"<div>{intro}{ad}<section>{f'<p>{LONG}</p>' * 8}</section><section><p>{LONG}</p><p>{LONG}</p></section></div>"))
    assert content.startswith("intro") and content.count("eleven") == 10 and "ad" not in content.split()


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("plain words", "plain words"), (page("<p>few</p>"), "few"), (page("<div>an ad</div><article><p>few</p></article>"), "few"), ("<p>a<div>b</span></p>c", "a b c"), ("<<<>>", "< < < >>"), (page("<p>" * 2000 + "deep"), "deep"), (page("<div>" * 3000 + LONG), LONG)])
def test_odd_pages(html, text):
    assert article_of(html)[0] == text


def brute(tree):
    """Scores of nested lists (tag, children or words) straight from the definition; returns the best one's words."""
    def words(t):
        return [t] if isinstance(t, str) else [w for c in t[1] for w in words(c)]

    every = []

    def walk(t, parents):
        if isinstance(t, str):
            return
        every.append((t, parents))
        for c in t[1]:
            walk(c, [t, *parents])

    walk(tree, [])
    scores = {id(t): 0.0 for t, _ in every}
    for t, parents in every:
        if not any(not isinstance(c, str) for c in t[1]):
            s = max(0, len(words(t)) - 5) / (1 if t[0] == "p" else 4)
            for k, p in enumerate(parents[:2]):
                scores[id(p)] += s / (k + 1)
    best = max(every, key=lambda x: scores[id(x[0])])
    if not scores[id(best[0])]:
        return words(tree)
    siblings = best[1][0][1] if best[1] else [best[0]]
    out = []
    for t in siblings:
        if t is best[0] or (not isinstance(t, str) and ((t[0] == "p" and len(words(t)) >= 40) or scores[id(t)] >= 0.2 * scores[id(best[0])])):
            out += words(t)
    return out


def test_against_brute_force():
    rng, n = random.Random(7), iter(range(10**9))

    def make(depth):
        if depth == 3 or rng.random() < 0.4:
            return ("p" if rng.random() < 0.7 else "div", [f"w{next(n)}" for _ in range(rng.choice([2, 8, 20, 45]))])
        return ("div", [make(depth + 1) for _ in range(rng.randint(1, 4))])

    write = lambda t: t + " " if isinstance(t, str) else f"<{t[0]}>{''.join(map(write, t[1]))}</{t[0]}>"
    for _ in range(300):
        tree = ("body", [make(0) for _ in range(rng.randint(1, 4))])
        assert article_of(write(tree))[0].split() == brute(tree)


def test_column(spark):
    table = spark.createDataFrame([(page(f"<div><p>{LONG}</p></div>"),), (None,)], "html string")
    got = sorted(((r.a.content, r.a.paragraphs) for r in table.select(article("html").alias("a")).collect()), key=str)
    assert got == sorted([(LONG, [LONG]), ("", [])], key=str)
    seen = snapshot.fetched(spark.createDataFrame([("https://a.x/", page(f"<div><p>{LONG}</p></div>"))], "url string, html string"))
    (r,) = snapshot.records(seen, readability=True).collect()
    assert (r.content, r.paragraphs) == (LONG, [LONG])
