"""Pages that markup and differencing judge together, and runs of copies."""

import pytest

from matchloom.llm import html_text


@pytest.fixture(scope="module")
def texts(spark):
    def run(rows, parts=2, **options):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        return {r.page_id: r.text for r in html_text.extract(df, **options).collect()}

    return run


def test_lines_outside_articles(texts):
    teasers = [(k, f"http://t/{k}", f"<div>Site</div><section><p>Body {k}</p></section><article>Teaser {k}</article><div>End</div>") for k in range(4)]
    remarks = [(10 + k, f"http://u/{k}", f'<div>Site</div><div><p>Body {k}</p></div><article class="comment"><p>Nice {k}</p></article>') for k in range(4)]
    got = texts(teasers + remarks)
    assert all(got[k] == f"Body {k}\nTeaser {k}" and got[10 + k] == f"Body {k}" for k in range(4))
    assert html_text.lines('<article class="post comment-list">a</article><main class="sidebar">b</main>') == [("a", True), ("b", True)]
    assert html_text.lines('<main><article class="comment">a</article><p>b</p></main>') == [("b", True)]


def test_noise_inside_an_article():
    inside = ["entry-notice", "post-ad", "post-comments", "ad-container", "articleComments", "comment-body", "cookie_notice", "site-footer"]
    for name in inside:
        assert html_text.lines(f'<article><h1>T</h1><p>a</p><div class="{name}"><p>x</p></div><p>b</p></article>') == [("T", True), ("a", True), ("b", True)], name
    for name in ["entry-content", "has-sidebar", "post-body no-comments", "main-text", "header-less story", "lead", "adventure", "post-header"]:
        assert html_text.lines(f'<article><div class="{name}"><p>a</p></div></article>') == [("a", True)], name


def test_differencing_within_articles(texts):
    # the site's own lines return in article after article; the first and last page of a host have one neighbour only
    page = lambda *lines: f"<nav>Home</nav><article>{''.join(f'<p>{x}</p>' for x in lines)}</article>"
    rows = [(k, f"http://s/{k}", page(f"Story {k}", f"More {k}", "Read our other stories", f"End {k}")) for k in range(5)]
    # an article that returns as a whole, but for a line, is a copy
    rows += [(10 + k, f"http://c/{k}", page("One", "Two", "Three", f"Copy {k}")) for k in range(3)]
    # what only one neighbour shares stays
    rows += [(20, "http://d/a", page("A1", "A2", "Same")), (21, "http://d/b", page("B1", "B2", "Same")), (22, "http://d/c", page("C1", "C2", "C3"))]
    whole = texts(rows)
    assert all(whole[k] == "\n".join(x for x, _ in html_text.lines(html)) for k, _, html in rows)
    got = texts(rows, within_articles=True)
    assert all(got[k] == f"Story {k}\nMore {k}\nEnd {k}" for k in (1, 2, 3))
    assert got[0] == "Story 0\nMore 0\nRead our other stories\nEnd 0"
    assert all(got[10 + k] == f"One\nTwo\nThree\nCopy {k}" for k in range(3))
    assert got[21] == "B1\nB2\nSame"


def test_runs_of_copies(texts):
    page = lambda k: f"<div>Site</div><div>Menu</div><p>Story {k}</p><div>End</div>"
    rows = [(0, "http://h/a", page("a"))]
    rows += [(1 + k, f"http://h/b?q={k:03}", page("b")) for k in range(150)]
    rows += [(200, "http://h/c", page("c")), (201, "http://i/c", page("c")), (202, "http://j/x?1", page("j")), (203, "http://j/x?2", page("j"))]
    for parts in (1, 7):
        got = texts(rows, parts)
        assert got[0] == "Story a" and got[200] == "Story c" and {got[1 + k] for k in range(150)} == {"Story b"}
        # one page on its host, and two copies with no other page: nothing to tell them by
        assert got[201] == "Site\nMenu\nStory c\nEnd" and got[202] == got[203] == "Site\nMenu\nStory j\nEnd"


def test_nodes_against_brute_force(texts):
    import random

    rng = random.Random(5)
    rows = []
    for k in range(400):
        lines = [f"L{rng.randrange(6)}" for _ in range(rng.randrange(1, 5))] if rng.random() < 0.6 or not rows else None
        tag = lambda x: rng.choice(["<p>{}</p>", "<p>{}</p>", "<nav>{}</nav>", "<article>{}</article>"]).format(x)
        rows.append((k, f"http://{'xy'[k // 300]}/{k:04}", "".join(map(tag, lines)) if lines else rows[-1][2]))
    nodes = []
    for k, url, html in rows:
        if not nodes or nodes[-1][0] != url[:8] or [t for t, _ in html_text.blocks(nodes[-1][1])] != [t for t, _ in html_text.blocks(html)]:
            nodes.append((url[:8], html, []))
        nodes[-1][2].append((k, url[8:]))
    want = {}
    for i, (host, html, own) in enumerate(nodes):
        mine = [html_text._hash(t) for t, _ in html_text.blocks(html)]
        near = [(html_text._near(nodes[i - 1][2][-1][1], own[0][1]), -i + 1)] if i and nodes[i - 1][0] == host else []
        near += [(html_text._near(own[-1][1], nodes[i + 1][2][0][1]), -i - 1)] if i + 1 < len(nodes) and nodes[i + 1][0] == host else []
        other = [html_text._hash(t) for t, _ in html_text.blocks(nodes[-max(near)[1]][1])]
        gone = set(html_text.common(html_text.np.array(mine), html_text.np.array(other)))
        text = "\n".join(t for j, (t, role) in enumerate(html_text.blocks(html)) if role == 2 or role == 1 and j not in gone)
        want.update({k: text for k, _ in own})
    assert texts(rows, 3) == want
