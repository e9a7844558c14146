import pytest

from gaugeworks.llm.html_text import extract_pages, main_text, smoothed, upper_cluster

LONG = "A sentence of the article that goes on for quite a while, with commas and all. " * 4
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now, it is a long advert text indeed.</div><article><h1>Title</h1><p><b>{LONG}<br><p>Of.</p><p>x &amp; y&nbsp;z</article><footer>&copy; foot</footer>", f"Title {LONG.strip()} Of. x & y z"),
    (f"<body><header>Top</header><div id=wrap><div class='content'><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='sidebar'>side</div></div><div id='comments'><p>{LONG}</p></div><footer>f</footer></body>", f"{LONG.strip()} Short. {LONG.strip()}"),
    (f"<main><h2>H</h2><p>{LONG}</p><form>Mail <input> me</form><div class='cookie-notice'>We use</div><aside>a</aside></main>", f"H {LONG.strip()}"),
    ("", ""),
    ("plain text only", "plain text only"),
    ("<nav>menu</nav>", ""),
    ("<article>one <i>two</i>three<td>cell</article>", "one twothree cell"),
    ("<article><p>open <script>never closed", "open"),
    ("<article><p>a <span class=ad>x <span>y</span> z</span>b <button>no</button>c<noscript>n</noscript></p></article>", "a b c"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_pages(html, text):
    assert main_text(html) == text


def test_rows(spark):
    rows = [(k, f"u{k}", h, "x") for k, (h, _) in enumerate(PAGES)] + [(None, None, None, None), (1, "u1", PAGES[1][0], "x"), (50, "long", "<article><p>" + "word " * 40000, "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()
    want = sorted([(k, t) for k, (_, t) in enumerate(PAGES)] + [(-1, ""), (1, PAGES[1][1]), (50, ("word " * 40000).strip())])
    assert sorted((-1 if r.page_id is None else r.page_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_smoothing_and_clusters():
    import numpy as np

    assert smoothed(np.ones(7)).tolist() == pytest.approx([1] * 7)
    assert upper_cluster(np.array([0.1, 0.2, 5, 6, 0.0])).tolist() == [False, False, True, True, False]


LINKS = "".join(f"<span><i><a href=/{k}>Place {k}</a></i></span><br>" for k in range(8))
SHORT = "<div><p><b>Hot</b></p></div><div><p><i>New</i></p></div><div><p><b>Top</b></p></div><div><p><b>All</b></p></div>"
UNNAMED = f"<body><div>{LINKS}</div>{SHORT}<div><h2>Title</h2><p>{LONG}</p><p>Of.</p><ul><li>one<li>two</ul><p>{LONG}</p><p>End.</p></div>{SHORT}<div>{LINKS}</div></body>"


def test_ratios_choose_the_region_where_nothing_is_named(monkeypatch):
    import numpy as np

    from gaugeworks.llm import html_text

    want = f"Title {LONG.strip()} Of. one two {LONG.strip()} End."
    assert main_text(UNNAMED) == want
    monkeypatch.setattr(html_text, "upper_cluster", lambda values: np.ones(len(values), bool))
    assert main_text(UNNAMED) != want  # the clusters decide


def test_region_against_clusters_by_hand():
    import numpy as np

    texts = [LONG, "Of.", "x", LONG, "y"]
    html = "<body>" + "".join(f"<div><p>{t}</p></div>" for t in texts) + "</body>"
    tags = [3, 4, 4, 4, 4]  # body div p, then p div div p
    ratio = np.log1p(np.array([len(t.strip()) for t in texts]) / tags)
    weight = np.exp(-0.5 * (np.arange(5)[:, None] - np.arange(5)) ** 2) * (abs(np.arange(5)[:, None] - np.arange(5)) <= 3)
    smooth = weight @ ratio / weight.sum(axis=1)
    cut = max(((smooth[smooth > c].mean() + smooth[smooth <= c].mean()) / 2 for c in [(smooth.min() + smooth.max()) / 2]), default=0)
    for _ in range(30):
        cut = (smooth[smooth > cut].mean() + smooth[smooth <= cut].mean()) / 2
    assert main_text(html) == " ".join(t.strip() for t, s in zip(texts, smooth) if s > cut)


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<html><head><title>T</title><meta name=a><body><p>{LONG}</p>", LONG.strip()),
        (f"<head><title>T</title><div><p>{LONG}</p></div>", LONG.strip()),
        (f"<head><script>x</script><noscript><img src=a></noscript><body><p>{LONG}</p>", LONG.strip()),
        *[(f"<body><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>side</div></body>", f"{LONG.strip()} {LONG.strip()}") for name in ("content has-sidebar", "no-comments", "page with-banner", "content-sidebar-wrap")],
        (f"<body><div class='sidebar-layout'><main><p>{LONG}</p></main></div><div class=related><p>{LONG}</p><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><article><p>{LONG[:160]}</p></article></body>", f"{LONG.strip()} {LONG.strip()}"),
    ],
)
def test_whole_pages_stay(html, text):
    assert text in main_text(html) and "side" not in main_text(html)
