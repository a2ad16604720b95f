import random

import pytest

from tessera.llm import extract

SCHEMA = "page_id bigint, url string, html string"


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        chosen = [a[i] for i in sorted(extract.shared_lines(a, b))]
        rest = iter(b)
        assert len(chosen) == lcs(a, b) and all(c in rest for c in chosen)


@pytest.mark.parametrize("page, lines", [
    ("", []),
    ("plain &amp; simple &lt;b&gt; &am", ["plain & simple <b> &am"]),
    ("<p>One <b>two</b>three<br>four<p>Five<ul><li>a<li>b</ul>", ["One twothree four", "Five", "a", "b"]),
    ("<head><title>t</title></head><nav>n</nav><div class='cookie-notice'>c</div><h1>T</h1><form>f</form><footer>z", ["T"]),
    ("<div class=comments><p>c1<p>c2</div><p>text", ["text"]),
    ("<article><header><h1>t</h1></header><p>b</p><aside>q</aside></article><header>h</header>", ["t", "b"]),
    ("<body class='has-sidebar no-menu'><p>x</p><p hidden>y</p><p role=navigation>z</p>", ["x"]),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><script>open", ["yes"]),
    ("<p>a\n\t b c</p><p> </p><p title='x > y'>d</p><p class=\"ad", ["a b c", "d"]),
    ("</div></p>x</b>", ["x"]),
])
def test_reading(page, lines):
    assert [line for line, _ in extract.read_lines(page)] == lines


STORY = "A long story in a paragraph that is most of the page. " * 3


@pytest.mark.parametrize("page", [
    "<nav>Home</nav><div class='layout-sidebar-right'>{}<div class='sidebar'>s</div></div><footer>f</footer>",
    "<div>Skip</div><div id='content-and-comments'>{}<div class='comments'><article class='comment'>c</article></div></div>",
    "<div class='banner-page'>{}<div class='ad'>x</div></div>",
    "<form id='all'><div class='top-menu'>m</div>{}<select><option>a</select></form>",
    "<div>Skip</div><form><div class='two-sidebar-theme'>{}</div></form>",
    "<div role='main' class='page-sidebar'>{}</div>",
])
@pytest.mark.parametrize("body", ["<article><p>{}</p><aside>q</aside></article>", "<p>{}</p><aside>q</aside>"])
def test_a_wrapper_named_like_a_part_keeps_the_article(page, body):
    lines = [line for line, _ in extract.read_lines(page.format(body.format(STORY)))]
    assert lines in ([STORY.strip()], ["Skip", STORY.strip()])


@pytest.mark.parametrize("page, lines", [
    (f"<article>Short story</article><div class='comments'>{'<article>' + STORY + '</article>'}</div>", ["Short story"]),
    (f"<p>{STORY}</p><aside class='related'><article>t1</article><article>t2</article></aside>", [STORY.strip()]),
    (f"<p>{STORY}</p><div class='post-comments'>{STORY * 3}</div><form class='newsletter-box'>Mail</form>", [STORY.strip()]),
    (f"<div hidden><article>{STORY}</article></div><p>a <span class=ad>buy</span>b</p>", ["a b"]),
    (f"<nav>{STORY}</nav>", []),
])
def test_parts_stay_out_however_long(page, lines):
    assert [line for line, _ in extract.read_lines(page)] == lines


def furnished(n):
    return [(i, f"https://h{i % 3}.org/a/{i:03d}.html?x={i}",
             f"<body><div>Home | About</div><div>Welcome to our site, please enjoy</div><div>Story {i} tells of {i * 7} and has a lot more text "
             f"to read on this page number {i}, more than the furniture</div><div>(c) Site</div>") for i in range(n)]


def test_furniture_goes_and_stories_stay(spark):
    got = {r.page_id: r.text for r in extract.digest(spark.createDataFrame(furnished(200), SCHEMA)).collect()}
    assert len(got) == 200
    assert all(t.startswith(f"Story {i} ") and "\n" not in t for i, t in got.items())


def test_unshared_lines_stay_and_shared_ones_outside_the_mark_go(spark):
    rows = [(i, f"http://h/{i}", f"<p>Lead of {i}, before the article</p><div>About us</div><article><p>own {i} " + f"and more of {i} " * 9 + "</p></article>")
            for i in range(5)]
    got = {r.page_id: r.text for r in extract.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Lead of {i}, before the article\n\nown {i} " + (f"and more of {i} " * 9).strip() for i in range(5)}


def test_a_mark_protects_what_one_neighbour_shares(spark):
    told = "A paragraph that two articles of the host tell in the same words"
    rows = [(i, f"http://h/{i}", f"<div>Home</div><article><p>{told if i in (1, 2) else f'Paragraph {i} of its own'}</p><p>{f'and the rest of {i} ' * 9}</p></article>") for i in range(6)]
    got = {r.page_id: r.text for r in extract.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].startswith(told) and got[2].startswith(told) and all(not t.startswith("Home") for t in got.values())


def plain_lcs(own, other):
    """Table of longest common subsequences, walked back as the operator does: the places of one of them."""
    n, m = len(own), len(other)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = best[i][j] + 1 if own[i] == other[j] else max(best[i][j + 1], best[i + 1][j])
    return best[n][m]


def test_whole_query_matches_a_plain_version(spark):
    """Pages without marks: nearest other pages by sorted URL, plain common subsequences, all in one list."""
    rng = random.Random(4)
    parts = [f"part {k} of the furniture" for k in range(6)] + [f"foot {k}" for k in range(4)]
    rows = []
    for i in range(120):
        story = [f"line {j} of story {i} with words of its own, number {i * 31 + j}" for j in range(rng.randint(1, 4))]
        head, foot = sorted(rng.sample(range(6), 2)), [rng.randint(6, 9)]
        page = [parts[k] for k in head] + story + [parts[k] for k in foot]
        rows.append((i, f"http://h{i % 2}.org/{rng.randint(0, 9)}/{i:03d}", "".join(f"<p>{x}</p>" for x in page), page))
    got = {r.page_id: r.text for r in extract.digest(spark.createDataFrame([r[:3] for r in rows], SCHEMA)).collect()}
    for host in (0, 1):
        own = sorted((r for r in rows if r[0] % 2 == host), key=lambda r: r[1])
        for at, (page_id, _, _, page) in enumerate(own):
            near = [own[k][3] for k in ((at - 1, at + 1) if 0 < at < len(own) - 1 else (at + 1, at + 2) if not at else (at - 1, at - 2))]
            left = got[page_id].split("\n\n")
            assert [x for x in page if x in left] == left
            # what no neighbour holds stays; as many lines go as the common subsequences hold, or fewer where both hold one
            assert all(x in left for x in page if not any(x in n for n in near))
            common = [plain_lcs(page, n) for n in near]
            assert max(common) <= len(page) - len(left) <= sum(common)


def test_a_mark_on_a_small_part_does_not_drop_the_rest(spark):
    story = "The story of page {0} is told outside any article element, at some length, and ends with number {0}"
    rows = [(i, f"http://h/{i}", f"<div>Home and more</div><p>{story.format(i)}</p><article>Teaser {i}</article><div>(c) Site</div>")
            for i in range(5)]
    got = {r.page_id: r.text for r in extract.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"{story.format(i)}\n\nTeaser {i}" for i in range(5)}


def test_copies_delete_nothing_and_odd_rows(spark):
    page = "<p>An article of its own</p><p>with two lines</p>"
    rows = [(1, "http://a/x", page), (2, "http://a/y", page), (3, None, "<p>q"), (4, "http://a/z", None), (5, "no host", "<p>b"), (5, "no host", "<p>b"),
            (None, "http://b/", "<p>only"), (6, "", ""), (7, "http://c/1", "<p>" + "long text " * 50_000)]
    table = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA + ", text string, n_chars bigint").selectExpr(
        "*", "1 AS `range`", "'k' AS `key`", "2 AS id", "'l' AS lines")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract.digest(table).collect()}
    whole = "An article of its own\n\nwith two lines"
    assert got[1, "http://a/x"] == got[2, "http://a/y"] == (whole, len(whole))
    assert got[3, None] == ("q", 1) and got[4, "http://a/z"] == ("", 0) and got[5, "no host"] == ("b", 1)
    assert got[None, "http://b/"] == ("only", 4) and got[6, ""] == ("", 0) and got[7, "http://c/1"][1] == 499_999
    assert extract.digest(table).count() == len(rows)


def test_copies_share_one_decision_across_ranges(spark):
    def page(story):
        return f"<div>Home | About us and more</div><div>Welcome to our site</div><p>{story}</p><div>(c) Site</div>"

    copied = "A story that many addresses of the host hold, word for word, and no other page"
    rows = [(i, f"http://h/m/{i:03d}", page(copied)) for i in range(150)]
    rows += [(900, "http://h/a", page("The first page has a story of its own, long enough to be more than the rest")),
             (901, "http://h/z", page("The last page has another story of its own, it also is more than the rest"))]
    got = {r.page_id: r.text for r in extract.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(150)} == {copied} and len(got) == 152
    assert got[900].startswith("The first") and got[901].startswith("The last") and "\n" not in got[900] + got[901]


def test_short_pages_lose_their_furniture(spark):
    furniture = "<div>Home | About | News | Sport | Weather | Travel | Culture | Shop | Contact | Help | Jobs | Press</div>"
    rows = [(i, f"http://h/{i}", f"{furniture}<p>Short {i}</p><div>(c) The owners of the site and their friends</div>") for i in range(9)]
    rows += [(20 + i, f"http://g/{i}", f"<p>One story, two versions of it, nearly all the same text</p><p>v{i}</p>") for i in range(2)]
    got = {r.page_id: r.text for r in extract.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Short {i}" for i in range(9))
    assert all(got[20 + i].startswith("One story") for i in range(2))


def test_ranges_get_the_nearest_other_runs():
    rng = random.Random(1)
    for _ in range(500):
        keys = [f"h\x01{i:04d}\x01u\x01{i}\x01{rng.choice('abc')}" for i in range(rng.randint(1, 25))]
        cuts = sorted(rng.sample(range(1, len(keys)), rng.randint(0, len(keys) - 1))) if len(keys) > 1 else []
        parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)])]

        def runs(some):
            return [k for i, k in enumerate(some) if not i or k[-1] != some[i - 1][-1]]

        got = extract.context_of([(runs(p)[:3], runs(p)[-3:]) for p in parts])
        for k, part in enumerate(parts):
            before = [x[-1] for x in runs(keys[:keys.index(part[0]) + 1])][:-1][-2:]
            after = [x[-1] for x in runs(keys[keys.index(part[-1]):])][1:][:2]
            mine = sorted(key for key, ranges in got.items() if k in ranges)
            assert [x[-1] for x in mine if x < part[0]] == before and [x[-1] for x in mine if x > part[-1]] == after


def test_every_page_once_whatever_the_ranges(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a = sorted(map(str, extract.digest(pages).collect()))
    b = sorted(map(str, extract.digest(pages.repartition(7)).collect()))
    assert a == b and len(a) == pages.count()
    assert extract.digest(pages.limit(0)).collect() == []
