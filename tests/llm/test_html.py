"""Pages of ordinary markup: what belongs to the article stays, what doesn't goes."""

import time

import pytest

from stimframe.llm.html_text import main_text

TEXT = "The harbour was quiet that morning, and the boats lay still. Nobody spoke; the tide was out."
TOP, END = '<html><body><nav><a href="/">Home</a></nav>', "<footer>Us, here.</footer></body></html>"
MENU = "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(8))
SAME = [
    # links that belong to the article
    (f'<article><h1><a href="/p">Title</a></h1><p>{TEXT}</p></article>', f"Title {TEXT}"),
    (f'<article><p>{TEXT}</p><ul><li><a href="/1">First</a></li><li><a href="/2">Second</a></li><li><a href="/3">Third</a></li></ul></article>', f"{TEXT} First Second Third"),
    (f'<main><p>{TEXT}</p><p><a href="/x">A linked line</a></p><p>{TEXT}</p></main>', f"{TEXT} A linked line {TEXT}"),
    (f'<div class="post"><h2><a href="/p">Title</a></h2><div><p>{TEXT}</p><p>{TEXT}</p></div></div>', f"Title {TEXT} {TEXT}"),
    ("<div id=content>" + '<p><a href="/x">A linked line</a></p>' * 6 + "</div>", " ".join(["A linked line"] * 6)),
    ('<p><a href="/x">One link.</a></p>', "One link."),
    # names within a sentence, and of what holds the article
    (f'<article><p>Press the <em class="header">key</em>, open <code class="menu">File</code> or <span class=\'menu\'>Edit</span>. {TEXT}</p></article>', f"Press the key, open File or Edit. {TEXT}"),
    (f"<main><div class='cookies recipe'>{TEXT}</div><div><p>Other.</p></div></main>", f"{TEXT} Other."),
    (f"<div class='comments'><p>{TEXT}</p><p>{TEXT}</p></div><div><p>Other.</p></div>", f"{TEXT} {TEXT} Other."),
    # what goes
    (f"<nav>Menu entry one, two</nav><p>{TEXT}</p><p>{TEXT}</p>", f"{TEXT} {TEXT}"),
    (f"<article><nav><ul><li>File<li>Edit</ul></nav><p>{TEXT}</p></article>", TEXT),
    ("<ul>" + "".join(f"<li><a href=https://e.org/>Entry {i}, here</a>" for i in range(8)) + f"</ul><div><p>{TEXT}</p><p>{TEXT}</p></div>", f"{TEXT} {TEXT}"),
    (f"<div><ul>{MENU}</ul><div><p>{TEXT}</p></div><div><p>{TEXT}</p></div><ul>{MENU}</ul></div>", f"{TEXT} {TEXT}"),
    (f"<div class='cookie-banner'>{TEXT}</div><div><p>{TEXT}</p><p>So.</p></div>", f"{TEXT} So."),
    (f"<article><p>{TEXT}</p><aside>{TEXT}</aside><p><span hidden>No.</span>Yes.</p></article>", f"{TEXT} Yes."),
    (f"<div><p>{TEXT}</p><p>{TEXT}</p><span class='advert'>Buy, now!</span></div>", f"{TEXT} {TEXT}"),
    # what is no link
    (f'<div><a name="top"/><p>{TEXT}</p><p><a id="x">{TEXT}</a></p></div>', f"{TEXT} {TEXT}"),
    (f"<h1>Title</h1><div><p>{TEXT}</p><p>{TEXT}</p></div>", f"Title {TEXT} {TEXT}"),
]


@pytest.mark.parametrize("body,want", SAME)
def test_article(body, want):
    assert main_text(f"{TOP}{body}{END}") == want


def test_pages_of_little():
    assert main_text("<nav>File, Edit</nav>") == "" == main_text("<nav><ul><li>File<li>Edit</ul></nav>")
    assert main_text(None) == main_text("") == main_text("<script>a</script>") == ""
    assert main_text('<a href="/x">Only this</a>') == "Only this"
    assert main_text("<p>Only this") == "Only this"
    assert main_text(f"<nav><article><p>{TEXT}</p></article></nav>") == TEXT


def test_time_in_proportion():
    began = time.time()
    assert main_text("<div>" * 100_000 + "text, here.") == "text, here."
    assert time.time() - began < 2
    for page in ('<a href="/">x' * 100_000, "<li><a href=/x/>entry</a>" * 50_000, "<h1><a href=x>t</a></h1>" * 50_000 + f"<div><p>{TEXT}</p></div>", "<span class=ad>" * 100_000):
        main_text(page)
    assert time.time() - began < 15
