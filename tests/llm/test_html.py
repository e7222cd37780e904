import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm.html import extract_main_text, main_text

BODY = "<p>First words, then more, and enough of them to count.</p><p>Second one, shorter.</p>"

CASES = [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    ("<div><a href=1>only</a></div>", ""),
    (f"<nav><a>Home</a></nav><article><h1>Title</h1>{BODY}</article><footer>end, end, end</footer>", "Title First words, then more, and enough of them to count. Second one, shorter."),
    ("<article><p>A &amp; B&nbsp;&lt;x&gt;,\n  spaced   out<br>line</p></article>", "A & B <x>, spaced out line"),
    ("<article><p>un<b>cut</b> word</p><p>open <i>tag<p>next", "uncut word open tag next"),
    ("<article><p>kept</p><script>var t='</p>, a, b, c';</script><style>p{}</style><!-- no, no --><p>too</p></article>", "kept too"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><blockquote>said, it</blockquote></article>", "one two c1 c2 said, it"),
    (f"<div id=content>{BODY}</div><div class=sidebar><p>{'side, ' * 60}</p></div><div id=comments><p>{'rude, ' * 90}</p></div>", "First words, then more, and enough of them to count. Second one, shorter."),
    (f"<body class=has-sidebar><main>{BODY}<div class='ad box'>buy, buy</div><form><p>name, mail</p></form><div class='cookie-notice'>we, use</div></main></body>", "First words, then more, and enough of them to count. Second one, shorter."),
    ("<main><section><p>One, two.</p></section><section><p>Three, four, five.</p></section></main>", "One, two. Three, four, five."),
    ("<div class=story>Text in the box, with commas.<br><br>Second line, too.</div><div class=list><a>x</a> <a>y</a></div>", "Text in the box, with commas. Second line, too."),
    (f"<article>{BODY}</article><article class=comment><p>{'no, ' * 80}</p></article>", "First words, then more, and enough of them to count. Second one, shorter."),
    ("<article><header><h1>Head</h1></header><p>Body, text.</p><aside>note</aside></article>", "Head Body, text."),
    ("<article><p>cut off in the midd", "cut off in the midd"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "<p>deep, text</p>") == "deep, text"
    words = " ".join(f"w{i}" for i in range(100_000))
    assert main_text(f"<article><p>{words}</p></article>") == words
    assert main_text("<" * 3000) == "<" * 3000


def test_table(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (1, "u", "<article><p>a</p></article>"), (None, None, None), (3, "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("mine"))
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (3, "", "", 0)], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0


STORY = "The long story goes on, as ever, with many words and commas."


@pytest.mark.parametrize("name", ["elementor-widget-container", "wp-block-group share", "post social", "modal-body", "entry-content widget", "td-post-content related"])
def test_a_name_does_not_leave_out_the_article(name):
    page = f"<body><nav><a href=x>home</a></nav><div class='{name}'>{f'<p>{STORY}</p>' * 9}</div><div class=footer>foot note</div></body>"
    assert main_text(page) == " ".join([STORY] * 9)


def test_comments_are_left_out_however_many():
    said = f"<p>{STORY}</p>" * 30
    assert main_text(f"<body><div><p>One short text, no more.</p></div><div class=comments>{said}</div></body>") == "One short text, no more."


def test_time_grows_with_the_page():
    def seconds(n):
        start = time.process_time()
        assert main_text("<div><p>a, b</p>" * n) == " ".join(["a, b"] * n)
        return time.process_time() - start

    assert seconds(32_000) < 20 * max(0.05, seconds(4_000))
