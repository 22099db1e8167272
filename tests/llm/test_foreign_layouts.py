"""Main text of pages written by hand: no generator's layout, other names, real nesting, cut-off tags."""

import time

from tidemark.llm import mainhtml

# (html, blocks of the main text)
PAGES = [
    (
        """<!doctype html><html lang=en><head><title>Tide tables | Harbour Weekly</title><style>p{}</style></head><body>
<div id="hd"><div class="inner"><span class="lg">Harbour Weekly</span><ul class="mn"><li><a href="/n">News</a><li><a href="/s">Sport</a><li><a href="/w">Weather</a></ul></div></div>
<div id="bd"><div class="col-8"><div class="entry-content">
<h1>Tide tables are changing this spring</h1>
<p>The harbour office said on Monday that the printed tide tables will be replaced by a daily bulletin, which is posted at the gate.</p>
<p>Sailors who rely on the old tables can still <a href="/a">order a copy</a> until the end of the month, the office added.</p>
<blockquote><p>We have printed them since 1911, but the sea bed has moved too much for a yearly table.</p></blockquote>
<p>The first bulletin appears on Tuesday.</p></div></div>
<div class="col-4"><div class="widget"><h3>Most read</h3><ul><li><a href="/1">Ferry strike ends</a></li><li><a href="/2">New crane arrives</a></li></ul></div></div></div>
<div id="ft"><p>Copyright Harbour Weekly. All rights reserved. <a href="/i">Imprint</a></p></div></body></html>""",
        [
            "Tide tables are changing this spring",
            "The harbour office said on Monday that the printed tide tables will be replaced by a daily bulletin, which is posted at the gate.",
            "Sailors who rely on the old tables can still order a copy until the end of the month, the office added.",
            "We have printed them since 1911, but the sea bed has moved too much for a yearly table.",
            "The first bulletin appears on Tuesday.",
        ],
    ),
    (
        """<html><body><table width=100%><tr><td colspan=2><a href=/>Home</a> | <a href=/faq>FAQ</a> | <a href=/dl>Downloads</a></td></tr>
<tr><td><a href=a>Intro</a><br><a href=b>Setup</a><br><a href=c>Usage</a></td><td><div class="main">
<h2>Setting up the compiler</h2><p>Unpack the archive into a folder of your choice and run the setup script once. It writes a file with the paths it found.
<p>If the script stops with an error, check that the variable HOME is set; the script does not guess it.
<pre>tar xf tool.tar
./setup --prefix=/opt/tool</pre><p>Afterwards the command is on your path.</div></td></tr></table>
<div class="footer"><hr>Last change 3 May. <a href=mailto:x>Mail</a></div></body></html>""",
        [
            "Setting up the compiler",
            "Unpack the archive into a folder of your choice and run the setup script once. It writes a file with the paths it found.",
            "If the script stops with an error, check that the variable HOME is set; the script does not guess it.",
            "tar xf tool.tar ./setup --prefix=/opt/tool",
            "Afterwards the command is on your path.",
        ],
    ),
    (
        """<body><div role="banner"><a href="/">Kochblog</a></div><div role="navigation"><a href="/r">Rezepte</a> <a href="/t">Tipps</a></div>
<main id="inhalt"><article itemscope><header><h1>Linsensuppe mit Zitrone</h1></header><div class="text"><p>Die Linsen am Abend vorher einweichen und am n&auml;chsten Tag in frischem Wasser aufsetzen.</p>
<ul><li>200 g rote Linsen, gewaschen</li><li>eine Zitrone, unbehandelt</li></ul><p>Zwanzig Minuten leise kochen lassen, dann mit Salz und dem Saft der Zitrone w&uuml;rzen.</p></div></article></main>
<section id="comments"><h2>Kommentare</h2><div class="comment"><p>Sehr lecker, danke f&uuml;r das Rezept, ich habe noch Minze dazu gegeben!</p></div></section>
<div class="cookie-hinweis"><p>Wir verwenden Cookies, um diese Seite zu verbessern.</p><button>Gut</button></div><footer><p>Impressum und Datenschutz</p></footer></body>""",
        [
            "Linsensuppe mit Zitrone",
            "Die Linsen am Abend vorher einweichen und am nächsten Tag in frischem Wasser aufsetzen.",
            "200 g rote Linsen, gewaschen",
            "eine Zitrone, unbehandelt",
            "Zwanzig Minuten leise kochen lassen, dann mit Salz und dem Saft der Zitrone würzen.",
        ],
    ),
    (
        """<div class="wrap"><div class="top-bar"><a href="#">Sign in</a> <a href="#">Register</a></div><div class="story-body"><div class="headline"><h1>Council votes on the bridge</h1></div>
<div class="par">After a long debate the council voted for the new bridge with a narrow majority of two.</div>
<div class="par">Work is to begin in the autumn, and the old crossing stays open until it is done.</div>
<div class="ad-slot"><p>Buy two tyres and pay for one, this week only at your dealer.</p></div>
<div class="par">Opponents said that they would take the matter to court.</div></div>
<div class="related-links"><h4>Read more</h4><a href="/x">Bridge costs rise</a> <a href="/y">Ferry timetable</a></div></div>""",
        [
            "Council votes on the bridge",
            "After a long debate the council voted for the new bridge with a narrow majority of two.",
            "Work is to begin in the autumn, and the old crossing stays open until it is done.",
            "Opponents said that they would take the matter to court.",
        ],
    ),
    (
        """<html><body><nav><ul><li><a href="/">Start</a></li><li><a href="/b">Blog</a></li></ul></nav><section class="post"><h2>How we moved the archive</h2>
<p>Moving forty thousand boxes takes patience. We numbered every shelf twice, once in pencil and once in the list.</p><figure><img src=a.jpg><figcaption>Boxes on the second day.</figcaption></figure>
<p>On the last day only three boxes were missing, and two of them turned up in the lift.</p></section><aside><p>Subscribe to our newsletter for more stories like this one.</p></aside><footer>Made by hand. <a href="/p">Privacy</a></footer></body></html>""",
        [
            "How we moved the archive",
            "Moving forty thousand boxes takes patience. We numbered every shelf twice, once in pencil and once in the list.",
            "Boxes on the second day.",
            "On the last day only three boxes were missing, and two of them turned up in the lift.",
        ],
    ),
]


def scores(model):
    found = wanted = right = 0
    for source, blocks in PAGES:
        got = mainhtml.main_text(source, model).split("\n\n")
        found, wanted, right = found + len(got), wanted + len(blocks), right + len(set(got) & set(blocks))
    return right / found, right / wanted


def test_precision_and_recall_of_blocks():
    precision, recall = scores(mainhtml.fit(mainhtml.labelled_pages()))
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)


def test_cut_off_pages_are_read_once():
    model = mainhtml.fit(mainhtml.labelled_pages(40))
    began = time.perf_counter()
    tails = ["<p " + "a" * 100_000, "<" + "a" * 100_000, '<p title="' + "a" * 100_000, "<p title='" * 10_000, "<script>" + "</script " * 20_000, "<b>" * 30_000 + "</i>" * 30_000]
    for tail in tails:
        assert mainhtml.main_text("<article><p>Some words here.</p>" + tail, model).startswith("Some words here.")
    assert time.perf_counter() - began < 20


def test_formulas_stay_and_empty_drawings_hide_nothing():
    model = mainhtml.fit(mainhtml.labelled_pages())
    page = "<article><svg class='i'/><p>Hello there, this is text.</p><p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"
    assert mainhtml.main_text(page, model) == "Hello there, this is text.\n\nThen x=2 holds."
