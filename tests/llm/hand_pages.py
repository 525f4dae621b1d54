"""Pages written by hand in styles that the training templates do not use, with their main blocks."""

PAGES = [
    # a blog engine's markup
    (
        """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Growing beans | My plot</title><style>p{margin:0}</style></head>
<body class="single single-post postid-81">
<div id="page" class="site"><div id="masthead" class="site-header" role="banner"><div class="site-branding"><a href="/" rel="home">My plot</a><span class="site-description">Notes from a small garden</span></div>
<div id="site-navigation" class="main-navigation" role="navigation"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/shop">Shop</a></li></ul></div></div>
<div id="content" class="site-content"><article id="post-81" class="post type-post"><h1 class="entry-title">Growing beans on a balcony</h1>
<div class="entry-content"><p>Beans are among the easiest plants to grow in a pot. They need sun, water and something to climb on.</p>
<p>I sow two seeds in each pot in the middle of May, when the nights are no longer cold, and keep the stronger plant.</p>
<h2>Watering</h2><p>In July a plant drinks a litre a day. Water in the morning, and never on the leaves.</p>
<ul><li>Pots of ten litres or more</li><li>A stick of two metres</li></ul></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Great post, my beans never flower though!</p></li><li class="comment"><p>Try another pot.</p></li></ol>
<form class="comment-form"><label>Your name</label><input name="n"><textarea></textarea></form></div></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent posts</h2><ul><li><a href="/1">Tomatoes</a></li><li><a href="/2">Chives</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly run by hand</div></footer></div></body></html>""",
        ["Growing beans on a balcony", "Beans are among the easiest plants to grow in a pot. They need sun, water and something to climb on.", "I sow two seeds in each pot in the middle of May, when the nights are no longer cold, and keep the stronger plant.", "Watering", "In July a plant drinks a litre a day. Water in the morning, and never on the leaves.", "Pots of ten litres or more", "A stick of two metres"],
    ),
    # a newspaper: main element, figure, related box inside the article's column
    (
        """<html><body><header class="top"><a href="/">The Courier</a> <a href="/login">Sign in</a></header><nav class="sections"><a href="/w">World</a><a href="/s">Sport</a><a href="/c">Culture</a></nav>
<main id="story"><h1>Harbour bridge closes for a year</h1><p>The old bridge over the harbour will be closed to all traffic from Monday, the city said on Friday.</p>
<p>Engineers found cracks in three of its eleven arches. &ldquo;We could not take the risk&rdquo;, said the head of the works department.</p>
<div class="advert">Advertisement: cheap flights to the sun, book today!</div>
<p>Ferries will run every ten minutes, and the tunnel stays open. The repair is expected to cost forty million.</p></main>
<div class="related"><h3>More on this</h3><ul><li><a href="/a">Who pays for the bridge?</a></li><li><a href="/b">A short history of the harbour</a></li></ul></div>
<footer><p>&copy; The Courier. All rights reserved.</p></footer></body></html>""",
        ["Harbour bridge closes for a year", "The old bridge over the harbour will be closed to all traffic from Monday, the city said on Friday.", "Engineers found cracks in three of its eleven arches. “We could not take the risk”, said the head of the works department.", "Ferries will run every ten minutes, and the tunnel stays open. The repair is expected to cost forty million."],
    ),
    # upper-case tags, unclosed paragraphs
    (
        """<HTML><BODY><DIV CLASS="navbar"><A HREF="i.htm">Index</A> | <A HREF="n.htm">News</A></DIV>
<DIV CLASS="content"><H1>How the mill works</H1><P>The wheel turns the shaft, and the shaft turns the upper stone; the lower one lies still.
<P>Grain falls from the hopper into the eye of the stone and leaves at its rim as flour.<BR>A good miller hears when it runs dry.
</DIV><DIV ID="footer">Last changed in 1998 by the webmaster</DIV></BODY></HTML>""",
        ["How the mill works", "The wheel turns the shaft, and the shaft turns the upper stone; the lower one lies still.", "Grain falls from the hopper into the eye of the stone and leaves at its rim as flour. A good miller hears when it runs dry."],
    ),
    # documentation with a contents list, a notice about cookies and pagers
    (
        """<html><body><div class="cookie-consent" role="alert"><p>We use cookies to make this site better for you.</p><button>Accept</button></div>
<div class="sidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li><li><a href="#c">Upgrade</a></li></ul></div>
<article class="doc"><h1>Configure the server</h1><p>The server reads its settings from one file when it starts. Lines that begin with a hash are comments.</p>
<blockquote>Keep a copy of the file before you change it.</blockquote><p>Set the port first; the default of 8080 is often taken by another program.</p></article>
<div class="pagination"><a href="1.html">Previous</a> <a href="3.html">Next</a></div><footer>Built from source</footer></body></html>""",
        ["Configure the server", "The server reads its settings from one file when it starts. Lines that begin with a hash are comments.", "Keep a copy of the file before you change it.", "Set the port first; the default of 8080 is often taken by another program."],
    ),
    # an encyclopaedia
    (
        """<html><body><div id="mw-panel" class="navigation"><ul><li><a href="/r">Random page</a></li><li><a href="/h">Help</a></li></ul></div>
<div id="content" role="main"><h1 id="firstHeading">Tern</h1><div class="body text"><p>Terns are seabirds with long wings and forked tails. They are found all over the world, and most of them breed in colonies near water.</p>
<p>The Arctic tern sees more daylight than any other animal: it flies from pole to pole and back each year.</p><h2>Food</h2><p>Most terns dive for fish, and some take insects over marshes.</p></div></div>
<div id="catlinks" class="links tags"><a href="/c1">Seabirds</a> <a href="/c2">Migration</a></div><div id="footer" role="contentinfo"><p>Text is available under a free licence.</p></div></body></html>""",
        ["Tern", "Terns are seabirds with long wings and forked tails. They are found all over the world, and most of them breed in colonies near water.", "The Arctic tern sees more daylight than any other animal: it flies from pole to pole and back each year.", "Food", "Most terns dive for fish, and some take insects over marshes."],
    ),
]


_P = "The river rose two metres in one night, and the lower streets were under water by noon. Nobody was hurt."
_Q = "Volunteers filled sandbags until the evening. The mayor thanked them on the steps of the town hall, and promised new walls."
_R = "Trains will not run before Thursday, says the company. Buses take their place between the two stations."
_TOP = '<div class="top"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></div>'
_END = '<div class="bottom"><p>&copy; 2020 The Courier</p></div>'
#: One article in many layouts, with its blocks: in a form, a table, a grid, under misleading names, without names, with a comment widget.
LAYOUTS = {
    "form": (
        f'''<form id="aspnetForm">{_TOP}<div><p>{_P}</p><p>{_Q}</p><p>{_R}</p></div>{_END}</form>''',
        [_P, _Q, _R],
    ),
    "table": (
        f'''<table><tr><td><a href="a">One</a><br><a href="b">Two</a></td><td>{_P}<br><br>{_Q}<br><br>{_R}</td></tr></table>''',
        [f"{_P} {_Q} {_R}"],
    ),
    "grid": (
        f'''<div class="container">{_TOP}<div class="row"><div class="col-md-8"><h1>Flood</h1><p>{_P}</p><p>{_Q}</p><p>{_R}</p></div><div class="col-md-4"><ul><li><a href=1>More</a></li><li><a href=2>Less</a></li></ul></div></div>{_END}</div>''',
        ["Flood", _P, _Q, _R],
    ),
    "notice": (
        f'''{_TOP}<div class="notice-board article"><h1>Flood in the valley</h1><p>{_P}</p><p>{_Q}</p><p>{_R}</p></div>{_END}''',
        ["Flood in the valley", _P, _Q, _R],
    ),
    "none": (
        f'''<div><ul><li><a href=1>More</a></li><li><a href=2>Less</a></li></ul></div><div><h1>Flood in the valley</h1><p>{_P}</p><p>{_Q}</p><p>{_R}</p></div><div>&copy; 2020 The Courier</div>''',
        ["Flood in the valley", _P, _Q, _R],
    ),
    "disqus": (
        f'''{_TOP}<article><h1>Flood in the valley</h1><p>{_P}</p><p>{_Q}</p></article><div id="disqus_thread"><div class="post-body"><p>I was there, it was awful. My cellar is still full of water!</p></div><div class="post-body"><p>Same here, and no help came.</p></div></div>{_END}''',
        ["Flood in the valley", _P, _Q],
    ),
    "divs": (
        f'''<div id="x1">{_TOP}<div id="x2"><div>{_P}</div><div>{_Q}</div><div>{_R}</div></div>{_END}</div>''',
        [_P, _Q, _R],
    ),
    "sectionh": (
        f'''<header><a href=/>The Courier</a></header><section><h2>Flood in the valley</h2><p>{_P}</p><ul><li>Two bridges closed.</li><li>Schools stay shut on Monday.</li></ul><p>{_R}</p></section><section class="comments-wrap"><h3>2 comments</h3><div class="entry-content"><p>{_Q[:60]}</p></div></section>''',
        ["Flood in the valley", _P, "Two bridges closed.", "Schools stay shut on Monday.", _R],
    ),
}
