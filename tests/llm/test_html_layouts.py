"""Pages of layouts that the training generator doesn't make, with blocks labelled by hand, and odd pages."""

import time

import numpy as np
import pytest

from trendloom.llm import html_text

#: (page, texts of the article's blocks in order).
PAGES = [
    ("""<html><body bgcolor=white><table border=0><tr><td valign=top><font size=2><a href=a.html>Home</a><br><a href=b.html>Trips</a><br><a href=c.html>Guest book</a></font></td>
<td><h2>Walking the north ridge</h2><p>We left the hut before dawn, when the snow was still hard enough to carry us. By nine the sun had reached the upper slopes.</p>
<p>From the saddle the path follows a line of cairns. It is easy to lose them in fog, so take a map.</p></td></tr><tr><td colspan=2><small>Last updated 12 June 2004</small></td></tr></table></body></html>""",
     ["Walking the north ridge", "We left the hut before dawn, when the snow was still hard enough to carry us. By nine the sun had reached the upper slopes.",
      "From the saddle the path follows a line of cairns. It is easy to lose them in fog, so take a map."]),
    ("""<html><body><div class="navbar-fixed"><a class="brand" href="/">Acme blog</a><ul><li><a href="/p">Products</a></li><li><a href="/c">Contact us</a></li></ul></div>
<div class="container"><div class="row"><div class="col-md-8"><div class="post-content"><h1>Why our builds got slower</h1><p>Last spring a full build took four minutes. In autumn it took eleven, and nobody could say why.</p>
<h2>What we measured</h2><ul><li>Time spent in the linker, which had doubled.</li><li>Cache misses, which had not changed at all.</li></ul><p>The answer turned out to be a single header that everything included.</p></div></div>
<div class="col-md-4 sidebar"><h4>Recent posts</h4><ul><li><a href="/1">Moving to a new office</a></li><li><a href="/2">Hiring again</a></li></ul></div></div></div>
<div class="footer"><p>&copy; 2021 Acme. All rights reserved.</p></div></body></html>""",
     ["Why our builds got slower", "Last spring a full build took four minutes. In autumn it took eleven, and nobody could say why.", "What we measured",
      "Time spent in the linker, which had doubled.", "Cache misses, which had not changed at all.", "The answer turned out to be a single header that everything included."]),
    ("""<body><header><span>The Daily Example</span><nav><a href=/w>World</a> <a href=/s>Sport</a></nav></header><div role="dialog" class="cookie-banner">We value your privacy. <button>Agree</button></div>
<main><article><header><h1>River levels fall for third week</h1></header><section><p>Water in the upper basin stood at its lowest since records began, officials said on Monday.</p><aside class="newsletter-signup">Get our morning newsletter</aside>
<p>Farmers downstream were told to expect limits on pumping.</p><figure><img src=r.jpg><figcaption>The dry bed near the old bridge.</figcaption></figure></section></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>About time someone wrote about this.</p></div><div class="comment"><p>It rained here yesterday though.</p></div></section></main><footer><ul><li><a href=/t>Terms</a></li></ul></footer></body>""",
     ["River levels fall for third week", "Water in the upper basin stood at its lowest since records began, officials said on Monday.", "Farmers downstream were told to expect limits on pumping.", "The dry bed near the old bridge."]),
    ("""<html><body><div id="top"><form action="/find"><input name="q"><input type="submit"></form></div><div id="left"><ul class="menu"><li><a href="1">Recipes</a></li><li><a href="2">Techniques</a></li></ul></div>
<div id="middle"><h1>Plain lentil soup</h1><p>Rinse two cups of lentils and leave them in cold water while the onions soften.</p><ol><li>Fry the onions slowly in oil for ten minutes.</li><li>Add the lentils and six cups of water.</li><li>Simmer until soft, then season.</li></ol>
<div class="ad-slot">Save 20 % on pans this week!</div><p>It keeps for three days and tastes better on the second.</p></div><div id="bottom" class="copyright">Copyright 2012 | Impressum</div></body></html>""",
     ["Plain lentil soup", "Rinse two cups of lentils and leave them in cold water while the onions soften.", "Fry the onions slowly in oil for ten minutes.", "Add the lentils and six cups of water.",
      "Simmer until soft, then season.", "It keeps for three days and tastes better on the second."]),
]


def test_blocks_of_other_layouts():
    right = total = 0
    for page, article in PAGES:
        found = html_text.blocks(page)
        assert all(t in [b.text for b in found] for t in article)
        field = html_text.model()
        got = field.viterbi(field.local(html_text.own_features(found)) + field.around(found))
        right += sum((b.text in article) == bool(k) for b, k in zip(found, got.tolist(), strict=True))
        total += len(found)
    print(f"blocks labelled as by hand: {right} of {total}")
    assert right >= 0.9 * total and total >= 40


def test_scores_by_element_equal_those_of_all_features():
    field = html_text.model()
    for page, _ in PAGES:
        found = html_text.blocks(page)
        assert np.allclose(field.local(html_text.own_features(found)) + field.around(found), field.local(html_text.block_features(found)))


def test_gradient_leads_to_the_likelihood_maximum():
    """Trained on one page without decay to speak of, every feature's expected count under all labellings nears its count in the page."""
    from itertools import product

    draw = np.random.default_rng(2)
    features, labels = [draw.choice(40, 3, replace=False).tolist() for _ in range(5)], [0, 1, 1, 0, 1]
    likelihood = []
    for epochs in (1, 5, 40):
        field = html_text.train([(features, labels)], epochs)

        def score(path, field=field):
            return sum(field.emission[s, k] for f, k in zip(features, path, strict=True) for s in f) + sum(field.transition[a, b] for a, b in zip(path, path[1:], strict=False))

        likelihood.append(score(labels) - np.logaddexp.reduce([score(p) for p in product((0, 1), repeat=5)]))
    assert likelihood[0] > -5 * np.log(2) and likelihood == sorted(likelihood) and likelihood[-1] > -0.1


@pytest.mark.parametrize("page", [
    "".join(f"<div class='k{j}'>w{j} " for j in range(20_000)), "<b>x " * 20_000 + "</i></p>" * 20_000, '<a title="x ' * 20_000, '<a title="x ' * 20_000 + ">", '<a "x>"' * 20_000,
    "<" * 200_000 + ">", "<!-- " * 50_000, "<p>" + "word " * 400_000, "<span>" * 20_000 + "end",
    "<script>" + "</script" * 200_000, "<p>x</p><textarea>" + "</textarea" * 200_000, "<script>" + "</scripts " * 200_000 + ">", "<style></style" * 100_000, "<title>a</title " * 100_000 + ">",
    "<!" * 500_000, "</p" * 300_000, "<p" * 300_000])
def test_odd_pages_take_linear_time(page):
    began = time.process_time()
    html_text.model()
    trained = time.process_time()
    html_text.model().main_text(page)
    assert time.process_time() - trained < 8 and trained - began < 120


def test_long_blocks_are_looked_at_to_their_end():
    words = "quiet " * 300
    whole = html_text.own_features(html_text.blocks(f"<div>{words}</div>"))
    for tail in ("cookie privacy policy " * 40, "1234567890 " * 200, "© " * 80):
        assert html_text.own_features(html_text.blocks(f"<div>{words}{tail}</div>")) != whole
