"""Labelled pages for the field of `html_text`: many layouts, filled with invented words.

SIGN marks the text of blocks that belong to the article; it is taken off before features are made.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SIGN = "\ue000"
PAGES = 500
SEED = 5

_SYLLABLES = "an er in on re ti en th es le de la ou ai ver un ge ich os as ra mi ar st ed nt or ing tion é ñ ü".split()
#: What page furniture says.
_PHRASES = {
    "notice": ("We use cookies to improve your experience.", "Accept all", "This site uses cookies", "Wir verwenden Cookies.", "You have two free articles left this month.", "Ce site utilise des cookies."),
    "form": ("Search", "Subscribe to our newsletter", "Your email address", "Sign up", "Name", "Suche", "Buscar"),
    "share": ("Share", "Tweet", "Share on Facebook", "Follow us", "Print", "Email"),
    "head": ("Home", "News", "Log in", "Menu", "Skip to content"),
    "side": ("Related posts", "Most read", "More from this author", "Tags", "Popular"),
    "comment": ("3 comments", "Reply", "Leave a comment", "Comments", "Log in to reply"),
    "foot": ("All rights reserved.", "© 2024", "Privacy policy", "Terms of use", "Impressum", "Contact", "Last updated 3 May 2023", "Last modified: 2019-11-07", "Back to top"),
    "ad": ("Advertisement", "Sponsored", "Werbung", "Publicité"),
}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 1, b: int = 18) -> str:
        return self.words(a, b).capitalize() + self.r.choice("....!?,") if self.r.random() < 0.95 else self.words(a, b) + "&amp; $$$ " + self.word()

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def some(self, kind: str) -> str:
        return self.r.choice(_PHRASES[kind])

    def maybe(self, chance: float, text: str) -> str:
        return text if self.r.random() < chance else ""

    def links(self, n: int) -> str:
        item = self.r.choice(("<li><a href='/x'>%s</a></li>", "<a href='/x'>%s</a> ", "<div><a href=/x>%s</a></div>"))
        return "".join(item % self.words(1, 3) for _ in range(n))

    def menu(self) -> str:
        inner = self.links(self.r.randint(2, 8))
        return self.r.choice(("<nav><ul>%s</ul></nav>", "<ul class='menu'>%s</ul>", "<div id='nav'>%s</div>", "<div class='main-menu'><ul>%s</ul></div>", "<nav class='breadcrumb'>%s</nav>", "<div role='navigation'>%s</div>")) % inner

    def header(self) -> str:
        return self.r.choice(("<header><h1>%s</h1><p>%s</p></header>", "<div class='header'><a href='/'>%s</a> %s</div>", "<div id='masthead'><h2>%s</h2><div>%s</div></div>", "<header class='site-header'><div class='logo'>%s</div>%s</header>")) % (self.words(1, 4), self.sentence())

    def advert(self) -> str:
        text = self.maybe(0.4, self.some("ad") + " ") + self.sentence(3, 18)
        return self.r.choice(("<div class='ad'>%s</div>", "<div class='ads banner'>%s</div>", "<aside class='advert'>%s</aside>", "<p class='sponsored'>%s</p>", "<div id='ad-top'><p>%s</p></div>", "<section class='promo'><p>%s</p></section>")) % text

    def notice(self) -> str:
        text = self.some("notice") if self.r.random() < 0.6 else self.sentence(4, 18)
        return self.r.choice(("<div class='cookie-notice'><p>%s</p><button>OK</button></div>", "<div id='consent'>%s</div>", "<div class='notice'>%s</div>", "<div role='alert' class='alert'>%s</div>", "<section class='gdpr popup'><p>%s</p></section>")) % text

    def form(self) -> str:
        text = self.some("form") if self.r.random() < 0.6 else self.sentence(2, 10)
        return self.r.choice(("<form><label>%s</label><input name=q></form>", "<form class='search'><p>%s</p><input type=submit></form>", "<div class='newsletter'><p>%s</p><form><input></form></div>", "<form action='/login'>%s<input></form>")) % text

    def share(self) -> str:
        inner = "".join(f"<li><a href='#'>{self.some('share')}</a></li>" for _ in range(self.r.randint(1, 4)))
        return self.r.choice((f"<ul class='share'>{inner}</ul>", f"<div class='social'><ul>{inner}</ul></div>"))

    def sidebar(self) -> str:
        inner = f"<h3>{self.some('side')}</h3>" + (f"<ul>{self.links(4)}</ul>" if self.r.random() < 0.6 else f"<p>{self.prose(3)}</p>")
        return self.r.choice(("<aside>%s</aside>", "<div class='sidebar'>%s</div>", "<div id='sidebar'><div class='widget'>%s</div></div>", "<aside class='related'>%s</aside>", "<div class='related-posts'>%s</div>")) % inner

    def comments(self) -> str:
        one = self.r.choice(("<div class='comment'><b>%s</b><p>%s</p></div>", "<li class='comment'><span>%s</span> %s</li>", "<article class='comment'><h4>%s</h4><p>%s</p></article>"))
        inner = "".join(one % (self.words(1, 2), self.prose(3)) for _ in range(self.r.randint(1, 4)))
        head = self.maybe(0.6, f"<h3>{self.some('comment')}</h3>")
        return self.r.choice(("<section class='comments'>%s</section>", "<div id='comments'>%s</div>", "<ol class='comment-list'>%s</ol>", "<div class='discussion'>%s</div>")) % (head + inner)

    def footer(self) -> str:
        text = self.r.choice((self.some("foot"), self.sentence(), f"&copy; {self.word()}.example &middot; {self.sentence()}"))
        return self.r.choice(("<footer>%s</footer>", "<footer><p>%s</p></footer>", "<div class='footer'>%s</div>", "<div id='footer'><p>%s</p></div>")) % (text + self.maybe(0.4, self.links(2)))

    def article(self) -> str:
        r, s = self.r, SIGN
        parts = [f"<h1>{s}{self.sentence(1, 12)}</h1>" if r.random() < 0.85 else ""]
        for _ in range(r.choice((0, 1, 2, 4, 8, 14))):
            kind = r.random()
            if kind < 0.6:
                parts.append(f"<p>{s}{self.prose()}</p>")
            elif kind < 0.7:
                parts.append(f"<p><b>{s}{self.sentence()}<br>")
            elif kind < 0.76:
                parts.append(f"<p>{s}{self.sentence(1, 3)}</p>")
            elif kind < 0.82:
                parts.append(f"<h2>{s}{self.words(1, 6)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{s}{self.sentence(1, 8)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.89:
                parts.append(f"<blockquote><p>{s}{self.prose(2)}</p></blockquote>")
            elif kind < 0.92:
                parts.append(f"<figure><img src=x><figcaption>{s}{self.sentence()}</figcaption></figure>")
            elif kind < 0.95:
                parts.append(f"<p>{s}{self.sentence()} <a href='/y'>{self.words(1, 4)}</a> {self.sentence()}</p>")
            else:
                parts.append(f"<table><tr><td>{s}{self.words(1, 3)}</td><td>{s}{r.randint(1, 999)}</td></tr></table>")
        for kind, chance in ((self.advert, 0.2), (self.share, 0.2), (self.form, 0.1), (self.notice, 0.1), (self.sidebar, 0.08), (self.comments, 0.15)):
            if r.random() < chance:
                parts.insert(len(parts) if kind == self.comments else r.randint(1, len(parts)), kind())
        body = "".join(parts)
        return r.choice((
            "<article>%s</article>", "<article>%s</article>", "<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", "<div class='content'>%s</div>",
            "<div id='post-12' class='post'>%s</div>", "<section class='story'>%s</section>", "<div class='entry-content'>%s</div>",
            "<article class='post'><div class='body'>%s</div></article>", "<table><tr><td class='main'>%s</td></tr></table>", "<div>%s</div>")) % body

    def page(self) -> str:
        r = self.r
        before = [self.maybe(p, k()) for k, p in ((self.header, 0.4), (self.menu, 0.8), (self.notice, 0.3), (self.form, 0.2), (self.advert, 0.5), (self.sidebar, 0.25))]
        after = [self.maybe(p, k()) for k, p in ((self.share, 0.15), (self.comments, 0.35), (self.sidebar, 0.3), (self.form, 0.15), (self.advert, 0.25), (self.notice, 0.1))]
        r.shuffle(before)
        r.shuffle(after)
        after.append(self.maybe(0.85, self.footer()))
        middle = "".join(before), self.article(), "".join(after)
        if r.random() < 0.15:  # laid out as a table without any marks
            cells = [f"<td width=150>{self.links(r.randint(2, 8))}</td>", f"<td>{middle[1]}</td>"]
            foot = r.choice(("<tr><td colspan=2>%s</td></tr>", "<tr><td><font size=1>%s</font></td><td></td></tr>")) % (self.some("foot") + self.maybe(0.5, " | " + self.some("foot")))
            top = self.maybe(0.6, f"<tr><td colspan=2>{self.maybe(0.5, '<img src=x> ')}<a href='/'>{self.words(1, 3)}</a></td></tr>")
            middle = self.maybe(0.3, middle[0]), f"<table>{top}<tr>{cells[0]}{cells[1]}</tr>{foot}</table>", self.maybe(0.3, middle[2])
        around = r.choice(("%s", "<div class='wrap'>%s</div>", "<div id='page'>%s</div>", "<div class='container'>%s</div>", "%s"))
        return "<!DOCTYPE html><html><head><title>t</title><script>a('</p>')</script></head><body>" + around % "".join(middle) + "</body></html>"


def pages(n: int = PAGES, seed: int = SEED) -> Iterator[str]:
    for k in range(n):
        yield _Page(seed * 1_000_003 + k).page()
