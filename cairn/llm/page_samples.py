"""Generated web pages whose elements are labelled content or not, to train the extraction model on."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: (tag, attributes, children, content?); a child is a string or such a tuple.
Node = tuple[str, str, list, bool]


class Layout:
    """One random page."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("bdfglmnprstvk") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.rng.choice([".", ".", ",", "!", "?"]) for _ in range(self.rng.randint(low, high)))

    def fragment(self) -> str:
        """A few words as they stand in prose, with its marks."""
        return self.rng.choice([self.words(1, 2), self.words(1, 1) + ",", self.words(1, 1).capitalize() + ".", self.words(1, 4).capitalize() + ".", self.prose(1, 1)])

    def of(self, *names: str) -> str:
        """A class, an id or both."""
        name = self.rng.choice(names)
        return self.rng.choice([f' class="{name}"', f' class="{name} c{self.rng.randint(1, 9)}"', f' id="{name}"', f' class="{name}" id="x{self.rng.randint(1, 99)}"'])

    def links(self, low: int = 3, high: int = 9) -> Node:
        like_prose = self.rng.random() < 0.6
        items = [("li", "", [("a", ' href="/x"', [self.fragment() if like_prose else self.words(1, 3)], False)], False) for _ in range(self.rng.randint(low, high))]
        return ("ul", "", items, False)

    def paragraph(self, content: bool) -> Node:
        r = self.rng
        parts: list = [self.prose()]
        for _ in range(r.choice([0, 0, 1, 2])):
            parts += [(r.choice(["b", "strong", "em", "i", "a", "span", "code"]), "", [self.words(1, 4)], content), " " + self.prose(1, 2)]
        if r.random() < 0.1:
            parts += [("br", "", [], content), self.prose(1, 2)]
        if r.random() < 0.2:  # a paragraph that is short, or begins in bold
            parts = [("b", "", [self.words(2, 9) + ".", ("br", "", [], content)], content)] if r.random() < 0.5 else [self.words(1, 5) + "."]
        if r.random() < 0.08:
            parts = [" ".join(w + r.choice(["***", "%%%", "&amp;&amp;&amp;", "###"]) for w in self.words(3, 40).split())]
        return ("p", "", parts, content)

    def content(self) -> list:
        """What an article consists of."""
        r = self.rng
        body: list = []
        if r.random() < 0.8:
            body.append((r.choice(["h1", "h1", "h2"]), "", [self.prose(1, 1) if r.random() < 0.5 else self.words(1, 9)], True))
        if r.random() < 0.12:  # one short paragraph is all
            return [*body[: r.randint(0, 1)], ("p", "", [self.words(1, 8) + r.choice([".", "", "!"])], True)]
        for _ in range(r.choice([1, 2, 3, 4, 6, 9])):
            kind = r.random()
            if kind < 0.72:
                body.append(self.paragraph(True))
            elif kind < 0.80:
                body.append((r.choice(["h2", "h3"]), "", [self.words(1, 6)], True))
            elif kind < 0.86:
                body.append((r.choice(["ul", "ol"]), "", [("li", "", [self.prose(1, 2)], True) for _ in range(r.randint(2, 5))], True))
            elif kind < 0.90:
                body.append(("blockquote", "", [("p", "", [self.prose(1, 2)], True)], True))
            elif kind < 0.93:
                body.append(("table", "", [("tr", "", [("td", "", [self.words(1, 4)], True) for _ in range(3)], True) for _ in range(3)], True))
            elif kind < 0.95:
                body.append(("pre", "", [self.words(3, 20)], True))
            elif kind < 0.97:
                body.append(("div", "", [self.prose(1, 4), ("br", "", [], True), self.prose(1, 3)], True))
            else:
                body.append(("figure", "", [("img", ' src="a"', [], True), ("figcaption", "", [self.words(3, 9)], True)], True))
        return body

    def with_noise(self, body: list) -> list:
        """Often other things stand within an article, comments and forms mostly at its end."""
        r = self.rng
        body = list(body)
        while r.random() < 0.4:
            body.insert(r.randint(0, len(body)), self.noise(r.choice("ad notice sidebar form related share".split())))
        if r.random() < 0.35:
            body.append(self.noise("form" if r.random() < 0.4 else "comments"))
        return body

    def article(self, tag: str | None = None) -> Node:
        r = self.rng
        body = self.content()
        if r.random() < 0.2:
            body = [("div", r.choice(["", self.of("entry-content", "text", "body", "article-body")]), body, True)]
        body = self.with_noise(body)
        choices = [("article", ""), ("article", ""), ("article", self.of("post", "story")), ("main", ""), ("main", self.of("content", "main")), ("div", self.of("content", "article", "post", "entry", "main", "story-body", "article-text")), ("section", self.of("content", "article-body"))]
        name, marks = r.choice([c for c in choices if tag in (None, c[0])])
        return (name, marks, body, True)

    def comment(self) -> Node:
        r = self.rng
        who: list = [(r.choice(["span", "b", "cite", "h4"]), r.choice(["", self.of("author", "user")]), [self.words(1, 2)], False)] if r.random() < 0.6 else []
        text = self.prose(1, 5)
        said: list = [text] if r.random() < 0.3 else [("p", "", [text], False)]
        if r.random() < 0.2:
            said.append(("p", "", [self.prose(1, 3)], False))
        if r.random() < 0.2:
            said.append(("a", ' href="/x"', [self.words(1, 1)], False))
        return (r.choice(["div", "div", "li", "article", "p"]) if not who and len(said) == 1 and isinstance(said[0], str) else r.choice(["div", "div", "li", "article"]), r.choice(["", self.of("comment", "reply", "comment-body", "review")]), who + said, False)

    def noise(self, kind: str | None = None) -> Node:
        """Something that isn't the article."""
        r = self.rng
        kind = kind or r.choice("ad notice sidebar comments form related share header footer nav menu".split())
        if kind == "ad":
            return (r.choice(["div", "div", "aside", "section"]), self.of("ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement"), r.choice([[self.prose(1, 4)], [("p", "", [self.prose(1, 4)], False)], [("a", ' href="/x"', [self.words(2, 8)], False)]]), False)
        if kind == "notice":
            said: list = [self.prose(1, 4)] if r.random() < 0.6 else [("p", "", [self.prose(1, 4)], False), ("button", "", [self.words(1, 2)], False)]
            return (r.choice(["div", "div", "section", "aside"]), r.choice([self.of("cookie-notice", "notice", "alert", "consent", "cookie-banner", "popup", "cookies", "gdpr", "privacy-notice"), ' role="alert"']), said, False)
        if kind == "sidebar":
            inner = r.choice([[self.links(2, 5)], [("p", "", [self.prose(1, 6)], False)], [self.prose(1, 3)]])
            title: list = [("h3", "", [self.words(1, 3)], False)] if r.random() < 0.7 else []
            return ("aside", r.choice(["", self.of("sidebar", "side", "widget", "related")]), title + inner, False) if r.random() < 0.7 else ("div", self.of("sidebar", "side", "widget"), title + inner, False)
        if kind == "comments":
            title = [(r.choice(["h2", "h3", "h4"]), "", [self.words(1, 3)], False)] if r.random() < 0.6 else []
            items = [self.comment() for _ in range(r.randint(1, 5))]
            if r.random() < 0.15:
                items = [self.prose(1, 4)]  # type: ignore[list-item]
            if r.random() < 0.3:
                items.append(self.noise("form"))
            return (r.choice(["section", "div", "div", "ol", "ul"]), self.of("comments", "discussion", "comment-list", "replies", "responses", "reader-comments", "comment-thread", "disqus-thread", "user-reviews"), title + items, False)
        if kind == "form":
            fields: list = []
            for _ in range(r.randint(1, 3)):
                fields += r.choice([[("label", "", [self.words(1, 3)], False), ("input", ' type="text"', [], False)], [self.words(1, 3) + " ", ("input", ' type="text"', [], False)], [("p", "", [self.words(1, 6)], False), ("input", ' type="text"', [], False)]])
            if r.random() < 0.2:
                fields.append(("select", "", [("option", "", [self.words(1, 2)], False) for _ in range(3)], False))
            if r.random() < 0.3:
                fields = [("fieldset", "", fields, False)]
            return ("form", r.choice(["", "", self.of("search", "newsletter", "login", "subscribe", "comment-form")]), [*fields, ("button", "", [self.words(1, 2)], False)], False)
        if kind == "related":
            return (r.choice(["div", "section", "aside"]), self.of("related", "recommended", "breadcrumbs", "pagination", "tags"), [*([("h3", "", [self.words(1, 3)], False)] if r.random() < 0.5 else []), r.choice([self.links(2, 6), ("p", "", [self.prose(1, 2)], False)])], False)
        if kind == "share":
            return ("div", self.of("share", "social", "toolbar"), [("a", ' href="/x"', [self.words(1, 1)], False) for _ in range(4)], False)
        if kind == "header":
            return r.choice([("header", "", [("a", ' href="/"', [self.words(1, 3)], False), ("p", "", [self.prose(1, 1)], False)], False), ("header", "", [self.words(1, 5)], False), ("header", "", [("h1", "", [self.words(1, 3)], False)], False), ("div", self.of("header", "site-header", "top"), [("h2", "", [self.words(1, 3)], False)], False)])
        if kind == "footer":
            return r.choice([("footer", "", ["&copy; " + self.words(1, 3) + " &middot; " + self.prose(1, 5)], False), ("footer", "", [("p", "", [self.prose(1, 2)], False), self.links(2, 4)], False), ("div", self.of("footer", "copyright", "legal"), [self.prose(1, 2)], False)])
        if kind == "menu":
            return ("div", self.of("menu", "navigation", "nav"), [self.links()], False)
        return ("nav", "", [self.links()] if r.random() < 0.7 else [("a", ' href="/x"', [self.words(1, 2)], False) for _ in range(r.randint(2, 6))], False)

    def bare_links(self) -> Node:
        """A menu that only its links tell."""
        return ("div", "", [self.links()] if self.rng.random() < 0.4 else [x for _ in range(self.rng.randint(2, 6)) for x in (("a", ' href="/x"', [self.words(1, 2)], False), " ")], False)

    def some(self, most: int, *kinds: str) -> list:
        return [self.noise(self.rng.choice(kinds) if kinds else None) for _ in range(self.rng.randint(0, most))]

    def plain(self) -> list:
        """A navigation, an article, a footer, and things between."""
        r = self.rng
        before, after = self.some(3), self.some(3)
        if r.random() < 0.7:
            before.insert(0, self.noise("nav"))
        if r.random() < 0.7:
            after.append(("footer", "", ["&copy; " + self.words(1, 2) + " &middot; " + self.prose(1, 2)], False))
        return [*before, self.article(), *after]

    def columns(self) -> list:
        """A header, a row of main part and side columns, a footer."""
        r = self.rng
        row = [("main", "", [self.article("article"), *self.some(1, "comments", "related", "form")], True) if r.random() < 0.5 else self.article(), self.noise("sidebar")]
        if r.random() < 0.4:
            row.insert(0, self.noise("sidebar"))
        return [self.noise("header"), *self.some(1, "nav", "menu", "notice"), ("div", r.choice(["", self.of("row", "wrapper", "container", "page")]), row, False), *self.some(2, "form", "comments", "related"), self.noise("footer")]

    def named_divs(self) -> list:
        """Only div elements, told by their classes."""
        div = lambda name, inner, content=False: ("div", self.of(name), inner, content)
        parts = [div(self.rng.choice(["content", "main", "article", "text", "post"]), self.with_noise(self.content()), True)]
        return [div("header", [self.words(1, 4)]), div("menu", [self.links()]), *self.some(1, "ad", "notice"), *parts, *self.some(1, "comments", "related"), div("footer", [self.prose(1, 2)])][self.rng.randint(0, 2) :]

    def bare_divs(self) -> list:
        """Only div elements without any mark: links in one, the text in another."""
        body = self.content()
        return [self.bare_links(), ("div", "", [self.prose(1, 6)] if self.rng.random() < 0.25 else body, True), *([self.bare_links()] if self.rng.random() < 0.4 else [])]

    def bare_body(self) -> list:
        """The text stands in the body itself."""
        text = self.content() if self.rng.random() < 0.7 else [self.prose(1, 5), *(x for _ in range(self.rng.randint(0, 2)) for x in (("br", "", [], True), self.prose(1, 3)))]
        return [*self.some(1, "nav", "menu", "header"), *text, *self.some(2, "footer", "form", "comments", "ad")]

    def table(self) -> list:
        """A table lays the page out."""
        cell = lambda inner, content: ("td", "", inner, content)
        return [("table", "", [("tr", "", [cell([self.links()], False), cell(self.content(), True)], False)], False), *self.some(1, "footer")]

    def short(self) -> list:
        """Little text among notices."""
        r = self.rng
        body = [("p", "", [self.words(1, 12) + r.choice([".", "!", ""])], True)]
        return [*self.some(2, "notice", "ad", "nav", "header"), (r.choice(["article", "article", "main"]), "", body, True), *self.some(1, "footer", "form", "comments")]

    def page(self, layout: str) -> list:
        r = self.rng
        if r.random() < 0.02:
            return [self.prose(1, 4)]  # no markup at all
        body = getattr(self, layout)()
        if r.random() < 0.03:
            body = self.some(4)  # nothing but noise
        if r.random() < 0.25:
            body = [("div", r.choice(["", self.of("wrapper", "page", "container", "site")]), body, any(isinstance(x, str) for x in body))]
        if r.random() < 0.12:
            return body  # a fragment, without html and body elements
        head = ("head", "", [("meta", ' charset="utf-8"', [], False), ("title", "", [self.words(2, 8)], False), ("style", "", ["p{color:red}"], False), ("script", "", ["start(1);"], False)][: r.choice([2, 4])], False)
        inner = ("body", "", body, any(isinstance(x, str) for x in body))
        return [("html", r.choice([' lang="en"', ""]), [head, inner] if r.random() < 0.95 else [inner], False)]


LAYOUTS = ("plain", "columns", "named_divs", "bare_divs", "bare_body", "table", "short")


def samples(n: int, seed: int, layouts: tuple[str, ...] = LAYOUTS) -> Iterator[tuple[str, list[bool]]]:
    """n pages, of the layouts in turn: html, and a label for the page itself and for each start tag in order."""
    rng = random.Random(seed)
    for k in range(n):
        labels: list[bool] = []

        def written(node: Node | str, labels: list[bool] = labels) -> str:
            if isinstance(node, str):
                return node
            tag, marks, children, content = node
            labels.append(content)
            inner = "".join(written(c) for c in children)
            return f"<{tag}{marks}>" + ("" if tag in ("br", "img", "meta", "input") else f"{inner}</{tag}>")

        top = Layout(rng).page(layouts[k % len(layouts)])
        labels.append(any(isinstance(x, str) for x in top))
        yield "<!DOCTYPE html>" + "".join(map(written, top)), labels
