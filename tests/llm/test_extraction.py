"""Pages without containers, broken markup, and random articles against an HTML parser's text."""

import random
from html.parser import HTMLParser

from arborix.llm import extraction

W = "some running words of a text that goes on for a while, "


def test_pages_without_containers():
    get = extraction.trained().extract
    long = (W * 4).strip()
    assert get(f"<html><body>Body {long}<br>Second line</body></html>") == f"Body {long} Second line"
    assert get("just text") == "just text" and get("") == "" and get("<body></body>") == ""
    assert get(f"<body><div>{long}</div><div>two {long}</div><div>three</div></body>") == f"{long}\ntwo {long}\nthree"
    assert get(f"<body><div class=menu><a href=/>x</a></div><div>{long}</div><div>two</div><div class=footer>c 2020</div></body>") == f"{long}\ntwo"


def test_hidden_elements_that_never_end():
    get = extraction.trained().extract
    assert get("<p>a <button>no <p>more text</p><p>Last</p>") == "a\nmore text\nLast"
    assert get("<p>a <canvas>no <p>more</p> <button>x</button><p>Last</p>") == "a\nmore\nLast"
    assert get("<p>x <canvas>old <p>no</p></canvas> y</p><p>z</p>") == "x y\nz"
    assert get("<article><p>x <select><option>no</select> y</p><p>z <button>no</article><p>w</p>").startswith("x y\nz")


def test_details_and_addresses_in_articles():
    long = (W * 4).strip()
    html = f"<body><nav><a href=/>n</a></nav><article><h1>T</h1><p>{long}</p><details><summary>More</summary><p>inner</p></details><address>By me</address><p>{long}</p></article><footer>foot</footer></body>"
    assert extraction.trained().extract(html) == f"T\n{long}\nMore\ninner\nBy me\n{long}"


class Article(HTMLParser):
    """The text of an article's blocks."""

    INLINE = {"b", "em", "a", "span"}

    def __init__(self):
        super().__init__()
        self.depth, self.lines, self.run = 0, [], ""

    def flush(self):
        if self.run.split():
            self.lines.append(" ".join(self.run.split()))
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.flush()
            self.depth += tag == "article" or self.depth > 0

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
            self.depth -= self.depth > 0

    def handle_data(self, data):
        if self.depth:
            self.run += data


def test_random_articles_have_a_parsers_text():
    r = random.Random(12)

    def text():
        return " ".join(r.choice(["word", "t&eacute;xt", "a &lt; b", "<b>bold</b>", "<em>so</em>", "<a href=/x>link</a>", "long words here", "and&nbsp;more", "\n  lines "]) for _ in range(r.randrange(6, 40)))

    def block(depth):
        kind = r.choice(["p", "p", "p", "h2", "blockquote", "ul", "div"] if depth < 3 else ["p"])
        inner = text() if kind in ("p", "h2") else "".join(f"<li>{text()}</li>" for _ in range(3)) if kind == "ul" else "".join(block(depth + 1) for _ in range(r.randrange(1, 4)))
        return f"<{kind}>{inner}</{kind}>"

    for _ in range(150):
        article = "".join(block(0) for _ in range(r.randrange(2, 8)))
        html = f"<html><body><header><p>site</p></header><nav><ul><li><a href=/>home</a></li></ul></nav><article><h1>title here</h1>{article}</article><aside class=sidebar><p>{text()}</p></aside><footer><p>end</p></footer></body></html>"
        parser = Article()
        parser.feed(html)
        assert extraction.trained().extract(html) == "\n".join(parser.lines)
