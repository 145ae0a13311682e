"""Hand-labelled pages on which the extraction model is trained.

In each, an element with the attribute ``main`` holds content with all below it, but for elements with the attribute
``not``; a run of text that begins with ``MAIN_TEXT`` is content whatever holds it. ``{s}``, ``{m}`` and ``{l}`` stand for a short, a middling and a long run of words; ``{a}`` for three links.
"""

MAIN_TEXT = "Main text:"
_SHORT = "three short words"
_MIDDLE = "a sentence of some ten words or so, and then one more."
_LONG = "many words in a row, which make up several lines of running text on a page; " * 6
_LINKS = "<a href='/1'>one link</a> <a href='/2'>second link</a> <a href='/3'>third</a>"

_PAGES = [
    "<body><header><div class=logo>{s}</div></header><nav><ul><li><a href=/>{s}</a></li><li><a href=/>{s}</a></li></ul></nav><div class=ad>{m}</div>"
    "<article main><h1>{s}</h1><p>{l}</p><p>{m}</p><p>{s}</p><p>{l}</p></article><footer>{m}</footer></body>",
    "<body><nav class=menu><ul><li><a href=/>{s}</a></li></ul></nav><main><article main><h1>{m}</h1><p>{l}</p><ul><li>{s}</li><li>{m}</li></ul><blockquote><p>{l}</p></blockquote>"
    "<aside not class=related><h3>{s}</h3><p>{a}</p></aside><p>{m}</p></article><aside class=sidebar><h3>{s}</h3><p>{l}</p><ul><li>{a}</li></ul></aside></main><footer><p>{m}</p><p>{a}</p></footer></body>",
    "<body><div id=header><h1>{s}</h1><div class=search><form><input><label>{s}</label></form></div></div><div id=wrapper><div id=content class=post main><h2>{m}</h2><div class=entry><p>{l}</p><p>{l}</p><h3>{s}</h3><p>{m}</p><pre>{m}</pre></div>"
    "<div not id=comments class=comments><h3>{s}</h3><div class=comment><p>{l}</p></div><div class=comment><p>{m}</p><p>{l}</p></div><form class=respond><p>{s}</p></form></div></div><div id=sidebar><div class=widget><h4>{s}</h4><p>{m}</p><ul><li>{a}</li></ul></div></div></div><div id=footer><p>{s}</p></div></body>",
    "<body><div class=cookie-notice role=alert><p>{l}</p></div><div class=top-bar>{a}</div><div class=container><div class=row><section class=story-body main><h1>{s}</h1><p>{l}</p><figure><figcaption>{m}</figcaption></figure><p>{m}</p><p>{l}</p><table><tr><td>{s}</td><td>{s}</td></tr></table></section>"
    "<section class=newsletter-signup><h3>{s}</h3><p>{m}</p><form><p>{s}</p></form></section></div></div><footer class=site-footer><div>{a}</div><p>{m}</p></footer></body>",
    "<body><header class=site-header><p>{m}</p>{a}</header><main role=main><div class=breadcrumb>{a}</div><article class=article main><header not><h1>{m}</h1></header><p>{s}</p><p>{l}</p><div class=share not>{a}</div><p>{m}</p><section><h2>{s}</h2><p>{l}</p><ol><li>{m}</li><li>{s}</li></ol></section><dl><dt>{s}</dt><dd>{m}</dd></dl>"
    "<section class=comments not><h2>{s}</h2><article class=comment><p>{l}</p></article><article class=comment><p>{m}</p></article></section></article><div class=advert><p>{l}</p></div></main><footer><nav>{a}</nav><small>{s}</small></footer></body>",
    "<body><div class=banner><p>{m}</p></div><div class=menu><ul><li>{a}</li></ul></div><div class=page><div class=main-content main><p>{l}</p><p>{l}</p><p>{m}</p><p>{s}</p></div><div class=right-column><div class=promo><p>{l}</p></div><div class=ads><p>{m}</p></div><div class=related-posts><h4>{s}</h4><p>{m}</p><p>{l}</p></div></div></div><div class=copyright>{m}</div></body>",
    "<body><aside><p>{l}</p><p>{m}</p></aside><article main><h1>{s}</h1><div><p>{l}</p></div><div><p>{m}</p><p>{s}</p></div><div class=ad not><p>{m}</p></div><p>{l}</p></article><section id=disqus class=comment-list><p>{l}</p><p>{l}</p><p>{m}</p></section><div class=popup><p>{m}</p></div><footer>{l}</footer></body>",
    "<body><nav>{a}</nav><div class=notice>{l}</div><article main><h1>{s}</h1><p>{m}</p><p>{l}</p><p>{s}</p><p>{s}</p></article><div class=comments><p>{l}</p><p>{m}</p></div><div class=social>{a}</div><form class=subscribe><p>{m}</p><p>{l}</p></form><footer>{m}</footer></body>",
    "<body><header><h1>{s}</h1><p>{m}</p></header><nav><a href=/>{s}</a></nav><main main><h1>{m}</h1><p>{l}</p><p>{m}</p><h2>{s}</h2><p>{l}</p><nav not class=pagination>{a}</nav></main><aside class=sponsor><p>{m}</p></aside><footer><p>{s}</p></footer></body>",
    "<body><div class=disclaimer><p>{l}</p></div><div class=header>{s}</div><div class=article-text main><h1>{s}</h1><p>{l}</p><p>{l}</p><p>{l}</p><p>{m}</p></div><div class=footer>{m}</div><div class=reviews><p>{l}</p><p>{l}</p></div><div class=feedback><p>{m}</p></div><div class=toolbar>{a}</div></body>",
    "<body><header><h1>{s}</h1><p>{s}</p><nav><ul><li>{a}</li></ul></nav></header><main><article main><h2>{m}</h2><p>{l}</p><p>{l}</p><div><p>{m}</p></div></article></main><aside><h2>{s}</h2><p>{m}</p></aside><footer><p>{l}</p></footer></body>",
    "<body><div><header><p>{s}</p></header><article main><h1>{s}</h1><div><p>{l}</p><p>{s}</p></div><section><h2>{s}</h2><p>{l}</p></section></article><section class=comments><h2>{s}</h2><div class=comment><p>{l}</p></div><div class=comment><p>{l}</p></div></section></div><footer><div>{m}</div></footer></body>",
    "<body><header><h1>{s}</h1><h2>{m}</h2></header><div class=notice><p>{m}</p></div><article main><h1>{m}</h1><p>{m}</p><p>{l}</p></article><form><h3>{s}</h3><p>{l}</p></form><div class=sidebar><p>{l}</p></div><footer>{a}</footer></body>",
    "<body><div class=site><nav>{a}</nav><article main><h1>{m}</h1><p>{l}</p><aside not><p>{l}</p></aside><p>{l}</p><form not><p>{m}</p></form><p>{m}</p><footer not><p>{m}</p></footer></article><div id=comments><h3>{s}</h3><ol><li>{l}</li><li>{m}</li></ol></div></div></body>",
    "<body><h1 main>{m}</h1><p main>{l}</p><p main>{m}</p><h2 main>{s}</h2><p main>{l}</p><ul main><li>{m}</li><li>{s}</li></ul><p main>{l}</p><div class=footer>{s}</div></body>",
    "<p main>{l}</p><p main>{m}</p><p main>{s}</p>",
    "<body><div class=menu>{a}</div><h1 main>{m}</h1><p main>{l}</p><p main>{m}</p><div class=comments><p>{l}</p></div><div class=ad>{m}</div></body>",
    "<body><nav>{a}</nav><article main>{l}</article><div class=promo>{m}</div><aside>{m}</aside></body>",
    "<body><nav>{a}</nav><article main><h1>{s}</h1><section><h2>{s}</h2><p>{l}</p></section><section><h2>{s}</h2><p>{l}</p></section><div><div><p>{m}</p></div><div class=text><p>{l}</p></div></div><div class=ad not>{m}</div></article><footer>{m}</footer></body>",
    "<body><header>{a}</header><main main><header not><h1>{s}</h1></header><section><p>{l}</p></section><section><h2>{s}</h2><div><p>{l}</p></div></section><div><section><p>{s}</p></section></div></main><footer>{m}</footer></body>",
    "<body>Main text: {l}<br>{m}</body>",
    "<html><body>Main text: {m}<br>{s}</body></html>",
    "Main text: {m}",
    "<body><div class=menu>{a}</div>Main text: {l}<br>{m}<div class=footer>{m}</div></body>",
    "<body><div main>{l}</div><div main>{m}</div><div main>{s}</div></body>",
    "<body><div><div main>{l}</div><div main>{m}</div><div main>{s}</div></div></body>",
    "<body><div main>{s}</div><div main>{m}</div></body>",
    "<body><div class=header>{a}</div><div main>{l}</div><div main>{m}</div><div class=footer>{s}</div></body>",
    "<body><nav>{a}</nav><article main><h1>{s}</h1><p>{l}</p><details><summary>{s}</summary><p>{m}</p></details><address>{s}</address><p>{m}</p></article><footer>{m}</footer></body>",
    "<body><header>{a}</header><article main><p>{l}</p><address>{m}</address><details><summary>{m}</summary>{m}</details></article><div class=comments><p>{l}</p></div></body>",
]


def labelled_pages() -> list[str]:
    return [p.replace("{s}", _SHORT).replace("{m}", _MIDDLE).replace("{l}", _LONG).replace("{a}", _LINKS) for p in _PAGES]
