"""Labelled pages to train the extractor on: seeded pages whose layout is known.

Every element that holds text or structures it carries data-y: 1 in the article, 0 in menus,
headers, footers, sidebars, notices, adverts, forms, sharing bars and reader comments. The layouts
vary in tags, class names, nesting and unclosed tags; words are drawn, so only structure tells.
"""

from __future__ import annotations

import random


def _words(r: random.Random, lo: int, hi: int) -> str:
    n = r.randint(lo, hi)
    text = " ".join("".join(r.choice("abdefgilmnoprstuv") for _ in range(r.randint(1, 9))) for _ in range(n))
    mark = r.choice([".", ".", ".", "", "!", " &amp; " + "x" * 3])
    return text.capitalize() + mark


def _links(r: random.Random, n: int, item: str = "li") -> str:
    if item:
        return "".join(f'<{item} data-y="0"><a href="/{k}">{_words(r, 1, 3)}</a></{item}>' for k in range(n))
    return " | ".join(f'<a href="/{k}">{_words(r, 1, 3)}</a>' for k in range(n))


def _wrap(r: random.Random, tags: list[str], names: list[str], inner: str, y: int) -> str:
    tag = r.choice(tags)
    name = r.choice(names)
    attr = f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""
    return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'


def _menu(r: random.Random) -> str:
    inner = f'<ul data-y="0">{_links(r, r.randint(3, 9))}</ul>' if r.random() < 0.8 else _links(r, r.randint(3, 8), "")
    return _wrap(r, ["nav", "nav", "div", "ul"], ["", "menu", "nav", "navbar", "main-nav", "breadcrumb", "topnav"], inner, 0) if r.random() < 0.85 else f'<nav data-y="0">{inner}</nav>'


def _plain(r: random.Random, lo: int, hi: int, tags=("p", "p", "p", "div", "span", "")) -> str:
    tag = r.choice(tags)
    text = _words(r, lo, hi)
    return f'<{tag} data-y="0">{text}</{tag}>' if tag and tag != "span" else text


def _advert(r: random.Random) -> str:
    return _wrap(r, ["div", "aside", "section"], ["ad", "ads", "advert", "ad-box", "sponsored", "promo", "advertisement", "banner-ad"], _plain(r, 3, 30), 0)


def _notice(r: random.Random) -> str:
    inner = _plain(r, 5, 40) + r.choice(["", '<button data-y="0">' + _words(r, 1, 2) + "</button>"])
    return _wrap(r, ["div", "div", "section", "aside"], ["cookie-notice", "notice", "alert", "consent", "gdpr", "cookie", "popup", "newsletter", "subscribe", "modal", "banner"], inner, 0)


def _sidebar(r: random.Random) -> str:
    inner = f'<h3 data-y="0">{_words(r, 1, 4)}</h3>' * r.randint(0, 1)
    inner += r.choice([f'<ul data-y="0">{_links(r, r.randint(2, 7))}</ul>', "".join(f'<p data-y="0">{_words(r, 4, 40)}</p>' for _ in range(r.randint(1, 3)))])
    return _wrap(r, ["aside", "aside", "div"], ["sidebar", "side", "related", "widget", "right-col", "recommended", "trending"], inner, 0)


def _form(r: random.Random) -> str:
    return f'<form data-y="0" class="{r.choice(["search", "login", "contact", "signup", ""])}"><label data-y="0">{_words(r, 1, 4)}</label><input name="q">{_plain(r, 1, 12)}<button data-y="0">{_words(r, 1, 2)}</button></form>'


def _comments(r: random.Random) -> str:
    tag = r.choice(["div", "div", "li", "li", "p", "p", "article"])
    names = ["comment", "comment-body", "reply"] + [""] * (tag != "article")
    one = lambda: _wrap(r, [tag], names, f'<b>{_words(r, 1, 2)}</b> ' + _plain(r, 5, 60), 0)
    inner = f'<h3 data-y="0">{_words(r, 1, 3)}</h3>' * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6)))
    return _wrap(r, ["section", "div", "ol"], ["comments", "comment-list", "disqus", "responses", "user-comments", "discussion"], inner, 0)


def _share(r: random.Random) -> str:
    return _wrap(r, ["div", "ul", "p"], ["share", "social", "share-bar", "tags", "byline-links"], _links(r, r.randint(2, 5), ""), 0)


def _body(r: random.Random) -> str:
    """The article's own blocks."""
    out = [f'<h1 data-y="1">{_words(r, 2, 10)}</h1>'] if r.random() < 0.85 else []
    for _ in range(r.randint(1, 9)):
        kind = r.random()
        text = _words(r, *r.choice([(1, 4), (6, 30), (20, 120), (40, 160)]))
        if r.random() < 0.3:
            text += f' <a href="/x">{_words(r, 1, 4)}</a> ' + _words(r, 3, 20)
        if kind < 0.62:
            out.append(f'<p data-y="1">{text}' + r.choice(["</p>", "</p>", ""]))
        elif kind < 0.72:
            out.append(f'<p data-y="1"><b>{text}<br>' + r.choice(["", "</b></p>"]))
        elif kind < 0.80:
            out.append(f'<h2 data-y="1">{_words(r, 1, 8)}</h2>')
        elif kind < 0.88:
            out.append('<ul data-y="1">' + "".join(f'<li data-y="1">{_words(r, 2, 25)}</li>' for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.93:
            out.append(f'<blockquote data-y="1">{text}</blockquote>')
        elif kind < 0.96:
            out.append(f'<table data-y="1"><tr data-y="1"><td data-y="1">{_words(r, 1, 4)}</td><td data-y="1">{_words(r, 1, 4)}</td></tr></table>')
        else:
            out.append(f'<div data-y="1">{text}</div>')
        if r.random() < 0.10:
            out.append(r.choice([_advert, _notice, _sidebar, _form, _share])(r))
    return "".join(out)


def page(r: random.Random) -> str:
    """One labelled page."""
    article = _body(r)
    style = r.random()
    if style < 0.55:
        article = f'<article data-y="1">{article}{_comments(r) if r.random() < 0.15 else ""}</article>'
    elif style < 0.85:
        article = _wrap(r, ["div", "section", "main"], ["content", "post", "entry", "article", "article-body", "main-content", "story", "post-body", "text"], article, 1)
    if r.random() < 0.25:
        article = f'<main data-y="1">{article}</main>'
    elif r.random() < 0.2:
        article = f'<div class="{r.choice(["wrap", "container", "page", "row", "col"])}" data-y="1">{article}</div>'
    before, after = [], []
    if r.random() < 0.8:
        before.append(_menu(r))
    if r.random() < 0.5:
        inner = _plain(r, 1, 8, ("h1", "p", "div", "")) + (_menu(r) if r.random() < 0.4 else "")
        before.append(_wrap(r, ["header", "header", "div"], ["header", "site-header", "masthead", "top"], inner, 0))
    for make, p in ((_advert, 0.45), (_notice, 0.35), (_form, 0.25), (_sidebar, 0.4)):
        if r.random() < p:
            (before if r.random() < 0.5 else after).append(make(r))
    if r.random() < 0.4:
        after.append(_comments(r))
    if r.random() < 0.3:
        after.append(_share(r))
    if r.random() < 0.85:
        inner = "&copy; " + _words(r, 2, 20) + r.choice(["", f'<p data-y="0">{_words(r, 2, 20)}</p>', _links(r, 3, "")])
        after.append(_wrap(r, ["footer", "footer", "footer", "div"], ["footer", "site-footer", "bottom", "copyright"], inner, 0))
    r.shuffle(before)
    head = f'<head><meta charset="utf-8"><title data-y="0">{_words(r, 2, 9)}</title><style>p{{margin:0}}</style></head>'
    end = r.choice(["</body></html>", "</body></html>", ""])
    return f'<!DOCTYPE html><html>{head}<body data-y="0">{"".join(before)}{article}{"".join(after)}{end}'


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
