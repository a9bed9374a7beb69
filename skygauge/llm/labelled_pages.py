"""Labelled pages for the extraction field: layouts drawn by rule, each text block with its label."""

from __future__ import annotations

import numpy as np

# Names that page authors give to parts of a page.
NAMES = {
    "menu": ["nav", "menu", "navbar", "main-nav", "breadcrumb", "breadcrumbs", "topbar", "site-nav", "menu-item", "pagination", "pager", "toc", "tabs", "skip-link"],
    "head": ["header", "masthead", "site-header", "page-header", "logo", "brand", "branding", "top"],
    "foot": ["footer", "site-footer", "copyright", "colophon", "legal", "bottom", "credits", "foot"],
    "side": ["sidebar", "aside", "widget", "side", "rail", "related", "related-posts", "recommended", "popular", "trending", "more-stories", "tags", "author-box", "right-col"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "alert", "banner", "gdpr", "popup", "modal", "announcement", "warning", "paywall", "disclaimer", "message"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "ad-slot", "adsbox", "banner-ad", "google-ad", "advertorial"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form", "search-box", "subscription"],
    "comments": ["comments", "comment", "comment-list", "replies", "reply", "responses", "discussion", "disqus", "respond", "reader-comments", "comment-body", "user-comments"],
    "share": ["share", "social", "social-links", "share-buttons", "follow", "sharing"],
    "content": ["content", "article", "post", "entry", "entry-content", "post-content", "article-body", "main", "story", "text", "body", "main-content", "post-body", "page-content", "wrapper", "container", ""],
}
#: Names of parts of an article that hold words of other parts.
MISLEADING = ["read-more-content", "more-content", "header-image-caption", "article-header", "entry-header", "post-footer-text", "story-side-note", "ad-free-content", "top-story-text", "search-result-story", "post-comment-text"]
#: Marks of whole pages.
PAGE_MARKS = ["", "", "", "has-sidebar single-post", "page-with-comments", "home blog sidebar-right", "no-js ads-enabled", "search-open", "header-fixed footer-dark", "post-template", "menu-closed"]
#: Keyword groups that a name is reduced to, looked up in parts of class, id and role.
ROLES = {
    "menu": ["nav", "menu", "breadcrumb", "pagination", "pager", "toc", "tab", "skip", "navigation", "topbar"],
    "head": ["header", "masthead", "logo", "brand", "banner-top"],
    "foot": ["footer", "copyright", "colophon", "legal", "bottom", "credits", "contentinfo", "foot"],
    "side": ["sidebar", "aside", "widget", "rail", "related", "recommend", "popular", "trending", "more", "tags", "author", "complementary", "side", "teaser"],
    "notice": ["cookie", "consent", "notice", "alert", "banner", "gdpr", "popup", "modal", "announcement", "warning", "paywall", "disclaimer", "message", "overlay", "dialog"],
    "advert": ["ad", "ads", "advert", "sponsor", "promo", "adslot", "adsbox", "advertorial", "advertising", "commercial", "affiliate"],
    "form": ["form", "newsletter", "subscri", "signup", "login", "search", "contact", "register"],
    "comments": ["comment", "repl", "response", "discussion", "disqus", "respond", "feedback"],
    "share": ["share", "social", "follow", "sharing"],
    "hidden": ["is-hidden"],
    "content": ["content", "article", "post", "entry", "main", "story", "text", "body"],
}
#: Parts that mean a role only as a whole word.
WHOLE = {"ad", "ads", "tab", "more", "side", "foot", "main", "text", "body", "post", "toc", "nav", "rail", "tags"}


def page(rng: np.random.Generator) -> tuple[str, list[tuple[str, int]]]:
    """(html, [(block text, 1 for content)]) of one drawn page."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    maybe = lambda p: rng.random() < p
    gold: list[tuple[str, int]] = []
    word = lambda: "".join(pick("bcdfghklmnprstvz") + pick("aeiouäéó") for _ in range(rng.integers(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.integers(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(3, 14).capitalize() + pick(". . . . ? !".split()) for _ in range(rng.integers(a, b)))

    def odd() -> str:
        """Text that an article may hold as well: columns, marks, numbers."""
        sign = pick([" | ", "*** ", " # ", "; ", " 12 ", "%%% ", " - "])
        return sign.join(words(1, 2) for _ in range(rng.integers(2, 9))).capitalize() + pick(["", sign.rstrip(), "."])

    def block(tag: str, text: str, label: int, inner: str | None = None) -> str:
        gold.append((text, label))
        return f"<{tag}>{inner or text}" + ("" if tag in ("p", "li") and maybe(0.15) else f"</{tag.split()[0]}>")

    def link_list(label: int, a: int = 2, b: int = 8) -> str:
        rows = []
        for _ in range(rng.integers(a, b)):
            t = pick([words(1, 4), words(1, 4).capitalize(), words(1, 3).capitalize() + pick(".?!")])
            rows.append(block("li", t, label, f'<a href="/x">{t}</a>'))
        return f"<ul>{''.join(rows)}</ul>"

    def named(role: str, inner: str, tags=("div", "section")) -> str:
        tag = pick(tags)
        name = pick(NAMES[role])
        mark = f' {pick(["class", "class", "class", "id"])}="{name}{pick(["", "", " clearfix", " col-4"])}"' if name and (tag in ("div", "section", "p", "ul") or maybe(0.5)) else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def boiler(role: str) -> str:
        if role == "menu":
            return named(role, link_list(0), ("nav", "nav", "div"))
        if role == "head":
            return named(role, pick([lambda: block("h1", words(1, 4), 0), lambda: block("div", words(1, 4), 0), lambda: block("p", sentences(1, 2), 0)])() + (link_list(0) if maybe(0.5) else ""), ("header", "header", "div"))
        if role == "foot":
            t = pick(["© ", "Copyright ", ""]) + words(1, 4) + pick([" · ", " | ", ". "]) + pick([words(2, 8), sentences(1, 3)])
            if maybe(0.5):
                gold.append((t, 0))
                return named(role, t + (link_list(0) if maybe(0.4) else ""), ("footer", "footer", "div"))
            return named(role, block("p", t, 0), ("footer", "footer", "div"))
        if role == "side":
            return named(role, (block(pick(["h2", "h3", "h4"]), words(1, 4), 0) if maybe(0.7) else "") + (link_list(0) if maybe(0.6) else block("p", sentences(1, 4), 0)), ("aside", "aside", "div"))
        if role == "form":
            fields = block("label", words(1, 4), 0) if maybe(0.5) else ""
            return named(role, f'<form action="/s">{block("p", pick([words(2, 6), sentences(1, 3)]), 0)}{"<p>" * bool(fields)}{fields}<input name="q">' + (f"<p>{block('button', words(1, 3), 0)}" if maybe(0.7) else "") + "</form>") if maybe(0.6) else f"<form>{block('p', sentences(1, 3), 0)}</form>"
        if role == "comments":
            rows = "".join(named("comments", (block(pick(["h4", "p", "div"]), words(1, 3), 0) if maybe(0.5) else "") + block("p", sentences(1, 5), 0), ("div", "li", "article", "div")) for _ in range(rng.integers(1, 5)))
            return named(role, (block("h3", words(1, 3), 0) if maybe(0.6) else "") + (f"<ol>{rows}</ol>" if maybe(0.3) else rows), ("section", "div"))
        text = sentences(1, 4) if maybe(0.7) else words(2, 9)
        if maybe(0.5):
            gold.append((text, 0))
            return named(role, text, ("div", "div", "section", "p"))
        return named(role, block("p", text, 0), ("div", "div", "section"))

    def unmarked(side: bool) -> str:
        """A column of links or a label that nothing names."""
        if side:
            return "<div>" + (block(pick(["h3", "h4", "p"]), words(1, 3), 0) if maybe(0.5) else "") + link_list(0, 2, 6) + "</div>"
        return block(pick(["div", "p"]), pick(["Sponsored", "Advertisement", "Read more", "Share this", "Back to top", "Related", "Print this page"]), 0)

    bare = maybe(0.25)  # a page of little but its text

    def body() -> str:
        parts = [block("h1", words(2, 10), 1) if maybe(0.8) else ""]
        for _ in range(rng.integers(1, 9)):
            kind = rng.random()
            if bare and kind >= 0.88:
                kind = 0.3
            if kind < 0.66:
                text = sentences(1, 9) if maybe(0.85) else words(1, 5).capitalize() + "." if maybe(0.5) else odd()
                inner = text
                if maybe(0.2) and " " in text:
                    head, tail = text.split(" ", 1)
                    inner = f"<{pick(['b', 'i', 'em', 'strong'])}>{head} {tail}<br>" if maybe(0.4) else f'<a href="/y">{head}</a> {tail}'
                part = block("p", text, 1, inner)
                parts.append(f'<div class="{pick(MISLEADING)}">{part}</div>' if maybe(0.06) else f"<div>{part}</div>" if maybe(0.06) else part)
            elif kind < 0.76:
                parts.append(block(pick(["h2", "h3"]), words(1, 7), 1))
            elif kind < 0.83:
                parts.append("<ul>" + "".join(block("li", words(2, 12), 1) for _ in range(rng.integers(2, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(block(pick(["blockquote", "pre", "figcaption"]), sentences(1, 3), 1))
            elif kind < 0.91:
                parts.append("<table>" + "".join("<tr>" + "".join(block("td", words(1, 4), 1) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                parts.append(boiler(pick(["advert", "share", "side", "form", "notice"])) if maybe(0.85) else unmarked(False))
        if maybe(0.25):
            parts.append(boiler("comments"))
        return "".join(parts)

    out = []
    for role, p in (("notice", 0.3), ("head", 0.4), ("menu", 0.8), ("advert", 0.4), ("side", 0.15), ("form", 0.2)):
        if maybe(0 if bare else p):
            out.append(boiler(role))
    shell = pick(["none", "none", "plain", "article", "div"]) if bare else pick(["article", "article", "article", "main", "div", "div", "both", "table", "none", "plain"])
    inner = body()
    if shell == "div":
        out.append(named("content", inner, ("div",)))
    elif shell == "both":
        out.append(f"<main>{named('content', '<article>' + inner + '</article>', ('div',))}</main>")
    elif shell == "table":
        out.append(f"<table><tr><td>{inner}</td>{'<td>' + unmarked(True) + '</td>' if maybe(0.5) else ''}</tr></table>")
    elif shell == "plain":
        out.append(f"<div>{inner}</div>")
    else:
        out.append(inner if shell == "none" else f"<{shell}>{inner}</{shell}>")
    for role, p in (("share", 0.2), ("comments", 0.35), ("side", 0.35), ("form", 0.15), ("advert", 0.3), ("menu", 0.1), ("foot", 0.8)):
        if maybe(0 if bare else p):
            out.append(boiler(role))
    if not bare and maybe(0.2):
        out.append(unmarked(True))
    whole = "".join(out)
    if maybe(0.2):  # wrappers around everything
        whole = pick([f"<form method=post>{whole}</form>", f'<div class="{pick(PAGE_MARKS)}">{whole}</div>', f"<div id=page><div class=wrapper>{whole}</div></div>"])
    mark = pick(PAGE_MARKS)
    return f"<html><head><title>{word()}</title></head><body{f' class={chr(34)}{mark}{chr(34)}' if mark else ''}>{whole}</body></html>", gold
