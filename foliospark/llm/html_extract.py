"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding.

The trees are fitted here, on pages composed at random from page parts whose role is known.
Decoding labels all nodes of a page at once: the most likely labelling in which nothing is
kept below a dropped node.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost
from .common import slices
from .html_tree import Tree, features

#: Pages composed for fitting: bounds the training sample.
FIT_PAGES = 700
TREES, DEPTH = 50, 4
BATCH_BYTES = 2_000_000


# -- training pages --------------------------------------------------------------------------


class Composer:
    """Pages at random with the role of every text known: main texts start with ``KEEP``."""

    KEEP = "⁠"

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice("the an re on er st ou in ed es ha le nt qu ver ung ción à é".split()) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, lo: int = 2, hi: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.randint(lo, hi))]
        if self.rng.random() < 0.3 and len(words) > 3:
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + self.rng.choice(["."] * 8 + ["!", "?"])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 1, 2, 3, 5, 8])))

    def label(self) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(1, 4))).capitalize()

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.label()}</a>'

    def named(self, *names: str) -> str:
        """A class or id attribute, or none."""
        if self.rng.random() < 0.2:
            return ""
        name = self.rng.choice(names)
        style = self.rng.randrange(4)
        name = {0: name, 1: name + "-" + self.word(), 2: self.word() + " " + name, 3: "site-" + name}[style]
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def maybe(self, share: float, make) -> str:
        return make() if self.rng.random() < share else ""

    # parts that go

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"

    def menu(self) -> str:
        body = self.rng.choice([self.links(self.rng.randint(3, 9)), " | ".join(self.link() for _ in range(self.rng.randint(2, 8)))])
        return self.rng.choice([f"<nav>{body}</nav>", f'<div{self.named("nav", "menu", "navbar", "breadcrumbs", "pagination")}>{body}</div>', f'<nav{self.named("menu")}>{body}</nav>'])

    def top(self) -> str:
        body = self.maybe(0.7, lambda: f"<h1>{self.label()}</h1>") + self.maybe(0.5, lambda: f"<p>{self.sentence(2, 9)}</p>") + self.maybe(0.6, self.menu)
        return self.rng.choice([f"<header>{body}</header>", f'<div{self.named("header", "masthead", "topbar", "logo")}>{body}</div>'])

    def bottom(self) -> str:
        text = self.rng.choice(["&copy; ", "Copyright ", "", "© 2024 "]) + f"{self.word()}.example.com &middot; {self.sentence()}" + self.maybe(0.3, self.prose)
        body = self.rng.choice([text, f"<p>{text}</p>", f"<div>{text}</div>"]) + self.maybe(0.4, lambda: self.links(self.rng.randint(2, 6)))
        return self.rng.choice([f"<footer>{body}</footer>", f'<div{self.named("footer", "colophon", "copyright", "legal")}>{body}</div>'])

    def side(self) -> str:
        parts = [f"<h3>{self.label()}</h3>", self.links(self.rng.randint(2, 7)), f"<p>{self.prose()}</p>", f"<div>{self.link()} {self.sentence()}</div>"]
        body = "".join(self.rng.sample(parts, self.rng.randint(1, 4)))
        return self.rng.choice([f"<aside>{body}</aside>", f'<aside{self.named("sidebar", "widget")}>{body}</aside>', f'<div{self.named("sidebar", "widget", "related", "recommended", "popular-posts", "side")}>{body}</div>', f'<section class="related"><h2>{self.label()}</h2>{self.links(4)}</section>'])

    def advert(self) -> str:
        text = self.rng.choice([self.prose(), self.sentence(), "Advertisement", f"Sponsored {self.link()}", f"<p>{self.prose()}</p>", f"<p>{self.sentence()}</p>{self.link()}"])
        return f'<{"div"} class="{self.rng.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "ad box", "advertisement"])}">{text}</div>'

    def notice(self) -> str:
        text = self.rng.choice([self.sentence(4, 20), self.prose()])
        body = self.rng.choice([text, f"<p>{text}</p>"]) + self.maybe(0.6, lambda: f"<button>{self.label()}</button>")
        return self.rng.choice([f'<div{self.rng.choice([" class=", " id="])}"{self.rng.choice(["cookie-notice", "cookies", "consent", "gdpr-banner", "notice", "alert", "modal", "popup", "paywall", "cookie-banner"])}">{body}</div>', f'<div role="{self.rng.choice(["alert", "dialog"])}">{body}</div>', f'<section class="notice">{body}</section>', f"<dialog open>{body}</dialog>"])

    def form(self) -> str:
        body = self.maybe(0.7, lambda: f"<p>{self.sentence()}</p>") + self.maybe(0.7, lambda: f"<label>{self.label()}</label>") + '<input type="text">' + self.maybe(0.5, lambda: f"<textarea>{self.sentence()}</textarea>") + f"<button>{self.label()}</button>"
        form = f"<form{self.named('search', 'login', 'subscribe', 'newsletter')}>{body}</form>"
        return self.rng.choice([form, form, f'<div class="newsletter">{form}</div>', f'<div class="{self.rng.choice(["newsletter", "signup", "subscribe"])}"><h3>{self.label()}</h3><p>{self.sentence()}</p>{form}</div>'])

    def comments(self) -> str:
        def one() -> str:
            who = self.rng.choice([f"<cite>{self.label()}</cite>", f"<h4>{self.label()}</h4>", f"<b>{self.label()}</b>", f'<p class="author">{self.label()}</p>'])
            body = "".join(f"<p>{self.prose()}</p>" for _ in range(self.rng.randint(1, 2)))
            return self.rng.choice([f'<div class="comment">{who}{body}</div>', f"<li>{who}{body}</li>", f'<article class="comment">{who}{body}</article>', f"<div>{who}{body}</div>"])

        body = self.maybe(0.7, lambda: f"<h2>{self.label()}</h2>") + "".join(one() for _ in range(self.rng.randint(1, 6))) + self.maybe(0.4, self.form)
        name = self.rng.choice(["comments", "comment-list", "disqus", "discussion", "replies", "responses", "reader-comments", "user-comments"])
        return self.rng.choice([f'<div id="{name}">{body}</div>', f'<section class="{name}">{body}</section>', f'<ol class="{name}">{body}</ol>', f'<div class="{name}">{body}</div>'])

    def share(self) -> str:
        return f'<div class="{self.rng.choice(["share", "social", "share-buttons", "tags", "post-meta", "byline"])}">{" ".join(self.link() for _ in range(self.rng.randint(1, 5)))}</div>'

    # parts that stay

    def keep(self, text: str) -> str:
        return self.KEEP + text

    def main_block(self) -> str:
        r, k = self.rng.random(), self.keep
        if r < 0.66:
            text = k(self.prose() if self.rng.random() < 0.85 else self.sentence(1, 3))
            if self.rng.random() < 0.15:
                text = text.replace(" ", f" {self.link()} ", 1)
            return f"<p>{text}</p>" if self.rng.random() < 0.9 else f"<p><b>{text}<br>"
        if r < 0.76:
            return f"<h{(n := self.rng.randint(2, 4))}>{k(self.label())}</h{n}>"
        if r < 0.85:
            items = "".join(f"<li>{k(self.sentence(1, 12))}</li>" for _ in range(self.rng.randint(2, 7)))
            return f"<ul>{items}</ul>" if self.rng.random() < 0.6 else f"<ol>{items}</ol>"
        if r < 0.90:
            return f"<blockquote>{self.rng.choice(['<p>%s</p>', '%s']) % k(self.prose())}</blockquote>"
        if r < 0.93:
            rows = "".join("<tr>" + "".join(f"<td>{k(self.label())}</td>" for _ in range(3)) + "</tr>" for _ in range(self.rng.randint(2, 5)))
            return f"<table>{rows}</table>"
        if r < 0.95:
            return f"<pre>{k(self.prose())}</pre>"
        if r < 0.97:
            return f'<figure><img src="x.png"><figcaption>{k(self.sentence())}</figcaption></figure>'
        return f"<div>{k(self.prose())}</div>"

    def main(self) -> str:
        count = self.rng.choice([1, 2, 3, 4, 6, 9, 14, 22])
        blocks = [self.main_block() for _ in range(count)]
        if self.rng.random() < 0.8:
            title = f"<h1>{self.keep(self.label() if self.rng.random() < 0.5 else self.sentence())}</h1>"
            blocks.insert(0, title if self.rng.random() < 0.85 else f"<div>{title}</div>")
        for _ in range(self.rng.choice([0, 0, 0, 1, 2])):
            blocks.insert(self.rng.randint(0, len(blocks)), self.rng.choice([self.advert, self.share, self.side, self.form, self.notice])())
        body = "".join(blocks)
        wrap = self.rng.randrange(9)
        name = self.rng.choice(["content", "post", "entry-content", "article-body", "story", "main", "page-content", "text"])
        return {0: f"<article>{body}</article>", 1: f"<article>{body}</article>", 2: f"<main>{body}</main>", 3: f"<main><article>{body}</article></main>", 4: f'<div class="{name}">{body}</div>', 5: f'<div id="{name}"><div>{body}</div></div>', 6: f'<article class="{name}"><div class="body">{body}</div></article>', 7: f"<div>{body}</div>", 8: body}[wrap]

    def page(self) -> str:
        before = [f for f, p in ((self.top, 0.4), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.4), (self.form, 0.15), (self.side, 0.15)) if self.rng.random() < p]
        after = [f for f, p in ((self.share, 0.25), (self.comments, 0.4), (self.side, 0.4), (self.advert, 0.3), (self.form, 0.2), (self.bottom, 0.7), (self.notice, 0.2)) if self.rng.random() < p]
        if self.rng.random() < 0.5:
            self.rng.shuffle(before)
            self.rng.shuffle(after)
        wrapped = self.main()
        if self.rng.random() < 0.2:
            # What follows an article may stand inside the element that holds it.
            wrapped = f'<div class="{self.rng.choice(["container", "wrapper", "row", "page", "layout"])}">{wrapped}{"".join(f() for f in after)}</div>'
            after = []
        body = "".join(f() for f in before) + wrapped + "".join(f() for f in after)
        return f"<!DOCTYPE html><html><head><title>{self.label()}</title></head><body>{body}</body></html>"


def labelled(tree: Tree) -> np.ndarray:
    """1 for texts that stay and for what holds any; the marks are taken off the texts."""
    y = np.zeros(len(tree.tag), np.int64)
    for k in range(len(y) - 1, -1, -1):
        if Composer.KEEP in tree.text[k]:
            tree.text[k] = tree.text[k].replace(Composer.KEEP, "")
            y[k] = 1
        if y[k] and tree.parent[k] >= 0:
            y[tree.parent[k]] = 1
    return y


@lru_cache(maxsize=1)
def fitted(pages: int = FIT_PAGES, seed: int = 6) -> Boosted:
    composer = Composer(seed)
    xs, ys = [], []
    for _ in range(pages):
        tree = Tree(composer.page())
        y = labelled(tree)
        xs.append(features(tree))
        ys.append(y)
    return boost(np.concatenate(xs), np.concatenate(ys), TREES, DEPTH)


# -- decoding --------------------------------------------------------------------------------


def decode(tree: Tree, log_odds: np.ndarray) -> list[str]:
    """Texts of the best labelling in which every kept node's ancestors are kept.

    Bottom up, a node is worth the better of keeping it (its own odds and the best of each
    child) and dropping all that is below it.
    """
    n = len(tree.tag)
    odds = np.clip(log_odds, -12, 12).tolist()
    # A container's odds restate those of its texts; texts carry the decision.
    odds = [o if t == 0 else 0.5 * o for o, t in zip(odds, tree.tag)]
    odds[0] = 0.0
    kept, dropped = odds[:], [-o for o in odds]
    parents = tree.parent
    for k in range(n - 1, 0, -1):
        p = parents[k]
        kept[p] += max(kept[k], dropped[k])
        dropped[p] += dropped[k]
    stays = [False] * n
    stays[0] = True
    for k in range(1, n):
        stays[k] = stays[parents[k]] and kept[k] > dropped[k]
    return [t for k, t in enumerate(tree.text) if t and stays[k]]


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    """The main text of each page: its blocks, an empty line between them."""
    trees = [Tree(page) for page in pages]
    if not trees:
        return []
    xs = [features(t) for t in trees]
    odds = model.log_odds(np.concatenate(xs))
    cuts = np.cumsum([len(x) for x in xs])[:-1]
    return ["\n\n".join(decode(t, o)) for t, o in zip(trees, np.split(odds, cuts))]


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` with the main text of each row of ``pages``.

    References are decoded, white space in a block becomes one space, blocks are joined in
    page order by an empty line. Null or empty html, or a page without main text: the empty
    string. Null ids and urls and repeated rows: a row each. Empty table: empty result.
    Other columns are ignored.
    """
    trees = model or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", BATCH_BYTES):
                texts = main_texts([h or "" for h in batch.column("html").to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
