"""Main text of web pages by tag-path ratios."""

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import small_batches

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NEVER = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object",
         "form", "button", "select", "option", "textarea", "nav", "footer", "aside", "dialog", "menu"}
#: words of a class or id that mark page furniture
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent notice notices notification popup modal newsletter subscribe menu nav "
    "navbar navigation breadcrumb breadcrumbs sidebar side aside footer header masthead comment comments "
    "replies disqus share sharing social related recommended pagination pager login search widget skip".split())
#: words that say nothing about what an element holds
LAYOUT = frozenset(
    "area author bar block body bottom box button buttons cell center col column container content count entry "
    "form group holder icons inner item items left link links list main meta outer page panel post right row "
    "section site slot text the thread top unit wrap wrapper".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form",
         "menu", "menubar"}
#: an article's own heading block stays although page headers go
CONTAINERS = {"article", "main"}
PUNCTUATION = re.compile(r"[.,;:!?…、。，？！]")


def named_furniture(attrs, anchors):
    """How far class and id name page furniture: 2 for a name made of furniture words alone, 1 for
    one that holds such a word among others (related-work), 0 for none.  Where ``anchors`` holds,
    an id may be the name of a heading and counts 1 at most."""
    found = 0
    for kind in ("class", "id"):
        for name in attrs.get(kind, "").split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if any(w in FURNITURE for w in words):
                plain = all(w in FURNITURE or w in LAYOUT for w in words)
                found = max(found, 2 if plain and not (anchors and kind == "id") else 1)
    return found


class Run(NamedTuple):
    """A text run: tag path, number of its block, elements around it from the outside in, the
    elements of doubtful name among them, whether it is link text."""
    text: str
    path: str
    block: int
    regions: tuple
    doubtful: tuple
    linked: bool


class _Leaves(HTMLParser):
    """Text runs in page order, without those of page furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.block, self.skip = [], [], 0, 0
        self.made, self.containers = 1, set()

    def handle_starttag(self, tag, attrs):
        if tag == "p" or tag not in INLINE:
            self.block += 1
        if tag in VOID:
            return
        if tag == "p":  # a paragraph ends where the next one begins
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    self._close(at)
                    break
                if self.open[at][0] not in INLINE:
                    break
        a = {k: (v or "").lower() for k, v in attrs}
        inside = any(o[0] in CONTAINERS for o in self.open)
        # names of the page as a whole say what is on it, not what it is
        named = 0 if tag in ("html", "body", "main") else named_furniture(a, inside)
        furniture = (tag in NEVER or tag == "header" and not inside or a.get("role") in ROLES
                     or "hidden" in a or a.get("aria-hidden") == "true" or named == 2)
        region = self.made if tag not in INLINE and tag not in ("p", "html") else 0
        self.open.append((tag, furniture, region, self.made if named == 1 else 0))
        if tag in CONTAINERS:
            self.containers.add(region)
        self.made += 1
        self.skip += furniture

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, at):
        self.skip -= sum(o[1] for o in self.open[at:])
        del self.open[at:]

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.block += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return
            if self.open[at][0] in CONTAINERS:
                return

    def handle_data(self, data):
        if self.skip or not data:
            return
        self.texts.append(Run(
            data, "/".join(o[0] for o in self.open), self.block, (0, *(o[2] for o in self.open if o[2])),
            tuple(o[3] for o in self.open if o[3]), any(o[0] == "a" for o in self.open)))


def _selected(leaves, sigma):
    """Which text runs are content by the fused, smoothed ratios of their tag paths, and which
    are by the ratios of their own path alone."""
    chars, marks, nodes = {}, {}, {}
    for run in leaves:
        chars[run.path] = chars.get(run.path, 0) + len(run.text.strip())
        marks[run.path] = marks.get(run.path, 0) + len(PUNCTUATION.findall(run.text))
        nodes[run.path] = nodes.get(run.path, 0) + bool(run.text.strip())
    ratio = {p: chars[p] / max(nodes[p], 1) for p in chars}
    points = {p: marks[p] / max(nodes[p], 1) for p in chars}
    raw = np.array([(ratio[run.path], points[run.path]) for run in leaves], float)
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel, "full")[reach:reach + len(raw)]
    smooth = [np.convolve(raw[:, c], kernel, "full")[reach:reach + len(raw)] / weight for c in (0, 1)]
    fused = smooth[0] * (1 + smooth[1])
    if len(fused) < 2:
        return np.ones(len(fused), bool), np.ones(len(fused), bool)
    least = min(fused.mean(), fused.std())
    return fused >= least, raw[:, 0] * (1 + raw[:, 1]) >= least


def _shares(leaves, chosen, elements):
    """Characters of each element a run lies in: all, chosen by ratio, link text."""
    out = {}
    for run, take in zip(leaves, chosen):
        n = len(run.text.strip())
        for e in elements(run):
            all_, good, linked = out.get(e, (0, 0, 0))
            out[e] = all_ + n, good + n * bool(take), linked + n * run.linked
    return out


def _article(leaves, chosen, containers):
    """The innermost article or main element with half of the chosen text or more; without one
    the lowest element around all of the chosen text."""
    held = _shares(leaves, chosen, lambda run: run.regions)
    whole = held[0][1]
    own = [r for r in held if r in containers and 2 * held[r][1] >= whole]
    if own:
        return max(own)  # elements are numbered from the outside in
    return max(r for r in held if held[r][1] == whole)


def main_text(html, sigma=1.0):
    """Main text of a page: content paths choose the article, the article gives its whole text.

    Length and punctuation are summed per tag path, divided by the path's runs, smoothed in
    page order, multiplied and held against a threshold.  The chosen runs name the article
    (:func:`_article`), link text aside.  All its runs count but for furniture, elements of
    doubtful name that hold mostly runs of low ratio, and elements below it that hold such runs
    only and mostly link text.
    """
    page = _Leaves()
    page.feed(html)
    page.close()
    leaves = page.texts
    if not any(run.text.strip() for run in leaves):
        return ""
    chosen, high = _selected(leaves, sigma)
    low = {e for e, (n, good, _) in _shares(leaves, high, lambda run: run.doubtful).items() if 2 * good < n}
    stays = np.array([not low.intersection(run.doubtful) for run in leaves])
    leaves, chosen, high = [run for run, s in zip(leaves, stays) if s], chosen[stays], high[stays]
    if not leaves:
        return ""
    telling = chosen & np.array([bool(run.text.strip()) and not run.linked for run in leaves])
    chosen = telling if telling.any() else np.ones(len(leaves), bool)
    article = _article(leaves, chosen, page.containers)
    below = lambda run: run.regions[run.regions.index(article) + 1:][:1] if article in run.regions else ()
    menus = {e for e, (n, good, linked) in _shares(leaves, high, below).items() if not good and 2 * linked > n}
    blocks = {}
    for run in leaves:
        if article in run.regions and not menus.intersection(run.regions):
            blocks.setdefault(run.block, []).append(run.text)
    parts = (" ".join("".join(b).split()) for b in blocks.values())
    return " ".join(p for p in parts if p)


@F.pandas_udf(StringType())
def _main_texts(html: pd.Series) -> pd.Series:
    return pd.Series([main_text(h or "") for h in html], dtype=object)


def extract_main_text(pages, id_col="page_id", html_col="html"):
    """``text`` and ``n_chars`` of every page, beside its id and url.

    Null and empty pages give an empty text; repeated rows stay; an empty table gives an
    empty result; further columns are ignored.
    """
    small_batches(pages.sparkSession)
    out = pages.select(id_col, "url", _main_texts(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
