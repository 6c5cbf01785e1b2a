"""Main text of web pages by consensus host paths.

Each page scores its containers by text that is not in links and votes for the best one, named by its path of
tags and classes with digits generalised. Votes are counted by host and path in Spark. Pages are then read
again: of the paths that a page has, the one with most votes of its host chooses the containers whose blocks are the text.
Of equal ones the page's own best container is taken, then the lowest name; so a page that shares nothing with its host, or an unseen host, still gets its text.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import discard, fields, flat_map, map_rows, materialise, small

# Element names by kind, and words that mark boilerplate in a class, id or role.
RAW = frozenset("script style noscript template textarea svg math iframe object title".split())
FOREIGN, NESTING = frozenset(["svg", "math"]), frozenset(["svg", "math", "template", "object"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center details div dl figure main ol section table tbody td tr ul".split())
SKIP = frozenset("aside button canvas dialog fieldset footer form head input label legend menu nav optgroup option select audio video".split())
NEVER_BY_CLASS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion".split())
#: Also as part of a class name, and also inside an article.
STRONG = ADVERTS | frozenset(
    "nav navbar navigation menu sidebar footer cookie cookies cookiebar consent gdpr popup modal newsletter subscribe signup share sharing social comment comments"
    " commentlist respond disqus replies related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar".split()
)
#: Also as part of a class name, but not inside an article.
OUTSIDE = frozenset("banner header masthead topbar notice overlay login discussion complementary contentinfo".split())
#: As a whole class name only, and not inside an article.
WHOLE = frozenset("side rail privacy alert reply search skip copyright tags byline-links".split())
OF_ARTICLE = frozenset("article content entry main post section story".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
HIDDEN = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden""", re.I)

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
NUMBER, JOINT = re.compile(r"\d+"), re.compile(r"[-_]+")
_IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd", ("dl",)), "dt": ("dd", ("dl",))}
_PARAGRAPH = ("p", ("td", "th", "li", "div", "article", "section", "main", "blockquote"))


@cache
def _ends_of(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)


def _raw_end(source: str, tag: str, at: int) -> int:
    """Where an element ends whose content is no text; at the end of the page if it is never closed."""
    depth = 1
    for m in _ends_of(tag).finditer(source, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif tag in NESTING and not (tag in FOREIGN and m[2].endswith("/")):
            depth += 1
    return len(source)


def _boilerplate(tag: str, names: list[str], inside: bool) -> bool:
    """Whether names of classes or an id mark an element as no part of the text; inside an article few do."""
    for name in names:
        parts = JOINT.split(name.strip("-_"))
        if inside:
            words = STRONG if tag in CONTAINER or tag in ("aside", "span", "a") else ADVERTS
            if parts[0] in words or (parts[-1] in words and parts[0] not in OF_ARTICLE):
                return True
        elif name in WHOLE or not STRONG.isdisjoint(parts) or (not OUTSIDE.isdisjoint(parts) and OF_ARTICLE.isdisjoint(parts)):
            return True
    return False


class Page:
    """Blocks of text in page order and the containers that they stand in; memory and time grow with the length alone."""

    def __init__(self, source: str):
        self.parent, self.name, self.key = [-1], ["body"], [_hash("body", 0)]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters of it in links
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, skipped, in an article
        opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        text: list[str] = []
        linked = link = at = 0

        def flush():
            nonlocal linked
            if text:
                words = " ".join("".join(text).split())
                if words:
                    self.blocks.append((stack[-1][1], words, min(linked, len(words))))
                text.clear()
            linked = 0

        def say(raw: str):
            nonlocal linked
            if raw and not stack[-1][2]:
                raw = entities.unescape(raw)
                text.append(raw)
                if link:
                    linked += len(raw.strip())

        def close(k: int):
            while len(stack) > k:
                opened[stack.pop()[0]].pop()

        while m := TOKEN.search(source, at):
            say(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:  # an end
                if tag == "a":
                    link = 0
                if tag in BLOCK:
                    flush()
                if tag not in ("html", "body") and opened.get(tag):
                    close(opened[tag][-1])
                continue
            if tag in RAW:
                if not (tag in FOREIGN and m[3].endswith("/")):
                    at = _raw_end(source, tag, at)
                continue
            if tag in BLOCK:
                flush()
                ends, scopes = _IMPLIED.get(tag, _PARAGRAPH)
                if opened.get(ends):
                    k = opened[ends][-1]
                    if not any(opened.get(s) and opened[s][-1] > k for s in scopes):
                        close(k)
            elif tag == "br":
                say(" ")
            elif tag == "a":
                link = 1
            if tag in VOID or m[3].endswith("/"):
                continue
            _, place, skipped, article = stack[-1]
            attrs = {}
            for a in ATTRIBUTE.finditer(m[3]) if m[3] else ():
                attrs.setdefault((a[1] or a[5]).lower(), a[2] or a[3] or a[4] or "")
            if not skipped:
                names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split() if attrs else []
                skipped = (
                    tag in SKIP
                    or (tag == "header" and not article)
                    or "hidden" in attrs
                    or attrs.get("aria-hidden") == "true"
                    or (tag not in NEVER_BY_CLASS and (attrs.get("role", "").lower() in ROLES or _boilerplate(tag, names, article)))
                    or ("style" in attrs and HIDDEN.search(attrs["style"]) is not None)
                )
            if tag in CONTAINER and tag != "body" and not skipped:
                classes = ".".join(sorted(NUMBER.sub("#", attrs.get("class", "")).split()))
                self.parent.append(place)
                self.name.append(f"{tag}.{classes}" if classes else tag)
                self.key.append(_hash(self.name[-1], self.key[place]))
                place = len(self.parent) - 1
            opened[tag].append(len(stack))
            stack.append((tag, place, skipped, article or tag in ("article", "main")))
        say(source[at:])
        flush()

    def path(self, i: int) -> str:
        names = []
        while i >= 0:
            names.append(self.name[i])
            i = self.parent[i]
        return ">".join(reversed(names))

    def best(self) -> tuple[int, int]:
        """The container with the highest score, and that score."""
        own = [0.0] * len(self.parent)
        for place, words, linked in self.blocks:
            own[place] += len(words) - 2 * linked
        score = own[:]
        for i in range(len(own) - 1, 0, -1):  # parents come before their children
            score[self.parent[i]] += 0.6 * max(0.0, score[i])
        for i, name in enumerate(self.name):
            if name.split(".", 1)[0] in ("article", "main"):
                score[i] *= 1.5
        i = max(range(len(score)), key=lambda k: (score[k], -k))
        return i, int(score[i])

    def text(self, key: int) -> str:
        """The blocks of all containers with this path, a blank line between them."""
        inside = [False] * len(self.parent)
        for i, p in enumerate(self.parent):
            inside[i] = self.key[i] == key or (p >= 0 and inside[p])
        return "\n\n".join([words for place, words, _ in self.blocks if inside[place]])

    def chosen(self, votes: dict[int, int]) -> int:
        """The path that the votes of the page's host choose."""
        own = self.key[self.best()[0]]
        return max(set(self.key), key=lambda k: (votes.get(k, 0), k == own, -k))


def _hash(name: str, above: int) -> int:
    """64 bits of a path, signed, from its last name and what is above."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(name.encode(), above & 0xFFFFFFFFFFFFFFFF)
    return x - (1 << 64) if x >> 63 else x


def host(url: Column) -> Column:
    """The host of a URL in lower case; one empty host for null and what has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _source(pages: DataFrame, url: str, source: str) -> DataFrame:
    return pages.select(host(F.col(url)).alias("host"), F.col(source).alias("html"))


def winning_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, key, path, votes), written: all paths that pages of a host vote for. key is the path's hash."""

    def make() -> Callable:
        def run(sources):
            out = []
            for s in sources:
                page = Page(s or "")
                i, score = page.best()
                out.append((page.key[i], page.path(i)) if score > 0 else (None, None))
            return list(zip(*out, strict=True))

        return run

    votes = map_rows(_source(pages, url, source), ["host"], ["html"], fields(key="long", path="string"), make).where("key is not null")
    return materialise(votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("votes")), "votes")


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null or empty pages have the empty text; null urls share a host of their own; equal rows get equal texts, and of paths
    with equal votes the page's own best wins, then the least hash. Very long and very deep pages take memory in proportion
    to their length. Only the three named columns are read, so others may have any name.

    Votes are sent to all executors if they are few in rows and bytes. Else the paths of each page are
    joined with the votes of its host; Spark splits the partitions of hot hosts, and no host's paths meet in one task.
    """
    src = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.col(source).alias("html"))
    votes = winning_paths(pages, url, source)
    # A path with one vote can't beat a page's own best path.
    won = materialise(votes.where("votes > 1").select("host", "key", "votes"), "paths")
    discard(votes)
    if small(won) is not won:
        listed = won.groupBy("host").agg(F.collect_list(F.struct("key", "votes")).alias("v")).select("host", F.col("v.key").alias("keys"), F.col("v.votes").alias("n"))  # few, as counted
        j = src.join(F.broadcast(listed), "host", "left")

        def pick():
            known: dict = {}

            def run(hosts, sources, keys, counts):
                texts = []
                for h, s, k, n in zip(hosts, sources, keys, counts, strict=True):
                    if h not in known:
                        known[h] = dict(zip(k or (), n or (), strict=True))
                    p = Page(s or "")
                    texts.append(p.text(p.chosen(known[h])))
                return texts, [len(t) for t in texts]

            return run

        return map_rows(j, ["page_id", "url"], ["host", "html", "keys", "n"], fields(text="string", n_chars="long"), pick)

    def paths():
        def run(hosts, ids, sources):
            rows = []
            for h, i, s in zip(hosts, ids, sources, strict=True):
                p = Page(s or "")
                own = p.key[p.best()[0]]
                rows += [(h, i, k, k == own) for k in set(p.key)]
            return list(zip(*rows, strict=True)) if rows else [[], [], [], []]

        return run

    known = src.withColumn("th", F.xxhash64("html"))
    each = flat_map(known, ["host", "th", "html"], fields(host="string", th="long", key="long", own="boolean"), paths)
    each = each.join(won, ["host", "key"], "left").select("host", "th", F.struct(F.coalesce("votes", F.lit(0)).alias("n"), "own", (-F.col("key").cast("decimal(20,0)")).alias("less"), "key").alias("c"))
    chosen = materialise(each.groupBy(F.col("host").alias("h2"), F.col("th").alias("t2")).agg(F.max("c").alias("c")).select("h2", "t2", "c.key"), "chosen")
    j = known.join(chosen, (F.col("host") == F.col("h2")) & (F.col("th") == F.col("t2")), "left")

    def read():
        def run(sources, keys):
            texts = [Page(s or "").text(k) for s, k in zip(sources, keys, strict=True)]
            return texts, [len(t) for t in texts]

        return run

    return map_rows(j, ["page_id", "url"], ["html", "key"], fields(text="string", n_chars="long"), read)
