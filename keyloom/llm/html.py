"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  What stands in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments is boilerplate by its place, and so is what
stands outside the article, if the page marks one.  Pass one decides each other block by itself:

* mostly links: bad; inside a marked article open, as it may be a list of sources;
* short: open;
* stop-word density high: good if the block is long, else open;
* stop-word density low: bad, where other blocks of the page show that its language is known; else open.
  Inside a marked article a long block of few links is never bad for its words alone, but open.

Pass two gives an open block the label of its nearest decided neighbours before and after it.  Where they
differ, a heading goes with the text after it, another short block with the nearer one, a longer one with the good one.

Pages are read by a scanner that goes over each character a bounded number of times.

Defined cases: a null or empty page has the empty text; unclosed and misnested tags are taken as browsers
do in the main cases; an unclosed comment, script or style hides what follows it; a quote that is never closed
is a character like others; a very long page is read whole; a page of which no block is good, by words nobody
lists or by short blocks only, is its own article, but for links; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import small_batches

LENGTH_LOW, LENGTH_HIGH = 70, 140
#: Shares of words that are stop words; the lists below are short, so running text has about a fifth and more.
STOP_LOW, STOP_HIGH = 0.08, 0.16
LINKS_MOST = 0.2
#: A block with at least this share of its characters in links is a link and nothing else.
LINKS_ONLY = 0.8
#: A run of at least so many blocks that are nothing but links is a menu, even in an article.
MENU_RUN = 3

# Frequent function words of four languages.
STOP_WORDS = frozenset("""
a about after all an and are as at be been but by can could did do for from had has have he her his i if in into is it its
more my no not of on one or our out she so some than that the their them then there they this to up was we were what when
which who will with would you your
aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer es für hat
ich ihr im in ist ja kann man mit nach nicht noch nur ob oder sein sich sie sind so über um und uns von vor war was wenn wie
wir wird zu zum zur
au aux avec ce ces comme dans de des du elle en est et eux il ils je la le les leur lui mais même mes moi mon ne nos nous on
ou où par pas pour qu que qui sa se ses son sont sur ta te tu un une vos votre vous été être
al como con de del desde donde dos el ella ellos en entre era es esta este esto fue ha hay la las le les lo los me mi muy más
no nos o para pero por porque que quien se si sin sobre son su sus también te tiene un una uno y ya
""".split())

# Element names of HTML.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody
td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button dialog footer form head header menu nav select option label input".split())
LANDMARKS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words in class, id and role that name what is not the article.
BOILER = frozenset("""ad ads advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs comment comments commentlist
consent contentinfo cookie cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter
notice notices notification pager pagination popup promo promoted promotion related recommended recommendations replies reply respond
search share sharing sidebar signup social sponsor sponsored subscribe subscription syndication toolbar topbar widget widgets complementary
alert outbrain taboola""".split())
NOT_MEANT = frozenset("has no with without".split())
KEEPERS = frozenset("html body main article".split())

# Elements whose content is not markup of the page.
RAW = frozenset("script style noscript template textarea title svg iframe object math head".split())
_name = re.compile(r"[a-zA-Z][^\s/>]*")
_stop = re.compile("[>\"']")
_body = re.compile(r"<body\b", re.I)
_attribute = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_names = re.compile(r"[^\s_-]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_word = re.compile(r"\w+")


def unwanted(name: str, attributes: str) -> bool:
    """Whether an element, by name or attributes, holds something other than the article."""
    if name in DROPPED:
        return True
    if not attributes or name in KEEPERS:
        return False
    for m in _attribute.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and _hidden.search(value):
            return True
        if kind in ("class", "id", "role"):
            for one in value.split():
                words = [w.lower() for w in _names.findall(_camel.sub("-", one))]
                if any(w in BOILER for w in words) and not NOT_MEANT & set(words):
                    return True
    return False


class Scanner:
    """Markup in order: ("text", text), ("open", name, attributes) and ("close", name)."""

    def __init__(self, page: str):
        self.page = page
        bodies = [m.start() for m in _body.finditer(page)]
        self.last_body = bodies[-1] if bodies else -1
        self.absent: set[str] = set()  # closing tags and quotes that don't occur any more from here on
        self.plain = False  # whether quotes no longer hide the end of a tag

    def find(self, what: str, at: int) -> int:
        """Where ``what`` is next; a search that failed once is not made again."""
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag that is open at ``at`` has its ``>``; -1 if nowhere."""
        here = at
        while not self.plain:
            m = _stop.search(self.page, here)
            if m is None:
                self.plain = True
            elif m[0] == ">":
                return m.start()
            else:
                closed = self.find(m[0], m.end())
                here = closed + 1 if closed >= 0 else m.end()
        return self.find(">", at)

    def after_raw(self, name: str, at: int) -> int:
        """Where the page goes on after the content of a raw element that begins at ``at``."""
        if name not in self.absent:
            m = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(self.page, at)
            if m:
                return m.end()
            self.absent.add(name)
        return at if self.last_body >= at else len(self.page)

    def __iter__(self):
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            begin = page.find("<", at)
            if begin < 0:
                yield "text", page[at:]
                return
            if begin > at:
                yield "text", page[at:begin]
            if page.startswith("<!--", begin):
                end = self.find("-->", begin + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), begin):
                end = self.find(">", begin)
                if end >= 0:
                    at = end + 1
                    continue
            closing = page.startswith("/", begin + 1)
            m = _name.match(page, begin + 1 + closing)
            end = self.tag_end(m.end()) if m else -1
            if end < 0:
                yield "text", "<"
                at = begin + 1
                continue
            at, name = end + 1, m[0].lower()
            if closing:
                yield "close", name
                continue
            if name in RAW:
                at = self.after_raw(name, at)
            else:
                yield "open", name, page[m.end() : end]


def blocks(page: str) -> list[tuple[str, int, str, str]]:
    """(text, characters in links, place, tag) of each block that has text; place: drop, article or open."""
    out: list[tuple[str, int, str, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, unwanted, landmark: here or further out
    depth: Counter = Counter()  # how often a name is on the stack
    text: list[str] = []
    links = link = 0
    tag = ""

    def end():
        nonlocal links
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                place = "open"
                if stack:
                    _, bad, good = stack[-1]
                    place = "drop" if bad else "article" if good else "open"
                out.append((whole, links, place, tag))
            text.clear()
        links = 0

    for kind, *what in Scanner(page):
        name = what[0]
        if kind == "text":
            text.append(name)
            if link:
                links += len(name)
        elif kind == "close":
            if name == "a":
                link = 0
            if name in BLOCKS:
                end()
            if depth[name]:
                if name not in BLOCKS:
                    end()
                shut = ""
                while shut != name:
                    shut = stack.pop()[0]
                    depth[shut] -= 1
            if name in HEADINGS:
                tag = ""
        elif name == "br":
            text.append(" ")
        elif name in VOID:
            if name == "hr":
                end()
        else:
            attributes = what[1]
            if name == "a":
                link = 1
            if name in BLOCKS:
                end()
                link = 0 if name != "a" else link
                tag = name
                if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                    depth[stack.pop()[0]] -= 1
                if name in ("li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
                    depth[stack.pop()[0]] -= 1
            bad = unwanted(name, attributes)
            if name == "header" and stack and stack[-1][2] and not stack[-1][1]:
                bad = False  # the head of the article itself
            if name in BLOCKS and name not in HEADINGS or bad:
                if name not in BLOCKS:
                    end()
                if not attributes.endswith("/") or name in BLOCKS:
                    above = stack[-1] if stack else ("", False, False)
                    stack.append((name, above[1] or bad, above[2] or name in LANDMARKS or 'role="main"' in attributes))
                    depth[name] += 1
    end()
    return out


def stop_density(text: str) -> float:
    words = _word.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(found: list[tuple[str, int, str, str]], landmarks: bool) -> list[str]:
    """good, bad or, for open ones, links, near or short, of each block."""
    out, sparse = [], []
    for i, (text, links, place, _) in enumerate(found):
        inside = place == "article"
        if place == "drop" or landmarks and not inside:
            out.append("bad")
        elif links > LINKS_MOST * len(text):
            out.append("links" if inside else "bad")
        elif len(text) < LENGTH_LOW:
            out.append("bad" if not inside and (links or "\u00a9" in text) else "short")
        else:
            stop = stop_density(text)
            out.append("good" if stop >= STOP_HIGH and len(text) >= LENGTH_HIGH else "near")
            if stop < STOP_LOW and not inside:
                sparse.append(i)
    if "good" in out:  # the page's language is one of those listed
        for i in sparse:
            out[i] = "bad"
    return out


def nearest(first: list[str], found: list[tuple[str, int, str, str]], landmarks: bool) -> list[tuple[int, str]]:
    """(distance, label) of the nearest decided block before each; (0, "") where there is none.  What is boilerplate by
    its place is not asked, as it says nothing of the text around it."""
    out, at, near = [], 0, ""
    for i, (label, block) in enumerate(zip(first, found)):
        out.append((i - at if near else 0, near))
        if label in ("good", "bad") and block[2] == ("article" if landmarks else "open"):
            at, near = i, label
    return out


def runs_of_links(found: list[tuple[str, int, str, str]], first: list[str]) -> set[int]:
    """Blocks of runs of at least MENU_RUN that are links and nothing else."""
    out: set[int] = set()
    run: list[int] = []
    for i, (text, links, _, _) in enumerate(found):
        run = [*run, i] if first[i] == "links" and links > LINKS_ONLY * len(text) else []
        if len(run) == MENU_RUN:
            out.update(run)
        elif len(run) > MENU_RUN:
            out.add(i)
            run = run[-MENU_RUN - 1 :]
    return out


def labels(found: list[tuple[str, int, str, str]]) -> list[bool]:
    """Whether each block belongs to the main text."""
    landmarks = any(b[2] == "article" for b in found)
    first = first_pass(found, landmarks)
    before, after = nearest(first, found, landmarks), nearest(first[::-1], found[::-1], landmarks)[::-1]
    menus = runs_of_links(found, first)
    alone = "good" not in first  # nothing is sure: what is not bad is the article
    out = []
    for i, label in enumerate(first):
        (gap, one), (far, two) = before[i], after[i]
        if label in ("good", "bad"):
            out.append(label == "good")
        elif i in menus:
            out.append(one == two == "good")  # between parts of the text
        elif alone:
            out.append(True)
        elif not one or not two or one == two:
            out.append("good" in (one, two))
        elif landmarks or label == "near":
            out.append(True)
        elif found[i][3] in HEADINGS:
            out.append(two == "good")
        else:
            out.append((one if gap <= far else two) == "good")
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b[0] for b, keep in zip(found, labels(found)) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages(page_id, url, html)``."""
    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
