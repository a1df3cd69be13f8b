"""Operator 3: main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags. Each block is described by its word
count and link density, those of the blocks before and after it, and the kind of its
element (list item, plain, paragraph, heading). A decision tree, grown from the small
labelled TABLE, keeps or drops it. Three hints are features of the same tree: whether the
block lies in an article, in a menu-like element, or in one whose class or id names an
advert, a notice, a comment... The tree also works without them (tree(False)).
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import per_document, table

#: Elements of HTML by their role.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
REGION = frozenset("article main nav header footer aside form div section menu dialog figure ul ol table fieldset head".split())
#: Elements that end without a tag of their own, and those that hold nothing.
LOOSE = frozenset("p li dt dd option tr td th".split())
VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset head button".split())
#: Class or id tokens, whole, of what is no main text; common words before and after them.
HINT = re.compile(
    r"(?i)(?:(?:site|page|top|bottom|left|right|cookie|share|social|related|user|reader|side|comment|ad|google|global|nav|post|article)[-_]?)?"
    r"(?:ads?|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|comments?|replies|disqus|respond|sidebar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|notice|alert|popup|modal|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|widget|masthead)"
    r"(?:[-_]?(?:list|box|bar|banner|section|area|block|container|wrapper|slot|unit|buttons?|links?|posts?|form|thread|notice|item|body|\d+))?"
    r"|(?:(?:site|page|global|top|bottom)[-_]?)?(?:header|footer)"
)
COMMENT = re.compile(r"(?i)(?:reader|user)?[-_]?(?:comments?|replies|disqus|respond)(?:[-_]?(?:list|section|area|thread|body|item|\d+))?")
NAMED = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?=[\s/>]|=\s*["']?(?:hidden)?["']?(?:[\s/>]|$)|$)|display\s*:\s*none|(?:^|\s)aria-hidden\s*=\s*["']?true""")
#: Kinds of elements: list items and controls 0, others 1, paragraphs 2, headings 3.
KIND = {t: 0 for t in "li td th option label button a dd nav menu".split()} | {t: 2 for t in "p pre blockquote figcaption".split()} | {t: 3 for t in "h1 h2 h3 h4 h5 h6 caption dt summary".split()}
RAW = "script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|audio|video"
TOKEN = re.compile(rf"""(?is)<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>.*?(?:</\1\s*+[^>]*+>|\Z)|<(/?)([a-z][a-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""")

#: Labelled pages, one to a line. A block is the region's letter, the kind's letter (i item, t plain, p paragraph, h
#: heading), its words and, if it has links, a slash and the words in links. Regions: a article, c menu, header, footer,
#: sidebar or form, n named like an advert, notice or comment, d menu within the article, m named region within the
#: article, o none of these. Capitals: main text. A line after = is taken as it is, others also with other numbers of words.
TABLE = """
ci1/1 ci1/1 ci2/2 ci1/1 nt6 Ah9 Ap120 Ap60 Ap3 Ap1 Ap200/20 ct18
ci1/1 ci2/2 ci3/3 nt12 Ah9 Ap5 Ap30/8 Ap2 Ap90 Ap14 ct9 ci3/3
ci4/1 nt40 Ah12 Ap80 di7/2 Ap60 mp15 Ap20 Ap6 Ap1 ct60
nt9 Ah6 Ap1 Ap1 Ap2 Ap150 mp80 mp30 mp12 mt3 ct25/5 ot25
ci1/1 ci1/1 nt25 nt3 Ah10 Ap300 Ap40/20 Ap8 mp60 Ah4 Ap25 at12/12 op30/2
ci2/2 nt8 Ah7 Ap18 di1/1 di2/2 di1/1 Ap70 Ap11/5 mp120 ct40
nt5 nt18 Ah12 Ap33 Ap4 mt5 Ap250 Ap1 Ap2 ct8 ct5/5 ot5/5 op60
ct30 nt7 Ah60 Ap70/8 Ap5 dp90/20 Ap17 mt9 mp40 np33 ct100
ci3/3 ci3/3 nt14 Ah8 Ap45 Ap200/110 ai3/3 ai4/4 Ap25 mp22 ct6 np60 np15
ot3 ot40 nt10 Ah13 Ap22 Ap100 Ap2 di12 mt7 Ap55 ot12/10 ct7
Ah8 Ap40 ai5/5 ai4/4 ai6/6 Ap30 Ai9 Ai12 Ai7/1 Ap80 ap6/6 at4/4
Ah5 At60 At35/4 At3 At80 ai2/2 at7/7 At12 Ap9 ot9/9
ci1/1 ci1/1 Ah3/3 Ap50 Ah4/4 Ap70/5 ap9/9 Ap40 ai3/3 ai2/2 ai3/3 ct10
Ah7 Ap12 Ai3 Ai4 Ai2 Ap30 at2/2 at3/3 oi4/4 op25 oh3 op40
ci1/1 ci2/2 ci1/1 oi2/2 Oh9 Op80 Op60/5 Op25/2 oi3/3 ot5 ct9
ci1/1 ci1/1 Oh8 Op14 Op150/30 np30 Op70 ot4/3 oi1/1 ct50
oi1/1 oi2/2 oi1/1 oi4/4 Oh12 Op90 Op40 nt20 Op60 ot8/8 oi5/5 ct12
np60 Op20 Op33 Oh18/1 Op80 nt12 ct4 ot2 ct30
ci2/2 Oh6 Op120 Op11 Op30/3 ot6/6 oi12/12 ot2/2 ct15
Op25 Op60 Op90/9 nt45 cp80 ot4
Op50
Op2 Op50
Op2 Op12 Op1
Oh5 Op2
Ot50
Ot120 Ot40/3 Ot70 oi2/2
oi1/1 oi1/1 ot3 Ot60 Ot25 Ot45/5 ot6/6 ot4
Oh6 Ot40 Ot30 Oi6 Oi9 Oi4 Op20 oi2/2 oi3/3 ot7
ot4/2 ot5/5 Oh4/4 Op33 Oh3 Op45/9 op6/6 ot12/12 ot8
ct12 ci1/1 Ot35 Op15 Ot55 nt30 ct9 ot3/1
oi2/2 oi3/3 ot8 oi1/1 Op70 Op15 op4/4 ot5 ot6
ot9 ot4 Op200 Oh6 Op3 Op7 ot10/9
oi1/1 oi1/1 oi1/1 ot7 Oh9 Op44 Op1 Op2 Op120 ot4 ot12/1
Op20 Op30/25 Op60 Op10/6 ot12/11 op25/24
=At30
=At33 At20
=At20 At10 At8 ai3/3 At15
=Ah6 At12 at4/4 At25 At6
=Ah6 Ap40 ap5/5 Ap30
=Ap40 ap8/8 Ap30 ap6/6 Ap5
=ap6/6 Ap30 ap5/5 Ap12 ap4/4
=ai2/2 Ap6 ai3/3 At14 ai1/1 Ai8 ai2/2
=Ap2 ap3/3 Ap1 at2/2 At2 at5/5 Ap9
=Ot30
=Ot20
=Ot14 Ot20
=Ot33 Ot20
=Ot25 Ot25 Ot16
=Ot15 Ot40 Ot18
=Ot24 Op30 Ot16 Op12
=Oh5 Ot16 Ot30
=Op200 Ot30 Op150
=Op160 Ot24 Op30 Ot45
=Ot200 Ot40 Ot180 Ot22
=Op300 Ot60
=Op250 Op40 Ot16 Op90
=Ot400 Ot900 Ot35
=ct14 ci1/1 ci1/1 nt16 Ah14 Ap40 Ap30 ct15
=ct14 Ot14 Ot20 nt15 Ot15
=ct11 ct12 ct13 ct14 ct15 ct16 ct20 ct30 Ot30 Ot20 ct9 ct14 ct33
=nt11 nt13 nt14 nt15 nt17 nt25 nt60 Op30 Ot22 nt12 nt16
=nt14 At16 At14 mt11 mt14 mt16 mt30 Ap20 ct14
=ot11 ot13 ot15 ot20 ot30 ot60 Ah9 Ap40 ot14 ot35
=ot14 At30 At15 ot16
=oi5 oi9 oi14 oi30 Ah9 Ap40 oi12 oi6
=ci6 ci13 ni14 ni5 Oi9 Oi14 Op30 ci12 ni20
=ci1 ci2 ci3 ci4 Ah5 Ap40 ci1 ni3 ct2
=oi1 oi3 oi4 oi2 Ah9 Ap40 oi3 oi1
=ci1 ci2 ci4 ni3 Op50 Op20 Oi3 Oi2 Oi4 Op30 ci3 ni2 ci1
=cp14 np15 cp30 Op15 Op30 np12 cp9
=Op30 Ot22 Oh4 Ot18
=op5/5 Op30
=op9/9 Op30 op4/4
=Op40 op6/6 Op30
=Op30 op5/5
=op8/8 Op18 Op40 op5/5 Op60
=ot6/6 Ot30 Op40 ot4/4
=oi1/1 oi2/2 ot25 oi1/1 Op80 Op30 oi3/3 ot14 oi2/2
=oi2/2 ot30 oi2/2 ot16 oi1/1 Oh8 Op60 Op45 oi2/2 ot22 oi1/1 ot12 oi4/4
=oi2/2 op12 oi3/3 Oh8 Op60 Op45 oi2/2 op9 oi1/1
=ot2/2 ot20 ot3/3 Op50 Op20 ot5/5 ot28 ot4/4 ot15 ot2/2
=ot3/3 op10 ot4/4 op6 ot2/2 Op70 Op33 ot4/4 op14 ot6/6
=oi1/1 ot18 oi5/5 ot35 oi3/3 Ot40 Op30 Ot25
"""


#: Each page of TABLE also counts with its words multiplied so, and each main text block as a page of its own.
SCALES = (1.0, 0.3, 4.0, 40.0)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of TABLE and of its variants."""
    pages = []
    for line in TABLE.strip().splitlines():
        page = []
        for one in line.removeprefix("=").split():
            words, _, links = one[2:].partition("/")
            page.append((one[0].lower(), "itph".index(one[1]), int(words), int(links or 0), one[0].isupper()))
        if line[0] == "=":
            pages.append(page)
            continue
        # a short plain text may be a label and a long one is no label, so plain main text is not made shorter, nor other plain text longer
        pages += [[(r, kind, max(1, round(w * (1 if k or kind == 1 and (s < 1 or not main) else s))), k, main) for r, kind, w, k, main in page] for s in SCALES]
        pages += [[b] for b in pages[-len(SCALES)] + pages[1 - len(SCALES)] if b[4] and b[1] >= 2]
    x, y = [], []
    for page in pages:
        x += features([(w, k, kind, int(r in "adm"), int(r in "cd"), int(r in "nm")) for r, kind, w, k, _ in page])
        y += [p[4] for p in page]
    return np.array(x, dtype=float), np.array(y, dtype=int)


def features(found: list[tuple[int, int, int, int, int, int]]) -> list[tuple[float, ...]]:
    """From (words, words in links, kind, in article, chrome, named) of a page's blocks, for each: words and link density in per
    cent of the block, of the one before and of the one after, its kind; then the hints: article (2 within one, 1 beside one, 0
    none on the page), chrome, named."""
    has_article = int(any(b[3] for b in found))
    counts = [(0, 0.0), *((b[0], 100 * b[1] / b[0]) for b in found), (0, 0.0)]
    return [(*counts[i], *counts[i - 1], *counts[i + 1], b[2], 2 if b[3] else has_article, b[4], b[5]) for i, b in enumerate(found, 1)]


#: Features that are not hints.
PLAIN_FEATURES = 7


def grow(x: np.ndarray, y: np.ndarray, least: int = 2, depth: int = 12) -> tuple | int:
    """A binary decision tree by the Gini impurity: (feature, threshold, below or equal, above), or a label."""
    if depth == 0 or len(set(y)) < 2:
        return int(2 * y.sum() >= len(y))
    best = None
    for j in range(x.shape[1]):
        cuts = np.unique(x[:, j])
        for t in (cuts[:-1] + cuts[1:]) / 2:
            low = x[:, j] <= t
            if min(low.sum(), (~low).sum()) < least:
                continue
            cost = sum(p.sum() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, j, float(t), low)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, j, t, low = best
    return (j, t, grow(x[low], y[low], least, depth - 1), grow(x[~low], y[~low], least, depth - 1))


@lru_cache(maxsize=2)
def tree(hints: bool = True) -> tuple | int:
    """The tree over all features, or over word counts, link densities and kinds alone."""
    x, y = labelled()
    return grow(x if hints else x[:, :PLAIN_FEATURES], y)


def decide(node: tuple | int, x: tuple[float, ...]) -> int:
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def blocks(page: str) -> list[tuple[str, tuple[int, int, int, int, int, int]]]:
    """(text, (words, words in links, kind, in article, in chrome, in a named region)) of each block in page order.

    A form that holds most of a page's paragraphs is no chrome, and what stands around the
    page's only article, or in its own class, does not count for what is within it, unless it
    is a comment. Hidden inline elements, and those named like an advert, are left out.
    """
    out, parts, linked = [], [], []
    region: list[tuple] = []  # tag, and the state within it: article, chrome, named, whether the article is in chrome or a named region, number of the form, comment
    state, link, at, kind, forms = (0, 0, 0, 0, 0, 0), 0, 0, 1, 0
    muted: list[str] = []  # open inline elements that are hidden or named like an advert, and those of their kind within them

    def flush() -> None:
        nonlocal parts, linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(len(words), sum(len(x.split()) for x in linked)), kind, *state[:5]))
        parts, linked = [], []

    def say(text: str) -> None:
        if text and not muted:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked.append(text)

    def leave(tag: str) -> None:
        nonlocal state, link
        while region.pop()[0] != tag:
            pass
        state, link = region[-1][1:] if region else (0, 0, 0, 0, 0, 0), 0

    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        closing, tag, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        tokens = " ".join("".join(x) for x in NAMED.findall(rest)).split() if rest and not closing else []
        hint = any(map(HINT.fullmatch, tokens)) or (bool(rest) and not closing and bool(HIDDEN.search(rest)))
        if tag == "a":
            link = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            muted.clear()
            kind = 1 if closing else KIND.get(tag, 1)
            if closing:
                if any(r[0] == tag for r in region):
                    leave(tag)
                continue
            if region and region[-1][0] in LOOSE and (region[-1][0] == tag or region[-1][0] == "p"):
                leave(region[-1][0])
            if tag not in REGION and not hint and not any(r[0] == tag for r in region):
                continue
            article, chrome, named, outer, form, comment = state
            comment = int(comment or any(map(COMMENT.fullmatch, tokens)))
            if tag in ("article", "main") and not comment:
                outer, article, chrome, named = int(outer or chrome or named or hint), 1, 0, 0
            else:
                named = int(named or hint or comment)
            if tag == "form":
                forms += 1
                form = form or forms
            chrome = int(chrome or (tag in CHROME and tag != "form" and not (tag == "header" and article)))
            region.append((tag, article, chrome, named, outer, form, comment))
            state = region[-1][1:]
        elif closing:
            if muted and muted[-1] == tag:
                muted.pop()
        elif muted and muted[-1] == tag or hint and tag not in VOID and not rest.endswith("/"):
            muted.append(tag)
    say(page[at:])
    flush()
    free = any(b[4] and not b[7] for b in out)
    prose = [0] * (forms + 1)
    for _, words, links, kind_, _, chrome, named, _, form in out:
        prose[form] += words if kind_ >= 2 and 2 * links < words and not chrome and not named else 0
    whole = {f for f in range(1, forms + 1) if 2 * prose[f] > sum(prose)}
    return [(text, (words, links, kind_, article, int(chrome or (form > 0 and form not in whole)), int(named or (outer and free)))) for text, words, links, kind_, article, chrome, named, outer, form in out]


def main_text(page: str, hints: bool = True) -> str:
    """Kept blocks of a page in order, joined by one space."""
    found, node = blocks(page), tree(hints)
    return " ".join(b[0] for b, x in zip(found, features([b[1] for b in found])) if decide(node, x))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of pages: page_id, the columns named in keep, text, n_chars (code points).

    Null or empty html gives an empty text, as do pages without a kept block. Broken
    markup is read as far as it goes; pages of any length are read whole. Repeated rows
    and null ids are handled like others. An empty table gives an empty result; columns
    that are not named are not read.
    """
    names = ["page_id", *keep]
    keyed = pages.select(F.struct(F.col(id_col).cast("long").alias("page_id"), *keep).alias("key"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema["key"].dataType)

    def rows(keys, texts):
        found = [main_text(t) for t in texts]
        return {n: [k[n] for k in keys] for n in names} | {"text": found, "n_chars": [len(t) for t in found]}

    return per_document(keyed, rows, f"{fields}, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), keep=("url",))
