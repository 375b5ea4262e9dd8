"""HTML extraction by a site style tree: what a host repeats is told from what its pages say.

A page is parsed into block elements and text blocks. The style tree of a host merges elements by their path of signatures (tag,
classes, id with digits masked), pages by pages: an element counts the pages that hold it and the sequences of children that it
shows (its presentation), and, under it, the pages that hold each text block (its content). Two importances
follow, both from entropy over the M pages of an element:

* presentation: -sum(p * log_M(p)) over its sequences of children: 0 where all pages lay it out alike;
* content: 1 - log_M(c) for a text block that c of the M pages hold under this element: 0 where all do.

Pages whose longest text block is equal count once, so copies of an article on one host are no repetition of its site.
The composite importance of an element of PAGES pages or more with l sequences is (1 - DAMPING^l) * presentation + DAMPING^l * the mean over its children, as
pages show them, of theirs; of text it is the mean content importance. An element is noise if its own and those of all elements below it are at most LEAST,
and its text goes. What fewer pages hold, and what lies in a declared article, counts as 1. Beside that, a text block goes if its content importance is at most
LEAST and more than half of the pages of its element, PAGES or more, hold it: a notice without a mark goes from an element that has other texts too, while a
passage of some articles stays. An element that lists links only goes too.

Entropy cannot see a menu whose words differ on every page, or a host of one page. What an element declares itself to be is therefore
its importance beforehand: an element is 0, with all that is below it, if its tag, role, class or id names a menu, header, footer,
sidebar, notice, advert, form or reader comments (fixed lists below), or if it is hidden, unless it holds the article itself.
Where a page has an `article` (else a `main`, or an element that is named as the content) with at least a tenth of the remaining text, only
what lies in it is kept, and a title in `main` before an article without one.

Plans: the tree is sums by key; a table of the repeated blocks is joined to the blocks' keys, and what goes of a page returns to it as a
list of numbers of its blocks. Html itself is moved only if the pages concerned are too many to be broadcast.

Defined cases: a null or empty html gives an empty text; a page whose URL is null or has no host belongs to no site and is judged by
itself; repeated rows are each returned and count once; tags that are cut off, not closed or wrongly nested are read as
browsers do in the main (a block ends where another begins, nesting stops at DEEPEST), an unclosed comment or script takes the rest. Empty tables
give no rows; other columns are ignored. Elements and blocks are named by 64-bit hashes of their host's own paths and texts, two of which
must agree, pages by two hashes of 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import broadcast_if, cut
from siltbed.llm.url_filter import url_host

PAGES, LEAST, DAMPING = 5, 0.35, 0.9
DEEPEST = 512  # elements around a place; deeper ones belong to the last of these, as in browsers
MARKS_TO_BROADCAST = 500_000

# What HTML says about elements, and names by which pages mark what is not their article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NOISE_TAGS = frozenset("nav aside footer form dialog menu search template button select datalist svg object audio video canvas map applet".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist status".split())
NOISE_NAMES = frozenset("""
ad ads advert adverts advertisement advertising adsense adsbygoogle adbox adslot banner sponsor sponsored sponsors promo promotion promotions
nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager toc sidebar aside rail footer foot masthead topbar toolbar header
cookie cookies consent gdpr notice notices notification disclaimer alert popup modal overlay lightbox paywall
newsletter subscribe subscription signup signin login register form searchform search
comment comments commentlist disqus respond replies reply
share sharing social socials related recommended recommendations widget widgets copyright legal skip hidden
""".split())
NOT_NAMES = frozenset("no not non without with has is".split())
CORE_NAMES = frozenset("article articlebody article-body article-content content main maincontent main-content page-content post post-body post-content entry entry-content story story-body".split())
CLOSES = {  # an opening tag ends these, up to the element named last
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
TAG = r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)"""
ATTRIBUTE = r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?"""


class Page:
    """Elements and text blocks of one page. Elements: tag, parent, signature, noise, children; blocks: element, text, characters in links."""

    def __init__(self, html: str, tools):
        tag_of, attribute_of, unescape, raw_end = tools
        self.tags, self.parents, self.signs, self.noise, self.core, self.muted = ["#page"], [-1], ["#page"], [False], [False], [False]
        self.children: list[list[str]] = [[]]
        self.owners, self.texts, self.linked = [], [], []
        stack, said, links, depth, mute = [0], [], 0, 0, 0  # depth, mute: links, and inline elements that are left out, around this place
        here, at, end = 0, 0, len(html)

        def flush():
            nonlocal links
            text = " ".join("".join(said).split())
            if text:
                self.owners.append(here)
                self.texts.append(text)
                self.linked.append(links)
                self.children[here].append("#text")
            said.clear()
            links = 0

        def pop(k):
            nonlocal here, depth, mute
            for e in stack[k:]:
                depth -= self.tags[e] == "a"
                mute -= self.muted[e]
            del stack[k:]
            here = next(e for e in reversed(stack) if self.signs[e])

        def close(k):
            flush()
            pop(k)

        def push(tag, sign, noise, inline=False):
            """A link, or an inline element that is left out, has no signature: the text around it is one block."""
            nonlocal here, depth, mute
            if not inline:
                flush()
            if len(stack) > DEEPEST:
                return
            if not inline:
                self.children[here].append(sign)
            for column, value in ((self.tags, tag), (self.parents, here), (self.signs, sign), (self.noise, noise), (self.core, False), (self.muted, inline and noise), (self.children, [])):
                column.append(value)
            stack.append(len(self.tags) - 1)
            if inline:
                depth += tag == "a"
                mute += noise
            else:
                here = stack[-1]

        def say(text):
            nonlocal links
            if text and not mute:
                text = unescape(text) if "&" in text else text
                said.append(text)
                if depth:
                    links += len("".join(text.split()))

        while at < end:
            m = tag_of.search(html, at)
            if not m:
                say(html[at:])
                break
            say(html[at : m.start()])
            at = m.end()
            slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            if slash:
                if tag == "br":
                    said.append(" ")
                elif tag == "p" and not any(self.tags[e] == "p" for e in stack):
                    flush()
                elif tag not in ("html", "body"):
                    k = next((k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] == tag), 0)
                    if k and tag not in BLOCKS and any(self.tags[e] in BLOCKS for e in stack[k + 1 :]):
                        k = 0  # a link or span does not end a block
                    if k and tag in BLOCKS:
                        close(k)
                    elif k:
                        pop(k)
                    elif tag in BLOCKS:
                        flush()
                continue
            if tag in RAW or tag == "plaintext":
                found = raw_end[tag].search(html, at) if tag in raw_end else None
                at = found.end() if found else end
                continue
            if tag in BLOCKS:
                if tag != "hr" and tag not in ("html", "body"):
                    k = next((k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] in BLOCKS), 0)
                    if k and self.tags[stack[k]] == "p":
                        close(k)
                    elif tag[0] == "h" and len(tag) == 2 and k and self.tags[stack[k]][0] == "h" and len(self.tags[stack[k]]) == 2:
                        close(k)
                if tag in CLOSES:
                    ends, upto = CLOSES[tag]
                    last = 0
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] in upto:
                            break
                        if self.tags[stack[k]] in ends:
                            last = k
                    if last:
                        close(last)
                if tag == "hr":
                    flush()
                    continue
                if tag in ("html", "body") and any(self.tags[e] == tag for e in stack):
                    continue
                sign, noise = self.about(tag, rest, attribute_of, stack)
                push(tag, sign, noise)
                if not noise and (tag in ("article", "main") or sign.endswith("@main")):
                    for e in stack:
                        self.core[e] = True
            elif tag == "br":
                said.append(" ")
            elif tag not in VOID and not rest.endswith("/"):
                noise = tag in NOISE_TAGS or "-" in tag and (tag.endswith("-header") or declared(tag, False)) or "=" in rest and self.about(tag, rest, attribute_of, stack)[1]
                if tag == "a":
                    k = next((k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] == "a" or self.tags[stack[k]] in BLOCKS), 0)
                    if k and self.tags[stack[k]] == "a":
                        pop(k)
                if noise or tag == "a":
                    push(tag, "", noise, inline=True)
        flush()

    def about(self, tag, rest, attribute_of, stack):
        """(signature, whether the element declares itself to be none of the article)."""
        inside = any(self.tags[e] in ("article", "main") for e in stack)
        noise = tag in NOISE_TAGS or tag == "header" and not inside or tag == "article" and any(self.tags[e] == "article" for e in stack)
        if not rest or rest.isspace():
            return tag, noise
        found = {}
        for m in attribute_of.finditer(rest):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        role = found.get("role", "").lower()
        noise = noise or role in NOISE_ROLES and tag != "body" or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        style = "".join(found.get("style", "").lower().split())
        noise = noise or "display:none" in style or "visibility:hidden" in style
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        if not noise and tag not in ("html", "body", "article", "main"):
            noise = any(declared(n, inside) for n in names)
        noise = noise or tag == "article" and any(n.lower() in NOISE_NAMES for n in names)
        kind = "".join("0" if c.isdigit() else c for c in " ".join(sorted(names)))
        core = role == "main" or found.get("itemprop") == "articleBody" or tag in ("div", "section") and any(n.lower() in CORE_NAMES for n in names)
        return f"{tag}.{kind}" + "@main" * core, noise and tag not in ("html", "body")

    def kept(self) -> list[int]:
        """Numbers of the text blocks that no element around them has ruled out, in the article if there is one."""
        out, scope = [False] * len(self.tags), [0] * len(self.tags)
        for e in range(1, len(self.tags)):
            p, tag = self.parents[e], self.tags[e]
            out[e] = out[p] or self.noise[e] and not self.core[e]
            scope[e] = max(scope[p], 2 if tag == "article" else 1 if tag == "main" or self.signs[e].endswith("@main") else 0)
        links: dict[int, list[bool]] = {}
        for owner, text, linked in zip(self.owners, self.texts, self.linked):
            e = owner
            while e > 0 and self.tags[e] not in ("ul", "ol"):
                e = self.parents[e]
            if e > 0:
                links.setdefault(e, []).append(10 * linked >= 9 * len(text.replace(" ", "")))
        menus = {e for e, each in links.items() if len(each) > 1 and all(each) and not scope[e]}
        for e in range(1, len(self.tags)):
            out[e] = out[e] or out[self.parents[e]] or e in menus
        self.scope = scope
        mine = [k for k, owner in enumerate(self.owners) if not out[owner]]
        size = [0, 0, 0]
        for k in mine:
            for level in range(scope[self.owners[k]] + 1):
                size[level] += len(self.texts[k])
        level = next((level for level in (2, 1) if size[level] and 10 * size[level] >= size[0]), 0)
        titled = any(scope[self.owners[k]] == 2 and self.tags[self.owners[k]] == "h1" for k in mine)
        return [k for k in mine if scope[self.owners[k]] >= level or scope[self.owners[k]] == 1 and not titled and self.tags[self.owners[k]] == "h1"]


def declared(name: str, inside: bool) -> bool:
    """Whether a class or id names something other than the article, by its first or last part: site-footer, ad-slot, commentList."""
    if name.isupper() or name.islower():
        parts = name.lower().replace("_", "-").split("-")
    else:
        parts = "".join(f"-{c.lower()}" if c.isupper() else c for c in name).replace("_", "-").split("-")
    parts = [p.rstrip("0123456789") for p in parts if p.rstrip("0123456789")]
    if not parts or parts[0] in NOT_NAMES:
        return False
    if parts[-1] == "header" or parts[0] == "header":
        return not inside and parts in (["header"], ["site", "header"], ["main", "header"], ["top", "header"], ["global", "header"])
    return parts[0] in NOISE_NAMES and parts[0] not in ("legal", "search", "form") or parts[-1] in NOISE_NAMES


def tools():
    import html
    import re

    ends = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
    return re.compile(TAG, re.S), re.compile(ATTRIBUTE, re.S), html.unescape, ends


def _hash(*parts: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _keyed(pages: DataFrame) -> DataFrame:
    """pages with their host and two hashes, by which rows equal in host and html are known."""
    host = F.coalesce(url_host(F.col("url")), F.lit(""))
    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host)
    return d.withColumn("p1", F.xxhash64("host", "html")).withColumn("p2", F.xxhash64(F.lit(1), "host", "html"))


def style_rows(keyed: DataFrame) -> DataFrame:
    """Of every page that has a host, (kind, node, what, rep, p1, p2, block, above, share, told).

    kind 0: an element (node) and its sequence of children (what), with its parent (above), its share of the parent's sequence, and the share of text of its own (told), -1 in
    a declared article; kind 1: a text block (what, and its number) below an element, and the one that holds it (above). rep stands for all pages with
    the same longest block.
    """

    def parse(batches):
        from collections import Counter

        import pyarrow as pa

        own = tools()
        names, types = ["kind", "node", "what", "rep", "p1", "p2", "block", "above", "share", "told"], [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            for host, html, p1, p2 in zip(*(batch.column(c).to_pylist() for c in range(4))):
                page = Page(html or "", own)
                kept = page.kept()
                if not kept:
                    continue
                rep = _hash(max((page.texts[k] for k in kept), key=len))
                ids, there = [_hash(host)], {0}
                for e in range(1, len(page.tags)):
                    ids.append(_hash(str(ids[page.parents[e]]), page.signs[e]))
                for k in kept:
                    e = page.owners[k]
                    block = page.signs[e] if page.children[e] == ["#text"] else ""  # the only text of its element is merged below the element's parent
                    under = page.parents[e] if block and e else e
                    out.append((1, ids[under], _hash(block, page.texts[k]), rep, p1, p2, k, ids[e], None, None))
                    while e >= 0 and e not in there:
                        there.add(e)
                        e = page.parents[e]
                inner = {e: [c for i, c in enumerate(page.children[e]) if not i or c != page.children[e][i - 1]] for e in there}
                times = {e: Counter(some) for e, some in inner.items()}
                for e, some in inner.items():
                    up = page.parents[e]
                    share = times[up][page.signs[e]] / len(inner[up]) if e else None
                    told = -1.0 if page.scope[e] else times[e]["#text"] / len(some)
                    out.append((0, ids[e], _hash(*some), rep, p1, p2, -1, ids[up] if e else None, share, told))
            for i in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 100_000]), types)], names)

    sited = keyed.where("host <> '' and html <> ''").select("host", "html", "p1", "p2")
    return sited.mapInArrow(parse, "kind int, node long, what long, rep long, p1 long, p2 long, block int, above long, share double, told double")


def style_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, pages, styles, presentation) of the merged elements, and (node, what, held, pages, content) of the blocks below them, by entropy.

    Blocks that fewer than half of PAGES pages hold are not listed: their importance is above LEAST.
    """
    seen = rows.groupBy("kind", "node", "what", "rep").agg(F.lit(1).alias("one"))
    pages = seen.where("kind = 0").groupBy("node", "rep").agg(F.count(F.lit(1)).alias("shown")).groupBy("node").agg(F.count(F.lit(1)).alias("pages"), F.sum("shown").alias("shown"))
    style = seen.where("kind = 0").groupBy("node", "what").agg(F.count(F.lit(1)).alias("n"))
    spread = style.groupBy("node").agg(F.count(F.lit(1)).alias("styles"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    presentation = F.when(F.col("pages") > 1, (F.log("shown") - F.col("nlogn") / F.col("shown")) / F.log("pages")).otherwise(F.lit(1.0))
    elements = pages.join(spread, "node").select("node", "pages", "styles", presentation.alias("presentation"))
    held = seen.where("kind = 1").groupBy("node", "what").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") * 2 > PAGES)
    content = F.lit(1.0) - F.log("held") / F.log("pages")
    blocks = held.join(pages.where(F.col("pages") >= PAGES).select("node", "pages"), "node").select("node", "what", "held", "pages", content.alias("content"))
    return elements, blocks


def composite_importance(rows: DataFrame, elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, pages, composite, most) of the elements of PAGES pages or more: composite importance, and the largest of the element's and of those below it.

    Composite importance is linear in that of the children, so sums over all below an element are found by doubling: in each round an
    element passes what it has gathered to the ancestor it points at, and then points twice as far. Rounds: the logarithm of the depth.
    """
    shown = rows.where("kind = 0").groupBy("node", "rep").agg(F.first("above").alias("above"), F.max("share").alias("share"), F.max("told").alias("told"), F.min("told").alias("core"))
    once = shown.groupBy("node").agg(F.first("above").alias("above"), F.sum("share").alias("share"), F.avg("told").alias("told"), (F.min("core") < 0).alias("core"))
    each = rows.where("kind = 1").groupBy("above", "node", "what", "rep").agg(F.lit(1).alias("one")).join(blocks.select("node", "what", "content"), ["node", "what"], "left")
    texts = each.groupBy(F.col("above").alias("node")).agg(F.avg(F.coalesce("content", F.lit(1.0))).alias("content"))
    damped = F.pow(F.lit(DAMPING), F.col("styles"))
    fixed = F.col("core") | (F.col("pages") < PAGES)
    own = F.when(fixed, 1.0).otherwise((1 - damped) * F.col("presentation") + damped * F.col("told") * F.coalesce("content", F.lit(1.0)))
    known = once.join(elements, "node").join(texts, "node", "left").select("node", "above", "share", "pages", own.alias("x"), fixed.alias("fixed"), damped.alias("damped"))
    over = known.select(F.col("node").alias("above"), F.col("pages").alias("over_pages"), F.col("fixed").alias("over_fixed"), F.col("damped").alias("over_damped"))
    passes = F.when(~F.col("over_fixed"), F.col("over_damped") * F.col("share") / F.col("over_pages"))
    links = cut(known.join(over, "above", "left").select("node", "pages", "x", F.when(passes.isNotNull(), F.col("above")).alias("above"), passes.alias("part")), "links")

    def gathered(state: DataFrame, gather, put, name: str) -> DataFrame:
        """x of all elements, with what those below them have, by doubling."""
        while not state.where("above is not null").isEmpty():
            more = state.where("above is not null").groupBy(F.col("above").alias("node")).agg(gather.alias("more"))
            far = state.select(F.col("node").alias("above"), F.col("above").alias("further"), F.col("part").alias("far_part"))
            met = state.join(more, "node", "left").join(far, "above", "left")
            state = cut(met.select("node", "pages", put.alias("x"), F.col("further").alias("above"), (F.col("part") * F.col("far_part")).alias("part")), name)
        return state

    summed = gathered(links, F.sum(F.col("part") * F.col("x")), F.col("x") + F.coalesce("more", F.lit(0.0)), "sums")
    worth = summed.select("node", F.col("x").alias("composite"))
    most = gathered(links.drop("x").join(worth.withColumnRenamed("composite", "x"), "node"), F.max("x"), F.greatest("x", "more"), "most")
    return most.where(F.col("pages") >= PAGES).select("node", "pages", F.col("x").alias("most")).join(worth, "node").select("node", "pages", "composite", "most")


def repeated_blocks(rows: DataFrame) -> DataFrame:
    """(p1, p2, gone): the numbers of those text blocks of a page that lie in noisy elements, or that its site repeats. rows: read several times."""
    elements, blocks = style_tree(rows)
    elements, blocks = cut(elements, "elements"), cut(blocks, "contents")
    noise = blocks.where(F.col("content") <= LEAST).where("2 * held > pages").select("node", "what")
    noise = broadcast_if(cut(noise, "noise"), MARKS_TO_BROADCAST)
    below = composite_importance(rows, elements, blocks).where(F.col("most") <= LEAST).select(F.col("node").alias("above"))
    below = broadcast_if(cut(below, "noisy"), MARKS_TO_BROADCAST)
    said = rows.where("kind = 1").select("p1", "p2", "block", "node", "what", "above")
    marked = said.join(noise, ["node", "what"], "left_semi").select("p1", "p2", "block").union(said.join(below, "above", "left_semi").select("p1", "p2", "block"))
    return marked.groupBy("p1", "p2").agg(F.collect_set("block").alias("gone"))  # blocks of one page


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by two line feeds), n_chars: a row for each row of (page_id, url, html)."""
    keyed = _keyed(pages)
    rows = cut(style_rows(keyed), "styles")
    gone = broadcast_if(cut(repeated_blocks(rows), "repeated"), MARKS_TO_BROADCAST)

    def write(batches):
        import pyarrow as pa

        own = tools()
        for batch in batches:
            texts = []
            for html, gone_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page, drop = Page(html or "", own), set(gone_ or ())
                texts.append("\n\n".join(page.texts[k] for k in page.kept() if k not in drop))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return keyed.join(gone, ["p1", "p2"], "left").select("page_id", "url", "html", "gone").mapInArrow(write, "page_id long, url string, text string, n_chars long")
