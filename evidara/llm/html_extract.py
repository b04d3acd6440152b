"""HTML extraction by site style trees.

The pages of a host are merged: nodes with the same path of tags and styles are one style node. Its importance falls with the
entropy of its content over the host's pages: what says the same on every page is worth nothing, what is said once is
worth everything. Tags and style names that state a role (navigation, advert, comment ...) and dense links weigh the node further.
Branches of low importance are taken out of each page. Within a page's article the same holds, with a prior for what it says: so many
more pages must agree. An article with less than half of a page's text is a teaser: then all blocks are judged alike.

Rules for odd input: null or empty html gives the empty text; a null url is a host of its own name, empty; pages that say the
same count once as evidence for their host and each give a row; very long pages are read whole, one at a time; ties need no rule; broken markup is read as far as it goes; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from evidara.llm.common import materialise, small, spread

#: Fixed sets of HTML tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
SILENT = frozenset("script style noscript template svg title head iframe object canvas select option textarea button datalist audio video math".split())
ROLELESS = frozenset("nav footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
#: Tags that may stand in a head; any other ends it.
OF_HEAD = frozenset("head meta link title style script base noscript template".split())
#: Tags that end an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
#: Words in class, id or role that state what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist disqus discussion cookie cookies consent footer gdpr login masthead menu menubar modal nav navbar navigation navi newsletter notice notices alert "
    "overlay pagination pager paywall popup promo promoted promotion recommended recommendations related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets complementary contentinfo dialog".split()
)
#: Words that say nothing of a role beside one that does: related-posts is noise, social-history is not.
PLAIN = frozenset("area article articles aside bar block body bottom box btn button buttons col column container content div element entry form group header holder inner item items left line link links list main message more new news outer page panel popular post posts primary reader readers right row secondary section site story text title top unit user users wrap wrapper".split())
#: Importance under which a block goes, and the share of links that takes one out.
LEAST_IMPORTANCE, LINKED = 0.3, 0.5
#: States that are judged, and the pages that are thought to differ beforehand.
PRIOR_PAGES = {1: 10, 2: 1}
#: Share of a page's text outside links that makes its articles the main text.
LEAST_MAIN = 0.5
#: Share of the articles of a style node that must say a block for it to go.
ARTICLE_SHARE = 0.8
SALTS = 16
#: A named element stays in if what else would stay is under this share of what it holds.
LEAST_LEFT = 0.1
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def noisy(name: str) -> bool:
    """Whether a class, id or role states what is not the article: all its words do, or say nothing."""
    words = [w.lower() for w in NAME.findall(name)]
    return any(w in NOISE for w in words) and all(w in NOISE or w in PLAIN for w in words)


class Page(HTMLParser):
    """Collects blocks: (style path, text, characters within links, whether in the article, whether in noise by tag or hidden, and
    the elements that are noise by name around it, by number)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, int, bool, bool, frozenset[int]]] = []
        self.stack: list[tuple[str, str, bool, bool, bool, frozenset[int]]] = [("", "", False, False, False, frozenset())]
        #: Elements that are noise by name and hold the first article, or are it.
        self.around: frozenset[int] | None = None
        self.named = 0
        self.links = self.linked = 0
        self.buffer: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.buffer.append("\n")
        if tag not in INLINE:
            self.flush()
        if tag not in OF_HEAD:
            self.leave_head(tag == "body")
        if tag in ENDS_P:
            self.leave({"p"})
        if tag in CLOSES:
            self.leave(CLOSES[tag])
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        names = " ".join((a.get("class", ""), a.get("id", ""), a.get("role", "")))
        _, path, silent, main, noise, named = self.stack[-1]
        noise = noise or tag in ROLELESS or tag == "header" and not main
        if tag not in ("html", "body") and any(noisy(n) for n in names.split()):
            self.named += 1
            named |= {self.named}
        noise = noise or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        if tag not in INLINE:
            path = f"{path}/{tag}.{re.sub(r'[0-9]+', '', a.get('class', ''))}#{re.sub(r'[0-9]+', '', a.get('id', ''))}"
        self.links += tag == "a"
        main = main or tag in MAIN or a.get("role") == "main"
        if main and not noise and self.around is None:
            self.around = named
        self.stack.append((tag, path, silent or tag in SILENT, main, noise, named))

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if any(s[0] == tag for s in self.stack):
            while True:
                top = self.stack.pop()
                self.links -= top[0] == "a"
                if top[0] == tag:
                    break

    def end(self) -> None:
        HTMLParser.close(self)

    def leave(self, tags: set[str]) -> None:
        """End an open element of these, unless another container was opened since."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                self.flush()
                for s in self.stack[i:]:
                    self.links -= s[0] == "a"
                del self.stack[i:]
                return
            if self.stack[i][0] not in INLINE:
                return

    def leave_head(self, body: bool) -> None:
        """End an open head that its end tag was left out of: what else is open in it ends only for the body."""
        at = next((i for i, s in enumerate(self.stack) if s[0] == "head"), None)
        if at is not None and (body or at == len(self.stack) - 1):
            del self.stack[at:]

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.leave_head(False)
        if not self.stack[-1][2]:
            self.buffer.append(data)
            self.linked += self.links > 0 and len(data.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            _, path, _, main, noise, named = self.stack[-1]
            self.blocks.append((path, text, self.linked, main, noise, named))
        self.buffer.clear()
        self.linked = 0


def lifted(page: Page) -> frozenset[int]:
    """Elements whose noise names do not count: those around the first article, and those without which next to nothing is left."""
    out = page.around or frozenset()
    held: dict[int, int] = {}
    left = 0
    for _, text, linked, _, noise, named in page.blocks:
        size = 0 if noise else max(0, len(text) - linked)
        left += 0 if named - out else size
        for k in named - out:
            held[k] = held.get(k, 0) + size
    return out | {k for k, n in held.items() if left < LEAST_LEFT * n}


def read(html: str) -> list[tuple[int, str, int]]:
    """Blocks of a page in order: style path (hashed), text, and its state: 0 goes; 1 (in the article) and 2 are up to their importance."""
    page = Page()
    try:
        page.feed(html)
        page.end()
    except AssertionError:  # the parser's own word for markup that it cannot read
        pass
    page.flush()
    ignored = lifted(page)
    blocks = [(path, text, linked, main, noise or bool(named - ignored)) for path, text, linked, main, noise, named in page.blocks]
    size = [0, 0]
    for _, text, linked, main, noise in blocks:
        size[main] += 0 if noise else max(0, len(text) - linked)
    has_main = size[True] > 0 and size[True] >= LEAST_MAIN * sum(size)
    out = []
    for path, text, linked, main, noise in blocks:
        if noise or linked > LINKED * len(text) and not (main and has_main):
            state = 0
        else:
            state = 2 if not has_main else 1 if main else 0
        out.append((xxh3_64_intdigest(path) - (1 << 63), text, state))
    return out


def parsed(pages: DataFrame, texts: bool) -> DataFrame:
    """Each row as host and page (digests) with, of its blocks that roles alone do not take out, either the keys (path, text
    digest, state) or row (page_id, url) and the texts."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = spread(pages).select(F.struct("page_id", "url").alias("row"), F.xxhash64(host).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    key = pa.struct([("path", pa.int64()), ("text", pa.int64()), ("state", pa.int32())])
    kind = rows.schema["row"].dataType.simpleString()
    names, schema = (["row", "host", "page", "texts"], f"row {kind}, host long, page long, texts array<string>") if texts else (["host", "page", "keys"], "host long, page long, keys array<struct<path:long,text:long,state:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, digest = [], []
            for html in batch["html"].to_pylist():
                own = [b for b in read(html) if b[2]]
                found.append([t for _, t, _ in own] if texts else [{"path": p, "text": xxh3_64_intdigest(t) - (1 << 63), "state": s} for p, t, s in own])
                # pages that say the same are one page, whatever else their markup holds
                digest.append(xxh3_64_intdigest("\n\n".join(t for _, t, _ in own)) - (1 << 63))
            columns = [batch["host"], pa.array(digest, pa.int64()), pa.array(found, pa.list_(pa.string() if texts else key))]
            yield pa.RecordBatch.from_arrays([batch["row"], *columns] if texts else columns, names)

    return rows.mapInArrow(run, schema)


def low(k: Column, pages: Column, prior: int) -> Column:
    """Whether what some pages of a node say alike is of low importance; k is its count, or their weighted geometric mean.

    Entropy is taken over the node's own pages and some more, thought to differ, that stand for what is believed beforehand.
    """
    return 1 - F.log(k) / F.log(pages + prior) < LEAST_IMPORTANCE


def branches(once: DataFrame) -> DataFrame:
    """host, path, text and the states in which a block of these goes: by its own importance or by that of its style node."""
    seen = F.expr("array_distinct(transform(filter(keys, b -> b.state IN (JUDGED)), b -> struct(b.path AS path, b.text AS text)))".replace("JUDGED", ", ".join(map(str, PRIOR_PAGES))))
    paths = F.expr("array_distinct(transform(seen, s -> struct(s.path AS path, cast(null AS long) AS text)))")
    each = once.select("host", seen.alias("seen")).select("host", F.explode(F.concat("seen", paths)).alias("s"))
    # without a text, k is the number of pages that have the path
    texts = materialise(each.groupBy("host", "s.path", "s.text").agg(F.count("*").alias("k")), "styles")
    some = F.when(F.col("text").isNotNull(), F.col("k"))
    nodes = texts.groupBy("host", "path").agg(F.max(F.when(F.col("text").isNull(), F.col("k"))).alias("pages"), F.exp(F.sum(some * F.log("k")) / F.sum(some)).alias("mean"), F.max(some).alias("most"))
    repeated = nodes.where("most > 1").drop("most").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = texts.where("text IS NOT NULL").withColumn("salt", F.pmod("text", F.lit(SALTS)).cast("int"))
    # of an article goes only what nearly all articles of its kind say
    usual = {1: F.col("k") >= ARTICLE_SHARE * F.col("pages"), 2: F.lit(True)}
    goes = [F.when(usual[state] & (low(F.col("k"), F.col("pages"), prior) | low(F.col("mean"), F.col("pages"), prior)), state) for state, prior in PRIOR_PAGES.items()]
    return salted.join(repeated, ["host", "path", "salt"]).select("host", "path", "text", F.array_compact(F.array(*goes)).alias("states")).where(F.size("states") > 0)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text (blocks joined by an empty line) and its code points."""
    once = materialise(parsed(pages, False).groupBy("host", "page").agg(F.first("keys").alias("keys")), "pages")
    # both tables grow with the input, so neither is broadcast even where it is small
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    each = once.select("host", "page", F.posexplode("keys").alias("at", "b")).select("host", "page", "at", "b.*").withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
    going = each.join(branches(once).withColumn("salt", salts).hint("merge"), ["host", "path", "text", "salt"]).where(F.array_contains("states", F.col("state")))
    gone = materialise(going.groupBy("host", "page").agg(F.collect_set("at").alias("gone")), "gone").withColumn("salt", salts)
    rows = parsed(pages, True).withColumn("salt", F.pmod(F.xxhash64("row.page_id"), F.lit(SALTS)).cast("int"))
    kept = F.filter("texts", lambda t, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    out = rows.join(gone.hint("merge"), ["host", "page", "salt"], "left").select("row.page_id", "row.url", F.concat_ws("\n\n", kept).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
