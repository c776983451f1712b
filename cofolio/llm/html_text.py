"""Operator 4: main text of HTML pages by site template removal.

Each page becomes an element tree; element subtrees are hashed and Spark counts, for each host, on how many
different pages a subtree occurs. Subtrees that recur are the site's template and go, in articles too. What differs
from page to page though it isn't the article (adverts, comments, teasers) can't recur; it goes where its element or its
class says what it is, which also decides on hosts of few pages. What is left of the page's articles is its text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: A subtree is template when it occurs on so many different pages of the host and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.02
#: Templates up to this number (some 100 bytes each) are sent to all tasks; more are joined by shuffles.
BROADCAST_ROWS = 200_000
#: Parts that the pages of one template are dealt to in that join.
SALTS = 32

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_ONE_OF_A_ROW = frozenset("li dd dt td th tr option".split())
_GONE = frozenset(
    "head script style noscript template iframe svg math nav footer aside form button select option textarea menu dialog object canvas title input audio video noembed noframes".split()
)
#: Text blocks and their parts, which are an article's content however often they recur.
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ol b i em strong span a code td th tr tbody thead tfoot table caption figure figcaption dl dt dd summary".split())
#: Parts of a sentence, which never go on their own.
_INLINE = frozenset("a abbr b cite code em i kbd mark q s small span strong sub sup u br wbr img".split())
#: Words by which a class or id names furniture, and words that only say where it is or what shape it has.
_FURNITURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus submenu "
    "sidebar sidebars footer footers masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter newsletters subscribe "
    "subscription share sharing social comment comments commentlist disqus replies respond related recommended recommendations widget widgets toolbar pagination pager "
    "search searchbox login signup".split()
)
_SHAPE = frozenset(
    "site page global main top bottom left right side header head bar box block blocks wrap wrapper container inner outer section area region slot unit zone panel list lists "
    "item items link links button buttons icon icons form field group row column col posts articles stories thread body title text primary secondary mobile desktop".split()
)
_AROUND = frozenset("header head top title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


#: Words that name furniture whatever stands before them ('reader-comments'), but for words of place and state.
_HEADS = frozenset("comments commentlist replies disqus sidebar sidebars nav navbar footer newsletter newsletters ads advert adverts advertisement advertisements breadcrumb breadcrumbs pagination popup".split())
_STATES = frozenset("with has no non without is not show hide for on in under over beside before after".split())
#: An article's sentences and their parts are its text whatever they are called, but for these words.
_SENTENCES = _INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_ADVERTS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsored".split())
_WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


def _says_furniture(names: str, in_article: bool, sentence: bool = False) -> bool:
    """Whether one of the names consists of words for furniture and shapes only ('share-price' doesn't), ends in one that names furniture
    on its own ('with-sidebar' doesn't), or names a header outside the article. Sentences of an article are adverts or its text."""
    for name in names.split():
        words = [w.lower() for w in _WORDS.split(name) if w]
        parts = set(words)
        if parts & (_ADVERTS if in_article and sentence else _FURNITURE) and parts <= _FURNITURE | _SHAPE:
            return True
        if in_article and sentence:
            continue
        while len(words) > 1 and words[-1] in _SHAPE:
            words.pop()
        if words and words[-1] in _HEADS and not parts & _STATES:
            return True
        if not in_article and "header" in parts and parts <= _SHAPE:
            return True
    return False


class Element:
    __slots__ = ("tag", "attrs", "inside", "hash", "holds")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.inside = tag, attrs, []
        self.hash, self.holds = 0, False

    def attributes(self) -> Iterator[tuple[str, str]]:
        for name, *values in _ATTR.findall(self.attrs) if self.attrs else ():
            yield name.lower(), "".join(values)

    def furniture(self, in_article: bool) -> bool:
        """Whether the element or its attributes say that it isn't the article's text. What holds an article is never named away."""
        if self.tag in _GONE or self.tag == "header" and not in_article and not self.holds:
            return True
        for name, value in self.attributes():
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            if self.holds or self.tag in ("html", "body", "main"):
                continue
            if name in ("class", "id") and _says_furniture(value, in_article, self.tag in _SENTENCES) or name == "role" and value.lower() in _ROLES:
                return True
        return False


def _tag_end(page: str, at: int, closes: dict[str, bool]) -> int:
    """Where the tag whose attributes begin at ``at`` ends (after its '>'). Quotes hold a '>' only as an attribute's value; one that is
    never closed doesn't."""
    while True:
        stop = _UNQUOTED.match(page, at).end()
        if stop == len(page):
            return stop
        sign = page[stop]
        if sign == ">":
            return stop + 1
        at, before = stop + 1, stop - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=":
            if closes[sign] and (end := page.find(sign, at)) >= 0:
                at = end + 1
            else:
                closes[sign] = False


def parse(page: str) -> Element:
    """The element tree; never fails, whatever the markup, in time linear in the page. Unclosed elements end with their parent."""
    root = Element("")
    stack, at, text_from = [root], 0, 0
    open_tags: dict[str, int] = {}
    last_end, closes = page.rfind(">"), {'"': True, "'": True}

    def pop() -> str:
        tag = stack.pop().tag
        open_tags[tag] -= 1
        return tag

    while (lt := page.find("<", at)) >= 0:
        name, at = _NAME.match(page, lt) if lt < last_end else None, lt + 1
        if name is None:
            if not page.startswith("<!--", lt) and (lt > last_end or page[at] not in "!?/"):
                continue  # a sign of its own
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = len(page) if end < 0 else end + 3
            else:
                at = page.find(">", lt) + 1
            if text_from < lt:
                stack[-1].inside.append(page[text_from:lt])
            text_from = at
            continue
        if text_from < lt:
            stack[-1].inside.append(page[text_from:lt])
        tag = name[1].lower()
        at = text_from = _tag_end(page, name.end(), closes)
        if page[lt + 1] == "/":
            if open_tags.get(tag, 0):
                while pop() != tag:
                    pass
            continue
        if tag in _CLOSES_P and open_tags.get("p"):
            while pop() != "p":
                pass
        if tag in _ONE_OF_A_ROW and stack[-1].tag == tag:
            pop()
        attrs = page[name.end() : at - 1]
        node = Element(tag, attrs.strip())
        stack[-1].inside.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = text_from = end.end() if end else len(page)
        elif tag in ("article", "main"):
            for outer in reversed(stack):  # those inside one that knows know too
                if outer.holds:
                    break
                outer.holds = True
        if tag not in _VOID and tag not in _RAW and not attrs.endswith("/"):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if text_from < len(page):
        stack[-1].inside.append(page[text_from:])
    return root


def _walk(root: Element) -> Iterator[tuple[Element, bool]]:
    """Elements with whether they stand in an article, parents first; without recursion, as trees may be very deep."""
    todo = [(root, False)]
    while todo:
        node, in_article = todo.pop()
        yield node, in_article
        inner = in_article or node.tag == "article"
        todo += [(x, inner) for x in reversed(node.inside) if isinstance(x, Element)]


def hash_subtrees(root: Element) -> None:
    """Every element's 64-bit hash of tag, attributes, texts and children."""
    for node, _ in reversed(list(_walk(root))):
        h = hashlib.blake2b(f"{node.tag} {node.attrs}".encode("utf-8", "surrogatepass"), digest_size=8)
        for x in node.inside:
            h.update(x.hash.to_bytes(8, "little", signed=True) if isinstance(x, Element) else _SPACE.sub(" ", x).encode("utf-8", "surrogatepass"))
            h.update(b"\0")
        node.hash = int.from_bytes(h.digest(), "little", signed=True)


def _may_go(node: Element, in_article: bool) -> bool:
    """Whether recurrence makes an element template: anything around the article, but only containers in it. Elements without content tell nothing."""
    if node.tag in ("", "html", "body", "head", "main", "article") or node.tag in _INLINE or node.tag in _VOID or not node.inside or node.holds:
        return False
    return node.tag not in _CONTENT if in_article else True


def template_candidates(page: str) -> list[int]:
    """Distinct subtree hashes of a page that may be template."""
    root = parse(page)
    hash_subtrees(root)
    return list({n.hash for n, inside in _walk(root) if _may_go(n, inside)})


def _texts(top: Element, in_article: bool, gone: Callable[[Element, bool], bool]) -> Iterator[str]:
    """The blocks' texts in page order."""
    todo: list = [(top, in_article, True)]  # what is still to come; None ends a block
    held: list[str] = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(x)
            continue
        if x is not None:
            node, inside, own = x
            if not own and gone(node, inside):
                continue
            inner = inside or node.tag == "article"
            if node.tag in _BLOCK:
                todo.append(None)
            todo += [(y, inner, False) if isinstance(y, Element) else y for y in reversed(node.inside)]
            if node.tag not in _BLOCK:
                continue
        if held:
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


def _main_text(root: Element, gone: Callable[[Element, bool], bool]) -> str:
    """All outermost articles in page order; without one, the main element; without that, the page."""
    articles, mains = [], []
    todo = [root]
    while todo:
        node = todo.pop()
        if node is not root and gone(node, False):
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" or any(k == "role" and v.lower() == "main" or k == "itemprop" and v.lower() == "articlebody" for k, v in node.attributes()):
            mains.append(node)
        todo += [x for x in reversed(node.inside) if isinstance(x, Element)]
    chosen = [(a, True) for a in articles] or [(m, False) for m in mains[:1]] or [(root, False)]
    clean = (_SPACE.sub(" ", html.unescape(b)).strip() for top, inside in chosen for b in _texts(top, inside, gone))
    return " ".join(b for b in clean if b)


def main_text(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks in page order, each with single blanks, joined by one blank. A page that consists of template
    only (copies of one page with small changes) keeps its text."""
    root = parse(page)
    if template:
        hash_subtrees(root)
        found = _main_text(root, lambda n, inside: n.hash in template and _may_go(n, inside) or n.furniture(inside))
        if found:
            return found
    return _main_text(root, lambda n, inside: n.furniture(inside))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; what has none (null too) belongs to the host ''."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, page, hash``: the subtrees of each page that may be template; ``page`` is a hash of its html. A null hash stands for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [[None, *template_candidates(p)] for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.list_(pa.int64()))], ["host", "page", "hashes"])

    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(text).alias("page"), text.alias("html"))
    return rows.mapInArrow(run, "host string, page long, hashes array<long>").select("host", "page", F.explode("hashes").alias("hash"))


def site_templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, hash``: the subtrees of ``found`` (as of :func:`subtrees`) that recur on a host. Pages repeated whole count once."""
    counted = found.groupBy("host", "hash").agg(F.count_distinct("page").alias("n")).where((F.col("n") >= min_pages) | F.col("hash").isNull())
    counted = cut(counted, "html-subtrees")
    totals = counted.where("hash is null").select("host", F.col("n").alias("pages"))
    often = counted.where("hash is not null").join(totals, "host")
    return often.where(F.col("n") >= F.lit(min_share) * F.col("pages")).select("host", "hash")


def _of_pages(found: DataFrame, templates: DataFrame) -> DataFrame:
    """``host, page, hashes``: the template subtrees of each page. A subtree on all pages of a large host meets its template in ``SALTS`` parts."""
    salt = F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int").alias("salt")
    every = templates.select("host", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = found.where("hash is not null").distinct().select("host", "page", "hash", salt).join(every, ["host", "hash", "salt"])
    return met.groupBy("host", "page").agg(F.collect_list("hash").alias("hashes"))  # at most the elements of one page


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``id_col, url_col, text, n_chars`` for every page.

    Null html counts as empty and gives an empty text; null urls form one host; ids may be null or repeat
    (each row is extracted on its own); other columns are ignored; broken markup never fails; an empty table gives an empty result.
    """
    found = subtrees(pages, url_col, html_col)
    templates = cut(site_templates(found, min_pages, min_share), "html-templates")
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), text.alias("__html"), host_of(F.col(url_col)).alias("host"))
    kinds = dict(pages.dtypes)
    by_host = None
    if templates.count() <= BROADCAST_ROWS:
        listed: dict[str, set[int]] = {}
        for r in templates.collect():  # at most BROADCAST_ROWS rows
            listed.setdefault(r["host"], set()).add(r["hash"])
        by_host = pages.sparkSession.sparkContext.broadcast(listed)
        rows = rows.withColumn("hashes", F.lit(None).cast("array<long>"))
    else:
        rows = rows.withColumn("page", F.xxhash64("__html")).join(_of_pages(found, templates), ["host", "page"], "left")
    rows = rows.select("__id", "__url", "__html", "host", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages_, hosts, own = (b.column(k).to_pylist() for k in (2, 3, 4))
            of = [by_host.value.get(h, frozenset()) for h in hosts] if by_host else [frozenset(x or ()) for x in own]
            texts = [main_text(p, t) for p, t in zip(pages_, of, strict=True)]
            n = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), n], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
