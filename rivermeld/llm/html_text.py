"""Main text of web pages; page furniture goes by site template counts and by the meaning of its markup.

First pass: every block element (div, article, nav, ul, footer, ...) with text is hashed with all it holds. Spark counts, per
host, on how many different pages each hash occurs. Second pass: blocks that recur on `least` pages of their host, however
many pages it has, are deleted, and with them menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments
of readers, told by their tags, roles and class names. Pages differ if their addresses do and their main texts without any
block that may be a template, so an article that is stored again with other adverts is no template. Paragraphs, headings,
list items and other single pieces of text are never counted, so a sentence that many articles share stays.

Only pages that keep text inside a recurring container need the first pass's result; they are joined by a broadcast
while their number is below a checked limit and by a shuffle join beyond it.

Defined cases: a null or empty page has empty text; a null url is the host ''; repeated rows get a result each and count
once; an empty table gives an empty result; broken markup is read as far as it goes; elements may be nested to any depth and pages be
of any length; other columns are not read. A class name that holds a word of furniture beside words of its own ("entry-header",
"has-sidebar") says nothing; where classes leave no text at all, those around an article or its heading are not heeded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import query, table
from rivermeld.session import written

# Names of elements and words of class names, as published for HTML and commonly used by sites.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "tfoot thead tr ul caption".split())
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre blockquote caption figcaption summary legend hr".split())
CONTAINER = BLOCK - PIECES - {"html", "body"}
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas audio video map nav footer aside form button select "
    "option datalist input textarea label menu dialog search title".split())
CLOSES = {  # an opening tag closes these, up to one of the second set
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})), "body": (frozenset({"head"}), frozenset({"html"})),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus respond reply replies widget pagination pager toolbar skip skiplink outbrain taboola paywall".split())
#: Words that may stand beside those in one class name without changing its sense: "site-footer", "related-posts".
NEUTRAL = frozenset(
    "site page global top bottom left right primary secondary main box block wrap wrapper container inner outer area section "
    "list item items link links button buttons bar slot unit zone row col column group module panel form post posts articles "
    "stories icon icons count title text large small desktop mobile fixed sticky wp js".split())
KEPT = frozenset({"html", "body", "article", "main"})

_MARK = re.compile(r"<(?:!--|[!?/a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass
class Node:
    """An element; `inside` holds texts and elements in page order."""

    tag: str
    attributes: str
    inside: list


def _tag_end(html: str, at: int) -> int:
    """The place of the '>' that ends the tag at `at`; quoted values may hold others."""
    end = html.find(">", at)
    while end >= 0:
        part = html[at:end]
        place, quote = 0, ""
        for m in re.finditer("[\"']", part):
            if not quote:
                if part[:m.start()].rstrip().endswith("="):
                    quote, place = m.group(), m.start()
            elif m.group() == quote:
                quote = ""
        if not quote:
            return end
        closing = html.find(quote, at + place + 1 + (end - at - place))
        if closing < 0:
            return html.find(">", at)
        end = html.find(">", closing)
    return html.find(">", at)


def parse(html: str) -> Node:
    """A tree of elements with their texts; forgiving of unclosed and stray tags."""
    root = Node("html", "", [])
    stack, at, n = [root], 0, len(html)
    opened: Counter = Counter()  # of tags on the stack, so that stray tags do not search it

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while at < n:
        m = _MARK.search(html, at)
        if m is None:
            stack[-1].inside.append(html[at:])
            break
        begin = m.start()
        if begin > at:
            stack[-1].inside.append(html[at:begin])
        if m.group() == "<!--":
            end = html.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        end = _tag_end(html, begin)
        if end < 0:
            break
        at = end + 1
        kind = html[begin + 1]
        if kind in "!?":
            continue
        name = _NAME.match(html, begin + (2 if kind == "/" else 1))
        if name is None:
            continue
        tag = name.group().lower()
        if kind == "/":
            if opened[tag]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag == "html":
            continue
        if tag in BLOCK and opened["p"]:  # an open paragraph ends where a block begins
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag][0]):
            closed, limit = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    cut(k)
                    break
                if stack[k].tag in limit:
                    break
        node = Node(tag, html[name.end():end], [])
        stack[-1].inside.append(node)
        if tag in VOID or node.attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            if close is None:
                at = n
            else:
                after = html.find(">", close.end())
                at = n if after < 0 else after + 1
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def _named_furniture(value: str, inside_main: bool) -> bool:
    """Whether a class or id says furniture: one name with such a word and, beside it, neutral words only.

    "sidebar" and "site-footer" do; "has-sidebar", "entry-header" and "related-work" do not. A header inside the article is its own.
    """
    for name in value.split():
        words = set(_WORD.findall(name))
        marks = words & FURNITURE
        if marks and words <= FURNITURE | NEUTRAL and not (inside_main and marks <= {"header", "masthead"}):
            return True
    return False


def _furniture(node: Node, inside_main: bool = False, spared: frozenset = frozenset()) -> bool:
    """Whether tag, role, class, id or style say that the element is no part of the article; classes of `spared` say nothing."""
    tag = node.tag
    if tag in DROPPED:
        return True
    if tag in KEPT or not node.attributes:
        return False
    for key, value in _ATTRIBUTE.findall(node.attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if id(node) not in spared and _named_furniture(value, inside_main):
                return True
        elif key == "role":
            if value in ROLES:
                return True
        elif key == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif key == "hidden" or value == "true":
            return True
    return False


def _main(node: Node, spared: frozenset = frozenset()) -> list[Node]:
    """The articles of the page, else its main element, else nothing; not those inside furniture."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag == "article" and not _hinted_article(x):
            found["article"].append(x)
            continue
        if x.tag == "main" or 'role="main"' in x.attributes:
            found["main"].append(x)
        stack.extend(c for c in reversed(x.inside) if not isinstance(c, str) and not _furniture(c, False, spared))
    return found["article"] or found["main"]


def _hinted_article(node: Node) -> bool:
    """An article that is a comment or an advert by its class."""
    return any(k.lower() in ("class", "id") and _named_furniture(v.strip("\"'").lower(), False)
               for k, v in _ATTRIBUTE.findall(node.attributes))


def _around_articles(root: Node) -> frozenset:
    """Elements that hold an article, a main element or a first heading."""
    around: set[int] = set()
    stack = [(root, iter(root.inside))]
    while stack:
        node, rest = stack[-1]
        x = next(rest, None)
        if x is None:
            stack.pop()
        elif not isinstance(x, str):
            if x.tag in ("article", "main", "h1"):
                for held, _ in reversed(stack):
                    if id(held) in around:
                        break
                    around.add(id(held))
            stack.append((x, iter(x.inside)))
    return frozenset(around)


def _digest(root: Node, out: list[tuple[int, Node]]) -> None:
    """Adds the containers with text below `root` to `out`, each with the hash of its subtree."""
    import xxhash

    def code_of(text: str) -> int:
        code = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
        return code - ((code >> 63) << 64)

    stack: list[tuple[Node, Iterator, list[str]]] = [(root, iter(root.inside), [])]
    while stack:
        node, rest, parts = stack[-1]
        x = next(rest, None)
        if isinstance(x, str):
            parts.append(" ".join(x.split()))
        elif x is not None:
            if x.tag not in RAW:
                stack.append((x, iter(x.inside), []))
        else:
            stack.pop()
            held = " ".join(p for p in parts if p)
            if not held:
                continue
            held = f"<{node.tag}>{held}"
            if node.tag in CONTAINER:
                out.append((code_of(held), node))
                held = f"<{node.tag} {out[-1][0]}>"
            elif len(held) > 500:  # so that deep nesting does not copy long texts again and again
                held = f"<{node.tag} {code_of(held)}>"
            if stack:
                stack[-1][2].append(held)


def text_of(html: str | None, recurring: frozenset = frozenset()) -> tuple[str, list[int], list[int]]:
    """(main text, hashes of all containers, hashes of those that hold kept text)."""
    if not html:
        return "", [], []
    root = parse(html)
    containers: list[tuple[int, Node]] = []
    _digest(root, containers)
    codes = {id(node): code for code, node in containers}
    blocks, live = _kept(root, codes, recurring, frozenset())
    if not blocks:  # a class of an element around the whole article said too much
        spared = _around_articles(root)
        blocks, live = _kept(root, codes, recurring, spared) if spared else (blocks, live)
    return "\n".join(blocks), [c for c, _ in containers], sorted(live)


def _kept(root: Node, codes: dict[int, int], recurring: frozenset, spared: frozenset) -> tuple[list[str], set[int]]:
    """The blocks of the main text and the hashes of containers that hold some of it."""
    blocks: list[str] = []
    current: list[str] = []
    live: set[int] = set()

    def end_block() -> None:
        line = " ".join(unescape("".join(current)).split())
        current.clear()
        if line:
            blocks.append(line)

    def walk(start: Node, inside_main: bool) -> None:
        # A frame: the element, what is left of it, whether it kept text.
        frames = [[start, iter(start.inside), False]]
        if start.tag in BLOCK:
            end_block()
        while frames:
            frame = frames[-1]
            node = frame[0]
            x = next(frame[1], None)
            if x is None:
                if node.tag in ("td", "th"):
                    current.append(" ")
                if node.tag in BLOCK:
                    end_block()
                if frame[2] and id(node) in codes:
                    live.add(codes[id(node)])
                frames.pop()
                if frames:
                    frames[-1][2] = frames[-1][2] or frame[2]
            elif isinstance(x, str):
                current.append(x)
                frame[2] = frame[2] or not x.isspace()
            elif x.tag == "br":
                current.append(" ")
            elif x.tag == "header" and not inside_main or x.tag != "header" and (
                    _furniture(x, inside_main, spared) or x.tag == "article" and _hinted_article(x)):
                if x.tag in BLOCK:
                    end_block()
            elif x.tag not in ("td", "th", "header") and codes.get(id(x)) in recurring:
                end_block()
            else:
                if x.tag in ("td", "th"):
                    current.append(" ")
                if x.tag in BLOCK:
                    end_block()
                frames.append([x, iter(x.inside), False])

    main = _main(root, spared)
    for node in main or [root]:
        if codes.get(id(node)) not in recurring:
            walk(node, bool(main))
            end_block()
    return blocks, live


TRACKING = r"#.*$|(?<=[?&])utm_[a-z]+=[^&#]*&?"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _signed(text: str) -> int:
    import xxhash

    code = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return code - ((code >> 63) << 64)


def _subtrees(pages: DataFrame) -> DataFrame:
    """f1, f2, host, place, main (hash of the main text), codes of containers, live ones of them."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [text_of(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("f1", "f2", "host", "place")],
                pa.array([_signed(r[0]) for r in rows], pa.int64()),
                pa.array([list(dict.fromkeys(r[1])) for r in rows], pa.list_(pa.int64())),
                pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["f1", "f2", "host", "place", "main", "codes", "live"])

    return pages.select("f1", "f2", "host", "place", "html").mapInArrow(
        counted, "f1 long, f2 long, host string, place long, main long, codes array<long>, live array<long>")


def _rest(pages: DataFrame) -> DataFrame:
    """f1, f2, rest (hash of the main text without the containers in `codes`)."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rest = [_signed(text_of(h.as_py(), frozenset(c.as_py()))[0]) for h, c in zip(batch.column("html"), batch.column("codes"))]
            yield pa.RecordBatch.from_arrays([batch.column("f1"), batch.column("f2"), pa.array(rest, pa.int64())], names=["f1", "f2", "rest"])

    return pages.select("f1", "f2", "html", "codes").mapInArrow(counted, "f1 long, f2 long, rest long")


def templates(subtrees: DataFrame, least: int) -> DataFrame:
    """host, code of the containers on pages of at least `least` different main texts and `least` different places of their host."""
    each = subtrees.select("host", "main", "place", F.explode("codes").alias("code"))

    def often(by: str) -> DataFrame:
        once = each.groupBy("host", "code", by).agg(F.lit(1).alias("one"))
        return once.groupBy("host", "code").agg(F.sum("one").alias("n")).where(F.col("n") >= least).select("host", "code")

    return often("main").join(often("place"), ["host", "code"])


def _held(subtrees: DataFrame, codes: DataFrame, name: str, broadcast_rows: int) -> DataFrame:
    """f1, f2, codes: those of `codes` that hold kept text of a page; broadcast while small."""
    rows = written(
        subtrees.select("f1", "f2", "host", F.explode("live").alias("code")).join(codes, ["host", "code"])
        .groupBy("f1", "f2").agg(F.collect_set("code").alias("codes")), name)
    # A row is two hashes and the containers of one page; few pages keep text inside a recurring container.
    small = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
    return F.broadcast(rows) if small[0] + small[1] <= broadcast_rows else rows


def main_text(pages: DataFrame, least: int = 5, broadcast_rows: int = 50_000) -> DataFrame:
    """page_id, url, text of every page."""
    named = pages.select(
        "page_id", "url", "html", F.xxhash64(F.lit(1), "page_id", "url", "html").alias("f1"),
        F.xxhash64(F.lit(2), "page_id", "url", "html").alias("f2"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"),
        F.xxhash64(F.coalesce(F.regexp_replace("url", TRACKING, ""), F.col("html"))).alias("place"))
    subtrees = written(_subtrees(named), "subtrees")
    likely = written(templates(subtrees, least), "likely")
    doubtful = _held(subtrees, likely, "doubtful", broadcast_rows)
    rest = written(_rest(named.join(doubtful, ["f1", "f2"])).distinct(), "rest")
    judged = subtrees.join(rest, ["f1", "f2"], "left").withColumn("main", F.coalesce("rest", "main"))
    recurring = templates(judged, least)
    affected = _held(subtrees, recurring, "recurring", broadcast_rows)
    joined = named.join(affected, ["f1", "f2"], "left").select("page_id", "url", "html", "codes")

    def extracted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [text_of(h.as_py(), frozenset(c.as_py() or ()))[0] for h, c in zip(batch.column("html"), batch.column("codes"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(extracted, f"page_id {kinds['page_id']}, url string, text string")


@query("op6_html_extraction")
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
