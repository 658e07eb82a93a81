"""Main text of web pages by equivalence-class template deduction.

Pages of one host are taken in groups. Tokens (tags with their classes, and whole text nodes) that occur
equally often on every page of the group, page by page, form an equivalence class. The class of tokens that
every page has exactly once, in one common order, is the root of the template; its tokens cut each page into
slots. Other classes are valid if their tokens come in one repeating order inside one slot, and nest there.

The containers among the root's tokens nest as well, and every text stands in a chain of them. The template knows of
each chain how much text the group has there, less what all pages repeat and less the lists of links, which are
nested classes with links that hold most of their slot's text. The main text is where most of this is: from the
outside inwards, the container that holds the larger part of the rest is entered. Names of elements (article, nav,
"ad") weigh a container's text, so they settle what the amounts leave open, and say what is dropped inside of the
main container where pages have elements that the template hasn't.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_arrow
from frameloom.llm.url_filter import split_url

#: Pages of a group. Larger hosts are taken in several groups, so no group grows with the host.
GROUP_PAGES = 32
#: A host of more pages is dealt over several tasks. Such hosts are broadcast: HOT_HOSTS of them at most, beyond that parts grow.
PART_PAGES, HOT_HOSTS = 2048, 200_000
#: What a name is worth: text in an article counts so many times, text in a menu or advert one so-many-th.
NAME_WEIGHT = 64.0
#: A container is entered if it holds this share of the text.
LARGER_PART = 0.6

# Element names of HTML, and names that mark what is no part of an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title"
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("html body div section center article main nav header footer aside form table tbody td fieldset details dialog menu".split())
MAIN = {"article", "main"}
DROPPED = set("nav header footer aside form button select dialog menu head object canvas audio video map datalist".split())
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer sidebar side aside widget notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments commentlist disqus reply replies respond discussion related recommended recommendations".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|(?P<text>[^<]+|<)", re.S | re.I)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Za-z]+")


@dataclass
class Page:
    #: (kind, label, value): kind is open, close or text; label is what the template compares.
    tokens: list[tuple[str, str, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Tags and text of a page; comments, declarations and raw elements such as scripts are left out."""
    tokens: list[tuple[str, str, str]] = []
    said: list[str] = []

    def text() -> None:
        if said:
            value = "".join(said)
            tokens.append(("text", "#" + " ".join(value.split()), value))
            said.clear()

    last = html.rfind(">") + 1  # no tag ends behind it
    open_ended = False
    for m in TOKEN.finditer(html, 0, last):
        if (found := m["text"]) is not None:
            said.append(unescape(found))
        elif name := m["name"]:
            text()
            name = name.lower()
            if m["close"]:
                tokens.append(("close", f"</{name}>", name))
            else:
                marks = " ".join(x for g in CLASS.findall(m["attrs"] or "") for x in g if x).lower()
                tokens.append(("open", f"<{name} {marks}>" if marks else f"<{name}>", name))
        elif m.end() == last:
            part = m[0]
            open_ended = not part.endswith("-->") if part.startswith("<!--") else bool(m["raw"]) and not re.search(rf"</{m['raw']}\s*>\Z", part, re.I)
    if not open_ended:
        said.append(unescape(html[last:].partition("<!--")[0]))
    text()
    return Page(tokens)


def is_dropped(label: str, name: str) -> bool:
    if name in MAIN:
        return bool(DROPPED_WORDS.intersection(WORD.findall(label)[1:]) - {"main"})
    return name in DROPPED or bool(DROPPED_WORDS.intersection(WORD.findall(label)[1:]))


def step(stack: list[tuple[str, str]], kind: str, label: str, name: str) -> None:
    """The open elements of a page behind one more token: a closing tag closes the last open element of its name and all in it."""
    if kind == "open" and name not in VOID:
        stack.append((label, name))
    elif kind == "close" and any(n == name for _, n in stack):
        while stack.pop()[1] != name:
            pass


Chain = tuple[tuple[str, str], ...]


def chain_of(stack: list[tuple[str, str]], containers: set[str]) -> Chain:
    """The template's containers that are open, from the outside inwards."""
    return tuple(x for x in stack if x[0] in containers)


@dataclass
class Template:
    #: Root tokens in order, the classes nested in the slot behind each of them, and the slots that are lists of links.
    root: list[str]
    nested: list[list[list[str]]]
    menus: set[int]
    #: The root's containers, the chain of them that holds the main text (None: none does), and the texts that all pages repeat.
    containers: set[str]
    main: Chain | None
    repeated: set[str]

    @property
    def named(self) -> bool:
        return bool(self.main) and self.main[-1][1] in MAIN


def weight(label: str, name: str) -> float:
    if is_dropped(label, name):
        return 1 / NAME_WEIGHT
    return NAME_WEIGHT if name in MAIN else 1.0


def deduce(pages: list[Page]) -> Template:
    """The template of a group of pages: equivalence classes, their validity, their nesting, and where the main text is."""
    # A single page says nothing about which texts are the template's.
    counts = [Counter(label for kind, label, _ in p.tokens if label != "#" and (kind != "text" or len(pages) > 1)) for p in pages]
    shared = set.intersection(*(set(c) for c in counts)) if counts else set()
    classes: dict[tuple, list[str]] = defaultdict(list)
    for label in sorted(shared):
        classes[tuple(c[label] for c in counts)].append(label)
    once = set(classes.pop((1,) * len(pages), []))
    root = ordered_by_all(pages, once)
    nested: list[list[list[str]]] = [[] for _ in range(len(root) + 1)]
    of = slots_of(pages, root)
    for members in classes.values():
        # Tokens of one vector by chance, in different slots, are different classes.
        for slot in sorted({of[label] for label in members} - {None}):
            inside = [label for label in members if of[label] == slot]
            if repeats_one_order(pages, set(inside)):
                nested[slot].append(inside)
    repeated = {label for label in shared if label.startswith("#")} if len(pages) > 2 else set()
    at = {label: i + 1 for i, label in enumerate(root)}
    containers = {label for label in root if label[1:].split(" ")[0].rstrip(">") in CONTAINERS}
    links, amount = [0] * (len(root) + 1), [0] * (len(root) + 1)
    texts: Counter = Counter()
    for p in pages:
        stack: list[tuple[str, str]] = []
        slot = 0
        for kind, label, value in p.tokens:
            slot = at.get(label, slot)
            if kind != "text":
                step(stack, kind, label, value)
                if kind == "open" and value in MAIN:
                    texts[chain_of(stack, containers), slot] += 1  # an empty article is one, too
            elif size := len(label) - 1:
                amount[slot] += size
                links[slot] += size * any(name == "a" for _, name in stack)
                if label not in repeated:
                    texts[chain_of(stack, containers), slot] += size
    of_links = lambda classes: any(label == "<a>" or label.startswith("<a ") for c in classes for label in c)
    menus = {i for i, n in enumerate(amount) if 2 * links[i] > n and of_links(nested[i])}
    return Template(root, nested, menus, containers, main_chain(texts, menus), repeated)


def main_chain(texts: Counter, menus: set[int]) -> Chain | None:
    """Inwards from the whole page, the containers that hold the larger part; None where this ends in a dropped one or there is nothing."""
    weights: Counter = Counter()
    for (chain, slot), size in texts.items():
        value = size / (NAME_WEIGHT if slot in menus and not any(name in MAIN for _, name in chain) else 1.0)
        for x in chain:
            value *= weight(*x)
        weights[chain] += value
    here: Chain = ()
    while weights and not (here and here[-1][1] in MAIN and not is_dropped(*here[-1])):
        inside: Counter = Counter()
        for chain, value in weights.items():
            if len(chain) > len(here):
                inside[chain[len(here)]] += value
        best = max(inside, key=lambda x: (inside[x], x), default=None)
        if best is None or inside[best] < LARGER_PART * weights.total():
            break
        here = (*here, best)
        weights = Counter({c: v for c, v in weights.items() if c[: len(here)] == here})
    return None if not weights or any(is_dropped(*x) for x in here) else here


def ordered_by_all(pages: list[Page], once: set[str]) -> list[str]:
    """The labels of once in the order of the first page, without those that another page has elsewhere."""
    orders = [[label for _, label, _ in p.tokens if label in once] for p in pages]
    if not orders:
        return []
    rank = {label: i for i, label in enumerate(orders[0])}
    stray: set[str] = set()
    for order in orders[1:]:
        ranks = [rank[label] for label in order]
        best, low = len(ranks) * [0], len(ranks)
        for i in range(len(ranks) - 1, -1, -1):
            best[i], low = low, min(low, ranks[i])
        high = -1
        for i, r in enumerate(ranks):
            if r < high or r > best[i]:
                stray.add(order[i])
            high = max(high, r)
    return [label for label in orders[0] if label not in stray]


def slots_of(pages: list[Page], root: list[str]) -> dict[str, int | None]:
    """The slot that holds all tokens of a label; None if there are several."""
    at = {label: i + 1 for i, label in enumerate(root)}
    found: dict[str, int | None] = {}
    for p in pages:
        slot = 0
        for _, label, _ in p.tokens:
            slot = at.get(label, slot)
            if found.setdefault(label, slot) != slot:
                found[label] = None
    return found


def repeats_one_order(pages: list[Page], members: set[str]) -> bool:
    """Whether the tokens of a class come in one order on all pages, again and again."""
    cycle: list[str] | None = None
    for p in pages:
        seen = [label for _, label, _ in p.tokens if label in members]
        if cycle is None:
            cycle = seen[: len(members)]
        if len(set(cycle)) != len(members) or any(x != cycle[i % len(cycle)] for i, x in enumerate(seen)):
            return False
    return True


def extract(page: Page, template: Template) -> str:
    """The page's text in the template's main container: blocks in page order, one space between them.

    Elements end at their own closing tags, which need not be tokens of the template, so each text node is judged by
    the elements that are open at it on its page. Left out are dropped elements and, outside of a named article, the
    template's lists of links and texts that all pages repeat. A page's own articles, which the template hasn't, are
    the main text if the template's container isn't one.
    """
    if template.main is None:
        return ""
    main, depth = template.main, len(template.main)
    at = {label: i + 1 for i, label in enumerate(template.root)}
    own_articles = not template.named and any(k == "open" and name in MAIN and not is_dropped(label, name) for k, label, name in page.tokens)
    stack, blocks, current, slot = [], [], [], 0
    for kind, label, value in page.tokens:
        slot = at.get(label, slot)
        if kind == "text":
            chain = chain_of(stack, template.containers)
            if chain[:depth] == main and (template.named or slot not in template.menus and label not in template.repeated):
                inner = stack[stack.index(main[-1]) + 1 :] if main else stack
                if own_articles:
                    first = next((i for i, (mark, name) in enumerate(inner) if name in MAIN and not is_dropped(mark, name)), None)
                    inner = None if first is None else inner[first + 1 :]
                if inner is not None and not any(is_dropped(*x) for x in inner):
                    current.append(value)
            continue
        if value not in INLINE:
            blocks.append("".join(current))
            current = []
        step(stack, kind, label, value)
    blocks.append("".join(current))
    return " ".join(" ".join(blocks).split())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """<id_col>, <url_col>, text, n_chars for every page.

    A null or empty page has the empty text, and pages without a host form groups of their own. Ids may repeat
    or be null: each row is a page. An empty table gives no rows; other columns are ignored. The pages of a host
    are sorted by a hash and taken GROUP_PAGES at a time; hosts of more than PART_PAGES pages are dealt over several
    tasks first, by a table of at most HOT_HOSTS hosts.
    """
    named = pages.select(
        pages[id_col].cast("bigint").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    hosts = split_url(named, "id", "url").groupBy("host").count()
    total = hosts.agg(F.sum("count")).first()[0] or 0
    share = max(float(PART_PAGES), total / HOT_HOSTS)
    hot = hosts.where(F.col("count") > share).select("host", F.ceil(F.col("count") / share).cast("int").alias("parts"))
    at = F.instr("url", "://")
    host = F.when(at > 0, F.translate(F.regexp_extract(F.col("url").substr(at + 3, F.length("url")), "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")
    dealt = named.withColumn("host", F.coalesce(host, F.lit(""))).join(F.broadcast(hot), "host", "left")
    dealt = dealt.withColumn("mixed", F.xxhash64("id", "url"))
    dealt = dealt.withColumn("salt", F.pmod("mixed", F.coalesce("parts", F.lit(1))))
    dealt = dealt.repartition("host", "salt").sortWithinPartitions("host", "mixed", "id").select("id", "url", "html", "host")
    names = ["id", "url", "text"]

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)

    def groups(batches):
        for _, same in groupby(rows(batches), key=lambda r: r[3]):
            group = []
            for r in same:
                group.append(r)
                if len(group) == GROUP_PAGES:
                    yield group
                    group = []
            if group:
                yield group

    def run(batches):
        for group in groups(batches):
            parsed = [parse(r[2] or "") for r in group]
            template = deduce(parsed)
            texts = [extract(p, template) for p in parsed]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in group], pa.int64()), pa.array([r[1] for r in group], pa.string()), pa.array(texts, pa.string())], names=names)

    found = map_arrow(dealt, run, "id bigint, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars"))
