"""Pages parsed as trees, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags that a start tag of the same kind closes.
CLOSES_ITSELF = {"p", "li", "tr", "td", "th", "option", "dd", "dt"}
BLOCKS = {"p", "li", "div", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article"}
CHROME = {"script", "style", "noscript", "svg", "nav", "footer", "header", "form", "button"}
LEAST_MAIN = 200


class Node:
    """An element: its tag, attributes, children (nodes and text) and parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def find(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def closest(self, test: Callable[[Node], bool]) -> Node | None:
        node: Node | None = self
        while node is not None and not test(node):
            node = node.parent
        return node

    def text(self, skip: Callable[[Node], bool] | None = None) -> str:
        return "".join(c if isinstance(c, str) else "" if skip and skip(c) else c.text(skip) for c in self.children)

    def has_class(self, part: str) -> bool:
        return part.lower() in self.attrs.get("class", "").lower()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_ITSELF and self.at.tag == tag:
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def is_chrome(n: Node) -> bool:
    classes, own = n.attrs.get("class", "").lower(), n.attrs.get("id", "").lower()
    return n.tag in CHROME or n.attrs.get("role") == "dialog" or "modal" in classes.split() or "cookie" in classes or "cookie" in own


def collapse(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def block_text(node: Node) -> str:
    """A node's text with a line for each block, without navigation, scripts and forms."""
    if node.closest(is_chrome) is not None:
        return ""

    def gather(n: Node) -> str:
        parts = [c if isinstance(c, str) else "" if is_chrome(c) else "\n" if c.tag == "br" else gather(c) for c in n.children]
        return "".join(parts) + ("\n" if n.tag in BLOCKS else "")

    text = re.sub("[ \t ]+", " ", gather(node))
    return re.sub("\n{3,}", "\n\n", re.sub(" *\n *", "\n", text)).strip()


def main_text(root: Node) -> str:
    """The longest candidate for a page's content, or the whole body where none is long enough."""

    def candidate(n: Node) -> bool:
        named = n.attrs.get("class", "").lower()
        return n.tag in ("main", "article") or n.attrs.get("role") == "main" or any(w in named for w in ("descr", "detail", "content")) or "content" in n.attrs.get("id", "").lower()

    longest = max((block_text(n) for n in root.find(candidate)), key=len, default="")
    if len(longest) >= LEAST_MAIN:
        return longest
    return block_text(root.first(lambda n: n.tag == "body") or root)


EMAIL = re.compile(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", re.I)
FILE = re.compile(r"\.(png|jpe?g|gif|svg|webp|js|css)$", re.I)


def emails(root: Node) -> list[str]:
    """Addresses of mailto links, then of the text, outside of header, footer and navigation."""
    frame = {"header", "footer", "nav"}
    hidden = frame | {"script", "style", "noscript", "template"}
    links = root.find(lambda n: n.tag == "a" and n.attrs.get("href", "").lower().startswith("mailto:") and n.closest(lambda p: p.tag in frame) is None)
    texts = [n.attrs["href"][7:].split("?")[0] for n in links]
    texts.append((root.first(lambda n: n.tag == "body") or root).text(lambda n: n.tag in hidden))
    found = [e.lower() for t in texts for e in EMAIL.findall(t)]
    return list(dict.fromkeys(e for e in found if not FILE.search(e)))


def _text_of(node: Node | None) -> str:
    return collapse(node.text()) if node else ""


def _labelled_cards(root: Node, base: str) -> list[dict]:
    """prace.cz: cards of labelled list items."""
    fields = {"lokalita": "location", "nazev firmy": "company", "plat": "salary", "typ uvazku": "work_type"}
    out = []
    for link in root.find(lambda n: n.tag == "a" and n.attrs.get("data-testid") == "advert-link" and n.attrs.get("href")):
        card = link.closest(lambda n: n.has_class("StackItem"))
        row = {"url": urljoin(base, link.attrs["href"]), "title": _text_of(link)}
        for item in card.find(lambda n: n.tag == "li") if card else []:
            label, colon, value = _text_of(item).partition(":")
            name = fields.get(_fold(label))
            if colon and name:
                row[name] = collapse(value)
        out.append(row)
    return out


def _fold(text: str) -> str:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub("[^a-z0-9]+", " ", bare.lower()).strip()


#: What the parts of two boards' cards look like. A selector is a tag, `.part of a class` or `tag[part of href]`; several are tried in turn.
CARD_RULES = {
    "startupjobs": {
        "card": "a[/nabidka/]",
        "title": (".font-semibold", "h2", "h3"),
        "company": (".line-clamp",),
        "facts": ("li",),
        "kinds": {
            "salary": r"\d.*(kč|czk|eur|€|usd)|(kč|czk|eur|€|usd).*\d",
            "mode": r"remote|hybrid|onsite|on-site|vzdálen",
            "hours": r"full-time|part-time|contract|intern|freelance|plný|zkrácený|brigád",
        },
    },
    "jobstack": {
        "card": "a.jobpost-mainlink",
        "only": "/it-job/",
        "title": ("h3",),
        "salary": (".jobposts-item_salary",),
        "facts": (".custom-profile-label--secondary",),
        "kinds": {"location": r"\d{3} ?\d{2}\b|\d+/\d+"},
        "modes": (".custom-profile-label",),
        "mode": r"remote|hybrid|home ?office|on-?site",
    },
}


def _selected(node: Node, selector: str) -> list[Node]:
    tag, _, href = selector.partition("[")
    tag, _, part = tag.partition(".")
    fits = lambda n: (not tag or n.tag == tag) and (not part or n.has_class(part)) and (not href or href.rstrip("]") in n.attrs.get("href", ""))
    return list(node.find(fits))


def _texts(node: Node, selectors: tuple[str, ...]) -> list[str]:
    return [_text_of(n) for s in selectors for n in _selected(node, s)]


def by_kind(texts: list[str], kinds: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """(the first text of each kind, the texts that are none of these) for kinds given by patterns."""
    found: dict[str, str] = {}
    for text in texts:
        for kind, pattern in kinds.items():
            if re.search(pattern, text, re.I):
                found.setdefault(kind, text)
    return found, [t for t in texts if t not in found.values()]


def _ruled_cards(board: str):
    """Cards read by the board's rules: facts without a place of their own are told apart by kind, and the rest goes by position."""
    rule = CARD_RULES[board]

    def read(root: Node, base: str) -> list[dict]:
        out = []
        for card in _selected(root, rule["card"]):
            url = urljoin(base, card.attrs.get("href", ""))
            if rule.get("only", "") not in url:
                continue
            facts = _texts(card, rule["facts"])
            found, rest = by_kind(facts, rule["kinds"])
            row = {"url": url, "title": _card_title(card, rule["title"]), "salary": found.get("salary") or next(iter(_texts(card, rule.get("salary", ()))), None) or None}
            if "company" in rule:  # what is left over is the place
                row |= {"company": next(iter(_texts(card, rule["company"])), None) or None, "location": next(iter(rest), None), "work_type": ", ".join(found[k] for k in ("mode", "hours") if k in found) or None}
            else:  # company first, place second, unless the place shows
                place = found.get("location") or next(iter(facts[1:2]), None)
                modes = [m for m in _texts(card, rule["modes"]) if re.search(rule["mode"], m, re.I)]
                row |= {"company": next((f for f in facts if f != place), None), "location": place or None, "work_type": next(iter(modes), None)}
            out.append(row)
        return out

    return read


def _card_title(card: Node, selectors: tuple[str, ...]) -> str:
    """The first of the selected nodes with words, badges in it left out; else all the card says, where more than one selector was tried."""
    heads = [n for s in selectors for n in _selected(card, s)[:1]]
    said = (collapse(n.text(lambda x: x.tag == "span")) or (_text_of(n) if n.tag.startswith("h") else "") for n in heads)
    return (next((t for t in said if t), "") or (_text_of(card) if len(selectors) > 1 else ""))[:200]


_PLACE_HINT = re.compile(r"praha|brno|ostrava|plzeň|olomouc|liberec|remote|home\s?office|,", re.I)


def _result_cards(root: Node, base: str) -> list[dict]:
    """jobs.cz: result cards with a footer of facts."""
    out = []
    for card in root.find(lambda n: n.tag == "article" and n.has_class("SearchResultCard")):
        link = card.first(lambda n: n.tag == "a" and "data-jobad-id" in n.attrs)
        if link is None:
            continue
        test = lambda n, word: word in n.attrs.get("data-test", "").lower()
        foot = [_text_of(n) for n in card.find(lambda n: n.has_class("footerItem") or (n.tag == "li" and n.closest(lambda p: p.tag == "footer") is not None))]
        logo = card.first(lambda n: n.tag == "img" and n.closest(lambda p: p.has_class("SearchResultCard__logo")) is not None)
        company = _text_of(card.first(lambda n: n.has_class("companyName") or test(n, "company"))) or (logo.attrs.get("alt", "").strip() if logo else "") or (foot[0] if foot else "")
        place = _text_of(card.first(lambda n: test(n, "locality") or n.has_class("locality"))) or next((f for f in foot if _PLACE_HINT.search(f)), "")
        out.append({
            "url": urljoin(base, link.attrs.get("href", "")), "title": _text_of(link), "company": company, "location": place,
            "salary": _text_of(card.first(lambda n: n.has_class("salary") or test(n, "salary"))) or None, "posted": _text_of(card.first(lambda n: n.has_class("status"))) or None,
        })
    return out


def _thumbnail_cards(root: Node, base: str) -> list[dict]:
    """cocuma.cz: thumbnails; titles are matched against the query afterwards."""
    out = []
    for card in root.find(lambda n: n.tag == "a" and "/job/" in n.attrs.get("href", "")):
        title = _text_of(card.first(lambda n: n.has_class("job-thumbnail-title"))) or card.attrs.get("title", "").strip()
        out.append({
            "url": urljoin(base, card.attrs["href"]), "title": title, "company": _text_of(card.first(lambda n: n.has_class("job-thumbnail-company"))) or None,
            "location": _text_of(card.first(lambda n: n.has_class("location") or n.has_class("city"))) or None,
            "work_type": _text_of(card.first(lambda n: n.has_class("job-thumbnail-work-shedule") or n.has_class("schedule"))) or None,
        })
    return out


def _position_cards(root: Node, base: str) -> list[dict]:
    """skilleto.cz: positions inside job cards."""
    out = []
    for link in root.find(lambda n: n.tag == "a" and "/jobs/" in n.attrs.get("href", "")):
        card = link.closest(lambda n: n.has_class("_job_"))
        within = lambda test: _text_of(card.first(test)) if card else ""  # noqa: E731, B023
        company = within(lambda n: (n.has_class("_name") and n.closest(lambda p: p.has_class("_company")) is not None) or (n.tag == "a" and "/company/" in n.attrs.get("href", "")))
        out.append({
            "url": urljoin(base, link.attrs["href"]), "title": collapse(link.text().replace("\U0001f4cd", "")), "company": company or None,
            "location": within(lambda n: n.has_class("_location")) or None, "salary": collapse(within(lambda n: n.has_class("_money")).replace("*", "", 1)) or None,
        })
    return out


BOARDS = {
    "jobscz": ("https://www.jobs.cz", _result_cards),
    "cocuma": ("https://www.cocuma.cz", _thumbnail_cards),
    "pracecz": ("https://www.prace.cz", _labelled_cards),
    "startupjobs": ("https://www.startupjobs.cz", _ruled_cards("startupjobs")),
    "jobstack": ("https://www.jobstack.it", _ruled_cards("jobstack")),
    "skilleto": ("https://www.skilleto.cz", _position_cards),
}
_NAMES = ("url", "title", "company", "location", "salary", "work_type", "posted")
CARD = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _NAMES]))


def cards(board: str, html: str | None) -> list[tuple]:
    """A listing page's cards with a title, each URL once."""
    base, read = BOARDS[board]
    seen: dict[str, tuple] = {}
    for row in read(parse(html), base):
        if row["title"] and row["url"] not in seen:
            seen[row["url"]] = tuple(row.get(n) for n in _NAMES)
    return list(seen.values())


@F.pandas_udf(CARD)
def cards_of(board: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(_NAMES, c, strict=True)) for c in cards(b, h)] if b in BOARDS else [] for b, h in zip(board, html, strict=True)])


@F.pandas_udf(T.StringType())
def page_main_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: main_text(parse(h)), na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_emails(html: pd.Series) -> pd.Series:
    return html.map(lambda h: emails(parse(h)), na_action=None)


@F.pandas_udf(T.StringType())
def absolute_url(href: pd.Series, base: pd.Series) -> pd.Series:
    """A link resolved against its page; null unless it is http or https."""

    def one(h: str | None, b: str | None) -> str | None:
        try:
            url = urljoin(b or "", h or "")
        except ValueError:
            return None
        return url if h and url.lower().startswith("http") else None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)])


#: Where boards keep a posting's description, by class, id or attribute; the first place with a complete text wins.
DETAIL_PLACES = {
    "jobscz": (
        (("class", "cp-detail__content"), ("class", "m-detail__description")),
        (("data-jobad", "body"), ("data-test", "jd-body-richtext"), ("class", "RichContent")),
        (("id", "vacancy-detail"),),
    ),
}
PROFILE_SECTION, LEAST_SECTION = "company-profile-component", 40
DETAIL = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "body", "main", "meta")] + [T.StructField("emails", T.ArrayType(T.StringType()))])


def _stands_at(node: Node, place: tuple[str, str]) -> bool:
    name, value = place
    said = node.attrs.get(name, "")
    return value in said.split() if name == "class" else said == value


def detail(board: str, page: str) -> tuple:
    """(first heading, description, main text, meta line, addresses) of a posting's page; the description is empty unless it is complete."""
    root = parse(page)
    main = main_text(root)
    if board == "cocuma":  # the sections of the company's profile that say something, else the page
        sections = [block_text(n) for n in root.find(lambda n: _stands_at(n, ("class", PROFILE_SECTION)))]
        body = "\n\n".join(x for x in sections if len(x) > LEAST_SECTION) or main
    else:
        texts = ("\n".join(filter(None, (block_text(n) for n in root.find(lambda n: any(_stands_at(n, at) for at in places))))) for places in DETAIL_PLACES.get(board, ()))  # noqa: B023
        body = next((x for x in texts if len(x) >= LEAST_MAIN), "")
    metas = root.find(lambda n: n.tag == "meta" and n.attrs.get("content", "").strip() != "")
    said = [m.attrs["content"].strip() for key, name in (("property", "og:description"), ("name", "description")) for m in metas if m.attrs.get(key) == name]
    return _text_of(root.first(lambda n: n.tag == "h1")), body, main, next(iter(said), ""), emails(root)


@F.pandas_udf(DETAIL)
def detail_of(board: pd.Series, page: pd.Series) -> pd.DataFrame:
    """detail() of each page, nulls without a page."""
    read = [detail(b, p) if p is not None else (None,) * len(DETAIL.names) for b, p in zip(board, page, strict=True)]
    return pd.DataFrame(read, columns=DETAIL.names)


@F.pandas_udf(T.IntegerType())
def links_with(page: pd.Series, part: pd.Series) -> pd.Series:
    """How many links of a page hold `part` in their address; 0 without a page."""
    return pd.Series([len(parse(p).find(lambda n: n.tag == "a" and w in n.attrs.get("href", ""))) for p, w in zip(page, part, strict=True)])  # noqa: B023


def longest_description(*candidates: Column, least: int = 200) -> Column:
    """The first candidate of at least `least` characters, empty without one."""
    return F.coalesce(*(F.when(F.length(c) >= least, c) for c in candidates), F.lit(""))
