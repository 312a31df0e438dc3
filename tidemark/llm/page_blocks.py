"""The blocks of text of an HTML page, with what its markup says of them."""

from __future__ import annotations

import re
from html import unescape

# Elements of the HTML standard, and common names of page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FURNITURE = frozenset("nav aside footer template noscript svg button select dialog menu object canvas audio video map head datalist".split())
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar footer sidebar aside rail widget widgets "
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search searchbox "
    "share sharing social related recommended recommendations trending toolbar skip copyright legal complementary contentinfo".split()
)
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion responses".split())
PARTS = re.compile(r"^(?:cookie|sidebar|breadcrumb|newsletter|navbar|advert|footer|comments?(?:list|section|area|form))|(?:sidebar|navbar|footer|menu|banner|comments)$")
NEGATIVE = frozenset("has with without no".split())
BODIES = frozenset("article post entry story".split())
BODY_PARTS = frozenset("body content text".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|aria-hidden|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*|[0-9]+")

#: States: nothing dropped, dropped by a name (an article inside is read all the same), dropped for good.
READ, SOFT, HARD = 0, 1, 2


def _names(text: str) -> list[str]:
    return [w.lower() for part in re.split(r"[^A-Za-z0-9]+", text) for w in ([part] if part.islower() or part.isupper() else _NAME.findall(part))]


def _marks(name: str, attributes: str, level: int) -> tuple[int, int]:
    """What an opening tag's attributes say: dropping, and whether it holds an article (2) or the page's content (1)."""
    drop, inside = READ, 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                drop = HARD
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            drop = HARD
        elif key == "itemprop":
            if value.lower() == "articlebody":
                inside = 2
        elif key in ("class", "id", "role") and name not in ("html", "body"):
            for one in value.split():
                words = _names(one)
                if key == "role" and one.lower() == "main":
                    inside = max(inside, 2)
                elif NEGATIVE.intersection(words):
                    continue
                elif READERS.intersection(words) or PARTS.search(one.lower()) and "comment" in one.lower():
                    drop = HARD
                elif words and (found := WORDS.intersection(words) or PARTS.search("".join(words))):
                    if found == {"header"} and (level or BODIES.intersection(words)):
                        continue
                    drop = max(drop, SOFT)
                elif len(words) > 1 and BODIES.intersection(words) and BODY_PARTS.intersection(words) or words in (["article"], ["articlebody"]):
                    inside = max(inside, 2)
                elif words in (["content"], ["main"], ["main", "content"]):
                    inside = max(inside, 1)
    return drop, inside


def blocks(html: str) -> list[tuple[str, int, bool]]:
    """Each visible block as its text, level (2: in an article, 1: in the page's content, 0: else) and whether it is only links.

    Dropped are the elements whose name, class, id or role marks them as furniture or as readers' comments, hidden ones, forms,
    scripts and comments. An article inside of furniture by name alone is read. Unclosed elements end where an element around them does,
    a paragraph where a block begins. A tag that never ends drops the rest of the page, as does an unclosed script.
    Character references are decoded, white space becomes one space.
    """
    found: list[tuple[str, int, bool]] = []
    held: list[str] = []
    links = [0, 0]  # characters in links, and all
    stack: list[tuple[str, tuple[int, int]]] = []
    opened: dict[str, int] = {}
    state, link, at, tag = (READ, 0), False, 0, _TAG
    n, last = len(html), html.rfind(">")

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                found.append((text, state[1], links[0] == links[1]))
            held.clear()
        links[:] = 0, 0

    def say(text: str) -> None:
        if state[0] == READ and text:
            held.append(text)
            size = len(text) - text.count(" ")
            links[1] += size
            links[0] += size if link else 0

    def close(name: str) -> None:
        nonlocal state
        while stack:
            one, state = stack.pop()
            opened[one] -= 1
            if one == name:
                return

    def push(name: str, new: tuple[int, int]) -> None:
        nonlocal state
        stack.append((name, state))
        opened[name] = opened.get(name, 0) + 1
        state = new

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        follow = html[lt + 1 : lt + 2]
        if follow in ("!", "?"):
            comment = html.startswith("<!--", lt)
            end = html.find("-->", lt + 4) if comment else html.find(">", lt)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        if not (follow.isascii() and (follow.isalpha() or follow == "/")):
            say("<")
            at = lt + 1
            continue
        if lt > last:
            break
        m = tag.match(html, lt)
        if m is None:
            if tag is _TAG and follow != "/":
                tag = _LOOSE
                m = tag.match(html, lt)
            if m is None:
                at = html.find(">", lt) + 1
                continue
        at = m.end()
        end, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if name == "a":
            link = not end
        if name in RAW:
            if not end and not attributes.rstrip().endswith("/"):
                shut = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = shut.end() if shut else n
            continue
        block = name not in INLINE
        if block:
            flush()
            link = False
            if stack and stack[-1][0] == "p" and name != "span":
                close("p")
        elif name == "br":
            say(" ")
        if end:
            if opened.get(name):
                if not block:
                    flush()
                close(name)
            continue
        if name in VOID:
            continue
        drop, inside = _marks(name, attributes, state[1]) if attributes else (READ, 0)
        if name in FURNITURE or name == "header" and not state[1] and drop == READ:
            drop = max(drop, HARD if name not in ("header", "menu", "dialog") else SOFT)
        elif name == "form":
            drop = max(drop, SOFT)
        if name in ("article", "main") and drop < HARD:
            drop, inside = READ, 2
        if name == "body":
            while opened.get("head"):
                close("head")
            drop = READ
        if name == "li" and stack and stack[-1][0] == "li":
            close("li")
        if state[0] == HARD:
            new = state
        elif inside == 2 and drop == READ:
            new = (READ, 2)
        else:
            new = (max(state[0], drop), max(state[1], inside if drop == READ else 0))
        if block and name != "p" or new != state:
            if new != state and held:
                flush()
            push(name, new)
    flush()
    return found


def lines(html: str) -> tuple[list[str], bool]:
    """The lines that may be main text, and whether the markup names an article: its blocks where there are any, else those of the page's content, else all blocks that are not only links."""
    found = blocks(html)
    level = max((x[1] for x in found), default=0)
    if level == 2:
        return [t for t, of, _ in found if of == 2], True
    return [t for t, of, only in found if of == level and not only], False
