"""A forgiving HTML reader: pages as trees of elements with their text in page order."""

from __future__ import annotations

import html
import re

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body dd dt head html legend li noscript optgroup option select summary tbody td template tfoot th thead title tr".split())
UNREAD = frozenset("script style template noscript iframe object svg math canvas noframes".split())
RAW = frozenset("script style iframe noframes xmp textarea title".split())
P_ENDED = (("p",), ("table", "td", "th", "button", "object"))
# An open element of the left is ended by a start tag of the right, unless one of the last column stands between.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tr"), ("table",)),
    "tfoot": (("thead", "tbody", "tr"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?P<stop>>)|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?P<stop2>>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
RAW_END = {n: re.compile(rf"</{n}\b[^>]*>?", re.IGNORECASE) for n in RAW}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Elements in the order of their start tags, element 0 being the page itself; and pieces of text with their element and block."""

    def __init__(self) -> None:
        self.tag: list[str] = [""]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.marks: list[list[str]] = [[]]
        self.text: list[tuple[int, int, str]] = []


def parse(source: str) -> Page:
    page = Page()
    tag, parent, depth, marks, text = page.tag, page.parent, page.depth, page.marks, page.text
    stack = [0]
    where: dict[str, list[int]] = {}  # name -> places in the stack of the open elements of that name
    block, at, unread = 0, 0, 0

    def close(k: int) -> None:
        """End the k-th open element and those in it."""
        nonlocal block, unread
        for node in stack[k:]:
            name = tag[node]
            block += name in BLOCK
            unread -= name in UNREAD
        for node in reversed(stack[k:]):
            where[tag[node]].pop()
        del stack[k:]

    def last(names: tuple[str, ...]) -> int:
        """Where the innermost open element of these names stands in the stack, 0 if none is open; no walk over the stack."""
        return max([where[n][-1] for n in names if where.get(n)], default=0)

    search = TAG.search
    end = len(source)
    while at < end:
        m = search(source, at)
        upto = m.start() if m else end
        if upto > at and not unread:
            text.append((stack[-1], block, source[at:upto]))
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        if m["stop2"] == "":  # the page ends inside this tag
            break
        name = name.lower()
        if m["end"] or m["end2"]:
            if name in VOID:
                continue
            if k := last((name,)):
                close(k)
            else:
                block += name in BLOCK
            continue
        for ended, fence in ((P_ENDED,) if name in CLOSES_P else ()) + ((ENDED_BY[name],) if name in ENDED_BY else ()):
            if (k := last(ended)) > last(fence):
                close(k)
        node = len(tag)
        tag.append(name)
        parent.append(stack[-1])
        depth.append(depth[stack[-1]] + 1)
        rest = m["rest"] if m["rest"] is not None else m["rest2"]
        marks.append([f"{a.lower()}:{w.lower()}" for a, x, y, z in ATTRIBUTE.findall(rest) for w in WORD.findall(x or y or z)] if rest and "=" in rest else [])
        block += name in BLOCK
        if name == "br" and not unread:
            text.append((stack[-1], block, " "))
        if name in VOID or (rest.endswith("/") and name not in BLOCK and name not in RAW):
            continue
        if name in RAW:
            m = RAW_END[name].search(source, at)
            upto = m.start() if m else end
            if name not in UNREAD and not unread:
                text.append((node, block, source[at:upto]))
            at = m.end() if m else end
            block += name in BLOCK
            continue
        where.setdefault(name, []).append(len(stack))
        stack.append(node)
        unread += name in UNREAD
    return page


def blocks(page: Page, wanted: list[bool]) -> str:
    """The text of the wanted elements: one line per block, white space as one space, references decoded."""
    lines: list[str] = []
    parts: list[str] = []
    current = -1
    for node, block, piece in [*page.text, (0, -2, "")]:
        if block != current:
            if parts and (line := " ".join(html.unescape("".join(parts)).split())):
                lines.append(line)
            parts, current = [], block
        if wanted[node]:
            parts.append(piece)
    return "\n".join(lines)
