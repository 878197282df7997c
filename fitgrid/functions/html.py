"""Visible fragments of one HTML page; the only page work done in Python workers."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Tags that end themselves, are passed over, head a section, or hold a piece of text.
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_SKIPPED = frozenset(("script", "style", "template", "nav", "footer", "noscript"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BLOCKS = frozenset(("p", "li", "pre", "blockquote", "td", "th", "dd", "dt"))
# An opening tag on the left ends an open element of the right.
_ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
_ENDS_P = frozenset((
    "p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "header",
    "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "form", "hr",
))
_SCOPES = frozenset(("ul", "ol", "dl", "table", "body", "main", "section", "article", "div", "html"))
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "attrs", "line", "items")

    def __init__(self, tag, attrs, line):
        self.tag, self.attrs, self.line, self.items = tag, attrs, line, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, 1)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.getpos()[0])
        self.open[-1].items.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return
            if self.open[depth].tag in _SCOPES and tag not in _SCOPES:
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


def _find(node, test):
    todo = [node]
    while todo:
        current = todo.pop()
        if isinstance(current, _Node):
            if current.tag and test(current):
                return current
            todo.extend(reversed(current.items))
    return None


def _company(node):
    return "data-company" in node.attrs or node.attrs.get("itemtype", "").endswith("/Organization")


def _left_out(node, job):
    a = node.attrs
    return (node.tag in _SKIPPED or "hidden" in a or a.get("aria-hidden") == "true"
            or bool(_HIDDEN.search(a.get("style", ""))) or (job and _company(node)))


def _text(node, job):
    """All visible text below a node, white space folded."""
    out, todo = [], [node]
    while todo:
        current = todo.pop()
        if isinstance(current, str):
            out.append(current)
        elif not _left_out(current, job):
            todo.extend(reversed(current.items))
    return _SPACE.sub(" ", " ".join(out)).strip()


def _walk(root, job):
    """(text, locator, section) in page order; loose text between blocks becomes a gap."""
    found, loose, section = [], [], None
    gaps = 0

    def flush(label):
        nonlocal gaps
        text = _SPACE.sub(" ", " ".join(loose)).strip()
        loose.clear()
        if text:
            gaps += 1
            found.append((text, f"{root.tag}:line-{root.line}:gap-{gaps}", label))

    def emit(node, text, label):
        if text:
            flush(found[-1][2] if found else None)
            found.append((text, f"{node.tag}:line-{node.line}", label))

    todo = list(reversed(root.items))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            loose.append(node)
        elif _left_out(node, job):
            continue
        elif node.tag in _HEADINGS:
            text = _text(node, job)
            section = text or section
            emit(node, text, section)
        elif node.tag == "tr":
            cells = [c for c in node.items if isinstance(c, _Node) and c.tag in ("th", "td")]
            label = _text(cells[0], job) if cells and cells[0].tag == "th" else section
            emit(node, _text(node, job), label)
        elif node.tag == "dl":
            pair = None
            for child in [c for c in node.items if isinstance(c, _Node) and not _left_out(c, job)] + [None]:
                if child is None or child.tag == "dt":
                    if pair:
                        emit(pair[0], " ".join(p for p in pair[1:] if p), pair[1])
                    pair = [child, _text(child, job)] if child is not None else None
                elif pair:
                    pair.append(_text(child, job))
                else:
                    emit(child, _text(child, job), section)
        elif node.tag in _BLOCKS:
            emit(node, _text(node, job), section)
        else:
            todo.extend(reversed(node.items))
    flush(found[-1][2] if found else None)
    return found


def page_fragments(html: str) -> list[tuple[str, int, str, str, str | None]]:
    """(scope, position, text, locator, section) of the job part and the company part of a page."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    job = None
    for test in (
        lambda n: "data-job" in n.attrs, lambda n: n.attrs.get("itemtype", "").endswith("/JobPosting"),
        lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "body",
    ):
        job = _find(tree.root, test)
        if job is not None:
            break
    rows = []
    for scope, root in (("job", job), ("company", _find(tree.root, _company))):
        if root is not None:
            for position, (text, locator, section) in enumerate(_walk(root, scope == "job"), start=1):
                rows.append((scope, position, text, locator, section))
    return rows
