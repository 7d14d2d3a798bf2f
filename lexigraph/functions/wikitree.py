"""Marked-up article text as a tree: one pass of a lexer, one stack of open brackets.

Nodes are templates, links, outer links and tables; everything else is text. A closing mark
closes the nearest bracket of its kind; brackets left open on the way, or at the end of the
text, become part of what they stand in (``closed`` is false) and a reader decides what they
mean. References, formulas, comments and the like never reach the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

# Tags whose content isn't prose.
HIDDEN = "ref gallery math timeline imagemap score syntaxhighlight source hiero templatedata mapframe maplink references chem ce pre graph"

OPENERS = {"{{": "template", "[[": "link", "{|": "table", "[": "outer"}
CLOSERS = {"}}": "template", "]]": "link", "|}": "table", "]": "outer"}


@dataclass
class Node:
    kind: str
    parts: list[str | Node] = field(default_factory=list)
    closed: bool = True

    def head(self) -> str:
        """The text before anything nested."""
        return self.parts[0] if self.parts and isinstance(self.parts[0], str) else ""

    def cells(self) -> list[list[str | Node]]:
        """The parts between the bars of this level."""
        out: list[list[str | Node]] = [[]]
        for part in self.parts:
            if isinstance(part, str):
                first, *rest = part.split("|")
                out[-1].append(first)
                out += [[r] for r in rest]
            else:
                out[-1].append(part)
        return out


@cache
def _lexer(hidden: str) -> re.Pattern:
    names = "|".join(hidden.split())
    return re.compile(
        rf"<!--(?:.*?-->|.*)|<(?P<hidden>{names})\b(?P<rest>[^>]*)>|^[ \t]*(?P<open_table>\{{\|)|^[ \t]*(?P<close_table>\|\}})(?!\}})"
        r"|\{\{|\}\}|\[\[|\]\]|\[(?:(?:https?:|ftp:|mailto:)?//|mailto:)[^\s\]]*[ \t]*|\]",
        re.S | re.I | re.M,
    )


def _lexemes(text: str, hidden: str, open_ref_hides: bool) -> Iterator[tuple[str, str]]:
    """(mark, text): brackets with their mark, all other text with ''."""
    at = 0
    lexer = _lexer(hidden)
    while m := lexer.search(text, at):
        yield "", text[at : m.start()]
        at, shown = m.end(), m[0]
        if shown.startswith("<!--"):
            continue
        if name := m["hidden"]:
            if m["rest"].endswith("/"):
                continue
            if close := re.compile(rf"</{name}\s*>", re.I).search(text, at):
                at = close.end()
            elif open_ref_hides and name.lower() == "ref" and "/" not in m["rest"]:
                return
            else:
                yield "", shown
        elif m["open_table"]:
            yield "{|", ""
        elif m["close_table"]:
            yield "|}", shown
        elif shown[0] == "[" and shown[:2] != "[[":
            yield "[", ""
        else:
            yield shown, "]" if shown == "]" else ""
    yield "", text[at:]


def parse(text: str, hidden: str = HIDDEN, open_ref_hides: bool = True) -> Node:
    root = Node("root")
    stack = [root]

    def close_top(closed: bool) -> None:
        node = stack.pop()
        node.closed = closed
        stack[-1].parts.append(node)

    for mark, shown in _lexemes(text, hidden, open_ref_hides):
        if kind := OPENERS.get(mark):
            stack.append(Node(kind))
        elif kind := CLOSERS.get(mark):
            if any(n.kind == kind for n in stack):
                while stack[-1].kind != kind:
                    close_top(False)
                close_top(True)
            elif shown:
                stack[-1].parts.append(shown)
        elif shown:
            stack[-1].parts.append(shown)
    while len(stack) > 1:
        close_top(False)
    return root
