"""One pass over a tree's JSON text; a helper of the readers."""

from __future__ import annotations

import json
import re

COLUMNS = ["node_id", "ord", "parent_id", "depth", "title", "content", "summary", "embedding"]
_SPACE = re.compile(r"[ \t\r\n]*")


class _Text:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.value = text, 0, json.JSONDecoder().raw_decode

    def peek(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, wanted: str) -> str:
        c = self.peek()
        if not c or c not in wanted:
            raise ValueError(f"one of {wanted} expected at {self.at}")
        self.at += 1
        return c

    def read(self) -> object:
        self.peek()
        v, self.at = self.value(self.text, self.at)
        return v


def _row(own: dict, at: int, parent: str | None, depth: int) -> list:
    as_text = lambda k: own[k] if isinstance(own.get(k), str) else None if own.get(k) is None else json.dumps(own[k])
    v = own.get("embedding")
    vector = [float(x) for x in v] if isinstance(v, list) and v and all(isinstance(x, int | float) for x in v) else None
    return [as_text("node_id"), at, parent, depth, as_text("title"), as_text("content") or "", as_text("summary") or "", vector]


def nodes(text: str) -> list[list]:
    """Rows of the tree's nodes in pre-order; none if the text is not an object that is well
    formed. Open objects stand on a list, so depth is bounded by memory alone; what stands in
    ``nodes`` and is not an object is passed over; of a field that is given twice the last value
    counts."""
    t, out, open_ = _Text(text), [], []

    def start(at_root: bool) -> None:
        t.take("{")
        open_.append([{}, len(out), not at_root])
        out.append(None)

    try:
        start(True)
        first = True
        while open_:
            own = open_[-1][0]
            c = t.peek()
            if c == "}" and first:
                t.take("}")
            else:
                if not first:
                    c = t.take(",}")
                if first or c == ",":
                    if t.peek() != '"':
                        raise ValueError("a key expected")
                    key = t.read()
                    t.take(":")
                    if key == "nodes" and t.peek() == "[":
                        t.take("[")
                        first = _child(t, start)
                    else:
                        own[key] = t.read()
                        first = False
                    continue
            own, at, _ = open_.pop()
            out[at] = _row(own, at, None, len(open_)) + [open_[-1][1] if open_ else None]
            first = False
            if open_:
                first = _next(t, start)
        if t.peek():
            raise ValueError("text behind the tree")
    except ValueError:
        return []
    for r in out:
        above = r.pop()
        r[2] = None if above is None else out[above][0]
    return out


def _child(t: _Text, start) -> bool:
    """Into the first object of a list; False: there is none, and the list has ended."""
    if t.peek() == "]":
        t.take("]")
        return False
    if t.peek() == "{":
        start(False)
        return True
    t.read()
    return _next(t, start)


def _next(t: _Text, start) -> bool:
    """Into the next object of a list, if there is one before the list ends."""
    while t.take(",]") == ",":
        if t.peek() == "{":
            start(False)
            return True
        t.read()
    return False
