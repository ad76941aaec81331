"""Texts under revision: pieces that remember which part of the original they stand for.

Each pass proposes replacements in the text as it is. A draft applies them to its pieces, so the edits of any number of
passes are always known in the coordinates of the original and of the result, without being composed afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

EDIT = T.StructType([
    T.StructField("layer", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("original", T.StringType()),
    T.StructField("replacement", T.StringType()), T.StructField("out_start", T.IntegerType()), T.StructField("out_end", T.IntegerType()),
])
EDITED = T.StructType([T.StructField("text", T.StringType()), T.StructField("edits", T.ArrayType(EDIT))])


@dataclass(frozen=True)
class Change:
    """Put ``new`` in the place of [start, end) of the present text. Of changes that meet, that of the lowest weight names the
    edit, of equal ones the earlier."""

    start: int
    end: int
    new: str
    layer: int
    rule: str
    part: str = ""
    weight: int = 1
    locked: bool = False


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    text: str
    by: Change | None = None


class Draft:
    def __init__(self, text: str):
        self.original = text
        self.pieces = [Piece(0, len(text), text)] if text else []

    @property
    def text(self) -> str:
        return "".join(p.text for p in self.pieces)

    def locked(self) -> list[tuple[int, int]]:
        """Places of the present text that no later pass may touch."""
        out, at = [], 0
        for p in self.pieces:
            if p.by and p.by.locked:
                out.append((at, at + len(p.text)))
            at += len(p.text)
        return out

    def revise(self, changes: list[Change]) -> None:
        """Apply changes that don't overlap one another, the last first, so that places before it stay right."""
        changes = sorted(changes, key=lambda c: (c.start, c.end))
        if any(a.end > b.start for a, b in zip(changes, changes[1:], strict=False)):
            raise ValueError("changes of one pass overlap")
        for c in reversed(changes):
            self._cut(c.start)
            self._cut(c.end)
            met, slot, at = [], 0, 0
            for i, p in enumerate(self.pieces):
                end = at + len(p.text)
                if at < c.end and end > c.start:
                    met.append((i, at, p))
                elif end <= c.start:
                    slot = i + 1
                at = end
            if not met:
                place = self.pieces[slot - 1].end if slot else 0
                self.pieces.insert(slot, Piece(place, place, c.new, c))
                continue
            (i, a, first), (j, b, last) = met[0], met[-1]
            text = first.text[: max(0, c.start - a)] + c.new + last.text[c.end - b :]
            by = min([p.by for _, _, p in met if p.by] + [c], key=lambda x: x.weight)
            self.pieces[i : j + 1] = [Piece(first.start, last.end, text, by)]

    def _cut(self, x: int) -> None:
        """Part an untouched piece at a place of the present text."""
        at = 0
        for i, p in enumerate(self.pieces):
            if at < x < at + len(p.text) and p.by is None:
                k = x - at
                self.pieces[i : i + 1] = [Piece(p.start, p.start + k, p.text[:k]), Piece(p.start + k, p.end, p.text[k:])]
                return
            at += len(p.text)

    def edits(self) -> list[tuple]:
        """(layer, rule, part, start, end, original, replacement, out_start, out_end) of what differs from the original."""
        out, at = [], 0
        for p in self.pieces:
            if p.by and p.text != self.original[p.start : p.end]:
                out.append((p.by.layer, p.by.rule, p.by.part, p.start, p.end, self.original[p.start : p.end], p.text, at, at + len(p.text)))
            at += len(p.text)
        return out


def apply(text: str, edits) -> str:
    """``text`` with edits (start, end, replacement) in its own coordinates made."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])
