"""Whole-word highlighting of many entities in one pass over a text.

The result is that of replacing entity after entity, longest first, in the text as marked so far: a shorter entity is
found inside the span of a longer one, but not across its border, and also in the markup that earlier ones have put in.
One automaton of all entities (Aho-Corasick) finds every occurrence; the order of replacement is then replayed on
positions. A tag ends a stretch of text, so an occurrence counts if no tag stands inside it and what stands next to it is
a tag or no word character. A tag's own text is marked in the same way by the entities that come after it.

Entities with a character of markup (angle brackets, double quotes) could match across a tag's border; a text with one
of those is marked entity by entity.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick

MARKUP = frozenset('<>"')
CLOSE = "</span>"


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Marker:
    """Entities of one text, in the order of replacement, each with its opening tag."""

    def __init__(self, entities: list[str], tags: list[str]):
        self.entities, self.tags = entities, tags
        self.numbers = defaultdict(list)  # of each distinct entity: its places in the order
        for i, e in enumerate(entities):
            if e:
                self.numbers[e].append(i)
        self.automaton = ahocorasick.Automaton()
        for e in self.numbers:
            self.automaton.add_word(e, e)
        if self.numbers:
            self.automaton.make_automaton()
        self.known: dict[tuple[str, int], str] = {}

    def marked(self, text: str, after: int = -1) -> str:
        """The text marked by the entities that come after number `after`."""
        if not self.numbers:
            return text
        starts = defaultdict(list)
        for end, e in self.automaton.iter(text):
            starts[e].append(end + 1 - len(e))
        order = sorted((i, e) for e in starts for i in self.numbers[e] if i > after)
        if not order:
            return text
        cut = bytearray(len(text) + 1)  # where tags stand
        at: dict[int, list[list[str]]] = {}  # tags of a position: those that close, the last first, and those that open

        def clear(p: int, q: int) -> bool:
            """Whether text[p:q] is whole words now."""
            return cut.find(1, p + 1, q) < 0 and (p == 0 or cut[p] or not _word(text[p - 1])) and (q == len(text) or cut[q] or not _word(text[q]))

        for i, e in order:
            done, hits = 0, []
            for p in starts[e]:
                if p >= done and clear(p, p + len(e)):
                    hits.append(p)
                    done = p + len(e)
            if hits:
                first, last = self.tag(self.tags[i], i), self.tag(CLOSE, i)
                for p in hits:
                    for x in (p, p + len(e)):
                        if not cut[x]:
                            cut[x] = 1
                            at[x] = [[], []]
                    at[p][1].append(first)
                    at[p + len(e)][0].append(last)
        out, done = [], 0
        for x in sorted(at):
            out.append(text[done:x])
            out += at[x][0][::-1]
            out += at[x][1]
            done = x
        out.append(text[done:])
        return "".join(out)

    def tag(self, tag: str, number: int) -> str:
        """A tag that entity `number` puts in, as the entities after it leave it."""
        if (tag, number) not in self.known:
            self.known[tag, number] = self.marked(tag, number)
        return self.known[tag, number]


def one_by_one(text: str, entities: list[str], tags: list[str]) -> str:
    """The same by its definition."""
    for e, tag in zip(entities, tags, strict=True):
        if e:
            text = re.sub(rf"(?<!\w){re.escape(e)}(?!\w)", lambda m, tag=tag: tag + m[0] + CLOSE, text)
    return text


def marked(text: str, entities: list[str], tags: list[str]) -> str:
    """The text with a span around each whole-word occurrence of each entity; entities are in the order of replacement."""
    if any(not MARKUP.isdisjoint(e) for e in entities):
        return one_by_one(text, entities, tags)
    return Marker(entities, tags).marked(text)
