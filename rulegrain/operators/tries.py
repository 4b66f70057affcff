"""Patterns of one repository as a trie of path segments, which a path walks once from each of its segments.

What a pattern says literally, segment by segment, leads to a node. There it ends, or leaves the beginning
of a further segment, or a glob, which is filed under the literal texts it begins and ends with, or, if it has
neither, under a piece of its longest literal run.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

#: A character class, or one of the wildcards; a bracket that nothing closes is a literal.
_WILDCARD = re.compile(r"\[!?\]?[^\]]*\]|[*?]", re.DOTALL)
_STARS = re.compile(r"\*+")


#: Lengths of the pieces that globs are filed under: one of these, or less than the first.
_PIECES = (8, 12, 16, 24)


class _Globs:
    def __init__(self) -> None:
        #: By the lengths and texts of literal beginnings and endings; by those of pieces in between.
        self.outer: dict[tuple[int, int], dict[tuple[str, str], list[re.Pattern]]] = {}
        self.inner: dict[int, dict[str, list[re.Pattern]]] = {}

    def add(self, glob: str, marks: list[tuple[int, int]]) -> None:
        """A glob with the places of its wildcards."""
        head, end = glob[: marks[0][0]], glob[marks[-1][1] :]
        if head or end:
            filed = self.outer.setdefault((len(head), len(end)), {}).setdefault((head, end), [])
        else:
            run = max((glob[a:b] for (_, a), (b, _) in zip(marks, marks[1:])), key=len, default="")
            size = max((s for s in _PIECES if s <= len(run)), default=len(run))
            filed = self.inner.setdefault(size, {}).setdefault(run[:size], [])
        matcher = re.compile(fnmatch.translate(glob))
        if matcher not in filed:
            filed.append(matcher)

    def match(self, path: str, start: int) -> bool:
        """Does one of the globs match the path from ``start``?"""
        for (head, end), by_text in self.outer.items():
            for glob in by_text.get((path[start : start + head], path[max(0, len(path) - end) :]), ()):
                if glob.match(path, start):
                    return True
        for size, by_text in self.inner.items():
            pieces = {path[k : k + size] for k in range(start, len(path) - size + 1)} if size else {""}
            for piece in pieces:
                for glob in by_text.get(piece, ()):
                    if glob.match(path, start):
                        return True
        return False


class _Node:
    __slots__ = ("children", "is_tail", "is_directory", "heads", "globs", "rooted")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.is_tail = self.is_directory = False
        #: By length: beginnings of the next segment, of paths that got here from their first one.
        self.heads: dict[int, set[str]] = {}
        #: Globs over what is left of a path; the second kind is for paths that got here from their first segment.
        self.globs: _Globs | None = None
        self.rooted: _Globs | None = None


class PathTrie:
    def __init__(self) -> None:
        self.top = _Node()

    def _node(self, segments: Iterable[str]) -> _Node:
        node = self.top
        for segment in segments:
            node = node.children.setdefault(segment, _Node())
        return node

    def _add_glob(self, glob: str, rooted: bool) -> None:
        glob = _STARS.sub("*", glob)
        marks = list(_WILDCARD.finditer(glob))
        folders, slash, _ = glob[: marks[0].start()].rpartition("/")
        node = self._node(folders.split("/")) if slash else self.top
        skipped = len(folders) + len(slash)
        rest, places = glob[skipped:], [(m.start() - skipped, m.end() - skipped) for m in marks]
        # a star also stands for the segments before, so that such a glob need not start anywhere else
        if rooted or node is self.top and rest.startswith("*"):
            node.rooted = node.rooted or _Globs()
            node.rooted.add(rest, places)
        else:
            node.globs = node.globs or _Globs()
            node.globs.add(rest, places)

    def add_ignore(self, line: str) -> None:
        """An ignore line: a literal covers equal tails and all that it begins; so does a glob, and any path it begins without last stars."""
        line = line.lstrip("/")
        if _WILDCARD.search(line):
            self._add_glob(line, False)
            self._add_glob(line.rstrip("*") + "*", True)
            return
        segments = line.split("/")
        self._node(segments).is_tail = True
        head = segments[-1]
        self._node(segments[:-1]).heads.setdefault(len(head), set()).add(head)

    def add_suppression(self, pattern: str) -> None:
        """A suppression: a directory anywhere, a literal name or path, or a glob of a tail."""
        if pattern.endswith("/"):
            self._node(pattern.rstrip("/").split("/")).is_directory = True
        elif _WILDCARD.search(pattern):
            self._add_glob(pattern, False)
        else:
            self._node(pattern.split("/")).is_tail = True

    def covers(self, path: str) -> bool:
        segments = path.split("/")
        n, begin = len(segments), 0
        for i in range(n):
            node, place = self.top, begin
            for j in range(i, n):
                if node.globs and node.globs.match(path, place):
                    return True
                if i == 0:
                    if node.rooted and node.rooted.match(path, place):
                        return True
                    if any(path[place : place + size] in heads for size, heads in node.heads.items()):
                        return True
                node = node.children.get(segments[j])
                if node is None:
                    break
                place += len(segments[j]) + 1
                last = j == n - 1
                if node.is_tail and last or node.is_directory and (not last or i == 0):
                    return True
            begin += len(segments[i]) + 1
        return False
