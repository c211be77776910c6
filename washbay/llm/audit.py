"""The cheapest repair of a run of conversation rows, by a DP over persistent audits.

A row is one letter: its role's initial (``s u a``, ``x`` for any other), upper-case when its
text breaks off, ``-`` when it must go. The repaired initials must read ``(s?(ua)+)?``, so
what has been put out so far is one of four states: nothing, s, ..u, ..a. Per row and state
the DP keeps the cheapest edits (ties: ASCII-least audit), an audit being the string of edit
initials K, R, D, I. An audit decides state and cost, and equally cheap audits of one cell
are never prefixes of each other (the rest would be inserts, which cost), so the best one
per cell is enough.

Audits share their prefixes: an audit is a node with a parent, binary-lifting ancestors and
a rolling hash. A tie is decided at the first letter after the longest common prefix, found
by lifting both nodes while the hashes above differ; equal hashes of two nodes are
verified letter by letter down to the node that they share, and a collision falls back
to the spelled strings.
"""

from __future__ import annotations

import functools

NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
ACCEPTS = (NOTHING, AFTER_A)
#: What a row or insert may become next in each state (an s can only be kept).
NEXT = {NOTHING: ("u", AFTER_U), AFTER_S: ("u", AFTER_U), AFTER_U: ("a", AFTER_A), AFTER_A: ("u", AFTER_U)}
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3       # fixed values: the costs of the contract
_MOD = (1 << 61) - 1
_BASE = 1_000_003


class Audits:
    """Audit strings with shared prefixes; node 0 is the empty one."""

    def __init__(self, mod: int = _MOD):
        self.mod = mod
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[0]]

    def add(self, node: int, letter: str) -> int:
        new = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % self.mod)
        up, k = [node], 0
        while up[k] and k < len(self.up[up[k]]):            # the 2**k-th ancestor's own 2**k-th
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        return new

    def lift(self, node: int, depth: int) -> int:
        while (steps := self.depth[node] - depth) > 0:
            node = self.up[node][min(steps.bit_length() - 1, len(self.up[node]) - 1)]
        return node

    def spell(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth spell one string."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, x: int, y: int) -> bool:
        depth = min(self.depth[x], self.depth[y])
        a, b = self.lift(x, depth), self.lift(y, depth)
        if self.hash[a] == self.hash[b]:
            if not self.same(a, b):
                return self.spell(x) < self.spell(y)
            return self.depth[x] < self.depth[y]
        for k in range(max(len(self.up[a]), len(self.up[b])) - 1, -1, -1):
            if k < len(self.up[a]) and k < len(self.up[b]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        if not self.same(self.up[a][0], self.up[b][0]):
            return self.spell(x) < self.spell(y)
        return self.letter[a] < self.letter[b]


def _offer(cells: dict, audits: Audits, state: int, cost: int, node: int, letter: str) -> bool:
    have = cells.get(state)
    if have is not None and cost > have[0]:
        return False
    new = audits.add(node, letter)
    if have is None or cost < have[0] or audits.less(new, have[1]):
        cells[state] = (cost, new)
        return True
    return False


def _inserts(cells: dict, audits: Audits) -> None:
    changed = True
    while changed:                                          # two rounds at most improve anything: s or nothing to u to a
        changed = False
        for state, (cost, node) in sorted(cells.items()):
            changed |= _offer(cells, audits, NEXT[state][1], cost + INSERT, node, "I")


@functools.lru_cache(maxsize=1 << 15)
def repairs(rows: str, entry: int = NOTHING, mod: int = _MOD) -> tuple[tuple[int, str] | None, ...]:
    """Per state that the output can end in: (cost, audit) of the cheapest edits of ``rows``
    when ``entry`` is the state before them."""
    audits = Audits(mod)
    cells: dict[int, tuple[int, int]] = {entry: (0, 0)}
    _inserts(cells, audits)
    for row in rows:
        new: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in cells.items():
            _offer(new, audits, state, cost + DELETE, node, "D")
            if row == "-":
                continue
            fine = cost + (CUT_OFF if row.isupper() else 0)
            role, (fits, then) = row.lower(), NEXT[state]
            if role == fits:
                _offer(new, audits, then, fine, node, "K")
            elif role == "s" and state == NOTHING:
                _offer(new, audits, AFTER_S, fine, node, "K")
            _offer(new, audits, then, fine + REROLE, node, "R")
        _inserts(new, audits)
        cells = new
    return tuple((cells[s][0], audits.spell(cells[s][1])) if s in cells else None for s in range(STATES))


def best(ends: tuple) -> tuple[int, str]:
    """The cheapest repair that ends in a whole conversation."""
    return min(ends[s] for s in ACCEPTS if ends[s] is not None)


def steps(audit: str, rows: str, entry: int = NOTHING) -> list[tuple[str, str, str]]:
    """Per row: the inserts before it (initials), its edit, and its role's initial where it is
    reroled; a last entry with edit "" holds the inserts after all rows."""
    out, state, before, at = [], entry, "", 0
    for edit in audit:
        role, then = NEXT[state]
        if edit == "I":
            before, state = before + role, then
            continue
        if edit == "K":
            state = AFTER_S if rows[at].lower() == "s" else then
        elif edit == "R":
            state = then
        out.append((before, edit, role if edit == "R" else ""))
        before, at = "", at + 1
    return [*out, (before, "", "")]
