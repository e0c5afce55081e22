"""What has to follow the order of a graph's edges: rewiring around short fragments, and the search for circles.

Runs on one connected part of the graph at a time, inside grouped functions. Plain Python: the results
depend on visiting order, on ties, and on marks that outlive backtracking. No recursion.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, takewhile

from annulus.config import FRAGMENT, REWIRE

INF = float("inf")


@dataclass
class Frag:
    fid: int
    chrom: str
    start: float
    end: float
    tail: int
    head: int
    edge_id: int
    coverage: float
    length: float


@dataclass
class Part:
    """A connected part. Ties are (edge id, u, v, type, weight) in the order of their making."""

    frags: dict[int, Frag]
    ties: dict[int, tuple[int, int, int, float]]
    next_id: int = 1 << 40
    owner: dict[int, int] = field(default_factory=dict)
    around: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    def __post_init__(self):
        for f in self.frags.values():
            self.owner[f.tail] = self.owner[f.head] = f.fid
        ids, self.ties, given = sorted(self.ties), {}, self.ties
        for e in ids:
            self.tie(e, *given[e])

    def tie(self, e: int, u: int, v: int, kind: int, weight: float) -> None:
        self.ties[e] = (u, v, kind, weight)
        self.around.setdefault(u, {}).setdefault(v, []).append(e)
        self.around.setdefault(v, {}).setdefault(u, []).append(e)  # a loop is listed twice at its node

    def partner(self, node: int) -> int:
        f = self.frags[self.owner[node]]
        return f.head if node == f.tail else f.tail

    def other_end(self, node: int, e: int) -> int:
        u, v, _, _ = self.ties[e]
        return v if u == node else u

    def open_ties(self, node: int) -> list[int]:
        """Edges at a node but its fragment's, by neighbour and order of making."""
        return [e for held in self.around.get(node, {}).values() for e in held if self.ties[e][2] != FRAGMENT]

    def drop_fragment(self, fid: int) -> None:
        f = self.frags.pop(fid)
        for node in (f.tail, f.head):
            for other in list(self.around.get(node, {})):
                for e in self.around[node][other]:
                    self.ties.pop(e, None)
                if other in self.around:
                    self.around[other].pop(node, None)
            self.around.pop(node, None)
            self.owner.pop(node, None)


def rewire_short(part: Part, least: float, near: int = 50) -> None:
    """Removes fragments shorter than ``least``, in order of fid, tying their neighbours to each other.

    Which fragments go is settled beforehand. A neighbour that meets the gone fragment within ``near``
    bases takes over half of its length.
    """
    for fid in [f.fid for f in sorted(part.frags.values(), key=lambda f: f.fid) if f.length < least]:
        f = part.frags[fid]
        before = [n for n in part.around.get(f.tail, {}) if n not in (f.tail, f.head) and any(part.ties[e][2] != FRAGMENT for e in part.around[f.tail][n])]
        after = [n for n in part.around.get(f.head, {}) if n not in (f.tail, f.head) and any(part.ties[e][2] != FRAGMENT for e in part.around[f.head][n])]
        fresh = [(a, b) for a in before for b in after if not part.around.get(a, {}).get(b)]
        for node in dict.fromkeys([*after, *before]):
            g = part.frags[part.owner[node]]
            half = f.length / 2
            if node == g.head and min(abs(g.end - f.start), abs(g.end - f.end)) < near:
                g.end, g.length = g.end + half, g.length + half
            elif node == g.tail and min(abs(g.start - f.end), abs(g.start - f.start)) < near:
                g.start, g.length = g.start - half, g.length - half  # a tail moved back counts as shorter
        for a, b in fresh:
            if not part.around.get(a, {}).get(b):
                part.tie(part.next_id, a, b, REWIRE, INF)
                part.next_id += 1
        part.drop_fragment(fid)


def insert_ranked(held: list[tuple], new: tuple) -> None:
    """Places (edge, weight, coverage, type) into a list by weight and coverage descending, type ascending.

    Its place is a count: of the edges at the front that are heavier, and then of those in a row that weigh as much and
    have more coverage. The edge after these is looked at without its weight: where it has more coverage, or
    as much and no later type, the new one goes behind it, so an edge can land behind one of lower weight. Results
    depend on that, so it is kept.
    """
    _, weight, cover, kind = new
    front = sum(1 for _ in takewhile(lambda x: x[1] > weight, held))
    at = front + sum(1 for _ in takewhile(lambda x: x[1] == weight and x[2] > cover, held[front:]))
    ties = front < len(held) and held[front][1] == weight
    passed = ties and at < len(held) and (-held[at][2], held[at][3]) <= (-cover, kind)
    held.insert(at + passed, new)


def ranked_ties(part: Part, node: int) -> list[int]:
    ties = part.open_ties(node)
    if len(ties) < 2:
        return ties
    held: list[tuple] = []
    for e in ties:
        _, _, kind, weight = part.ties[e]
        insert_ranked(held, (e, weight, part.frags[part.owner[part.other_end(node, e)]].coverage, kind))
    return [x[0] for x in held]


def turn(path: tuple[int, ...]) -> tuple[int, ...]:
    """Canonical form: fewer inverted fragments than not, and the first smallest fragment leads."""
    if 2 * sum(x < 0 for x in path) > len(path):
        path = tuple(-x for x in reversed(path))
    at = min(range(len(path)), key=lambda i: (abs(path[i]), i), default=0)
    return path[at:] + path[:at]


class Search:
    """Depth-first search of one root's circles: each edge is used once for a root, fragments may be passed again.

    What doesn't change from root to root of a part is made once: the node each one is left by, the sign of its passage, and its ranked ties.
    """

    def __init__(self, part: Part, known: set[tuple[int, ...]]):
        self.part, self.known = part, known
        self.mate: dict[int, int] = {}
        self.sign: dict[int, int] = {}
        for f in part.frags.values():
            self.mate[f.tail], self.mate[f.head] = f.head, f.tail
            self.sign[f.tail], self.sign[f.head] = f.fid, -f.fid
        self.ranked: dict[int, list[tuple[int, int]]] = {}  # (edge, other end) of the ties of a node

    def ties(self, node: int) -> list[tuple[int, int]]:
        held = self.ranked.get(node)
        if held is None:
            held = self.ranked[node] = [(e, self.part.other_end(node, e)) for e in ranked_ties(self.part, node)]
        return held

    def run(self, root: int) -> list[tuple[int, ...]]:
        mate, sign, known, ranked = self.mate, self.sign, self.known, self.ranked
        used: set[int] = set()
        entered, signs = [], []  # the nodes by which fragments are passed, and the signs of these
        seen: set[int] = set()  # all nodes that were entered so far
        found: list[tuple[int, ...]] = []
        frames: list = []
        node = root
        while True:
            out = mate[node]
            seen.add(node)
            entered.append(node)
            signs.append(sign[node])
            ties = ranked.get(out)
            if ties is None:
                ties = self.ties(out)
            for e, other in ties:
                if other in seen and e not in used and other in entered:
                    # the circle from the nearest passage that entered by this node
                    i = len(entered) - 1
                    while entered[i] != other:
                        i -= 1
                    path = tuple(signs[i:])
                    if path not in known:
                        known.add(path)
                        found.append(path)
            rest = iter(ties)
            frames.append(rest)
            while True:
                for e, node in rest:
                    if e not in used:
                        break
                else:
                    frames.pop()
                    entered.pop()
                    signs.pop()
                    if not frames:
                        return found
                    rest = frames[-1]
                    continue
                break
            used.add(e)


def simple_circles(part: Part) -> list[tuple[int, ...]]:
    """Raw circles by root and order of finding. Roots whose ends have one edge each and that the last search passed are skipped."""
    search = Search(part, set())
    out: list[tuple[int, ...]] = []
    last: set[int] = set()
    for f in sorted(part.frags.values(), key=lambda f: f.fid):
        ends = len(search.ties(f.tail)), len(search.ties(f.head))
        if 0 in ends or (ends == (1, 1) and f.fid in last):
            continue
        found = search.run(f.tail)
        last = {abs(x) for p in found for x in p}
        out += found
    return out


def likeness(x: set[int], y: set[int], length: dict[int, float]) -> float:
    """Shared length of two circles' sets of fragments over the length of both."""
    both = sum(length[v] for v in x | y)
    return sum(length[v] for v in x & y) / both if both else 0.0


def combined(raw: list[tuple[int, ...]], length: dict[int, float], *, near_identical: float = 0.9, novelty: float = 0.7, most: int | None = None) -> list[tuple[int, ...]]:
    """Canonical circles made of several simple ones that share a first fragment, in order of acceptance.

    Of nearly identical simple circles of a start the last stays. Every choice of two or more is tried, by
    number and then by order; it is accepted if it is no raw circle and is new enough against every circle
    accepted before. ``most``: more simple circles of one start are an error, as choices double with each.
    """
    alike: dict[tuple[int, int], float] = {}  # circles of a part have few different sets of fragments, each of which is a number of bits here
    held: dict[int, set[int]] = {}
    bit = {v: 1 << i for i, v in enumerate(dict.fromkeys(abs(x) for p in raw for x in p))}

    def shape(p: tuple[int, ...]) -> int:
        m = 0
        for v in p:
            m |= bit[abs(v)]
        return m

    def fids(m: int) -> set[int]:
        if m not in held:
            held[m] = {v for v, b in bit.items() if b & m}
        return held[m]

    def like(x: int, y: int) -> float:
        if (x, y) not in alike:
            alike[x, y] = likeness(fids(x), fids(y), length)
        return alike[x, y]

    groups: dict[int, list[tuple[int, ...]]] = {}
    for p in raw:
        groups.setdefault(p[0], []).append(p)
    known, accepted = set(raw), []
    taken: dict[int, None] = {}  # sets of the accepted circles
    old: set[int] = set()  # sets too like one of these, as they are then for good
    for own in groups.values():
        if len(own) < 2:
            continue
        shapes = [shape(p) for p in own]
        kept, sets = [], []
        for i, p in enumerate(own):
            if not any(like(shapes[i], m) > near_identical for m in shapes[i + 1 :]):
                kept.append(p)
                sets.append(shapes[i])
        if most is not None and len(kept) > most:
            raise ValueError(f"{len(kept)} simple circles start at fragment {own[0][0]}; more than {most}")
        for n in range(2, len(kept) + 1):
            for choice in combinations(range(len(kept)), n):
                x = 0
                for i in choice:
                    x |= sets[i]
                if x in old:
                    continue
                if any(like(x, m) > novelty for m in taken):
                    old.add(x)
                    continue
                new = turn(tuple(v for i in choice for v in kept[i]))
                if new not in known:
                    accepted.append(new)
                    known.add(new)
                    taken[x] = None
    return accepted
