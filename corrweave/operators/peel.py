"""Kernels for one candidate: density, the greedy existence test, and the peel lattice.

A state is a set of the candidate's edges, as the bits of a whole number; its
nodes are those its edges touch. Degrees are static: edges of the state at a
node, a self-loop counting twice.

The lattice is taken level by level, a level being a number of nodes. Every
state leads to lower levels only, so within a level all that matters of the past
is which lower states are queued already. A level's states are looked at first;
dense ones are found and end there, others branch, and those with nodes of
degree one whose removal leaves a state that is not dense may go on with it
alone (a shortcut). Then shortcuts are taken, the state of least key first, to
states that are not queued; the rest branch. That is one of the orders in which
states could be taken one after the other, and it needs no order among tasks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

State = int


@dataclass(frozen=True)
class Rules:
    """What counts as dense. density: "min" or "avg". A task peels `states` states of a candidate before the rest of its lattice is dealt to others."""

    min_den: float
    min_edges_in_snap: int
    density: str = "min"
    prune: bool = True
    states: int = 4096


@dataclass(frozen=True)
class Look:
    """What a state comes to: `density` if it is dense; else its nodes of least degree, or none if it leads nowhere; `rest` is the shortcut, if there is one."""

    density: float | None = None
    low: tuple[int, ...] = ()
    rest: State = 0


class Candidate:
    """The edges of one candidate with their ends, supports and series."""

    def __init__(self, ids: list[int], ends: list[tuple[int, int]], series: list[list[float]], supports: list[float], rules: Rules):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = [ids[i] for i in order]
        self.support = [float(supports[i]) for i in order]
        self.rules = rules
        self.whole: State = (1 << len(ids)) - 1
        self.width = -(-len(ids) // 8)
        self.nodes = sorted({v for e in ends for v in e})
        at = {v: j for j, v in enumerate(self.nodes)}
        #: Edges at each node, self-loops, and edges alive in each snapshot.
        self.edges_of, self.loops, self.alive = [0] * len(self.nodes), 0, [0] * max((len(s) for s in series), default=0)
        for bit, i in enumerate(order):
            u, v = ends[i]
            self.edges_of[at[u]] |= 1 << bit
            self.edges_of[at[v]] |= 1 << bit
            self.loops |= (u == v) << bit
            for t, x in enumerate(series[i]):
                if x > 0:
                    self.alive[t] |= 1 << bit

    @classmethod
    def of_members(cls, members: list[dict], rules: Rules) -> Candidate:
        column = lambda c: [m[c] for m in members]
        return cls(column("edge_id"), [(m["src"], m["dst"]) for m in members], column("series"), column("support"), rules)

    def named(self, state: State) -> list[int]:
        return [e for i, e in enumerate(self.ids) if state >> i & 1]

    def key(self, state: State) -> bytes:
        return state.to_bytes(self.width, "big")

    def degrees(self, state: State) -> dict[int, int]:
        """Degree by the node's place in `nodes`."""
        loops = state & self.loops
        got = ((j, (state & m).bit_count() + (loops & m).bit_count()) for j, m in enumerate(self.edges_of))
        return {j: d for j, d in got if d}

    def level(self, state: State) -> int:
        return sum(1 for m in self.edges_of if state & m)

    def _full(self, state: State) -> tuple[list[State], int]:
        """The edges alive in each k-snapshot, and occurrences in the other snapshots."""
        k, full, skipped = max(1, self.rules.min_edges_in_snap), [], 0
        for a in self.alive:
            n = (state & a).bit_count()
            if n >= k:
                full.append(state & a)
            else:
                skipped += n
        return full, skipped

    def density(self, state: State) -> float | None:
        """The density by the rules; None without a k-snapshot."""
        full, skipped = self._full(state)
        if not full:
            return None
        n = self.level(state)
        if self.rules.density == "avg":
            total = sum(s for i, s in enumerate(self.support) if state >> i & 1)
            return 2 * (total - skipped) / (len(full) * n)
        # Edges alive that touch one node only, a node's own loops, have no density.
        return min(2 * a.bit_count() / n if a & ~self.loops or self.level(a) > 1 else 0.0 for a in full)

    def is_dense(self, state: State, min_den: float) -> bool:
        d = self.density(state)
        return d is not None and d >= min_den

    def without(self, state: State, nodes: Iterable[int]) -> State:
        for j in nodes:
            state &= ~self.edges_of[j]
        return state

    def contains_dense(self, min_den: float) -> bool:
        """Whether peeling nodes of least (degree, weight, id) meets a state with at least this density."""
        state, by_weight = self.whole, self.rules.density == "avg"
        while state:
            degree = self.degrees(state)
            if len(degree) < 2 or max(degree.values()) < min_den or not self._full(state)[0]:
                return False
            if self.is_dense(state, min_den):
                return True
            low = [j for j, d in degree.items() if d == min(degree.values())]
            if by_weight and len(low) > 1:
                weight = {j: sum(s * (2 if self.loops >> i & 1 else 1) for i, s in enumerate(self.support) if (state & self.edges_of[j]) >> i & 1) for j in low}
                low.sort(key=lambda j: (weight[j], j))
            state = self.without(state, low[:1])
        return False

    def look(self, state: State) -> Look:
        d = self.density(state)
        if d is None:
            return Look()
        if d >= self.rules.min_den:
            return Look(density=d)
        degree = self.degrees(state)
        if max(degree.values()) < self.rules.min_den:
            return Look()
        least = min(degree.values())
        low = tuple(j for j, n in degree.items() if n == least)
        rest = self.without(state, low) if least == 1 else 0
        return Look(low=low, rest=0 if rest and self.is_dense(rest, self.rules.min_den) else rest)

    def children(self, state: State, low: Iterable[int]) -> list[State]:
        """The state without each one of its nodes of least degree."""
        return [c for j in low if (c := self.without(state, (j,)))]

    def peel(self, queued: Iterable[State], budget: int | None = None, first_only: bool = False) -> tuple[dict[State, float], list[State]]:
        """(dense states with their densities, states that are still queued) of the lattice below `queued`; levels are begun while `budget` lasts."""
        found: dict[State, float] = {}
        levels: dict[int, set[State]] = {}

        def queue(states: Iterable[State]) -> None:
            for s in states:
                levels.setdefault(self.level(s), set()).add(s)

        queue(queued)
        done = 0
        while levels and (budget is None or done < budget):
            at = max(levels)
            if at < 2:
                levels.clear()
                break
            short: list[tuple[State, Look]] = []
            todo = sorted(levels.pop(at), key=self.key)
            done += len(todo)
            for state in todo:
                x = self.look(state)
                if x.density is not None:
                    found[state] = x.density
                    if first_only:
                        return found, []
                elif x.rest:
                    short.append((state, x))
                else:
                    queue(self.children(state, x.low))
            others = []
            for state, x in short:
                if x.rest in levels.get(self.level(x.rest), ()):
                    others.append((state, x))
                else:
                    queue([x.rest])
            for state, x in others:
                queue(self.children(state, x.low))
        return found, [s for states in levels.values() for s in states]

    def largest_first(self, found: dict[State, float]) -> list[tuple[list[int], float]]:
        return sorted(((self.named(s), d) for s, d in found.items()), key=lambda x: (-len(x[0]), x[0]))

    def extract_dense(self, first_only: bool = False) -> list[tuple[list[int], float]]:
        """Dense states of the peel lattice with their densities, largest first."""
        return self.largest_first(self.peel([self.whole], first_only=first_only)[0])

    def classify(self) -> tuple[str, list[tuple[list[int], float]], list[State]]:
        """("direct", the candidate), ("extracted", its dense parts), ("pruned", nothing), or, if the budget ran out, ("open", parts so far); and the states left."""
        d = self.density(self.whole)
        if d is not None and d >= self.rules.min_den:
            return "direct", [(self.named(self.whole), d)], []
        if self.rules.prune and not self.contains_dense(self.rules.min_den / 2):
            return "pruned", [], []
        found, left = self.peel([self.whole], self.rules.states)
        return "open" if left else "extracted" if found else "pruned", self.largest_first(found), left
