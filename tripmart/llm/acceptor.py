"""A minimised acyclic acceptor of a word list, and its composition with the
transducer that makes one edit (insert, delete or replace one code point) and
with itself: the pairs of accepted words that are one edit apart. No recursion,
so words may be of any length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Acceptor:
    """States are numbered children first; ``root`` is the last one. Equal right
    languages are one state."""

    def __init__(self, words: Iterable[str]):
        self.moves: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def settled(final: bool, edges: list[tuple[str, int]]) -> int:
            key = (final, *edges)
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.moves)
                self.moves.append(dict(edges))
                self.final.append(final)
            return state

        # the last word's path, whose states can still grow
        path: list[list] = [[False, []]]
        before = ""
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            for at in range(len(before), shared, -1):
                state = settled(*path.pop())
                path[-1][1].append((before[at - 1], state))
            path += [[False, []] for _ in range(len(word) - shared)]
            path[-1][0] = True
            before = word
        for at in range(len(before), 0, -1):
            state = settled(*path.pop())
            path[-1][1].append((before[at - 1], state))
        self.root = settled(*path[0])
        self._meets: dict[tuple[int, int], bool] = {}

    def meet(self, p: int, q: int) -> bool:
        """Whether some word is accepted from both states."""
        known, todo = self._meets, [(min(p, q), max(p, q))]
        while todo:
            pair = todo[-1]
            if pair in known:
                todo.pop()
                continue
            a, b = pair
            if a == b or (self.final[a] and self.final[b]):
                known[pair] = True
                continue
            other = self.moves[b]
            ahead = [(min(x, other[c]), max(x, other[c])) for c, x in self.moves[a].items() if c in other]
            if any(known.get(x) for x in ahead):
                known[pair] = True
            else:
                new = [x for x in ahead if x not in known]
                if new:
                    todo.append(new[0])
                else:
                    known[pair] = False
        return known[(min(p, q), max(p, q))]

    def common(self, p: int, q: int) -> Iterator[str]:
        """Words accepted from both states."""
        path: list[str] = []
        todo = [(p, q, 0, "")]
        while todo:
            a, b, depth, label = todo.pop()
            del path[max(0, depth - 1):]
            if depth:
                path.append(label)
            if self.final[a] and self.final[b]:
                yield "".join(path)
            other = self.moves[b]
            todo += [(x, other[c], depth + 1, c) for c, x in self.moves[a].items() if c in other and self.meet(x, other[c])]

    def edits(self, state: int) -> list[tuple[str, str, int, int]]:
        """What the transducer can do in its one step here: ``(x, y, p, q)``, the
        words go on with ``x`` and ``y`` and then alike from states ``p`` and ``q`` (-1:
        end here). An insertion stands where the two words first differ."""
        out = []
        moves = sorted(self.moves[state].items())
        for k, (a, p) in enumerate(moves):
            out += [(a, b, p, q) for b, q in moves[k + 1:] if self.meet(p, q)]
            if self.final[p] and self.final[state]:
                out.append((a, "", -1, -1))
            own = self.moves[p]
            out += [(a + c, c, own[c], q) for c, q in moves if c != a and c in own and self.meet(own[c], q)]
        return out

    def near(self) -> Iterator[tuple[str, str]]:
        """Every pair of accepted words one edit apart, once."""
        edits = [self.edits(s) for s in range(len(self.moves))]
        alive = [False] * len(self.moves)  # some edit here or further on
        for s in range(len(self.moves)):
            alive[s] = bool(edits[s]) or any(alive[x] for x in self.moves[s].values())
        path: list[str] = []
        todo = [(self.root, 0, "")] if alive[self.root] else []
        while todo:
            state, depth, label = todo.pop()
            del path[max(0, depth - 1):]
            if depth:
                path.append(label)
            if edits[state]:
                start = "".join(path)
                for x, y, p, q in edits[state]:
                    for tail in self.common(p, q) if p >= 0 else ("",):
                        yield start + x + tail, start + y + tail
            todo += [(x, depth + 1, c) for c, x in self.moves[state].items() if alive[x]]
