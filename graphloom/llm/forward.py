"""Forward states over sorted words: an Aho-Corasick automaton of the pieces, walked along the words' trie.

Sorted, the words lay their trie out depth first: each keeps the states of the prefix it
shares with the word before it and adds those of its own characters.  For each character the
automaton gives the pieces that end there, the shortest first, and one look at them extends
the states of one or both readings:

* unigram (Viterbi): the best score of the prefix; of equal scores the one whose last piece
  starts first, as the library takes it;
* merging (BPE): the one last piece that merging leaves at the end of the prefix.  No path of
  best scores gives merged pieces, so this state takes the place of the score; it depends on
  the prefix alone and is shared in the same way.

With its state a prefix carries its path, as the piece ids or as their number.

Scores are added in double precision within a word.  The library adds them in single
precision over the whole text, so on a unigram reading of long texts it can round ties.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from .pieces import UNIGRAM, PieceModel


def shared_prefix(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Automaton:
    """Aho-Corasick over the pieces; ``found`` has for each state (length, id, score, path, neighbours) of the pieces that end there."""

    def __init__(self, model: PieceModel, paths: dict[int, bytes] | dict[int, int]):
        self.moves: list[dict[str, int]] = [{}]
        own: dict[int, tuple] = {}
        for piece, i in model.ids.items():
            s = 0
            for c in piece:
                n = self.moves[s].get(c)
                if n is None:
                    n = self.moves[s][c] = len(self.moves)
                    self.moves.append({})
                s = n
            own[s] = (-len(piece), i, model.scores[i], paths[i], model.neighbours(i))
        self.back = [0] * len(self.moves)
        self.found: list[tuple] = [()] * len(self.moves)
        level = [(s, 0) for s in self.moves[0].values()]
        while level:
            after = []
            for s, back in level:
                self.back[s] = back
                self.found[s] = self.found[back] + ((own[s],) if s in own else ())
                after += [(n, self._move(back, c)) for c, n in self.moves[s].items()]
            level = after

    def _move(self, s: int, c: str) -> int:
        while c not in self.moves[s]:
            if not s:
                return 0
            s = self.back[s]
        return self.moves[s][c]

    def move(self, s: int, c: str) -> int:
        """The state after a character; it is remembered, but for characters that begin no piece."""
        n = self._move(s, c)
        if n:
            self.moves[s][c] = n
        return n


class Forward:
    """Walks sorted words, carrying ids (``counts``: numbers of ids) of the asked readings."""

    def __init__(self, model: PieceModel, readings: tuple[str, ...], counts: bool = False):
        self.model, self.counts = model, counts
        self.viterbi, self.merged = UNIGRAM in readings, any(r != UNIGRAM for r in readings)
        self.automaton = Automaton(model, {i: self._path([i]) for i in model.ids.values()})

    def _path(self, ids: list[int]):
        return len(ids) if self.counts else array("i", ids).tobytes()

    def _unknown(self, char: str, again: bool):
        """What an unknown character adds: its bytes, or the unknown id once for a run of them."""
        if again and not self.model.byte_ids:
            return self._path([])
        return self._path(self.model.unknown_ids(char))

    def walk(self, words: list[str]) -> Iterator[tuple[str, object, object]]:
        """(word, Viterbi path, merged path) of sorted words; a reading that was not asked for gives an empty path."""
        viterbi, merged, stand, unknown = self.viterbi, self.merged, self.model.stand, self.model.unknown_score
        moves, found, move, empty = self.automaton.moves, self.automaton.found, self.automaton.move, self._path([])
        # by prefix length: state, best score, last pieces and paths of both readings
        at, best, ends, ways, lasts, marks = [0], [0.0], [-1], [empty], [-1], [empty]
        before = ""
        for word in words:
            shared = shared_prefix(before, word)
            if shared < len(before):
                k = shared + 1
                del at[k:], best[k:], ends[k:], ways[k:], lasts[k:], marks[k:]
            s = at[-1]
            for char in word[shared:]:
                n = moves[s].get(char)
                s = move(s, char) if n is None else n
                options = found[s]
                top = mark = None
                for back, i, score, path, sides in options:
                    if viterbi:
                        other = best[back] + score
                        if top is None or other >= top:
                            top, way, start, end = other, path, back, i
                    if merged and mark is None:
                        left = lasts[back]
                        stands = sides.get(left)
                        if stands is None:
                            stands = stand(left, i)
                        if stands:
                            mark, last, size = path, i, back
                at.append(s)
                if viterbi:
                    if not options or options[0][0] != -1:
                        # a character that is no piece may also stand alone
                        other = best[-1] + unknown
                        if top is None or other > top:
                            top, way, start, end = other, self._unknown(char, len(best) > 1 and ends[-1] < 0), -1, -1
                    ways.append(ways[start] + way)
                    best.append(top)
                    ends.append(end)
                if merged:
                    if mark is None:
                        mark, last, size = self._unknown(char, len(lasts) > 1 and lasts[-1] < 0), -1, -1
                    marks.append(marks[size] + mark)
                    lasts.append(last)
            yield word, ways[-1], marks[-1]
            before = word
