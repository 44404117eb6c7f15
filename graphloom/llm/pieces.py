"""A SentencePiece vocabulary: pieces, scores, marked words, and what two pieces may stand side by side."""

from __future__ import annotations

import re
from functools import lru_cache

MARK = "▁"
RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
LINES = re.compile("(\n)")
UNIGRAM, BPE = "unigram", "bpe"
#: The tokenizer library's fixed penalty of an unknown character below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Remembered pairs of pieces.
PAIRS = 300_000
#: The score of what is no piece.
NEVER = float("-inf")


class PieceModel:
    """The vocabulary in a SentencePiece model file.

    ``reading`` says how its pieces are put together: ``unigram`` takes the path with the
    best sum of scores, ``bpe`` merges the best-scored neighbours first.  By default it is
    what the file was trained for.
    """

    def __init__(self, path: str, reading: str | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm, kind = model.trainer_spec, model.normalizer_spec, model.SentencePiece
        own = {1: UNIGRAM, 2: BPE}.get(spec.model_type)
        self.reading = reading or own
        if self.reading not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: only unigram and bpe models are read")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only the identity normalisation is read")
        if any(p.type == kind.USER_DEFINED for p in model.pieces):
            raise ValueError(f"{path}: user-defined pieces are not read")
        self.dummy_prefix = norm.add_dummy_prefix
        self.surface = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.byte_ids = [i for i, p in enumerate(model.pieces) if p.type == kind.BYTE] if spec.byte_fallback else []
        if self.reading == BPE and any(c not in self.ids for p in self.ids for c in p):
            raise ValueError(f"{path}: a merging vocabulary must have its pieces' characters")
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        #: A mark after another character begins a word unless some piece holds both.
        self.splits = (bool(self.byte_ids) or MARK in self.ids) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        #: A line break is in no piece, so it is a word of its own.
        self.breaks = bool(self.byte_ids) and not any("\n" in p for p in self.ids)
        silent = {i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.spelt = [b"" if i in silent else self._spell(i, spec.unk_surface) for i in range(len(self.surface))]
        self._sides: dict[int, dict[int, bool]] = {}
        self._pairs = 0
        self._merges: dict[int, list[tuple[float, str, str]] | None] = {}

    def _spell(self, i: int, unk_surface: str) -> bytes:
        if i == self.unknown:
            return unk_surface.encode()
        if self.byte_ids and self.byte_ids[0] <= i <= self.byte_ids[-1]:
            return bytes([i - self.byte_ids[0]])
        return self.surface[i].replace(MARK, " ").encode()

    # -- words ------------------------------------------------------------------------------

    def words(self, text: str | None) -> list[str]:
        """The marked words of a text: joined they are the text with spaces as marks."""
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.splits:
            return [marked]
        if MARK * 2 in marked or marked[0] != MARK:
            return RUNS.findall(marked)
        words = [MARK + w for w in marked[1:].split(MARK)]
        if self.breaks and "\n" in text:
            words = [x for w in words for x in (filter(None, LINES.split(w)) if "\n" in w else (w,))]
        return words

    def unknown_ids(self, char: str) -> list[int]:
        """The ids of a character that is in no piece: its bytes, or the unknown id."""
        if self.byte_ids:
            return [self.byte_ids[0] + b for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def decode(self, ids) -> str:
        """The text of a sequence of ids; byte pieces that are no UTF-8 become U+FFFD."""
        spelt = self.spelt
        raw = b"".join([spelt[i] for i in ids])
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    # -- merging ----------------------------------------------------------------------------

    def steps(self, text: str) -> tuple[list[tuple[float, str, str]], list[str]]:
        """The merges of the best-scored neighbours, the leftmost of equals first, as (score, the first and the
        last piece after it), and the pieces they leave."""
        parts, ids, scores = list(text), self.ids, self.scores

        def score(a: str, b: str) -> float:
            i = ids.get(a + b)
            return NEVER if i is None else scores[i]

        pairs, done = list(map(score, parts, parts[1:])), []
        while pairs and (best := max(pairs)) > NEVER:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score(parts[k - 1], parts[k])
            if k < len(pairs):
                pairs[k] = score(parts[k], parts[k + 1])
            done.append((best, parts[0], parts[-1]))
        return done, parts

    def merges_of(self, i: int) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, or None if others are made of them."""
        if i not in self._merges:
            done, parts = self.steps(self.surface[i])
            self._merges[i] = done if len(parts) == 1 else None
        return self._merges[i]

    def stand(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces side by side; with left -1, whether it makes the right one.

        Merging inside two neighbouring pieces does not depend on what surrounds them, so a
        sequence is the result of merging exactly if all its neighbours stand.  An unknown
        character merges with nothing, so it is -1 to what follows.
        """
        sides = self.neighbours(right)
        known = sides.get(left)
        if known is None:
            known = self._stand(left, right)
            if self._pairs >= PAIRS:
                for other in self._sides.values():
                    other.clear()
                self._pairs = 0
            self._pairs += 1
            sides[left] = known
        return known

    def _stand(self, left: int, right: int) -> bool:
        """Plays both pieces' merges in the order of scores; they stand if no merge over their border comes first."""
        after = self.merges_of(right)
        if left < 0 or after is None:
            return after is not None
        before = self.merges_of(left)
        if before is None:
            return False
        ids, scores = self.ids, self.scores
        last, first, a, b = self.surface[left][-1], self.surface[right][0], 0, 0
        while True:
            i = ids.get(last + first)
            over = NEVER if i is None else scores[i]
            own = before[a][0] if a < len(before) else NEVER
            other = after[b][0] if b < len(after) else NEVER
            if over > own and over >= other:
                return False
            if own == other == NEVER:
                return True
            if own >= other:
                last = before[a][2]
                a += 1
            else:
                first = after[b][1]
                b += 1

    def neighbours(self, right: int) -> dict[int, bool]:
        """What is remembered of ``stand`` for a right piece, by the left one."""
        return self._sides.setdefault(right, {})


@lru_cache(maxsize=8)
def load(path: str, reading: str | None = None) -> PieceModel:
    """The model of a file, loaded once in each worker."""
    return PieceModel(path, reading)
