"""SentencePiece encoding and decoding as a max-plus parallel scan.

An encoding is a best path through the lattice of vocabulary pieces in the
max-plus semiring: a step from piece `a` to piece `b` weighs fit(a, b). For a
unigram model that is the score of `b`. For a BPE model it is 0 if merging the
text of `a` and `b` alone leaves exactly these two, else minus infinity: a text's
BPE result is its one sequence of pieces in which all neighbours fit. So one
kernel gives the library's result for both kinds of model.

A text over `chunk` characters is cut. A state at a cut is the piece that covers
the character before it and how far it reaches over; a chunk, with one piece's
length of context on both sides, yields the matrix of best weights from entry to
exit states. Matrices are combined associatively (a tree scan by text), which
fixes every chunk's entry and exit state; then each chunk is traced back alone.

Where a non-space is followed by the space mark no piece can cross (checked when
the model is loaded), so the state is the same for all paths: between such cuts
units are encoded once and remembered.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache
from operator import concat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh, int_lists, kept, lean, save, table, without

#: Where the model lies; never copied into the repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, MEMO = 32_768, 200_000
#: Chunks whose matrices one task combines; the spans of a text are combined by the next.
SPAN = 64
NEG = float("-inf")
#: The model's space mark, and what stands for it inside: a plain space, so that Latin words take one byte a character.
MARK, SPACE = "\u2581", " "
#: A state: (piece id, or minus one minus the code point of a character without a piece; characters reached over).
#: FREE is the state at a text's ends and where units meet: any piece may follow.
State = tuple[int, int]
FREE: State = (1 << 40, 0)


def _varints(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """A SentencePiece model's pieces, and the weights between them."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        trainer = next((v for k, v in _varints(proto) if k == 2), b"")
        self.kind = next((v for k, v in _varints(trainer) if k == 3), 1)
        if self.kind not in (1, 2):
            raise ValueError("only unigram and BPE models have a lattice")
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i).replace(MARK, SPACE) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.bytes = {self.text[i]: i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        self.ids = {self.text[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.longest = max(map(len, self.ids))
        self.unk_score = min((self.score[i] for i in self.ids.values()), default=0.0) - 10
        #: Neighbours inside pieces.
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: No piece has a space mark after another character: then units stand alone.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Units: a word with the spaces before it, cut once more where a sign follows a letter and no piece holds the two side by side.
        signs = {x for x in string.punctuation if sum(p[1] == x and p[0].isalpha() for p in self.inside) <= 20}
        odd = {p[0] for p in self.inside if p[1] in signs and re.match(r"[^\W\d_]", p[0])}
        after, sign = f"(?<![^\\W\\d_{re.escape(''.join(sorted(odd)))}])", re.escape("".join(sorted(signs)))
        plain, mixed = f"{SPACE}*[^{SPACE}{sign}]++(?![{sign}])", f"{SPACE}*[^{SPACE}](?:[^{SPACE}{sign}]++|{after}[{sign}])*+"
        self.units = re.compile(f"{plain}|{mixed}|{SPACE}+" if signs else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        #: Units by text: the latest, and those before them, so that frequent ones last.
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        #: Finds all pieces of two characters or more in a text in one pass.
        self.finder = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1:
                self.finder.add_word(piece, (len(piece) - 1, i))
        if len(self.finder):
            self.finder.make_automaton()
        if self.kind == 2:
            order = sorted(self.ids.values(), key=lambda i: (-self.score[i], i))
            self.rank = {i: r for r, i in enumerate(order)}
            self.fits: dict[int, bool] = {}
            self.parts: dict[int, tuple[int, int]] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the characters of a short text by score, leftmost first."""
        parts, ids = list(text), self.ids
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i; None for a character or a piece that merging never makes."""
        if i not in self.parts:
            text, ids = self.text[i], self.ids
            parts = list(text)
            while len(parts) > 2:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    j = ids.get(parts[k] + parts[k + 1])
                    if j is not None and j != i and (best is None or self.score[j] > best):
                        best, at = self.score[j], k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[i] = (ids[parts[0]], ids[parts[1]]) if len(parts) == 2 and parts[0] in ids and parts[1] in ids else None
        return self.parts[i]

    def fit(self, a: int, b: int) -> float:
        """The weight of piece b after piece a."""
        if self.kind == 1:
            return self.score[b] if b >= 0 else self.unk_score
        if b < 0 or a < 0 or a == FREE[0]:
            return 0.0
        ok = self.fits.get(a << 24 | b)
        if ok is None:
            ok = self._fit_anew(a, b)
        return 0.0 if ok else NEG

    def _fit_anew(self, a: int, b: int) -> bool:
        if len(self.fits) > 2 * MEMO:
            self.fits.clear()
        ok = self.fits[a << 24 | b] = self._stays(a, b)
        return ok

    def _stays(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b leaves a and b.

        Undo merges on both sides of the seam, the latest first: if a merge over
        the seam would have come before the one just undone, a and b don't stay.
        Equal scores (runs of space marks) are settled by merging outright.
        """
        left, right = self.text[a], self.text[b]
        if (left[-1] == SPACE and right[0] == SPACE) or len(left) == len(right) == 1:
            return self.merged(left + right) == [left, right]
        last, rank, text, ids = 1 << 60, self.rank, self.text, self.ids
        if (len(left) > 1 and self.split(a) is None) or (len(right) > 1 and self.split(b) is None):
            return False
        while True:
            over = ids.get(text[a] + text[b])
            if over is not None and rank[over] < last:
                return False
            pa_, pb_ = self.split(a) if len(text[a]) > 1 else None, self.split(b) if len(text[b]) > 1 else None
            if pa_ is None and pb_ is None:
                return True
            # With equal merges on both sides the left one came first, so the right one is undone first.
            if pb_ is None or (pa_ is not None and rank[a] > rank[b]):
                last, a = rank[a], pa_[1]
            else:
                last, b = rank[b] + 1, pb_[0]

    def ending(self, text: str, at: int, low: int) -> list[tuple[int, int]]:
        """(start, piece) of the pieces that end at `at` and start at `low` or later, longest first."""
        ids, out = self.ids, []
        for j in range(max(low, at - self.longest), at):
            i = ids.get(text[j:at])
            if i is not None:
                out.append((j, i))
        if at > low and text[at - 1] not in ids:
            out.append((at - 1, -1 - ord(text[at - 1])))
        return out

    def forward(self, text: str, begin: int, end: int, state: int, low: int | None = None) -> tuple[list, list]:
        """Best weight and (start, piece) for every place from `begin` (entered with piece `state`) to `end`."""
        n = end - begin + 1
        best, back = [NEG] * n, [None] * n
        best[0], back[0] = 0.0, (-1, state)
        self.extend(text, begin, begin + 1, end, best, back)
        return best, back

    def extend(self, text: str, begin: int, first: int, end: int, best: list, back: list) -> None:
        unigram = self.kind == 1
        for at in range(first, end + 1):
            top, how = NEG, None
            for j, i in self.ending(text, at, begin):
                was = best[j - begin]
                if was == NEG:
                    continue
                w = was + self.fit(back[j - begin][1], i)
                if w > top:
                    top, how = w, (j, i)
                    if not unigram:
                        break  # BPE: one path at most reaches a place
            best[at - begin], back[at - begin] = top, how

    def trace(self, back: list, begin: int, at: int) -> list[int]:
        out = []
        while at > begin:
            j, i = back[at - begin]
            out.append(i)
            at = j
        return out[::-1]

    def unit(self, text: str) -> tuple[int, ...]:
        """The pieces of a text that stands alone, remembered."""
        got = self.memo.get(text) or self.older.get(text)
        if got is None:
            parts = self.breaks(text)
            got = tuple([i for p in parts for i in self.part(p)]) if len(parts) > 1 else tuple(self.alone(text))
        return self.remember(text, got)

    def part(self, text: str) -> tuple[int, ...]:
        """unit() of a text that breaks() has cut out."""
        return self.memo.get(text) or self.remember(text, self.older.get(text) or tuple(self.alone(text)))

    def alone(self, text: str) -> list[int]:
        if self.kind == 2:
            return self.first_path(text)
        _, back = self.forward(text, 0, len(text), FREE[0])
        return self.trace(back, 0, len(text))

    def remember(self, text: str, got: tuple[int, ...]) -> tuple[int, ...]:
        if len(text) <= 64:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[text] = got
        return got

    def breaks(self, text: str) -> list[str]:
        """A text cut where two characters meet that no piece holds side by side: no path crosses there, in any model."""
        inside = self.inside
        if inside.issuperset(map(concat, text, text[1:])):
            return [text]
        out, at = [], 0
        for k, pair in enumerate(map(concat, text, text[1:]), 1):
            if pair not in inside:
                out.append(text[at:k])
                at = k
        out.append(text[at:])
        return out

    def first_path(self, text: str) -> list[int]:
        """The first path of weight 0 through a BPE lattice, longest pieces first.

        No other path has that weight, and a place is reached by one path at
        most, so a place that led nowhere once needs no second visit: linear.
        """
        ok, ids, n = self.fits.get, self.ids, len(text)
        starting: list[list[tuple[int, int]] | None] = [None] * n
        if n > 1 and len(self.finder):
            for last, (before, i) in self.finder.iter(text):
                at = last - before
                if starting[at] is None:
                    starting[at] = [(last + 1, i)]
                else:
                    starting[at].append((last + 1, i))
        out: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        at, prev, below = 0, -1, n + 1
        while at < n:
            found = starting[at]
            if found is not None:
                for end, i in reversed(found):
                    if end >= below or end in dead:
                        continue
                    if prev < 0:
                        break
                    fit = ok(prev << 24 | i)
                    if fit or (fit is None and self._fit_anew(prev, i)):
                        break
                else:
                    found = None
            if found is None:
                end = at + 1
                i = ids.get(text[at], -1)
                if i < 0:
                    i = -1 - ord(text[at])
                if end >= below or end in dead or (i >= 0 and prev >= 0 and self.fit(prev, i) == NEG):
                    dead.add(at)
                    if not out:
                        raise ValueError("no path through the lattice")
                    out.pop()
                    below = ends.pop()
                    at = ends[-1] if ends else 0
                    prev = out[-1] if out else -1
                    continue
            out.append(i)
            ends.append(end)
            at, prev, below = end, i, n + 1
        return out

    def pieces(self, text: str) -> list[int]:
        """The pieces of a whole normalised text."""
        if not self.cuts:
            return list(self.unit(text))
        out: list[int] = []
        memo = self.memo
        for u in self.units(text):
            out += memo.get(u) or self.unit(u)
        return out

    def numbers(self, pieces: list[int]) -> list[int]:
        """Vocabulary ids: characters without a piece become byte pieces, or the unknown id."""
        if not pieces or min(pieces) >= 0:
            return pieces
        out: list[int] = []
        for i in pieces:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[f"<0x{b:02X}>"] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            elif not (out and out[-1] == self.unk):
                out.append(self.unk)
        return out

    def normal(self, text: str) -> str:
        return self.sp.normalize(text).replace(MARK, SPACE)

    def states(self, text: str, cut: int) -> list[State]:
        """The states that the text allows at a cut: pieces over the character before it."""
        out = []
        for j in range(max(0, cut - self.longest), cut):
            for e in range(cut, min(len(text), j + self.longest) + 1):
                i = self.ids.get(text[j:e])
                if i is not None:
                    out.append((i, e - cut))
        if text[cut - 1] not in self.ids:
            out.append((-1 - ord(text[cut - 1]), 0))
        return out

    def seams(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and last place in begin..end where a unit starts after another."""
        if not self.cuts:
            return None
        first = text.find(SPACE, max(begin, 1), end + 1)
        while first > 0 and text[first - 1] == SPACE:
            first = text.find(SPACE, first + 1, end + 1)
        if first < 0:
            return None
        last = text.rfind(SPACE, first, end + 1)
        while text[last - 1] == SPACE:
            last = text.rfind(SPACE, first, last)
        return first, last

    def exits(self, text: str, begin: int, cut: int, best: list, back: list) -> dict[State, tuple[float, int]]:
        """Weight and start of each state at `cut` that paths from `begin` reach."""
        out: dict[State, tuple[float, int]] = {}
        for j in range(max(begin, cut - self.longest), cut):
            if best[j - begin] == NEG:
                continue
            last = back[j - begin][1]
            tokens = [(self.ids[text[j:e]], e - cut) for e in range(cut, min(len(text), j + self.longest) + 1) if text[j:e] in self.ids]
            if j == cut - 1 and text[j] not in self.ids:
                tokens.append((-1 - ord(text[j]), 0))
            for s in tokens:
                w = best[j - begin] + self.fit(last, s[0])
                if w > out.get(s, (NEG, 0))[0]:
                    out[s] = (w, j)
        return out

    def lattices(self, text: str, begin: int, end: int, entries: list[State]) -> dict[State, tuple[int, list, list]]:
        """forward() for every entry state; entries whose last places agree go on as one."""
        live: dict[State, tuple[int, list, list]] = {}
        for s in entries:
            at = begin + s[1]
            if at <= end:
                live[s] = (at, [0.0], [(-1, s[0])])
        done, reach, groups = {}, begin + self.longest, {s: [s] for s in live}
        at = min(end, reach)
        for s, (b, best, back) in live.items():
            best.extend([NEG] * (at - b))
            back.extend([None] * (at - b))
            self.extend(text, b, b + 1, at, best, back)
        alias: dict[State, State] = {s: s for s in live}
        while at < end:
            seen: dict[tuple, State] = {}
            for s in list(groups):
                b, best, back = live[s]
                tail = tuple(None if w == NEG else (p[1], w) for w, p in zip(best[-self.longest :], back[-self.longest :], strict=True))
                weights = [w for w in best[-self.longest :] if w != NEG]
                if not weights or self.kind == 1:
                    if not weights:
                        groups.pop(s)
                    continue
                if tail in seen and len(best) > self.longest:
                    alias[s] = seen[tail]
                    groups.pop(s)
                elif len(best) > self.longest:
                    seen[tail] = s
            nxt = min(end, at + 64)
            for s in groups:
                b, best, back = live[s]
                best.extend([NEG] * (nxt - at))
                back.extend([None] * (nxt - at))
                self.extend(text, b, at + 1, nxt, best, back)
            at = nxt
        for s in live:
            o = s
            chain = [s]
            while alias[o] != o:
                o = alias[o]
                chain.append(o)
            b, best, back = live[s]
            for o in chain[1:]:  # what came after the meeting point is shared
                ob, obest, oback = live[o]
                have = b + len(best)
                best, back = best + obest[have - ob :], back + oback[have - ob :]
            if b + len(best) == end + 1:
                done[s] = (b, best, back)
        return done

    def matrix(self, text: str, begin: int, end: int, entries: list[State], last: bool) -> dict[tuple[State, State], float]:
        """Best weights from entry states at `begin` to exit states at `end` (FREE if the text ends there)."""
        reach = begin + self.longest
        seam = self.seams(text, min(reach, end), end)
        out: dict[tuple[State, State], float] = {}
        if seam:
            heads = {s: best[-1] for s, (_, best, _) in self.lattices(text, begin, seam[0], entries).items() if best[-1] != NEG}
            middle = self.weight(text[seam[0] : seam[1]])
            best, back = self.forward(text, seam[1], end, FREE[0])
            tails = {FREE: (best[-1], 0)} if last else self.exits(text, seam[1], end, best, back) if seam[1] < end else {FREE: (0.0, 0)}
            for s, h in heads.items():
                for x, (w, _) in tails.items():
                    if w != NEG:
                        out[s, x] = h + middle + w
            return out
        for s, (b, best, back) in self.lattices(text, begin, end, entries).items():
            found = {FREE: (best[-1], 0)} if last else self.exits(text, b, end, best, back)
            for x, (w, _) in found.items():
                if w != NEG:
                    out[s, x] = w
            if not last and b == end:
                out[s, (s[0], 0)] = max(0.0, out.get((s, (s[0], 0)), NEG))
        return out

    def weight(self, text: str) -> float:
        return 0.0 if self.kind == 2 else sum(self.score[i] if i >= 0 else self.unk_score for i in self.pieces(text))

    def between(self, text: str, begin: int, end: int, entry: State, exit_: State, last: bool) -> list[int]:
        """The pieces that start inside a chunk, on the best path between its states."""
        seam = self.seams(text, min(begin + self.longest, end), end)
        head: list[int] = []
        if seam:
            b, best, back = self.lattices(text, begin, seam[0], [entry])[entry]
            head = self.trace(back, b, seam[0]) + self.pieces(text[seam[0] : seam[1]])
            begin, entry = seam[1], FREE
            if seam[1] == end and not last:
                return head
        b, best, back = self.lattices(text, begin, end, [entry])[entry]
        if last:
            return head + self.trace(back, b, end)
        if exit_ == FREE or (b == end and exit_ == (entry[0], 0)):
            return head + self.trace(back, b, end)
        w, j = self.exits(text, b, end, best, back)[exit_]
        return head + self.trace(back, b, j) + [exit_[0]]


@lru_cache(2)
def model(path: str) -> Model:
    kept[__name__] = model.cache_clear
    return Model(path)


Matrix = dict[tuple[State, State], float]


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: best weights over both stretches. FREE joins with FREE."""
    by: dict[State, list[tuple[State, float]]] = {}
    for (s, x), w in b.items():
        by.setdefault(s, []).append((x, w))
    out: Matrix = {}
    for (s, m), w in a.items():
        for x, v in by.get(m, ()):
            if w + v > out.get((s, x), NEG):
                out[s, x] = w + v
    return out


def prefixes(matrices: list[Matrix]) -> list[Matrix]:
    """The products of the first 1, 2, ... matrices, by a tree of compositions."""
    if len(matrices) < 2:
        return matrices
    pairs = prefixes([compose(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)])
    return [matrices[0] if k == 0 else pairs[k // 2] if k % 2 else compose(pairs[k // 2 - 1], matrices[k]) for k in range(len(matrices))]


def resolve(matrices: list[Matrix], entry: State = FREE, exit_: State = FREE) -> list[tuple[State, State]]:
    """Entry and exit state of every chunk on the best path from one state to another."""
    done, state, out = prefixes(matrices), exit_, []
    for k in range(len(matrices) - 1, -1, -1):
        entries = [(entry, 0.0)] if k == 0 else [(x, w) for (s, x), w in done[k - 1].items() if s == entry]
        best = max((w + matrices[k].get((s, state), NEG), s) for s, w in entries)
        if best[0] == NEG:
            raise ValueError("no path through the lattice")
        out.append((best[1], state))
        state = best[1]
    return out[::-1]


_PIECE = "key binary, idx int, n int, begin int, finish int, part string"
_STATE = pa.struct([("s", pa.int64()), ("so", pa.int32()), ("x", pa.int64()), ("xo", pa.int32()), ("w", pa.float64())])


def _cut(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = m.normal(text)
                starts = list(range(0, max(1, len(text)), chunk))
                if len(starts) > 1 and len(text) - starts[-1] <= 2 * m.longest:
                    starts.pop()
                for k, a in enumerate(starts):
                    b = starts[k + 1] if k + 1 < len(starts) else len(text)
                    low, high = max(0, a - m.longest), min(len(text), b + m.longest)
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([k], pa.int32()), pa.array([len(starts)], pa.int32()), pa.array([a - low], pa.int32()), pa.array([b - low], pa.int32()), pa.array([text[low:high]], pa.string())], ["key", "idx", "n", "begin", "finish", "part"])

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                first, last = r["idx"] == 0, r["idx"] == r["n"] - 1
                entries = [FREE] if first else [*m.states(r["part"], r["begin"]), *([FREE] if m.seams(r["part"], r["begin"], r["begin"]) else [])]
                found = m.matrix(r["part"], r["begin"], r["finish"], entries, last)
                rows.append([{"s": s[0], "so": s[1], "x": x[0], "xo": x[1], "w": w} for (s, x), w in found.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(_STATE))], ["key", "idx", "n", "m"])

    return run


def _matrix_of(edges: list[dict]) -> Matrix:
    return {((e["s"], e["so"]), (e["x"], e["xo"])): e["w"] for e in edges}


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for each span of consecutive chunks, from rows sorted by (key, idx)."""
    held: list[Matrix] = []
    for batch in batches:
        for r in batch.to_pylist():
            held.append(_matrix_of(r["m"]))
            if r["idx"] == r["n"] - 1 or r["idx"] % SPAN == SPAN - 1:
                product = prefixes(held)[-1]
                held = []
                rows = [{"s": s[0], "so": s[1], "x": x[0], "xo": x[1], "w": w} for (s, x), w in product.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]], pa.binary()), pa.array([r["idx"] // SPAN], pa.int32()), pa.array([(r["n"] - 1) // SPAN + 1], pa.int32()), pa.array([rows], pa.list_(_STATE))], ["key", "idx", "n", "m"])


def _path_rows(key: bytes, first: int, path: list[tuple[State, State]]) -> pa.RecordBatch:
    k = len(path)
    return pa.RecordBatch.from_arrays([pa.array([key] * k, pa.binary()), pa.array(range(first, first + k), pa.int32()), pa.array([s[0] for s, _ in path], pa.int64()), pa.array([s[1] for s, _ in path], pa.int32()), pa.array([x[0] for _, x in path], pa.int64()), pa.array([x[1] for _, x in path], pa.int32())], ["key", "idx", "s", "so", "x", "xo"])


def _between_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry and exit state of each span of a text."""
    held: list[Matrix] = []
    for batch in batches:
        for r in batch.to_pylist():
            held.append(_matrix_of(r["m"]))
            if r["idx"] == r["n"] - 1:
                path, held = resolve(held), []
                yield _path_rows(r["key"], 0, path)


def _inside_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry and exit state of each chunk, from those of its span."""
    held: list[Matrix] = []
    for batch in batches:
        for r in batch.to_pylist():
            held.append(_matrix_of(r["m"]))
            if r["idx"] == r["n"] - 1 or r["idx"] % SPAN == SPAN - 1:
                path, held = resolve(held, (r["s"], r["so"]), (r["x"], r["xo"])), []
                yield _path_rows(r["key"], r["idx"] - len(path) + 1, path)


def _trace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = [m.numbers(m.between(r["part"], r["begin"], r["finish"], (r["s"], r["so"]), (r["x"], r["xo"]), r["idx"] == r["n"] - 1)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["key", "idx", "ids"])

    return run


def encode(df: DataFrame, text: str = "text", path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """Add token_ids (array<int>) to every row: the ids the library gives for the whole text.

    Null gives null, an empty text an empty array. Columns named token_ids are
    replaced; repeated rows stay, each with its ids. Ties between paths cannot
    occur in BPE; in a unigram lattice the longer last piece wins. Texts of any
    length are encoded whole; an empty table gives an empty one.
    """
    df = without(df, ("token_ids",))
    own, other = fresh(df, "key_"), fresh(df, "ids_key_")
    size = F.coalesce(F.length(text), F.lit(0))
    small, giant = df.where(size <= chunk), df.where(size > chunk)
    schema = T.StructType([*df.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            at = batch.schema.names.index(text)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [None if t is None else m.numbers(m.pieces(m.normal(t))) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "token_ids"])

    keyed = giant.withColumn(own, F.unhex(F.md5(text)))
    texts = keyed.select(F.col(own).alias("key_"), F.col(text).alias("t")).dropDuplicates(["key_"])
    chunks = save(texts.mapInArrow(lean(_cut(path, chunk)), _PIECE).repartition("key", "idx"), "chunks")
    kind, found = "key binary, idx int, n int, m array<struct<s:bigint,so:int,x:bigint,xo:int,w:double>>", "key binary, idx int, s bigint, so int, x bigint, xo int"
    matrices = save(chunks.mapInArrow(lean(_matrices(path)), kind), "matrices")
    # Up the tree: a matrix for each span of chunks, states for each span; and down: states for each chunk.
    span = F.floor(F.col("idx") / SPAN).cast("int")
    spans = matrices.repartition("key", span).sortWithinPartitions("key", "idx").mapInArrow(lean(_spans), kind)
    ends = spans.repartition("key").sortWithinPartitions("key", "idx").mapInArrow(lean(_between_spans), found).withColumnsRenamed({"key": "span_key", "idx": "span"})
    held = matrices.withColumn("at_", span).join(ends, (F.col("key") == F.col("span_key")) & (F.col("at_") == F.col("span")))
    held = held.select("key", "idx", "n", "m", "s", "so", "x", "xo", "at_").repartition("key", "at_").sortWithinPartitions("key", "idx")
    states = save(held.mapInArrow(lean(_inside_spans), found), "states")
    forget(matrices)
    traced = chunks.join(states, ["key", "idx"]).mapInArrow(lean(_trace(path)), "key binary, idx int, ids array<int>")
    ids = traced.groupBy(F.col("key").alias(other)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ids"))), lambda x: x["ids"])).alias("token_ids"))
    long = keyed.join(save(ids, "ids"), F.col(own) == F.col(other)).drop(own, other)
    return small.mapInArrow(lean(whole), schema).unionByName(long)


@lru_cache(2)
def processor(path: str):
    """The library's decoder alone, without a lattice's tables."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def decode(df: DataFrame, token_ids: str = "token_ids", path: str = MODEL, to: str = "decoded") -> DataFrame:
    """Add the decoded text: byte pieces are bytes again, space marks spaces. Null gives null, no ids an empty text.

    A column of the name `to` is replaced; repeated rows stay; an empty table gives an empty one.
    """
    df = without(df, (to,))
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in batches:
            at = batch.schema.names.index(token_ids)
            texts = [None if ids is None else sp.decode(ids) for ids in int_lists(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return df.mapInArrow(lean(run), schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, their number, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs))
    return both.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"), "token_ids")
