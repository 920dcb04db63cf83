"""A unigram piece lattice over a public vocabulary: Aho-Corasick matches, Viterbi, exact tie rules.

Pieces and scores come from a SentencePiece model file (its path is a parameter).  A text is normalised as that model
says for plain input: spaces become U+2581, one of which is put in front; nothing else changes.  A character that is no
piece by itself gets an unknown edge that scores 10 less than the least piece and counts as one piece for each of its
UTF-8 bytes.  Of equal scores at a position, the piece that starts first (the longest) wins, as in the SentencePiece
unigram model.  Sums are taken in double precision; that model's own are single, so they are equal while exact there.

No piece holds U+2581 after another character, so that the best path of a text is made of the best paths of its
chunks (leading marks and what follows up to the next mark); line ends, which no piece holds, are chunks too.  Chunks
repeat, and their results are kept in a bounded table in each Python worker.
"""
from __future__ import annotations

import bisect
import math
import re
from array import array

import ahocorasick
import numpy as np

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
MOST_KEPT = 240_000
MOST_PATHS = 20_000
#: Chunks of more characters are cut into parts where no piece can reach across.
LONG = 64
#: Characters of a step over many chunks.
SQUARE = 60_000


class Lattice:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown_id: int = 0) -> None:
        self.pieces, self.byte_ids, self.unknown_id = pieces, byte_ids, unknown_id
        self.find = ahocorasick.Automaton()
        for piece, (i, score) in pieces.items():
            self.find.add_word(piece, (len(piece), score, i))
        if pieces:
            self.find.make_automaton()
        self.unknown_score = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN
        glued = any(MARK in p.lstrip(MARK) for p in pieces)
        lines = any("\n" in p for p in pieces)
        cut = "" if lines else r"\n|"
        stop = "" if lines else r"\n"
        self.chunk = re.compile(r"(?s).+" if glued else f"{cut}{MARK}*[^{MARK}{stop}]+|{MARK}+")
        self.names = {i: p.replace(MARK, " ").encode("utf-8") for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.longest = max(map(len, pieces), default=1)
        self.side_by_side = {p[k: k + 2] for p in pieces for k in range(len(p) - 1)}
        self.counts: dict[str, tuple[float, int]] = {}
        self.best: dict[str, tuple[float, bytes, float]] = {}
        self.before: dict[str, tuple[float, bytes, float]] = {}
        self.paths: dict[str, list[tuple[float, bytes]]] = {}
        self.forward: Forward | None = None
        sizes = [len(self.names[i]) for i in self.names]
        self.name_size = np.zeros(max(self.names, default=0) + 1, np.int64)
        self.name_size[list(self.names)] = sizes
        self.name_at = np.zeros(len(self.name_size), np.int64)
        self.name_at[list(self.names)] = np.cumsum(sizes) - sizes
        self.name_bytes = np.frombuffer(b"".join(self.names.values()), np.uint8)

    @classmethod
    def load(cls, path: str = MODEL) -> Lattice:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        bytes_ = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        return cls({sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}, [bytes_[f"<0x{b:02X}>"] for b in range(256)] if len(bytes_) == 256 else [], sp.unk_id())

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def edges(self, chunk: str) -> list[list[tuple[int, float, int]]]:
        """For each end, the edges into it as (start, score, id), the first start first; id -1 is unknown."""
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(chunk) + 1)]
        if self.pieces:
            for last, (size, score, i) in self.find.iter(chunk):
                into[last + 1].append((last + 1 - size, score, i))
        for end in range(1, len(chunk) + 1):
            into[end].sort()
            if not into[end] or into[end][-1][0] != end - 1:
                into[end].append((end - 1, self.unknown_score, -1))
        return into

    def size(self, char: str) -> int:
        return len(char.encode("utf-8", "surrogatepass")) if self.byte_ids else 1

    def count(self, chunk: str) -> tuple[float, int]:
        """Score and number of pieces of the best path; only these two are carried."""
        got = self.counts.get(chunk)
        if got is None and len(units := self.units(chunk)) > 1:
            each = [self.count(p) for p in units]
            got = self.counts[chunk] = sum([s for s, _ in each], 0.0), sum([n for _, n in each])
        if got is None:
            scores, counts = [0.0], [0]
            for end, edges in enumerate(self.edges(chunk)):
                if end:
                    most, n = None, 0
                    for start, score, i in edges:
                        s = scores[start] + score
                        if most is None or s > most:
                            most, n = s, counts[start] + (1 if i >= 0 else self.size(chunk[start]))
                    scores.append(most)
                    counts.append(n)
            got = scores[-1], counts[-1]
            if len(self.counts) >= MOST_KEPT:
                self.counts.clear()
            self.counts[chunk] = got
        return got

    def ahead(self, chunk: str) -> list[float]:
        """Forward Viterbi: the best score of each prefix."""
        best = [0.0] + [-math.inf] * len(chunk)
        unknown, done, single = self.unknown_score, 0, False
        matches = self.find.iter(chunk) if self.pieces else iter(())
        for last, (size, score, _) in matches:
            while done < last:  # ends that are complete; one without a single-character piece has the unknown edge
                done += 1
                if not single and best[done - 1] + unknown > best[done]:
                    best[done] = best[done - 1] + unknown
                single = False
            got = best[last + 1 - size] + score
            if got > best[last + 1]:
                best[last + 1] = got
            single = single or size == 1
        while done < len(chunk):
            done += 1
            if not single and best[done - 1] + unknown > best[done]:
                best[done] = best[done - 1] + unknown
            single = False
        return best

    def into(self, chunk: str, ahead: list[float], end: int) -> list[tuple[float, int, int]]:
        """The edges into an end as (loss, start, id), the least loss first, of equal ones the first start."""
        pieces, best = self.pieces.get, ahead[end]
        here = []
        for start in range(end - self.longest if end > self.longest else 0, end):
            got = pieces(chunk[start:end])
            if got is not None:
                here.append((best - (ahead[start] + got[1]), start, got[0]))
        if not here or here[-1][1] != end - 1:
            here.append((best - (ahead[end - 1] + self.unknown_score), end - 1, -1))
        here.sort()
        return here

    def n_best(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations, best first; of equal scores, the one that the search meets first.

        Forward Viterbi scores are the exact rest of every backward path: an edge's loss is what it scores less than
        the best way to its end, and a backward path's cost is the sum of its losses.  What comes off the queue is
        walked down to the start along edges without loss, so each step of the A* search gives one segmentation.
        Paths are linked back to front, so a step costs no more than the chunk's length.
        """
        ahead = self.ahead(chunk)
        total = ahead[-1]
        # no longer than what is still asked for: (loss, serial number, (start, id, path behind it))
        queue: list[tuple[float, int, tuple]] = [(0.0, 0, (len(chunk), None, None))]
        serial = 0
        out: list[tuple[float, list[int]]] = []
        while queue:
            loss, _, path = queue.pop(0)
            room = n - len(out) - 1
            del queue[room:]
            limit = queue[-1][0] if room and len(queue) == room else math.inf if room else -1.0
            at = path[0]
            while at:
                edges = self.into(chunk, ahead, at)
                if len(edges) > 1 and loss + edges[1][0] <= limit:
                    for more, start, i in edges[1:]:
                        if loss + more > limit:
                            break
                        serial += 1
                        bisect.insort(queue, (loss + more, serial, (start, i, path)))
                        if len(queue) >= room:
                            del queue[room:]
                            limit = queue[-1][0]
                _, at, i = edges[0]
                path = (at, i, path)
            out.append((total - loss, self.spelled(chunk, path)))
        return out

    def spelled(self, chunk: str, path: tuple) -> list[int]:
        """Ids of a path from the start, unknown characters as bytes."""
        found: list[int] = []
        while path[1] is not None:
            start, i, path = path
            if i >= 0:
                found.append(i)
            elif self.byte_ids:
                found += [self.byte_ids[x] for x in chunk[start: path[0]].encode("utf-8", "surrogatepass")]
            else:
                found.append(self.unknown_id)
        return found

    def units(self, chunk: str) -> list[str]:
        """What is searched as one: the chunk, or if it is long, its parts."""
        return [chunk] if len(chunk) <= LONG else self.parts(chunk)

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut wherever two characters stand side by side in no piece; no edge of the lattice is cut."""
        out, start = [], 0
        for k in range(1, len(chunk)):
            if chunk[k - 1: k + 1] not in self.side_by_side:
                out.append(chunk[start:k])
                start = k
        out.append(chunk[start:])
        return out

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and the offset of each id's."""
        sizes = self.name_size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.name_bytes[np.repeat(self.name_at[ids] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark in front goes."""
        out = self.decode_bytes(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "surrogatepass")
        return out[1:] if out.startswith(" ") else out


class Forward:
    """Forward Viterbi over many short chunks in step: best score, best ids and least loss of another way, for each.

    Chunks stand as columns, longest first, a character a row.  Pieces are found by walking all starts down one trie
    together: the commonest characters by a dense table, others by a sorted list of (state, character).
    """

    DENSE = 96

    def __init__(self, lattice: Lattice) -> None:
        self.lattice = lattice
        often: dict[str, int] = {}
        for p in lattice.pieces:
            for c in p:
                often[c] = often.get(c, 0) + 1
        chars = sorted(often, key=lambda c: (-often[c], c))
        self.kind = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(chars):
            self.kind[ord(c)] = k + 1
        states: dict[str, int] = {"": 1}  # 0: dead
        steps = []
        for p in lattice.pieces:
            at = 1
            for k in range(1, len(p) + 1):
                to = states.get(p[:k])
                if to is None:
                    to = states[p[:k]] = len(states) + 1
                    steps.append((at, int(self.kind[ord(p[k - 1])]), to))
                at = to
        self.width = len(chars) + 1
        self.dense = np.zeros((len(states) + 1, self.DENSE), np.int32)
        rare = sorted((at * self.width + kind, to) for at, kind, to in steps if kind >= self.DENSE)
        for at, kind, to in steps:
            if kind < self.DENSE:
                self.dense[at, kind] = to
        self.rare_key, self.rare_to = np.array([k for k, _ in rare] + [np.iinfo(np.int64).max]), np.array([t for _, t in rare] + [0], np.int32)
        self.score = np.full(len(states) + 1, -np.inf)
        self.id = np.full(len(states) + 1, -1, np.int32)
        for p, (i, score) in lattice.pieces.items():
            self.score[states[p]], self.id[states[p]] = score, i

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        common = kind < self.DENSE
        to = self.dense[state, np.where(common, kind, 0)]  # column 0 is dead
        if not common.all():
            far = np.flatnonzero(~common)
            key = state[far].astype(np.int64) * self.width + kind[far]
            at = np.searchsorted(self.rare_key, key)
            to[far] = np.where(self.rare_key[at] == key, self.rare_to[at], 0)
        return to

    def __call__(self, chunks: list[str]) -> list[tuple[float, bytes, float]]:
        """For each chunk (not empty): the best score, its ids as 32-bit numbers, the least loss of another way."""
        found: list = [None] * len(chunks)
        order = sorted(range(len(chunks)), key=lambda i: -len(chunks[i]))
        first = 0
        while first < len(order):
            many = max(1, SQUARE // len(chunks[order[first]]))
            mine = order[first: first + many]
            for i, got in zip(mine, self._square([chunks[i] for i in mine])):
                found[i] = got
            first += many
        return found

    def _square(self, chunks: list[str]) -> list[tuple[float, bytes, float]]:
        n, tall = len(chunks), len(chunks[0])
        sizes = np.array([len(c) for c in chunks])
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        column = np.repeat(np.arange(n), sizes)
        row = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kind = np.zeros((tall, n), np.int32)
        kind[row, column] = self.kind[codes]
        flat = kind.ravel()
        longest = min(self.lattice.longest, tall)
        score, name, some = [None], [None], [None]  # by length of the piece, at its start
        where, state = row * n + column, np.ones(len(codes), np.int32)
        for size in range(1, longest + 1):
            inside = where + (size - 1) * n < tall * n
            where, state = where[inside], state[inside]
            state = self.step(state, flat[where + (size - 1) * n])
            alive = state > 0
            where, state = where[alive], state[alive]
            scores, names = np.full(tall * n, -np.inf), np.full(tall * n, -1, np.int32)
            scores[where], names[where] = self.score[state], self.id[state]
            if size == 1:
                scores[np.isneginf(scores)] = self.lattice.unknown_score
            score.append(scores.reshape(tall, n))
            name.append(names.reshape(tall, n))
            some.append((names.reshape(tall, n) >= 0).any(1) if size > 1 else np.ones(tall, bool))
        ahead, back, gap = np.zeros((tall + 1, n)), np.zeros((tall + 1, n), np.int32), np.full((tall + 1, n), np.inf)
        for end, active in enumerate(np.searchsorted(-sizes, -np.arange(tall + 1), side="right").tolist()):
            if not end:
                continue
            best, second, how = np.full(active, -np.inf), np.full(active, -np.inf), np.zeros(active, np.int32)
            for size in range(min(end, longest), 0, -1):  # the first start first: a later one must score more
                if some[size][end - size]:
                    other = ahead[end - size, :active] + score[size][end - size, :active]
                    how[other > best] = size
                    np.maximum(second, np.minimum(best, other), out=second)
                    np.maximum(best, other, out=best)
            ahead[end, :active], back[end, :active], gap[end, :active] = best, how, best - second
        names = np.stack([np.zeros((tall, n), np.int32), *name[1:]])
        at, least, live, spelled = sizes.copy(), np.full(n, np.inf), np.arange(n), []
        while len(live):
            end = at[live]
            least[live] = np.minimum(least[live], gap[end, live])
            size = back[end, live]
            at[live] = end - size
            spelled.append((live, names[size, end - size, live]))
            live = live[at[live] > 0]
        pieces = np.bincount(np.concatenate([x for x, _ in spelled]), minlength=n)
        ends = np.cumsum(pieces)
        ids = np.zeros(ends[-1], np.int32)
        for k, (live, i) in enumerate(spelled):
            ids[ends[live] - 1 - k] = i
        strange = np.logical_or.reduceat(ids < 0, ends - pieces).tolist()
        raw = ids.tobytes()
        return [
            (score, raw[4 * (end - size): 4 * end] if not odd else array("i", self.lattice.n_best(chunk, 1)[0][1]).tobytes(), loss)
            for chunk, score, end, size, odd, loss in zip(chunks, ahead[sizes, np.arange(n)].tolist(), ends.tolist(), pieces.tolist(), strange, least.tolist())]


_loaded: dict[str, Lattice] = {}
C.KEPT.append(_loaded)


def lattice(path: str) -> Lattice:
    """The worker's lattice for a model file; loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Lattice.load(path)
    return _loaded[path]
