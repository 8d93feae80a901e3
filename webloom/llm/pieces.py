"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k without replacement.

A text is encoded by the model and decoded again. Its lattice holds every piece of the vocabulary at every
character where it fits (what the model writes by bytes has that one way); a segmentation's weight is the
product of its pieces' weights, which fall with a piece's rank. Between two characters that no piece has next
to each other every path has a boundary, so the lattice is a chain of segments, mostly words; sums over all
ways to the end of a segment, taken backward, turn weights into probabilities. All paths race:
each arrives after an exponential time whose rate is its probability (the logarithm of that time, negated,
is its Gumbel-perturbed log-probability), and the first k to arrive are a sample without replacement. A best-
first search finds them. A node is a set of paths that share a prefix, with the time its first path arrives;
the node that is due first is split: its first path is drawn, and of the paths that leave it at each place,
and of all that leave it farther on, the first arrival is the node's time plus an exponential one.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import re
import sys
from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import strings, tidy


@dataclass(frozen=True)
class Settings:
    """model: the vocabulary file. samples: segmentations of each text. ahead: places a node is split into at a time. kept: characters
    of words whose lattices are held, 120 bytes each. together: characters of the texts that are sampled at a time. release:
    whether a worker lets its words go after each task. Results depend on none of these three."""

    model: str = "/opt/tokenizers/piece_bpe_32k.model"
    samples: int = 2
    power: float = 1.0
    ahead: int = 8
    kept: int = 2_000_000
    together: int = 1 << 18
    release: bool = False
    seed: int = 10


def vocabulary(p: sentencepiece.SentencePieceProcessor, s: Settings) -> tuple[dict[str, int], dict[str, float]]:
    """The ids and log-weights of the pieces that stand for their own characters."""
    n = p.get_piece_size()
    plain = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in range(n)]
    names = p.id_to_piece(list(range(n)))
    ids = {names[i]: i for i in range(n) if plain[i]}
    score = [p.get_score(i) for i in range(n)]
    return ids, {w: -s.power * float(np.log(10 + (-score[i] if score[i] > -1e8 else 0))) for w, i in ids.items()}


class Search:
    """The first paths to arrive, by splitting what is left of those that have. ``_rows`` gives the log-probabilities of all
    choices of states."""

    def __init__(self, s: Settings):
        self.s = s

    def _search(self, key: int) -> Generator[tuple, tuple, tuple[list[tuple[tuple, float]], float]]:
        """Asks for a path that leaves another at a place by a choice (or for any path), and takes its choices, the sums of
        their log-probabilities before each place, and the places' states."""
        s = self.s
        rng = np.random.Generator(np.random.SFC64([s.seed & 0xFFFFFFFF, key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF]))
        # A node: the time of its first path; a number against ties; the path it follows; from where it may leave that path;
        # at which place it has left it already, by which choice (or none).
        start = float(rng.standard_exponential())
        queue: list[tuple] = [(start, 0, None, 0, -1, -1)]
        out: list[tuple[tuple, float]] = []
        number = 1
        while queue and len(out) < s.samples:
            time, _, base, since, at, choice = heapq.heappop(queue)
            if base is not None and at < 0:  # paths that leave ``base`` at ``since`` or later: split by place
                number = self._split(queue, number, time, base, since, rng)
                continue
            path = yield base, at, choice, rng
            out.append((path, float(path[1][-1])))
            number = self._remainder(queue, number, time, path, at + 1, rng)
        return out, float(np.log(queue[0][0])) if queue else np.inf

    @staticmethod
    def _left(before: np.ndarray, since: int) -> float:
        """The log-probability of all paths that leave this one at ``since`` or later."""
        here, whole = before[since], before[-1]
        return here + np.log(-np.expm1(whole - here)) if whole < here else -np.inf

    def _remainder(self, queue: list, number: int, time: float, base: tuple, since: int, rng: np.random.Generator) -> int:
        rate = self._left(base[1], since)
        if rate > -np.inf:
            wait = np.exp(min(700.0, np.log(rng.standard_exponential()) - rate))
            heapq.heappush(queue, (time + wait, number, base, since, -1, -1))
        return number + 1

    def _split(self, queue: list, number: int, time: float, base: tuple, since: int, rng: np.random.Generator) -> int:
        """Of the paths that leave base from ``since`` on, one arrives at ``time``; where, is drawn; the rest come later."""
        path, before, states = base[:3]
        until = min(since + self.s.ahead, len(path))
        logs = self._rows(states[since:until])
        rates = before[since:until, None] + logs
        rates[np.arange(until - since), path[since:until]] = -np.inf
        rates = np.append(rates.ravel(), self._left(before, until) if until < len(path) else -np.inf)
        able = np.flatnonzero(rates > -np.inf)
        first = able[np.argmin(np.log(rng.standard_exponential(len(able))) - rates[able])]
        waits = np.exp(np.minimum(700.0, np.log(rng.standard_exponential(len(able))) - rates[able]))
        # Only arrivals that can still count are worth a place in the queue.
        keep = able[np.argsort(waits, kind="stable")[: self.s.samples + 1]]
        wait = dict(zip(able.tolist(), waits.tolist(), strict=True))
        for k in {int(first), *map(int, keep)}:
            due = time if k == first else time + wait[k]
            if k == len(rates) - 1:
                heapq.heappush(queue, (due, number, base, until, -1, -1))
            else:
                place, choice = divmod(k, logs.shape[1])
                heapq.heappush(queue, (due, number, base, since, since + place, choice))
            number += 1
        return number


#: Texts that a normaliser would change; where they come back as they are, words can be encoded by themselves.
PROBES = ("a b", " a  b ", "\ufb01 \u2460 \uff21 \u00bd", "\u00a0x\u3000y\u200bz\ufeff", "a\tb\r\nc\x01\x7f", "e\u0301 \u00e9 \u212b", "\n\n x")


#: A letter: no sign, digit, raised digit or fraction.
LETTER = r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]"
#: Words that are encoded by themselves: with the spaces before them, or spaces before a line's end, or that end. If no piece
#: goes on behind a letter with another sign, a run of letters is a word.
WORDS, LETTERS = re.compile(r"\n| *[^ \n]+| +"), re.compile(rf"\n| *{LETTER}+| *[^ \n]+| +")


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of these runs begins when they are laid side by side, and the places of all their parts."""
    ends = np.cumsum(size)
    return ends - size, np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def roomy(array: np.ndarray, need: int) -> np.ndarray:
    """The array, with place for so many entries; it grows by doubling."""
    return array if need <= len(array) else np.append(array, np.zeros(max(need, 2 * len(array)) - len(array), array.dtype))


class Lattice(Search):
    """The lattice of all pieces. A state is a character; its choice k is the piece of k + 1 characters from there.

    Texts are cut into units, mostly words, over whose bounds no piece reaches; units are encoded and built as they are met,
    and kept. Of each state there are ``cuts`` (sums of the chances of its choices, to within 2^-24; 2 from the last one on; ``short``: the first four),
    the ``ids`` of the pieces (-1 for none), ``rest`` (the log of the weight of all ways to the end of its segment), whether a
    segment begins there, ``opens``, and ``behind``, what the rest is for a piece that ends before it: 0 if one does. When there are more than ``kept`` states, the units met most often fill half of that
    and the others are forgotten; those met again are built anew.
    """

    SLOTS = 1 << 18

    #: What a worker is sent, made once by the driver.
    TABLES = ("flat", "lengths", "meet", "logs", "base", "parent", "piece", "words_alone", "ends_words")

    def __init__(self, model: bytes, s: Settings, tables: bytes | None = None):
        super().__init__(s)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        if tables is None:
            self._make()
        else:
            with np.load(io.BytesIO(tables)) as had:
                for name in self.TABLES:
                    setattr(self, name, had[name])
        self.size = len(self.base) - self.slots()
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.first, self.last = (self.flat[x].astype(np.int64) for x in (self.offsets, self.offsets + self.lengths - 1))
        self.width = int(self.lengths.max())
        self.weight = np.where(self.piece < 0, 0.0, np.exp(self.logs)[self.piece])
        self.pattern = LETTERS if self.ends_words else WORDS
        self._clear()

    def slots(self) -> int:
        """The largest power of two below the length of the trie's tables."""
        return 1 << (len(self.base) - 1).bit_length() - 1

    def tables(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{name: getattr(self, name) for name in self.TABLES})
        return out.getvalue()

    def _make(self) -> None:
        p = self.processor
        n = p.get_piece_size()
        ids, weight = vocabulary(p, self.s)
        names = p.id_to_piece(list(range(n)))
        codes = {c: k for k, c in enumerate(sorted({c for w in ids for c in w}))}
        # A piece that is not of characters (a byte, say) is a character by itself.
        own = [tuple(codes[c] for c in names[i]) if names[i] in ids and ids[names[i]] == i else (len(codes) + i,) for i in range(n)]
        size = len(codes) + n
        self.flat, self.lengths = np.array([c for x in own for c in x], np.int32), np.array([len(x) for x in own])
        pairs = np.unique([a * size + b for x in own for a, b in zip(x, x[1:], strict=False)]).astype(np.int64)
        self.meet = np.zeros(1 << 20, bool)  # by the low bits; pairs that only look alike join segments, which changes no probability
        self.meet[pairs & (1 << 20) - 1] = True
        self.logs = np.array([weight[names[i]] if len(x) > 1 or x[0] < len(codes) else 0.0 for i, x in enumerate(own)] + [-np.inf])  # of no piece, the last
        self._trie(own, size)
        self.words_alone = np.array(
            all(w.strip("\u2581").find("\u2581") < 0 and (w == "\u2581" * len(w) or not w.endswith("\u2581")) and "\n" not in w for w in ids)
            and len(p.encode("\n")) == 2
            and p.id_to_piece(p.encode("\n")[0]) == "\u2581"
            and all(p.decode(p.encode(x)) == x for x in PROBES)
        )
        letter = {c: re.fullmatch(LETTER, c) is not None for c in codes}
        self.ends_words = np.array(not any(letter[a] and not letter[b] for w in ids for a, b in zip(w, w[1:], strict=False)))

    def _trie(self, own: list[tuple[int, ...]], size: int) -> None:
        """Nodes are slots: the child of a node by a code is at the node's base plus the code, if ``parent`` there is the node."""
        below: list[dict[int, int]] = [{}]
        ends = {}
        for i, x in enumerate(own):
            node = 0
            for c in x:
                if c not in below[node]:
                    below[node][c] = len(below)
                    below.append({})
                node = below[node][c]
            ends[node] = i
        slots = max(self.SLOTS, 1 << (4 * len(below)).bit_length(), 2 * size)
        slots = 1 << (slots - 1).bit_length()
        self.base, self.parent = np.zeros(slots + size, np.int32), np.full(slots + size, -1, np.int32)
        self.piece = np.full(slots + size, -1, np.int32)
        # The root is in slot 0 with its children behind it. Nodes with most children go first; their parents may come later.
        rng, used = np.random.default_rng(1), np.zeros(slots + size, bool)
        used[: size + 1] = True
        bases = {0: 1}
        for node in sorted(range(1, len(below)), key=lambda k: -len(below[k])):
            if below[node]:
                cs = np.array(list(below[node]))
                while used[(at := int(rng.integers(0, slots))) + cs].any():
                    pass
                used[at + cs] = True
                bases[node] = at
        slot = {0: 0}
        for node in range(len(below)):  # parents have smaller numbers
            if below[node]:
                self.base[slot[node]] = bases[node]
                for c, child in below[node].items():
                    slot[child] = bases[node] + c
                    self.parent[slot[child]] = slot[node]
            if node in ends:
                self.piece[slot[node]] = ends[node]

    def _clear(self) -> None:
        self.known: dict[bytes | str, int] = defaultdict(count().__next__)
        # Of each unit: its first state, how many it has, where its encoding begins, how long that is, how often it was met.
        self.begin, self.extent, self.id_begin, self.id_count, self.used = (np.zeros(0, np.int64) for _ in range(5))
        self.given = np.zeros(0, np.int32)
        self.states = self.built = self.ids_given = 0
        self.cuts, self.short, self.ids = np.zeros((0, self.width), np.float32), np.zeros((0, min(4, self.width)), np.float32), np.zeros((0, self.width), np.int16 if len(self.lengths) < 1 << 15 else np.int32)
        self.rest, self.behind, self.opens = np.zeros(0), np.zeros(1), np.ones(1, bool)

    def _room(self, more: int) -> None:
        if (need := self.states + more) >= len(self.ids):
            room = max(need, min(2 * need, self.s.kept + self.s.kept // 4))
            for name in ("cuts", "short", "ids", "rest", "behind", "opens"):
                old = getattr(self, name)
                new = np.zeros((room + 1, *old.shape[1:]), old.dtype)
                new[: self.states] = old[: self.states]
                setattr(self, name, new)

    def units(self, text: str) -> list[bytes | str]:
        """Parts of a text over whose bounds no piece reaches: its lines' words with the spaces before them, or, if the model
        does not encode these by themselves, segments of its encoding."""
        if not text:
            return []
        if self.words_alone:
            return self.pattern.findall(" " + text.replace("\u2581", " "))
        return self.parts(np.array(self.processor.encode(text, num_threads=1), np.int32))

    def parts(self, ids: np.ndarray) -> list[bytes]:
        """An encoding as units."""
        if not len(ids):
            return []
        joined = self.meet[self.last[ids[:-1]] * self.size + self.first[ids[1:]] & (1 << 20) - 1]
        ends = [*(4 * (np.flatnonzero(~joined) + 1)).tolist(), 4 * len(ids)]
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _encoded(self, units: list[bytes | str], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one behind the other, and how many each has."""
        if not isinstance(units[0], str):
            return np.frombuffer(b"".join(units), np.int32), np.array([len(x) // 4 for x in units])
        # Units are lines of a text, whose ends, pieces of their own, tell them apart. A space goes before every text by itself.
        end = self.processor.encode("\n")[1]
        plain = [x for x in units if x != "\n"]
        found = self.processor.encode(["\n" + "\n".join(plain[k : k + together]) for k in range(0, len(plain), together)], num_threads=1)
        ids = np.array(list(chain.from_iterable(x[1:] for x in found)), np.int32)
        many = np.diff(np.flatnonzero(ids == end), append=len(ids)) - 1
        ids = ids[ids != end]
        if len(plain) < len(units):
            k = units.index("\n")
            ids, many = np.insert(ids, many[:k].sum(), end), np.insert(many, k, 1)
        return ids, many

    def numbers(self, units: list[list[bytes | str]]) -> list[np.ndarray]:
        """The numbers of each text's units; those met first are built, all at once."""
        if self.states > self.s.kept:
            self._forget()
        ask = self.known.__getitem__
        out = [np.fromiter(map(ask, x), np.int64, len(x)) for x in units]
        if fresh := list(islice(reversed(self.known), len(self.known) - self.built)):
            self._build(fresh[::-1])
        for x in out:
            np.add.at(self.used, x, 1)
        return out

    def encoded(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of texts of these units."""
        whole = np.concatenate(numbers)
        at, places = spread(self.id_begin[whole], self.id_count[whole])
        ends = np.r_[at, len(places)][np.cumsum([len(x) for x in numbers])]
        return np.split(self.given[places], ends[:-1])

    def _build(self, fresh: list[bytes | str]) -> None:
        ids, many = self._encoded(fresh)
        size = self.lengths[ids]
        upto = np.cumsum(size)
        codes = self.flat[spread(self.offsets[ids], size)[1]]
        unit_end = np.cumsum(many)
        opening = np.r_[True, ~self.meet[self.last[ids[:-1]] * self.size + self.first[ids[1:]] & (1 << 20) - 1]]
        opening[unit_end[:-1]] = True
        begins = (upto - size)[opening]
        n, top = len(codes), self.states
        ends = np.r_[begins[1:], n]
        extent = ends - begins
        self._room(n)
        self.opens[top : top + n] = False
        self.opens[top + begins] = True
        self.opens[top + n] = True
        weights, pieces = np.zeros((self.width, n)), self.ids[top : top + n]
        pieces[:] = -1
        at, end, node = np.arange(n), np.repeat(ends, extent), np.zeros(n, np.int32)
        self.base[0] = 1
        for k in range(self.width):
            child = self.base[node] + codes[at + k]
            able = self.parent[child] == node
            at, child, end = at[able], child[able], end[able]
            weights[k, at], pieces[at, k] = self.weight[child], self.piece[child]
            more = (at + k + 1 < end) & (self.base[child] > 0)
            at, node, end = at[more], child[more], end[more]
            if not len(at):
                break
        wide = k + 1  # no piece here is longer
        weights = weights[:wide]
        # Backward through all segments at once, the longest first; sums are held as multiples of the last one.
        order = np.argsort(-extent, kind="stable")
        longest, last = extent[order], ends[order]
        sums, ref, rest = np.zeros((wide, len(order))), np.zeros(len(order)), self.rest[top : top + n]
        sums[0] = 1
        left = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), side="right")
        for t, m in enumerate(left.tolist(), 1):
            place, reach = last[:m] - t, min(t, wide)
            part = weights[:reach, place] * sums[:reach, :m]
            whole = part.sum(0)
            scale = np.where(whole > 0, whole, 1.0)
            ref[:m] += np.log(scale)
            rest[place] = np.where(whole > 0, ref[:m], -np.inf)
            part /= scale
            weights[:reach, place] = part
            sums[1:, :m] = sums[:-1, :m] / scale
            sums[0, :m] = whole > 0
        self.behind[top : top + n + 1] = np.where(self.opens[top : top + n + 1], 0.0, np.append(rest, 0.0))
        cuts, later = self.cuts[top : top + n], np.zeros(n, bool)
        cuts[:, wide:] = 2
        upto_k = np.cumsum(weights, axis=0)
        for k in reversed(range(wide)):
            cuts[:, k] = np.where(later, upto_k[k], 2)
            later |= weights[k] > 0
        self.short[top : top + n] = cuts[:, : self.short.shape[1]]
        unit_states = upto[unit_end - 1]
        own = slice(self.built, self.built + len(many))
        for name, new in (("begin", top + np.r_[0, unit_states[:-1]]), ("extent", np.diff(unit_states, prepend=0)), ("id_begin", self.ids_given + unit_end - many), ("id_count", many), ("used", 0)):
            setattr(self, name, roomy(getattr(self, name), own.stop))
            getattr(self, name)[own] = new
        self.given = roomy(self.given, self.ids_given + len(ids))
        self.given[self.ids_given : self.ids_given + len(ids)] = ids
        self.states, self.built, self.ids_given = self.states + n, own.stop, self.ids_given + len(ids)

    def _forget(self) -> None:
        often = np.argsort(-self.used[: self.built], kind="stable")
        stay = np.sort(often[(np.cumsum(self.extent[often]) <= self.s.kept // 2) & (self.used[often] > 1)])
        names = list(self.known)
        numbers = count(len(stay))
        self.known = defaultdict(numbers.__next__, zip([names[k] for k in stay.tolist()], range(len(stay)), strict=True))
        at, states = spread(self.begin[stay], self.extent[stay])
        for name in ("cuts", "short", "ids", "rest", "behind", "opens"):
            own = getattr(self, name)
            own[: len(states)] = own[states]
        self.states, self.built, self.begin, self.extent = len(states), len(stay), at, self.extent[stay]
        self.opens[self.states], self.behind[self.states] = True, 0.0
        at, places = spread(self.id_begin[stay], self.id_count[stay])
        self.given, self.id_begin, self.id_count, self.used, self.ids_given = self.given[places], at, self.id_count[stay], self.used[stay] // 2, len(places)

    def sample(self, ids: np.ndarray, key: int) -> tuple[list[tuple[np.ndarray, float]], float]:
        """The first ``samples`` paths to arrive, each as its pieces with its log-probability, and the log of the time of the next one.

        Texts with fewer segmentations give them all; the time of the next is then infinite.
        """
        return self.sample_all(self.numbers([self.parts(ids.astype(np.int32))]), [key])[0]

    def sample_all(self, texts: list[np.ndarray], keys: list[int]) -> list[tuple[list[tuple[np.ndarray, float]], float]]:
        """The samples of texts of these units, none empty; their paths are drawn side by side, each with its own numbers."""
        numbers = np.concatenate(texts)
        extent = self.extent[numbers]
        ends, states = np.cumsum(extent), spread(self.begin[numbers], extent)[1]
        closed = np.append(self.opens[states], True)
        starts = np.flatnonzero(closed[:-1])
        cut = np.cumsum([len(x) for x in texts])
        bounds = [0, *ends[cut - 1].tolist()]
        edges = np.searchsorted(starts, bounds).tolist()
        own = [starts[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        out: list = [None] * len(texts)
        searches = [self._search(key) for key in keys]
        asked = [(k, next(x)) for k, x in enumerate(searches)]
        unit = np.zeros(len(states), np.float32)
        while asked:
            # The part of a path before the place where it leaves another is the other's.
            taken, active = np.full(len(states), -1, np.int8), []
            for k, (base, at, choice, rng) in asked:
                since = bounds[k]
                if base is None:
                    active.append(own[k])
                else:
                    place = base[3][at]
                    taken[place] = choice
                    since = place + choice + 1
                    active.append(own[k][np.searchsorted(own[k], place, side="right") :])
                    if not closed[since]:
                        active.append(np.array([since]))
                rng.random(bounds[k + 1] - since, np.float32, unit[since : bounds[k + 1]])
            now = np.concatenate(active)
            while len(now):  # all segments a step at a time
                chance, place = unit[now], states[now]
                drawn = (chance[:, None] < self.short[place]).argmax(1)
                if len(far := np.flatnonzero(chance >= self.short[place, -1])):
                    drawn[far] = (chance[far, None] < self.cuts[place[far]]).argmax(1)
                taken[now] = drawn
                now = now + drawn + 1
                now = now[~closed[now]]
            places = np.flatnonzero(taken >= 0)
            path, at_ = taken[places].astype(np.int64), states[places]
            logs = self._log(at_, path)
            edges = np.searchsorted(places, bounds).tolist()
            again = []
            for k, (base, at, _, _) in asked:
                a, b = edges[k], edges[k + 1]
                before = np.zeros(b - a + 1)
                np.cumsum(logs[a:b], out=before[1:])
                way = (path[a:b], before, at_[a:b], places[a:b])
                if base is not None:
                    way = tuple(np.concatenate([x[:at], y]) for x, y in zip(base, (path[a:b], before + base[1][at], *way[2:]), strict=True))
                try:
                    again.append((k, searches[k].send(way)))
                except StopIteration as done:
                    found, after = done.value
                    out[k] = [(self.ids[way[2], way[0]], log_p) for way, log_p in found], after
            asked = again
        return out

    def _log(self, states: np.ndarray, choices: np.ndarray) -> np.ndarray:
        """The log-probabilities of choices: the piece's weight and that of all ways behind it, of all ways from here."""
        behind = self.behind[np.minimum(states + choices + 1, self.states)]
        return self.logs[self.ids[states, choices]] + behind - self.rest[states]

    def _rows(self, states: np.ndarray) -> np.ndarray:
        return self._log(states[:, None], np.arange(self.width))


def lattice(model: bytes, s: Settings, tables: bytes | None = None) -> Lattice:
    """Built once in each worker. Kept beside the interpreter, since these functions travel by value, anew for each task."""
    kept = vars(sys).setdefault("_webloom_lattices", {})
    key = (hashlib.sha256(model).digest(), repr(s))
    if key not in kept:
        kept.clear()
        kept[key] = Lattice(model, s, tables)
        tidy()
    return kept[key]


def row_key(key: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little")


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def model_bytes(path: str) -> bytes:
    """The vocabulary file, read by the driver."""
    with open(path, "rb") as f:
        return f.read()


def sampled_texts(own: Lattice, keys: list, texts: list[str]) -> Iterator[tuple]:
    """Each key and text with its encoding and its samples."""
    held, n = [], 0
    for k, (key, text) in enumerate(zip(keys, texts, strict=True)):
        held.append((key, text))
        n += len(text)
        if k == len(texts) - 1 or n >= own.s.together:
            numbers = own.numbers([own.units(t) for _, t in held])
            encoded = own.encoded(numbers)
            some = [k for k, x in enumerate(numbers) if len(x)]
            drawn = iter(own.sample_all([numbers[k] for k in some], [row_key(held[k][0]) for k in some]) if some else [])
            for (row, t), ids in zip(held, encoded, strict=True):
                yield row, t, ids, next(drawn) if len(ids) else ([], np.inf)
            held, n = [], 0


def encoder(model: bytes, s: Settings, carry: list[str], with_ids: bool, tables: bytes | None = None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, s, tables)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: dict[str, list] = {k: [] for k in ("n_pieces", "ids_sha256", "round_trip", "sample_pieces", "sample_sha256", "sample_log_prob", "sample_log_inclusion", "ids", "sample_ids")}
                for row, text, ids, (found, after) in sampled_texts(own, batch.column("_key").to_pylist(), strings(batch.column("_text"))):
                    sampled = [x for x, _ in found]
                    out["n_pieces"].append(len(ids))
                    out["ids_sha256"].append(digest(ids))
                    out["round_trip"].append(own.processor.decode(ids.tolist()) == text)
                    out["sample_pieces"].append([len(x) for x in sampled])
                    out["sample_sha256"].append([digest(x) for x in sampled])
                    out["sample_log_prob"].append([p for _, p in found])
                    out["sample_log_inclusion"].append([log_inclusion(p, after) for _, p in found])
                    if with_ids:
                        out["ids"].append(ids)
                        out["sample_ids"].append(sampled)
                kinds = [pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
                made = {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True) if with_ids or k not in ("ids", "sample_ids")}
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *made.values()], names=[*carry, *made])
        if s.release:
            own._clear()
        tidy()

    return encode


def log_inclusion(log_p: float, log_time: float) -> float:
    """The log-probability that a path of this probability arrives before that time."""
    x = log_p + log_time
    return 0.0 if x > 4 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)


def encode_texts(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The columns of ``carry`` and, for each text, n_pieces, ids_sha256 (of little-endian 32-bit ids), round_trip (the
    decoded ids are the text), and for its sampled segmentations, in order of arrival, sample_pieces, sample_sha256,
    sample_log_prob and sample_log_inclusion; with_ids also ids and sample_ids.

    Draws depend on the row's key and the seed only, so rows that repeat give the same; null is a key like
    any other. A null text is an empty one, which has no pieces and no samples; a text with fewer segmentations
    than asked for gives them all.
    """
    model = model_bytes(s.model)
    sent = docs.select(*(F.col(c) for c in carry), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sent.schema if f.name in carry)
    schema = kinds + "n_pieces long, ids_sha256 string, round_trip boolean, sample_pieces array<long>, sample_sha256 array<string>, sample_log_prob array<double>, sample_log_inclusion array<double>"
    return sent.mapInArrow(encoder(model, s, list(carry), with_ids, lattice(model, s).tables()), schema + ", ids array<int>, sample_ids array<array<int>>" * with_ids)


def decode_ids(rows: DataFrame, s: Settings = Settings(), ids: str = "ids", into: str = "text") -> DataFrame:
    """All columns of rows and the text of its ids; null ids give a null text."""
    model = model_bytes(s.model)
    names = rows.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        for b in batches:
            made = [None if x is None else own.decode(x) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(made, pa.string())], names=[*names, into])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    return rows.withColumn("_ids", F.col(ids).cast("array<int>")).mapInArrow(decode, f"{kinds}`{into}` string")
