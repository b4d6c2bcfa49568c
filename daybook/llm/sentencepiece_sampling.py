"""SentencePiece segmentations sampled without replacement: a perturbed A* search over the lattice, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import distinct, portions, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of a document; how much sharper than the pieces' weights the distribution is; the row keys' seed.
SAMPLES, SHARPNESS, SEED = 2, 1.0, 1
#: Nodes of lattices that a worker remembers; steps of a path whose siblings wait one by one, the later ones as one set.
REMEMBERED, EARLY = 700_000, 48
SPACE = "▁"
#: Units: no piece crosses from other characters to a space mark, and none holds a line break.
UNITS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Stands between units while a text is split; a text that holds it goes through UNITS.
_BETWEEN = "\0"
_GOLDEN, _STRIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that only the keys and the step decide."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(step + 1) * _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def uniform_of(key: np.uint64, step: int) -> float:
    """uniform() of one key."""
    full = (1 << 64) - 1
    z = int(key) + (step + 1) * int(_GOLDEN) & full
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & full
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & full
    return (((z ^ (z >> 31)) >> 11) + 0.5) / float(1 << 53)


def units_of(text: str) -> list[str]:
    """The matches of UNITS, which cover the text; where no space marks stand side by side, cutting before each finds them faster."""
    if SPACE + SPACE in text or _BETWEEN in text:
        return UNITS.findall(text)
    return list(filter(None, text.replace(SPACE, _BETWEEN + SPACE).replace("\n", f"{_BETWEEN}\n{_BETWEEN}").split(_BETWEEN)))


class Pieces:
    """The model's pieces with a log weight each. Its scores are merge ranks; weights fall with the rank as Zipf's law has it."""

    def __init__(self, path: str, sharpness: float) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(n)]
        self.byte_of = {k: int(names[k][3:5], 16) for k in range(n) if model.is_byte(k)}
        self.id_of_byte = {b: k for k, b in self.byte_of.items()}
        plain = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        ranked = sorted(plain, key=lambda k: (-model.get_score(k), k))
        self.weight = np.full(n, -np.log(len(plain) + 3.0) * sharpness)
        self.weight[ranked] = -np.log(np.arange(len(ranked)) + 3.0) * sharpness
        self.raw = [bytes([self.byte_of[k]]) if k in self.byte_of else names[k].replace(SPACE, " ").encode() for k in range(n)]
        self.weight_of_plain = np.append(np.exp(self.weight), 0.0)  # -1, no piece, weighs nothing
        # of each length: hashes of all beginnings of pieces, the piece that ends there or -1, whether a longer one begins so
        beginnings: list[dict[str, list]] = [{} for _ in range(max(len(names[k]) for k in plain))]
        for k in plain:
            for length in range(1, len(names[k]) + 1):
                entry = beginnings[length - 1].setdefault(names[k][:length], [-1, False])
                if length == len(names[k]):
                    entry[0] = k
                else:
                    entry[1] = True
        self.tables = []
        for length, found in enumerate(beginnings, 1):
            h = np.zeros(len(found), np.uint64)
            for c in range(length):
                h = self.fold(h, np.array([ord(x[c]) for x in found], np.uint64))
            # entries by the top bits of the hash, with where each of these buckets begins
            with np.errstate(over="ignore"):
                h = h * _GOLDEN
            order = np.argsort(h)
            h, bits = h[order], max(4, len(h).bit_length() + 2)
            begins = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            most = int(np.diff(begins).max())
            h = np.append(h, [np.uint64(0)] * most)
            self.tables.append((h, begins[:-1], np.uint64(64 - bits), most, np.array([x[0] for x in found.values()], np.int64)[order], np.array([x[1] for x in found.values()], bool)[order]))

    @staticmethod
    def fold(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h ^ (code + np.uint64(1))) * np.uint64(0x100000001B3) + (h >> np.uint64(31))

    @staticmethod
    def lookup(h: np.ndarray, entries: np.ndarray, begins: np.ndarray, shift: np.uint64, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are entries of a table, and the place of each of these."""
        with np.errstate(over="ignore"):
            h = h * _GOLDEN
        k = begins[h >> shift]
        hit = entries[k] == h
        for step in range(1, most):
            # only those not found yet look at the bucket's next entry
            left = np.flatnonzero(~hit & (entries[k] >> shift == h >> shift)) if step == 1 else left[~hit[left]]
            if not len(left):
                break
            at = k[left] + step
            found = entries[at] == h[left]
            hit[left[found]] = True
            k[left[found]] = at[found]
        return np.flatnonzero(hit), k[hit]

    def as_bytes(self, c: str) -> tuple[int, float]:
        """A character that is no piece goes as its bytes; where these are several, a negative id stands for them at first."""
        raw = c.encode()
        return self.id_of_byte[raw[0]] if len(raw) == 1 else -ord(c) - 1, float(np.exp(sum(self.weight[self.id_of_byte[b]] for b in raw)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the pieces, without the space that encoding puts before it."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:]


class Lattices:
    """Lattices of units, side by side: a node for each character, its edges the pieces that begin there, the longest first.

    Of an edge: the share of the node's mass up to it, its log probability, its piece, and the node it leads to (-1 at the end).
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.weight = pieces.weight_of_plain
        self.first = np.zeros(1 << 18, np.int64)
        self.cum, self.logp, self.ids, self.next = np.zeros(1 << 19), np.zeros(1 << 19), np.zeros(1 << 19, np.int32), np.zeros(1 << 19, np.int32)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.nodes = self.edges = 0

    def _room(self, nodes: int, edges: int) -> None:
        """Arrays double when they are full, so adding a few units doesn't copy all."""
        while nodes >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while edges > len(self.cum):
            self.cum, self.logp, self.ids, self.next = (np.concatenate([x, np.zeros_like(x)]) for x in (self.cum, self.logp, self.ids, self.next))

    def numbers(self, units: list[str]) -> np.ndarray:
        """The first node of each unit."""
        if self.nodes > REMEMBERED:
            self.reset()
        firsts, codes = distinct(pa.array(units, pa.large_string()))
        each = [units[k] for k in firsts.tolist()]
        known = self.known
        new = sorted([u for u in each if u not in known], key=len)
        # some at a time: the work stays in the processor's cache
        for at in range(0, len(new), 4000):
            self._add(new[at : at + 4000])
        return np.fromiter(map(self.known.__getitem__, each), np.int64, len(each))[codes]

    def _edges(self, text: str, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By length and place: the piece of that length that begins there, and its weight (0: none)."""
        p, n = self.pieces, len(text)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        pieces, weights = [], []
        at, h = np.arange(n), np.zeros(n, np.uint64)
        for length, (*table, found, longer) in enumerate(p.tables, 1):
            fits = room[at] >= length
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = p.fold(h, code[at + length - 1])
            begins, k = p.lookup(h, *table)
            at, h = at[begins], h[begins]
            piece = found[k]
            pieces.append(np.zeros(n, np.int32))
            weights.append(np.zeros(n))
            pieces[-1][at], weights[-1][at] = piece, self.weight[piece]
            on = longer[k]
            at, h = at[on], h[on]
        for k in np.flatnonzero(weights[0] == 0).tolist():
            pieces[0][k], weights[0][k] = p.as_bytes(text[k])
        return np.array(pieces), np.array(weights)

    def _add(self, units: list[str]) -> None:
        """Units come by length: all of one length are one block."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        stops = np.cumsum(sizes)
        pieces, weights = self._edges("".join(units), np.repeat(stops, sizes) - np.arange(stops[-1]))
        bounds = np.append(np.flatnonzero(np.diff(sizes, prepend=0)), len(units)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            size, count, here = int(sizes[a]), b - a, slice(int(stops[a] - sizes[a]), int(stops[b - 1]))
            longest = min(size, len(pieces))
            # by length (the longest first), place in the unit, unit
            weight = np.ascontiguousarray(weights[longest - 1 :: -1, here].reshape(longest, count, size).transpose(0, 2, 1))
            upto = np.empty_like(weight)
            mass = np.zeros((size + 1, count))
            mass[size] = 1
            for k in range(size - 1, -1, -1):
                m = min(longest, size - k)
                each = weight[longest - m :, k]
                each *= mass[k + m : k : -1]
                sums = np.cumsum(each, axis=0)
                mass[k] = sums[-1]
                each /= sums[-1]
                weight[: longest - m, k] = upto[: longest - m, k] = 0
                upto[longest - m :, k] = sums / sums[-1]
                if mass[k].min() < 1e-150:
                    # only ratios within a unit count
                    mass[k : k + longest] *= np.where(mass[k] < 1e-150, 1e150, 1)
            share = weight.transpose(2, 1, 0).reshape(count * size, longest)
            row, col = np.nonzero(share > 0)
            unit, place = np.divmod(row, size)
            heads = np.append(0, np.cumsum(np.bincount(row, minlength=count * size)))
            length = longest - col
            self._room(self.nodes + count * size, self.edges + len(row))
            edges = slice(self.edges, self.edges + len(row))
            cum = upto[col, place, unit]
            cum[heads[1:] - 1] = 2
            self.cum[edges] = cum
            self.logp[edges] = np.log(share[row, col])
            self.ids[edges] = pieces[:longest, here][length - 1, row]
            self.next[edges] = np.where(place + length < size, self.nodes + row + length, -1)
            self.first[self.nodes : self.nodes + count * size + 1] = self.edges + heads
            self.known.update(zip(units[a:b], range(self.nodes, self.nodes + count * size, size), strict=True))
            self.nodes, self.edges = self.nodes + count * size, self.edges + len(row)

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One path from each node to the end of its unit, drawn by the keys: all edges taken, and where each walk ends in them."""
        active, now = np.arange(len(nodes)), nodes
        taken, count, step = [], np.zeros(len(nodes), np.int64), 0
        while len(active):
            u = uniform(keys, step)
            edge = self.first[now]
            beyond = np.flatnonzero(u >= self.cum[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[u[beyond] >= self.cum[edge[beyond]]]
            taken.append((active, edge))
            count[active] += 1
            now = self.next[edge]
            on = now >= 0
            active, now, keys, step = active[on], now[on], keys[on], step + 1
        ends = np.cumsum(count)
        edges, starts = np.empty(int(count.sum()), np.int64), ends - count
        for step, (who, edge) in enumerate(taken):
            edges[starts[who] + step] = edge
        return edges, ends


@dataclass
class Path:
    """A segmentation: the edges taken, and the unit each of them is in."""

    edges: np.ndarray
    units: np.ndarray
    value: float


def _truncated(mass: float | np.ndarray, limit: float | np.ndarray, u: float | np.ndarray) -> float | np.ndarray:
    """A Gumbel value of a set with this log mass, given that it is below the limit."""
    return -np.logaddexp(-limit, np.log(-np.log(u)) - mass)


def _left(logq: np.ndarray) -> np.ndarray:
    """Log of the share that an edge of log probability logq leaves to the others."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(logq, 0)))


@dataclass
class _Doc:
    units: np.ndarray  # first nodes of its units
    key: np.uint64
    agenda: list
    paths: list
    drawn: int = 0


class Sampler:
    def __init__(self, path: str = MODEL, samples: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = SEED) -> None:
        self.pieces = Pieces(path, sharpness)
        self.lattices = Lattices(self.pieces)
        self.samples, self.seed = samples, seed

    def _waits(self, begun: list[tuple[_Doc, Path, int, float]]) -> None:
        """For each (document, path, first, log mass of the path before it): the sets of segmentations that leave the path at step first or later go on the agenda."""
        logq = np.zeros((len(begun), EARLY))
        rest = np.zeros(len(begun))
        for k, (_, path, first, _) in enumerate(begun):
            q = self.lattices.logp[path.edges[first:]]
            logq[k, : len(q)] = q[:EARLY]
            rest[k] = q[EARLY:].sum()
        before = np.cumsum(np.concatenate([np.array([[b[3]] for b in begun]), logq], axis=1), axis=1)
        # columns: each early step, then all later ones together
        masses = before + _left(np.concatenate([logq, rest[:, None]], axis=1))
        keys = np.array([d.key for d, _, _, _ in begun])
        drawn = np.array([d.drawn for d, _, _, _ in begun], np.uint64)
        with np.errstate(over="ignore"):
            keys = keys[:, None] + (drawn[:, None] + np.arange(EARLY + 1, dtype=np.uint64)) * _STRIDE
        values = self._values(masses, np.array([p.value for _, p, _, _ in begun])[:, None], uniform(keys, 1 << 40))
        for k, (doc, path, first, _) in enumerate(begun):
            self._push_best(doc, values[k], masses[k], before[k], path, first, EARLY)

    @staticmethod
    def _values(masses: np.ndarray, limit: float | np.ndarray, u: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.isfinite(masses), _truncated(masses, limit, u), -np.inf)

    def _push_best(self, doc: _Doc, values: np.ndarray, masses: np.ndarray, before: np.ndarray, path: Path, first: int, late: int) -> None:
        """Sets that leave `path` at step first, first + 1, ..; no more than are still to be taken, and one for the best value left out, can come up."""
        for k in np.argsort(-values, kind="stable")[: self.samples - len(doc.paths) + 1].tolist():
            if np.isfinite(values[k]):
                heapq.heappush(doc.agenda, (-float(values[k]), doc.drawn + k, float(masses[k]), path, first + k, k == late, (), float(before[k])))
        doc.drawn += len(values)

    def _branch(self, doc: _Doc) -> tuple[Path, int, int, float, float] | None:
        """Takes the best set off the agenda: the path it leaves, the step, the edge drawn instead, the value, the log mass of the prefix with it."""
        lat = self.lattices
        while doc.agenda:
            value, _, mass, path, step, late, out, prefix = heapq.heappop(doc.agenda)
            value = -value
            doc.drawn += 1
            u = uniform_of(doc.key, (1 << 41) + doc.drawn)
            if late:
                # one of the later steps, by its mass; the others wait one by one, below this value
                logq = lat.logp[path.edges[step:]]
                before = prefix + np.concatenate([[0.0], np.cumsum(logq)[:-1]])
                masses = before + _left(logq)
                p = np.exp(masses - masses.max())
                chosen = min(int(np.searchsorted(np.cumsum(p), u * p.sum())), len(p) - 1)
                masses[chosen] = -np.inf
                with np.errstate(over="ignore"):
                    keys = doc.key + (np.uint64(doc.drawn) + np.arange(len(masses), dtype=np.uint64)) * _STRIDE
                self._push_best(doc, self._values(masses, value, uniform(keys, 1 << 40)), masses, before, path, step, -1)
                step, prefix = step + chosen, float(before[chosen])
                doc.drawn += 1
                u = uniform_of(doc.key, (1 << 41) + doc.drawn)
            taken = int(path.edges[step])
            node = int(np.searchsorted(lat.first[: lat.nodes + 1], taken, side="right")) - 1
            a, b = int(lat.first[node]), int(lat.first[node + 1])
            p = np.exp(lat.logp[a:b])
            out = {taken, *out}
            p[[e - a for e in out]] = 0
            if p.sum() <= 0:
                continue
            k = min(int(np.searchsorted(np.cumsum(p), u * p.sum())), int(np.flatnonzero(p)[-1]))
            left = p.sum() - p[k]
            if left > 0 and np.any(np.delete(p, k) > 0):
                doc.drawn += 1
                more = prefix + float(np.log(left))
                again = float(_truncated(more, value, uniform_of(doc.key, (1 << 40) + doc.drawn)))
                heapq.heappush(doc.agenda, (-again, doc.drawn, more, path, step, False, tuple(out | {a + k}), prefix))
            return path, step, a + k, value, prefix + float(lat.logp[a + k])
        return None

    def sample(self, keys: list[int], texts: list[str]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Of each text up to `samples` different segmentations, best perturbed value first: ids, log probability, perturbed value, log inclusion score."""
        split = [units_of((" " + t).replace(" ", SPACE)) if t else [] for t in texts]
        numbers = self.lattices.numbers([u for units in split for u in units])
        ends = np.cumsum([0, *map(len, split)])
        docs = [_Doc(numbers[a:b], np.uint64(xxhash.xxh64_intdigest(f"{self.seed}:{k}".encode())), [], []) for k, a, b in zip(keys, ends[:-1], ends[1:], strict=True)]
        # the whole set of segmentations first; then, again and again, the best set that no earlier one has used up
        begun = [(d, None, 0, 0, float(-np.log(-np.log(uniform_of(d.key, 1 << 39)))), 0.0) for d in docs]
        for turn in range(self.samples):
            if turn:
                begun = [(d, *b) for d in docs if len(d.paths) == turn and (b := self._branch(d))]
            if begun:
                self._finish(begun, turn)
        return [self._results(d) for d in docs]

    def _finish(self, begun: list, turn: int) -> None:
        """Draws the rest of every path that was begun, all documents at once."""
        lat = self.lattices
        nodes, keys, bounds, at = [], [], [0], np.arange(max(len(b[0].units) for b in begun))
        for doc, path, step, edge, _, _ in begun:
            unit = 0
            start = doc.units
            if path is not None:
                unit, here = int(path.units[step]), int(lat.next[edge])
                unit, start = (unit, np.append(here, start[unit + 1 :])) if here >= 0 else (unit + 1, start[unit + 1 :])
            nodes.append(start)
            with np.errstate(over="ignore"):
                keys.append(doc.key + (at[unit : len(doc.units)].astype(np.uint64) + np.uint64((turn + 1) << 36)) * _STRIDE)
            bounds.append(bounds[-1] + len(start))
        edges, ends = lat.walk(np.concatenate(nodes), np.concatenate(keys))
        ends = np.concatenate([[0], ends])
        waiting = []
        for k, (doc, path, step, edge, value, prefix) in enumerate(begun):
            a, b = ends[bounds[k]], ends[bounds[k + 1]]
            units = np.repeat(at[len(doc.units) - (bounds[k + 1] - bounds[k]) : len(doc.units)], np.diff(ends[bounds[k] : bounds[k + 1] + 1]))
            if path is None:
                made, first = Path(edges[a:b], units, value), 0
            else:
                made, first = Path(np.concatenate([path.edges[:step], [edge], edges[a:b]]), np.concatenate([path.units[: step + 1], units]), value), step + 1
            doc.paths.append(made)
            waiting.append((doc, made, first, prefix))
        self._waits(waiting)

    def _results(self, doc: _Doc) -> list[tuple[np.ndarray, float, float, float]]:
        best_left = -doc.agenda[0][0] if doc.agenda else -np.inf
        out = []
        for path in doc.paths:
            logp = float(self.lattices.logp[path.edges].sum())
            if np.isneginf(best_left):
                inclusion = 0.0
            else:
                x = logp - best_left
                inclusion = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700)))))
            ids = self.lattices.ids[path.edges]
            if (ids < 0).any():
                parts = [[k] if k >= 0 else [self.pieces.id_of_byte[b] for b in chr(-k - 1).encode()] for k in ids.tolist()]
                ids = np.array([k for part in parts for k in part], np.int32)
            out.append((ids, logp, path.value, inclusion))
        return out


@lru_cache(maxsize=2)
def sampler(model: str, samples: int, sharpness: float, seed: int) -> Sampler:
    """One for all tasks of a worker: the model is read once, and lattices stay known."""
    return Sampler(model, samples, sharpness, seed)


OUT = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_hash string, round_trip boolean"


def sample_segmentations(docs: DataFrame, samples: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = SEED, model: str = MODEL, return_ids: bool = False) -> DataFrame:
    """Rows (doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_hash, round_trip), up to `samples` per row of docs.

    The lattice of a text holds every way to cut it into pieces of the model; a piece's weight falls with its merge rank, and a
    segmentation's probability is proportional to the product of its weights (to the power `sharpness`). Gumbel noise makes the
    largest perturbed values a sample without replacement: the search keeps sets of segmentations with the noise of their maximum
    and splits the best set. Units between spaces are independent lattices, so whole texts stay linear; a task holds one portion of
    400 kB or one text, and a few hundred bytes for each of its characters. log_inclusion is the log of the probability
    that the segmentation is among those drawn, given the best value left out. round_trip tells that decoding gives the text
    back (a U+2581 comes back as a space). All draws follow from seed and doc_id. With return_ids the ids follow as an array.

    A null text counts as empty; an empty text has one segmentation, without pieces. A text with fewer segmentations than
    asked for gives those it has. A row without a doc_id is ignored; rows that repeat a doc_id are drawn alike. Other columns
    are ignored. No rows give no rows.
    """
    out = OUT + ", ids array<int>" * return_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model, samples, sharpness, seed)
        for batch in batches:
            for part in portions(batch, 1, 400_000):
                rows: list[tuple] = []
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for key, text, found in zip(keys, texts, own.sample(keys, texts), strict=True):
                    whole = text.replace(SPACE, " ").encode()
                    for k, (ids, logp, value, inclusion) in enumerate(found):
                        ids = ids.astype("<i4")
                        row = (key, k + 1, len(ids), logp, value, inclusion, f"{xxhash.xxh64_intdigest(ids.tobytes()):016x}", own.pieces.decode(ids) == whole)
                        rows.append(row + ((ids,) if return_ids else ()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()] + [pa.list_(pa.int32())] * return_ids
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                names = [x.split()[0] for x in out.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(run, out)

