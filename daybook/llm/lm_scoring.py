"""Language-model scores: a causal self-attention model over subword ids, beside word counts of the whole corpus."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import in_fold, portions, whole_text, written
from daybook.llm.token_counts import PATTERN, VOCABULARY

#: Ids of the vocabulary with the end of a text as the last one.
END = 50256
IDS = END + 1
#: Positions of a window, and how many of them are context that the window before has scored.
WINDOW, CONTEXT = 32, 8
SCORED = WINDOW - CONTEXT
#: Size of a vector, of the layer after attention; classes of ids; ids with a vector of their own.
DIM, HIDDEN, CLASSES, OWN = 16, 32, 64, 4096
#: Ids of one row of training text; rounds after which the shards' weights are averaged, each on its share of all windows; windows of one shard.
STRETCH, ROUNDS, SHARD = 40 * SCORED, 3, 16384
#: Words this share of all tokens or more are looked up in memory: 1 / share of them at most, a word of more than LONG bytes only with so much larger a share.
HOT_SHARE, LONG = 1e-6, 64
#: Words whose ids a worker remembers.
REMEMBERED = 500_000

_RARE = pa.map_(pa.string(), pa.int64())


def tokens_of(texts: pa.Array) -> pa.ListArray:
    """Of each text its words, the runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z, and the empty word as its end."""
    kept = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    # a space after the last word leaves an empty one behind it
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(kept, ""), "", pc.binary_join_element_wise(kept, "", " ")))


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_ids(encoding: tiktoken.Encoding, word: bytes) -> list[int]:
    """Subword ids of a word with a space before it; the empty word is the end of a text."""
    return encoding.encode_ordinary(" " + word.decode()) if word else [END]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows; each row's end counts as the empty word. Each batch counts its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [tokens_of(part.column(0)).flatten().value_counts() for part in portions(batch, 0, 4_000_000)]
            each = [pa.RecordBatch.from_arrays([p.field("values"), p.field("counts")], ["word", "n"]) for p in parts]
            if each:
                sums = pa.Table.from_batches(each).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
                yield from sums.to_batches()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def subword_counts(counts: DataFrame, vocabulary: str) -> np.ndarray:
    """How often each id occurs in the counted words: IDS sums, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sums = encoder(vocabulary), np.zeros(IDS, np.int64)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in word_ids(encoding, word.encode()):
                    sums[k] += c
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["id", "n"])

    out = np.zeros(IDS, np.int64)
    for k, n in counts.select("word", "c").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[k] = n
    return out


# ---- windows


def stretches(encoded: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(key, lead, ids) from (doc_id, ids): each text, with END before it, cut every `stretch` ids; `lead` ids before a cut come along as context.
    Every id is in one stretch, so the windows of all stretches have each id of each text as a target once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, 4_000_000):
                keys, leads, pieces = [], [], []
                for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(np.uint16(END), np.frombuffer(raw, np.uint16))
                    for start in range(0, len(ids) - 1, stretch):
                        lead = min(CONTEXT, start)
                        keys.append(xxhash.xxh64_intdigest(f"{doc_id}:{start}".encode()) >> 1)
                        leads.append(lead)
                        pieces.append(ids[start - lead : start + stretch + 1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(leads, pa.int32()), pa.array(pieces, pa.binary())], ["key", "lead", "ids"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "key long, lead int, ids binary")


def training_windows(train: DataFrame, vocabulary: str, stretch: int = STRETCH) -> DataFrame:
    """The stretches of all rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(vocabulary, [], np.zeros(0))
        for batch in batches:
            for part in portions(batch, 1, 400_000):
                tokens = tokens_of(part.column(1))
                ids, word_ends = known.ids_of(known.numbers(tokens.flatten()))
                ends = word_ends[np.cumsum(tokens.value_lengths().to_numpy().astype(np.int64)) - 1]
                yield pa.RecordBatch.from_arrays([part.column(0), _packed_ids(ids, ends)], ["doc_id", "ids"])

    return stretches(train.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary"), stretch)


def _packed_ids(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of texts laid end to end as one string of 16-bit numbers a text."""
    packed = ids.astype(np.uint16)
    return pa.array([packed[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())


def windows_of(leads: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of stretches: inputs and targets, -1 where there is none."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
    stops = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(pieces), np.uint16)
    each = -(-(sizes - leads - 1) // SCORED)
    of = np.repeat(np.arange(len(pieces)), each)
    place = np.arange(len(of)) - (np.cumsum(each) - each)[of]
    at = ((stops - sizes + leads)[of] + place * SCORED)[:, None] + np.arange(-CONTEXT, SCORED + 1)
    inside = (at >= (stops - sizes)[of, None]) & (at < stops[of, None])
    found = np.where(inside, flat[np.where(inside, at, 0)].astype(np.int32), -1)
    inputs, targets = found[:, :-1].copy(), found[:, CONTEXT + 1 :]
    inputs[:, CONTEXT:][targets < 0] = -1
    return inputs, targets


#: Numbers of one row of summed arrays.
_PIECE = 4096


def _pieces(values: np.ndarray) -> pa.RecordBatch:
    parts = [values[k : k + _PIECE].astype(np.float64).tobytes() for k in range(0, len(values), _PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["piece", "part"])


def summed(parts: DataFrame) -> np.ndarray:
    """The sum of arrays that tasks cut up by _pieces(): each piece is added up where its rows meet; one array reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(part, np.float64)
                sums[piece] = sums[piece] + values if piece in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["piece", "part"])

    # sorted, so that sums of doubles come out alike in every run
    rows = sorted(parts.repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(run, "piece int, part binary").collect())
    return np.concatenate([np.frombuffer(r.part, np.float64) for r in rows]) if rows else np.zeros(0)


# ---- the model


@dataclass
class Model:
    class_of: np.ndarray  # of each id
    within: np.ndarray  # log10 share of each id in its class
    row_of: np.ndarray  # of each id, its row of the vectors; the last one is that of -1
    weights: dict[str, np.ndarray]


def classes_of(counts: np.ndarray, sides: np.ndarray | None, seed: int = 5) -> np.ndarray:
    """A class for each id: the OWN most frequent by their neighbours (sides), the others by how frequent they are."""
    rank = np.empty(IDS, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(IDS)
    rare = 8
    out = CLASSES - rare + np.minimum(rank * rare // IDS, rare - 1)
    seen = sides.sum(1) if sides is not None else np.zeros(0)
    known = np.flatnonzero(seen >= 10)
    if not len(known):
        return out
    own = min(CLASSES - rare, len(known))
    rng = np.random.default_rng(seed)
    x = np.sqrt(sides[known] / seen[known, None])
    centres = x[rng.choice(len(known), own, replace=False, p=seen[known] / seen[known].sum())]
    for _ in range(12):
        nearest = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for k in range(own):
            if (mine := nearest == k).any():
                centres[k] = np.average(x[mine], axis=0, weights=seen[known][mine])
    out[np.argsort(-counts, kind="stable")[:OWN][known]] = nearest
    return out


def begun(counts: np.ndarray, class_of: np.ndarray, seed: int = 5) -> Model:
    """The model before it is fitted: it gives each class its share of all ids."""
    rng = np.random.default_rng(seed)
    in_class = np.bincount(class_of, weights=counts + 0.5, minlength=CLASSES)
    within = np.log10((counts + 0.5) / in_class[class_of])
    row_of = OWN + class_of
    row_of[np.argsort(-counts, kind="stable")[:OWN]] = np.arange(OWN)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    share = np.maximum(in_class, 1e-9) / in_class.sum()
    w = {"E": normal(OWN + CLASSES + 1, DIM, scale=0.3), "P": normal(WINDOW, DIM, scale=0.1), "Q": normal(DIM, DIM, scale=0.25), "K": normal(DIM, DIM, scale=0.25), "V": normal(DIM, DIM, scale=0.25)}
    w |= {"W1": normal(DIM, HIDDEN, scale=0.3), "b1": np.zeros(HIDDEN, np.float32), "W2": normal(HIDDEN, CLASSES, scale=0.1), "b2": np.log(share).astype(np.float32)}
    return Model(class_of, within, np.append(row_of, OWN + CLASSES), w)


#: A query at scored position i sees the inputs up to its own: 1 there, else 0.
_CAUSAL = (np.arange(WINDOW) <= np.arange(SCORED)[:, None] + CONTEXT).astype(np.float32)


def _with_ones(m: np.ndarray, bias: np.ndarray, column: bool = False) -> np.ndarray:
    """The matrix with the bias as its last row, for inputs that end in a 1; with `column`, the outputs end in that 1 too."""
    out = np.zeros((len(m) + 1, m.shape[1] + column), m.dtype)
    out[:-1, : m.shape[1]], out[-1, : m.shape[1]] = m, bias
    if column:
        out[-1, -1] = 1
    return out


_WINDOW_ONES, _CLASS_ONES, _DIM_ONES = np.ones(WINDOW, np.float32), np.ones(CLASSES, np.float32), np.ones(DIM, np.float32)


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, outside: np.ndarray, goal: np.ndarray, out: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Of the mean negative log probability of the goals (classes; -1: none) of windows: rows of vectors, and which inputs are none. `out`: arrays to fill."""
    n, scale = len(rows), np.float32(DIM**-0.5)
    out = out if out is not None else {name: np.empty_like(v) for name, v in w.items()}
    cut = lambda m: m.reshape(n, -1, m.shape[-1])
    rows = rows.ravel()
    x = w["E"].take(rows, axis=0)
    whole = cut(x)
    whole += w["P"]
    # queries, keys and values side by side
    into = np.concatenate([w["Q"] * scale, w["K"], w["V"]], axis=1)
    qkv = cut(x @ into)
    q, k, v = qkv[:, CONTEXT:, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]
    a = q @ k.transpose(0, 2, 1)
    if a.max() > 60 or a.min() < -60:
        np.clip(a, -60, 60, out=a)
    np.exp(a, out=a)
    a *= _CAUSAL
    some = np.flatnonzero(outside.any(1))
    if len(some):
        a[some] *= ~outside[some, None]
    a *= (1 / (a.reshape(-1, WINDOW) @ _WINDOW_ONES)).reshape(n, SCORED, 1)
    seen = (a @ v).reshape(-1, DIM)
    h = np.empty((n * SCORED, DIM + 1), np.float32)
    np.add(whole[:, CONTEXT:], cut(seen), out=cut(h)[:, :, :DIM])
    h[:, DIM] = 1
    w1, w2 = _with_ones(w["W1"], w["b1"], column=True), _with_ones(w["W2"], w["b2"])
    u = h @ w1
    np.maximum(u, np.zeros_like(u), out=u)
    p = u @ w2
    if p.max() > 80:
        np.minimum(p, 80, out=p)
    np.exp(p, out=p)
    goal = goal.ravel()
    ok = np.flatnonzero(goal >= 0)
    share = np.zeros(len(goal), np.float32)
    share[ok] = 1 / max(1, len(ok))
    p *= (share / (p @ _CLASS_ONES))[:, None]
    p.reshape(-1)[ok * CLASSES + goal[ok]] -= share[ok]
    du = p @ w2.T
    du *= (u > 0).view(np.int8)
    dh = du @ w1[:DIM].T
    ds = cut(dh) @ v.transpose(0, 2, 1)
    # what the weights of a query add up to: the sum of a * (dh @ v)
    ds -= ((dh * seen) @ _DIM_ONES).reshape(n, -1, 1)
    ds *= a
    back = np.empty_like(qkv)
    back[:, :CONTEXT, :DIM] = 0
    np.matmul(ds, k, out=back[:, CONTEXT:, :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=back[:, :, DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), cut(dh), out=back[:, :, 2 * DIM :])
    back = back.reshape(-1, 3 * DIM)
    dx = back @ into.T
    cut(dx)[:, CONTEXT:] += cut(dh)
    out["E"].fill(0)
    np.add.at(out["E"].reshape(-1), (rows[:, None] * DIM + np.arange(DIM)).ravel(), dx.ravel())
    cut(dx).sum(0, out=out["P"])
    of_into, of_w1, of_w2 = (back.T @ x).T, (du.T @ h).T, (p.T @ u).T
    np.multiply(of_into[:, :DIM], scale, out=out["Q"])
    out["K"][:], out["V"][:] = of_into[:, DIM : 2 * DIM], of_into[:, 2 * DIM :]
    out["W1"][:], out["b1"][:] = of_w1[:DIM, :HIDDEN], of_w1[DIM, :HIDDEN]
    out["W2"][:], out["b2"][:] = of_w2[:HIDDEN], of_w2[HIDDEN]
    return out


def descend(model: Model, inputs: np.ndarray, targets: np.ndarray, rate: float, seed: int, batch: int = 64) -> dict[str, np.ndarray]:
    """The weights after one pass over the windows in steps of `batch`."""
    rng = np.random.default_rng(seed)
    # all weights end to end, so that a step moves them at once
    now = np.concatenate([v.ravel() for v in model.weights.values()])
    g, spare = np.empty_like(now), np.empty_like(now)
    w, of, at = {}, {}, 0
    for name, v in model.weights.items():
        w[name], of[name], at = now[at : at + v.size].reshape(v.shape), g[at : at + v.size].reshape(v.shape), at + v.size
    # sums of gradients and of their squares, fading: 10 and 100 times their running means
    first, second = np.zeros_like(now), np.zeros_like(now)
    outside, goals = inputs < 0, np.where(targets >= 0, model.class_of[targets], -1)
    for step, part in enumerate(np.array_split(rng.permutation(len(inputs)), -(-len(inputs) // batch)), 1):
        gradients(w, model.row_of[inputs[part]], outside[part], goals[part], of)
        first *= np.float32(0.9)
        first += g
        second *= np.float32(0.99)
        g *= g
        second += g
        # from the sums to the means, free of their start at zero
        even = (0.01 / (1 - 0.99**step)) ** 0.5
        np.sqrt(second, out=spare)
        spare += np.float32(1e-7 / even)
        np.divide(first, spare, out=spare)
        spare *= np.float32(rate * min(1.0, step / 20) / (1 - 0.9**step) * 0.1 / even)
        now -= spare
    return w


def neighbours(windows: DataFrame, counts: np.ndarray, kinds: int = 48) -> np.ndarray:
    """Of the OWN most frequent ids, how often each of `kinds` kinds (the most frequent ids, and all others) comes before and after: (OWN, 2 * kinds) sums."""
    rank = np.empty(IDS, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(IDS)
    shared = windows.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rank = np.zeros((OWN, 2 * kinds)), shared.value
        for batch in batches:
            for part in portions(batch, 1, 2_000_000):
                pieces = part.column(1).to_pylist()
                sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
                ranks = rank[np.frombuffer(b"".join(pieces), np.uint16)]
                # every target, as windows_of has them, and the id before it
                at = np.flatnonzero(np.arange(len(ranks)) > np.repeat(np.cumsum(sizes) - sizes + part.column(0).to_numpy(), sizes))
                a, b = ranks[at - 1], ranks[at]
                for one, other, offset in ((a, b, 0), (b, a, kinds)):
                    mine = one < OWN
                    sums += np.bincount(one[mine] * 2 * kinds + offset + np.minimum(other[mine], kinds - 1), minlength=sums.size).reshape(sums.shape)
        yield _pieces(sums.ravel())

    return summed(windows.select("lead", "ids").mapInArrow(run, "piece int, part binary")).reshape(OWN, 2 * kinds)


#: The weights that every window moves.
_COMMON = ("P", "Q", "K", "V", "W1", "b1", "W2", "b2")


def _shard_moves(shared, rate: float) -> Callable[[pa.Table], pa.Table]:  # noqa: ANN001
    """Of one shard's windows: how its weights move, times what they count for, and that."""

    def run(part: pa.Table) -> pa.Table:
        own = shared.value
        part = part.sort_by([("key", "ascending"), ("ids", "ascending")])
        inputs, targets = windows_of(part.column("lead").to_numpy(), part.column("ids").to_pylist())
        after = descend(own, inputs, targets, rate, int(part.column("shard")[0].as_py()))
        often = np.bincount(own.row_of[inputs].ravel(), minlength=len(own.weights["E"])).astype(np.float64)
        weight = float((targets >= 0).sum())
        moves = [((after["E"] - own.weights["E"]) * often[:, None]).ravel(), often, *((after[k] - own.weights[k]).ravel() * weight for k in _COMMON), np.array([weight])]
        return pa.Table.from_batches([_pieces(np.concatenate(moves))])

    return run


def fit(counts: np.ndarray, windows: DataFrame, rounds: int = ROUNDS, shard: int = SHARD, rate: float = 0.02) -> Model:
    """The model fitted on all windows of all stretches, each once. Stretches are dealt to rounds and shards by their keys. In a round every shard of
    about `shard` windows descends from the common weights on its own, and the weights move by the mean of the shards' moves; a vector by the mean
    over its own occurrences."""
    targets = F.octet_length("ids") / 2 - F.col("lead") - 1
    n = windows.agg(F.sum(F.ceil(targets / SCORED))).first()[0]
    if not n:
        return begun(counts, classes_of(counts, None))
    model = begun(counts, classes_of(counts, neighbours(windows, counts)))
    shards = -(-n // (shard * rounds)) * rounds
    dealt = windows.withColumn("shard", F.pmod("key", F.lit(shards)))
    for turn in range(rounds):
        shared = windows.sparkSession.sparkContext.broadcast(model)
        now = rate * (1 - turn / rounds)
        mine = dealt.filter(F.col("shard") % rounds == turn)
        sums = summed(mine.groupBy("shard").applyInArrow(_shard_moves(shared, now), "piece int, part binary"))
        if not len(sums):
            continue  # so few stretches that none was dealt to this round
        old = model.weights
        e, often = sums[: old["E"].size].reshape(old["E"].shape), sums[old["E"].size : old["E"].size + len(old["E"])]
        new, at = {"E": (old["E"] + e / np.maximum(often, 1)[:, None]).astype(np.float32)}, old["E"].size + len(old["E"])
        for k in _COMMON:
            new[k] = (old[k] + sums[at : at + old[k].size].reshape(old[k].shape) / sums[-1]).astype(np.float32)
            at += old[k].size
        model = Model(model.class_of, model.within, model.row_of, new)
    return model


class Scorer:
    """log10 probabilities of whole texts: every id once, in windows that overlap by their context."""

    def __init__(self, model: Model) -> None:
        w = model.weights
        self.model = model
        scale = np.float32(DIM**-0.5)
        # what each vector becomes, and what a window's position adds, is worked out once: of scored positions the query and the vector
        # itself, of all positions the key and the value; a value ends in a 1, so that the weights are added up along with it
        self.own = [np.concatenate([w[m] @ w["Q"] * scale, w[m]], axis=1) for m in ("E", "P")]
        self.all = [np.concatenate([w[m] @ w["K"], w[m] @ w["V"], np.full((len(w[m]), 1), m == "E", np.float32)], axis=1) for m in ("E", "P")]
        self.w1, self.w2 = _with_ones(w["W1"], w["b1"], column=True), _with_ones(w["W2"], w["b2"])

    def _windows(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        m = self.model
        rows = m.row_of[inputs]
        own = self.own[0].take(rows[:, CONTEXT:], axis=0)
        own += self.own[1][CONTEXT:]
        kv = self.all[0].take(rows, axis=0)
        kv += self.all[1]
        s = own[:, :, :DIM] @ kv[:, :, :DIM].transpose(0, 2, 1)
        if s.max() > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= _CAUSAL
        some = np.flatnonzero(inputs[:, 0] < 0)
        if len(some):
            s[some] *= inputs[some, None] >= 0
        seen = (s @ kv[:, :, DIM:]).reshape(-1, DIM + 1)
        # the last column divided by itself is the 1 that meets the biases
        h = seen / seen[:, DIM:]
        h[:, :DIM] += own.reshape(-1, 2 * DIM)[:, DIM:]
        u = h @ self.w1
        np.maximum(u, np.zeros_like(u), out=u)
        logits = u @ self.w2
        flat = targets.ravel()
        goals = logits.ravel().take(np.arange(len(flat)) * CLASSES + m.class_of[flat])
        if logits.max() > 80:
            np.minimum(logits, 80, out=logits)
        np.exp(logits, out=logits)
        found = (goals - np.log(logits @ _CLASS_ONES)) * (1 / np.log(10)) + m.within[flat]
        return np.where(flat >= 0, found, 0).reshape(targets.shape).sum(1)

    def score(self, ids: np.ndarray, ends: np.ndarray, chunk: int = 192) -> np.ndarray:
        """Of texts laid end to end (ids, where each ends; none is without ids): the log10 probability of each."""
        starts = np.concatenate([[0], ends[:-1]])
        before = np.concatenate([[END], ids[:-1]])
        before[starts] = END
        windows = -(-(ends - starts) // SCORED)
        first = np.cumsum(windows) - windows
        text = np.repeat(np.arange(len(ends)), windows)
        begin = starts[text] + (np.arange(len(text)) - first[text]) * SCORED
        sums = np.empty(len(text))
        for a in range(0, len(text), chunk):
            here = slice(a, a + chunk)
            at = begin[here, None] + np.arange(-CONTEXT, SCORED)
            inside = (at >= starts[text[here], None]) & (at < ends[text[here], None])
            at = np.where(inside, at, 0)
            sums[here] = self._windows(np.where(inside, before[at], -1), np.where(inside, ids[at], -1)[:, CONTEXT:])
        return np.add.reduceat(sums, first)


class Words:
    """Numbers of words, with the ids and, for the words counted in memory, the log count of each. Others are remembered up to a bound."""

    def __init__(self, vocabulary: str, hot: list[bytes], counts: np.ndarray) -> None:
        self.encoding, self.hot = encoder(vocabulary), len(hot)
        self.counted = list(hot)
        self.logs = np.log10(counts + 0.5)
        self._reset()

    def _reset(self) -> None:
        self.number, self.names = {}, []
        self.ids, self.start = np.zeros(1 << 20, np.int32), np.zeros(1 << 19, np.int64)
        self._add(self.counted)

    def _add(self, words: list[bytes]) -> None:
        n = len(self.names)
        lists = [word_ids(self.encoding, w) for w in words]
        ends = int(self.start[n]) + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        while n + len(words) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while len(ends) and ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if len(ends):
            self.ids[self.start[n] : ends[-1]] = [k for found in lists for k in found]
            self.start[n + 1 : n + 1 + len(words)] = ends
        self.names += words
        self.number.update(zip(words, range(n, n + len(words)), strict=True))

    def numbers(self, words: pa.Array | list[bytes]) -> np.ndarray:
        if len(self.names) > self.hot + REMEMBERED:
            self._reset()
        coded = (words if isinstance(words, pa.Array) else pa.array(words, pa.binary())).dictionary_encode()
        each = coded.dictionary.cast(pa.binary()).to_pylist()
        found = np.fromiter(map(self.number.get, each, repeat(-1)), np.int64, len(each))
        fresh = np.flatnonzero(found < 0)
        found[fresh] = len(self.names) + np.arange(len(fresh))
        self._add([each[k] for k in fresh.tolist()])
        return found[coded.indices.to_numpy()]

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, end to end, and where each word's end."""
        sizes = self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[numbers] - ends + sizes, sizes) + np.arange(int(ends[-1]))].astype(np.int64), ends


_words: dict[str, Words] = {}


def _of_worker(job: str, shared, vocabulary: str) -> Words:  # noqa: ANN001
    """One for all tasks of a worker that belong to one job."""
    if job not in _words:
        _words.clear()
        _words[job] = Words(vocabulary, *shared.value)
    return _words[job]


def lm_score(docs: DataFrame, fold: int = 1, stretch: int = STRETCH, rounds: int = ROUNDS, hot_share: float = HOT_SHARE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs with a doc_id: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Word counts c come from all rows outside the held-out fold; base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the
    words and the end of a text. Words of at least `hot_share` of all tokens, 1 / hot_share at most, are looked up in each
    task's memory; the others are joined by word, so no word is hot there. The model takes classes of subword ids from attention over the window,
    and ids within a class from the counts of the whole corpus. Its attention is fitted on all windows of every training row, each id a target once
    (stretches), by all tasks side by side (fit). Each word is encoded on its own, with a space before it. score is the model's log10 probability of the words and the end.

    A null text counts as empty: one token, its end. Rows that repeat a doc_id are rows of their own; rows without one are ignored. Without training rows c, N and V are 0, and the model gives every class its share. A text is worked on whole: a task holds
    some hundred bytes for each of its words, and the windows in chunks. `stretch` ids make one row of training text, which changes nothing else than where windows begin. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"))
    train = rows.filter(~in_fold(F.col("doc_id"), fold))
    counts = written(word_counts(train))
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n = n or 0
    least = F.lit(max(1.0, hot_share * n)) * F.greatest(F.lit(1.0), F.octet_length("word") / LONG)
    hot = counts.filter(F.col("c") >= least).select(F.col("word").cast("binary").alias("word"), "c").orderBy(F.desc("c"), "word").toArrow()
    shared = spark.sparkContext.broadcast((hot.column("word").to_pylist(), hot.column("c").to_numpy()))
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _of_worker(job, shared, vocabulary)
        for batch in batches:
            for part in portions(batch, 1, 400_000):
                said = tokens_of(part.column(1))
                numbers = known.numbers(said.flatten())
                tokens = said.value_lengths().to_numpy().astype(np.int64)
                ends = np.cumsum(tokens)
                ids, word_ends = known.ids_of(numbers)
                in_memory = numbers < known.hot
                logs = np.where(in_memory, known.logs[np.minimum(numbers, known.hot - 1)] if known.hot else 0.0, 0.0)
                # the other words of each text, with how often it has them
                text = np.repeat(np.arange(len(tokens)), tokens)[~in_memory]
                pairs, often = np.unique(text << 40 | numbers[~in_memory], return_counts=True)
                names = pa.array([known.names[k] for k in (pairs & (1 << 40) - 1).tolist()], pa.binary()).cast(pa.string())
                offsets = pa.array(np.searchsorted(pairs >> 40, np.arange(len(tokens) + 1)), pa.int32())
                begins = ends - tokens
                columns = [part.column(0), pa.array(tokens), pa.array(np.add.reduceat(in_memory.astype(np.int64), begins)), pa.array(np.add.reduceat(logs, begins)), _packed_ids(ids, word_ends[ends - 1])]
                yield pa.RecordBatch.from_arrays([*columns, pa.MapArray.from_arrays(offsets, names, pa.array(often.astype(np.int64)))], ["doc_id", "n_tokens", "hot_known", "hot_sum", "ids", "rare"])

    encoded = rows.mapInArrow(run, "doc_id long, n_tokens long, hot_known long, hot_sum double, ids binary, rare map<string, long>")
    encoded = written(encoded.withColumn("row", F.monotonically_increasing_id()))
    model = fit(subword_counts(counts, vocabulary), written(stretches(encoded.filter(~in_fold(F.col("doc_id"), fold)), stretch)), rounds)
    fitted = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(fitted.value)
        for batch in batches:
            for part in portions(batch, batch.num_columns - 1, 400_000):
                raw = part.column(part.num_columns - 1).to_pylist()
                ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) // 2
                scores = scorer.score(np.frombuffer(b"".join(raw), np.uint16).astype(np.int64), ends)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], ["row", "doc_id", "n_tokens", "hot_known", "hot_sum", "score"])

    scored = encoded.select("row", "doc_id", "n_tokens", "hot_known", "hot_sum", "ids").mapInArrow(score, "row long, doc_id long, n_tokens long, hot_known long, hot_sum double, score double")
    scored = written(scored)
    each = encoded.select("row", F.explode("rare").alias("word", "n")).join(counts, "word", "left")
    rest = each.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"))
    per_token = F.log10(F.lit(n + 0.5 * (v + 1)))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        in_fold(F.col("doc_id"), fold).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )
