"""Language-model scores of documents: a log-bilinear model, learned by noise-contrastive estimation.

Tokens are words and one end for each text. A token's unit is the word itself for the most frequent training words, OWN times
the cube root of the number of training tokens and so growing with the corpus, that occur FEWEST times or more, else one of ENDINGS
units by the word's last two bytes; the end is a unit of its own.
Each unit has a context vector r and an output vector q. The CONTEXT tokens before a token (ends before the text's start)
give the predicted vector h, the sum of r C_i over the positions i, each with a matrix C_i of its own. The units lie in
groups by frequency, as many as a group has units, and P(unit | context) = P(group | context) P(unit | group, context), both softmaxes of h's
products with the groups' or the group's units' vectors, plus biases: batches of contexts times all groups, and for each group its
tokens times its units, normalised. A word inside an ending unit has its add-one probability there, unknown words included,
so that the probabilities of all words that can follow add up to one.

Learning: executors count all words of all training texts; the biases start as these counts' logarithms. Then all training tokens are
learned from, once, by stochastic gradient steps on the two NCE objectives, in ROUNDS rounds over parts of the texts that are told apart
by the texts' hash. A task's first steps take START tokens, later ones PORTION at most; in a step's batch NOISE groups and in each group NOISE of its units are drawn from
their frequencies. In a round every task starts from the round before and learns by itself; then what the tasks have learned is averaged
by shuffle, each row by how often each task has used it, so that only averages, whose size is that of the model, reach the driver. Which
rows share a task depends on how the texts lie in files, and so, a little, do the scores.

Word counts stay distributed: only the HEAD most frequent words go to executors; the counts of the others are joined
to the texts' words by shuffle. A word outside the head is none of the HEAD most frequent, so that join has no hot keys. A word of
over LONGEST bytes is known by its SHA-256 and its last two bytes, in the head and elsewhere.

Defined results: a null or empty text is one end; rows that repeat a doc_id are scored each; a null
doc_id folds as the empty text does; a text of any length is scored whole, and its tokens are held together by its task. Without training
texts, also where all rows are held out, every token is unknown: its base is log10(1 / 1) = 0, and the units share the
probability as the model's start does.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold, small_batches, staged

OWN, FEWEST, ENDINGS, HEAD, LONGEST = 20, 5, 128, 1 << 17, 64
WIDTH, CONTEXT, GROUP, PIECE = 24, 3, 128, 64
ROUNDS, NOISE, PORTION, RATE = 4, 16, 8_192, 0.15
#: The first slope that a row has counts so many times, so that its first steps are short.
FIRST = 100
#: Tokens of the first steps of the first round; they double after every so many steps and in every round.
START, EVERY = 256, 32
#: Distinct words that a task counts before it passes their counts on.
HELD = 300_000
#: Characters of texts that are read together.
BLOCK = 1 << 20
#: Tokens whose products with all groups are held at once.
ROWS = 1 << 12


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space: what bytes do. Long words by their digest, which no UTF-8 text equals.
    Plainly, of one text; tokens() gives the same of many."""
    return [w if len(w) <= LONGEST else digest(w) for w in (text or "").encode("utf-8", "replace").lower().split()]


def digest(word: bytes) -> bytes:
    return b"\xff" + hashlib.sha256(word).digest() + word[-2:]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of BLOCK characters at most, or one text, with the first one's index."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if i > start and held + size > BLOCK:
            yield start, texts.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(texts) > start:
        yield start, texts.slice(start)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, bounds = cut.values.cast(pa.binary()), cut.offsets.to_numpy()
    size = pc.binary_length(flat).to_numpy()
    if not size.all():
        # White space at either end of a text leaves an empty word there.
        real = size > 0
        flat, bounds, size = flat.filter(pa.array(real)), np.r_[0, np.cumsum(real)][bounds], size[real]
    many = size > LONGEST
    if many.any():
        many = pa.array(many)
        flat = pc.replace_with_mask(flat, many, pa.array([digest(w) for w in flat.filter(many).to_pylist()], pa.binary()))
    return flat, np.diff(bounds)


def endings(found: pa.Array) -> np.ndarray:
    """ending() of each word."""
    last = pc.binary_slice(found, -2).dictionary_encode()
    return np.array([ending(w) for w in last.dictionary.to_pylist()], dtype=np.int32)[last.indices.to_numpy()]


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: text. Columns word (binary), n, for all texts."""

    def run(batches):
        held, size = [], 0

        def summed():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for _, block in blocks(batch.column(0)):
                found = pc.value_counts(tokens(block)[0])
                held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                size += len(found)
                if size > 2 * HELD:
                    held = [summed()]
                    size = held[0].num_rows
                    if size > HELD:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from summed().to_batches()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """The most frequent words with their units and logarithms; what executors get. The ending units follow the words' own
    ones, the end is the last unit."""

    def __init__(self, rows: list[tuple[bytes, int]], ends: int, own: int = 8_192):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.words = pa.array([w for w, _ in rows], pa.binary())
        self.own = sum(n >= FEWEST for _, n in rows[:own])
        self.end = self.own + ENDINGS
        self.units = self.end + 1
        self.kind = np.array([*[i if i < self.own else self.own + ending(w) for i, (w, _) in enumerate(rows)], self.end, self.end], dtype=np.int32)
        self.log = np.array([math.log10(n + 1) for _, n in rows], dtype=np.float64)
        self.end_log = math.log10(ends + 1)

    def read(self, texts: pa.Array):
        """For texts together: units and places in the head (-1: none, -2: end) of all tokens, their bounds, the words that have no place."""
        found, many = tokens(texts)
        at = pc.fill_null(pc.index_in(found, value_set=self.words), -1).to_numpy()
        bounds = np.r_[0, np.cumsum(many + 1)]
        is_word = np.ones(bounds[-1], dtype=bool)
        is_word[bounds[1:] - 1] = False
        place = np.full(bounds[-1], -2, dtype=np.int64)
        place[is_word] = at
        # The two last places stand for the end and for unknown words.
        kind = self.kind[place]
        unknown = found.filter(pa.array(at == -1))
        kind[place == -1] = self.own + endings(unknown)
        return kind, place, bounds, unknown

    def before(self, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The CONTEXT units before each token, the nearest first; ends before a text's start."""
        out = np.full((CONTEXT, kind.size), self.end, dtype=np.int32)
        sizes = np.diff(bounds)
        for i in range(CONTEXT):
            out[i, i + 1 :] = kind[: -i - 1]
            for j in range(i + 1):
                out[i, bounds[:-1][sizes > j] + j] = self.end
        return out


def _short(units: np.ndarray, n: int) -> np.ndarray:
    """The same numbers, all below n, in the type that sorts fastest."""
    return units.astype(np.uint16) if n <= 1 << 16 else units


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of sorted ones begins, and how many there are of it."""
    new = np.empty(rows.size, dtype=bool)
    new[:1] = True
    np.not_equal(rows[1:], rows[:-1], out=new[1:])
    first = np.flatnonzero(new)
    many = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=many[:-1])
    many[-1:] = rows.size - first[-1:]
    return first, many


def _run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of float32 rows that begin at `first`. numpy goes through a run once for each column, so two columns go
    together, as a complex number."""
    if first.size == values.shape[0]:
        return values
    even = values.shape[1] // 2 * 2
    out = np.empty((first.size, values.shape[1]), dtype=np.float32)
    out[:, :even] = np.add.reduceat(np.ascontiguousarray(values[:, :even]).view(np.complex64), first, axis=0).view(np.float32)
    if even < values.shape[1]:
        out[:, even] = np.add.reduceat(values[:, even], first)
    return out


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values and their numbers; rows are sorted."""
    first, many = _firsts(rows)
    return rows[first], _run_sums(values, first), many


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -30, 30)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.divide(1, out, out=out)


class Model:
    """r: context vectors; c: matrices of the positions; q, g: output vectors of units and groups, each with its bias last."""

    def __init__(self, unit_counts: np.ndarray, seed: int = 3, group: int | None = None):
        rng = np.random.default_rng(seed)
        n = unit_counts.size
        self.group = group or GROUP
        self.groups = -(-n // self.group)
        self.cuts = np.r_[np.arange(0, n, self.group), n]
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        share = (unit_counts + 1.0) / (unit_counts.sum() + n)
        # Frequent units first, so that a group's units are about equally frequent.
        self.order = np.argsort(-unit_counts, kind="stable")
        self.rank = np.empty(n, dtype=np.int32)
        self.rank[self.order] = np.arange(n, dtype=np.int32)
        self.share = share[self.order]
        self.of_group = np.add.reduceat(self.share, self.cuts[:-1])
        inside = self.share / np.repeat(self.of_group, np.diff(self.cuts))
        self.r = small(n, WIDTH)
        self.c = np.stack([np.eye(WIDTH, dtype=np.float32) / (i + 1) for i in range(CONTEXT)])
        self.q = np.concatenate([small(n, WIDTH) * 0.1, np.log(inside)[:, None].astype(np.float32)], axis=1)
        self.g = np.concatenate([small(self.groups, WIDTH) * 0.1, np.log(self.of_group)[:, None].astype(np.float32)], axis=1)
        #: What the noise of a set of rows is drawn from: shares of all rows up to each.
        self.upto = {"g": np.r_[0.0, np.cumsum(self.of_group)], "q": np.r_[0.0, np.cumsum(self.share)]}
        self.log_noise = {"g": np.log(NOISE * self.of_group / self.of_group.sum()).astype(np.float32), "q": np.log(NOISE * inside).astype(np.float32)}
        self.seen = {name: np.full(table.shape[0], 1e-4 if name == "c" else 0, dtype=np.float32) for name, table in zip("rqgc", self.tables())}

    def copy(self) -> Model:
        out = copy(self)
        out.r, out.c, out.q, out.g = self.r.copy(), self.c.copy(), self.q.copy(), self.g.copy()
        out.seen = {name: seen.copy() for name, seen in self.seen.items()}
        return out

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """h of each context, with a 1 for the bias."""
        h = np.ones((before.shape[1], WIDTH + 1), dtype=np.float32)
        h[:, :WIDTH] = sum(self.r[b] @ c for b, c in zip(before, self.c))
        return h

    # Learning

    def learn(self, before: np.ndarray, target: np.ndarray, rng: np.random.Generator, state: dict) -> None:
        """One step on a batch: contexts and the ranks of the tokens that followed them.

        A score s is log P itself: among one true and NOISE drawn candidates it is the true one with the probability
        sigmoid(s - log(NOISE * p)), p being what the noise is drawn from. The batch's contexts share the drawn groups, and
        those of one group the drawn units, so that noise is a product of matrices."""
        order = np.argsort(_short(target, self.share.size), kind="stable")
        before, target, size = before.take(order, axis=1), target.take(order), target.size
        # What a position's matrix makes of a unit, and back, is reckoned once for each unit of the batch.
        h, met = np.ones((size, WIDTH + 1), dtype=np.float32), []
        for i in range(CONTEXT):
            order = np.argsort(_short(before[i], self.share.size), kind="stable")
            units = before[i].take(order)
            first, many = _firsts(units)
            units = units[first]
            vectors = self.r.take(units, axis=0)
            at = np.empty(size, dtype=np.int64)
            at[order] = np.repeat(np.arange(units.size), many)
            made = (vectors @ self.c[i]).take(at, axis=0)
            if i:
                h[:, :WIDTH] += made
            else:
                h[:, :WIDTH] = made
            met.append((order, first, many, units, vectors))
        back = self.nce("g", h, target // self.group, np.array([0, self.groups]), rng, state)
        back += self.nce("q", h, target, self.cuts, rng, state)
        slopes = []
        for i, (order, first, _, _, vectors) in enumerate(met):
            sums = _run_sums(back.take(order, axis=0), first)
            slopes.append(sums @ self.c[i].T)
            slope = vectors.T @ sums / size
            rows = slice(i * WIDTH, (i + 1) * WIDTH)
            seen, used = self.kept("c", state)
            seen[rows] += (slope**2).mean(axis=1)
            used[rows] += size
            self.c[i] += RATE * 0.1 * slope / np.sqrt(seen[rows])[:, None]
        units = np.concatenate([m[3] for m in met])
        order = np.argsort(_short(units, self.share.size), kind="stable")
        at, sums, _ = _summed(units[order], np.concatenate(slopes).take(order, axis=0))
        times = np.bincount(units, np.concatenate([m[2] for m in met]), self.share.size)[at].astype(np.int64)
        self.step("r", at, sums, times, state)

    def nce(self, name: str, h: np.ndarray, true: np.ndarray, cuts: np.ndarray, rng: np.random.Generator, state: dict) -> np.ndarray:
        """The step of a table of output vectors whose rows lie in sets between `cuts`; `true`, sorted, are the contexts' true rows.
        Returns the slopes of h."""
        weights, upto = getattr(self, name), self.upto[name]
        low, high = upto[cuts[:-1], None], upto[cuts[1:], None]
        drawn = np.searchsorted(upto, low + rng.random((cuts.size - 1, NOISE)) * (high - low), "right") - 1
        drawn = np.clip(drawn, cuts[:-1, None], cuts[1:, None] - 1)
        log_noise = self.log_noise[name]
        own = weights.take(true, axis=0)
        up = 1 - _sigmoid(np.einsum("ij,ij->i", h, own) - log_noise.take(true))
        back = up[:, None] * own[:, :WIDTH]
        rows, sums, many = _summed(true, up[:, None] * h)
        bounds = np.searchsorted(true, cuts)
        if cuts.size == 2:
            of = first = np.zeros(1, dtype=np.int64)
            noise = weights[drawn[0]]
            down = _sigmoid(h @ noise.T - log_noise[drawn[0]])
            back -= down @ noise[:, :WIDTH]
            lost = -(down.T @ h)
        else:
            # Pieces of some contexts, each of one set: a product of matrices for each, all at once.
            piece = min(PIECE, max(8, true.size // cuts.size))
            pieces = -(-np.diff(bounds) // piece)
            of = np.repeat(np.arange(pieces.size), pieces)
            at = (bounds[of] + piece * (np.arange(of.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)))[:, None] + np.arange(piece)
            real = at < bounds[of + 1][:, None]
            held = h.take(np.minimum(at, true.size - 1), axis=0)
            noise = weights.take(drawn[of], axis=0)
            down = -_sigmoid(held @ noise.transpose(0, 2, 1) - log_noise.take(drawn[of])[:, None, :])
            down *= real[:, :, None]
            # The pieces' contexts are all contexts, in order.
            back += (down @ noise[:, :, :WIDTH]).reshape(-1, WIDTH).take(np.flatnonzero(real), axis=0)
            first, _ = _firsts(of)
            lost = _run_sums((down.transpose(0, 2, 1) @ held).reshape(of.size, -1), first)
        # True and drawn rows together.
        every = np.concatenate([rows, drawn[of[first]].ravel()])
        times = np.concatenate([many, np.repeat(np.diff(bounds)[of[first]], NOISE)])
        order = np.argsort(_short(every, weights.shape[0]), kind="stable")
        units = every.take(order)
        first, _ = _firsts(units)
        slopes = np.concatenate([sums, lost.reshape(-1, WIDTH + 1)]).take(order, axis=0)
        self.step(name, units.take(first), _run_sums(slopes, first), np.add.reduceat(times.take(order), first), state)
        return back

    def kept(self, name: str, state: dict) -> tuple[np.ndarray, np.ndarray]:
        """Squares of the slopes that each row has had, and how often it was used in this task."""
        if name not in state:
            state[name] = self.seen[name].copy(), np.zeros(self.seen[name].size, dtype=np.int64)
        return state[name]

    def step(self, name: str, at: np.ndarray, slopes: np.ndarray, times: np.ndarray, state: dict) -> None:
        """Steps up the slopes of distinct rows, for each row relative to the slopes it has had."""
        seen, used = self.kept(name, state)
        squares = np.einsum("ij,ij->i", slopes, slopes) / slopes.shape[1]
        seen[at] += np.where(seen[at] > 0, 1, FIRST) * squares + 1e-6
        used[at] += times
        table = getattr(self, name)
        table[at] = table.take(at, axis=0) + slopes * (RATE / np.sqrt(seen[at]))[:, None]

    # Averages

    def tables(self) -> list[np.ndarray]:
        """The rows of r, q, g, c."""
        return [self.r, self.q, self.g, self.c.reshape(-1, WIDTH)]

    def rows(self, state: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, uses and values of the rows that were used: r, q, g, c, all as wide as q, then the squares of their slopes."""
        ats, uses, values, first = [], [], [], 0
        for name, table in zip("rqgc", self.tables()):
            seen, used = self.kept(name, state)
            at = np.flatnonzero(used)
            wide = np.zeros((at.size, WIDTH + 2), dtype=np.float32)
            wide[:, : table.shape[1]] = table[at]
            wide[:, -1] = seen[at]
            ats.append(first + at)
            uses.append(used[at])
            values.append(wide)
            first += table.shape[0]
        return np.concatenate(ats), np.concatenate(uses), np.concatenate(values)

    def put(self, at: np.ndarray, values: np.ndarray) -> None:
        """Sets the rows with these numbers."""
        first = 0
        for name, table in zip("rqgc", self.tables()):
            own = (at >= first) & (at < first + table.shape[0])
            table[at[own] - first] = values[own, : table.shape[1]]
            self.seen[name][at[own] - first] = values[own, -1]
            first += table.shape[0]

    # Scores

    def log_probabilities(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 P(unit | context) of the ranks `target`, exactly normalised, in both levels."""
        out = np.empty(target.size)
        group = target // self.group
        h = np.empty((target.size, WIDTH + 1), dtype=np.float32)
        moved = [self.r @ c for c in self.c] if target.size > self.r.shape[0] else None
        for a in range(0, target.size, ROWS):
            own = slice(a, min(a + ROWS, target.size))
            if moved is None:
                h[own] = self.predicted(before[:, own])
            else:
                h[own, :WIDTH] = moved[0].take(before[0, own], axis=0)
                for i in range(1, CONTEXT):
                    h[own, :WIDTH] += moved[i].take(before[i, own], axis=0)
                h[own, WIDTH] = 1
            out[own] = _log_softmax(h[own] @ self.g.T, group[own])
        order = np.argsort(group.astype(np.int16), kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.groups + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            for a in range(bounds[k], bounds[k + 1], ROWS):
                own = order[a : min(a + ROWS, bounds[k + 1])]
                out[own] += _log_softmax(h.take(own, axis=0) @ self.q[k * self.group : (k + 1) * self.group].T, target[own] - k * self.group)
        return out / math.log(10)


def _log_softmax(s: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen columns' logarithms of the softmax of each row."""
    top = s[np.arange(chosen.size), chosen].astype(np.float64)
    with np.errstate(over="ignore"):
        sums = np.exp(s) @ np.ones(s.shape[1], dtype=s.dtype)
    out = top - np.log(np.maximum(sums, np.finfo(s.dtype).tiny))
    # Scores are near logarithms of probabilities; where they are not, the largest is taken off first.
    odd = np.flatnonzero(~((sums > 1e-30) & (sums < 1e30)))
    if odd.size:
        most = s[odd].max(axis=1, keepdims=True)
        out[odd] = top[odd] - most[:, 0] - np.log(np.exp(s[odd] - most).sum(axis=1))
    return out


def train(learned: DataFrame, head, start: Model) -> Model:
    """learned: text. Learns from all texts in ROUNDS rounds, from the model `start`. head: broadcast."""
    model = start
    for number in range(ROUNDS):
        part = learned.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == number)
        model = train_round(part, head, learned.sparkSession.sparkContext.broadcast(model), number)
    return model


def train_round(learned: DataFrame, head, start, number: int) -> Model:
    """learned: text. One pass of all tasks from the model `start`, averaged. head, start: broadcast."""

    def run(batches):
        head_, model = head.value, start.value.copy()
        rng, state = np.random.default_rng([7, number, TaskContext.get().partitionId()]), {}
        held, size, taken = [], 0, 0
        portion = lambda taken: min(PORTION, START << min(number + taken // EVERY, 20))
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                kind, _, bounds, _ = head_.read(block)
                held.append(np.concatenate([head_.before(kind, bounds), model.rank[kind][None]]))
                size += kind.size
                if size >= PORTION:
                    # The tokens of a step are from all over what was read.
                    rows = np.concatenate(held, axis=1).take(rng.permutation(size), axis=1)
                    at = 0
                    while size - at >= (step := portion(taken)):
                        model.learn(rows[:CONTEXT, at : at + step], rows[CONTEXT, at : at + step], rng, state)
                        at, taken = at + step, taken + 1
                    held, size = [rows[:, at:]], size - at
        rows, at = np.concatenate(held, axis=1).take(rng.permutation(size), axis=1) if size else None, 0
        while at < size:
            step = portion(taken)
            model.learn(rows[:CONTEXT, at : at + step], rows[CONTEXT, at : at + step], rng, state)
            at, taken = at + step, taken + 1
        at, weight, values = model.rows(state)
        for a in range(0, at.size, ROWS):
            own, wide = slice(a, a + ROWS), WIDTH + 2
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (at[own].size + 1) * wide, wide), pa.int32()), pa.array(values[own].ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(at[own]), pa.array(weight[own].astype(np.int64)), flat], ["at", "n", "v"])

    rows = learned.mapInArrow(run, "at bigint, n bigint, v array<float>")
    mean = [(F.sum(F.col("n") * F.col("v")[k].cast("double")) / F.sum("n")).cast("float").alias(f"v{k}") for k in range(WIDTH + 2)]
    found = rows.groupBy("at").agg(*mean).toArrow()
    model = start.value.copy()
    if found.num_rows:
        model.put(found["at"].to_numpy(), np.stack([found[f"v{k}"].to_numpy() for k in range(WIDTH + 2)], axis=1))
    return model


def scores(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """docs: doc_id, text. Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    out = fold(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    data = docs.select("doc_id", F.col("text").cast("string").alias("text"), out.alias("held_out"))
    learned = data.where(~F.col("held_out")).select("text")
    counts = staged(word_counts(learned), "counts")

    ends = learned.count()
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    wanted = int(OWN * tokens ** (1 / 3))
    # The least count of a head word: how many words have each count, largest first, as long as the head lasts.
    often = counts.groupBy("n").agg(F.count("*").alias("words"))
    least, size = None, 0
    for row in often.orderBy(F.desc("n")).limit(max(HEAD, wanted)).toLocalIterator():
        size += row.words
        if size > max(HEAD, wanted):
            break
        least = row.n
    is_head = F.col("n") >= least if least else F.lit(False)
    rows = counts.where(is_head).toArrow()
    head = Head(list(zip(rows["word"].to_pylist(), rows["n"].to_pylist())), ends, wanted)
    shared = sc.broadcast(head)

    # Tokens and distinct words of each ending unit: those of all words less those of the words that are units.
    kind = F.crc32(F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")) % ENDINGS
    tokens_in, words_in = np.zeros(ENDINGS, dtype=np.int64), np.zeros(ENDINGS, dtype=np.int64)
    for r in counts.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens_in[r.kind], words_in[r.kind] = r.n, r.v
    listed = sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist()), key=lambda r: (-r[1], r[0]))[: head.own]
    for w, n in listed:
        tokens_in[ending(w)] -= n
        words_in[ending(w)] -= 1
    inner = np.zeros(head.units)
    inner[head.own : head.end] = np.log10(tokens_in + words_in + 1)
    inner = sc.broadcast(inner)
    start = Model(np.r_[[n for _, n in listed], tokens_in, ends].astype(np.float64), group=math.isqrt(head.units))
    model = sc.broadcast(train(learned, shared, start))

    def run(batches):
        head, model_, inner_ = shared.value, model.value, inner.value
        log = head.log
        for batch in batches:
            row, n = batch.column(0), batch.num_rows
            size, known, base, score = (np.zeros(n, t) for t in (np.int64, np.int64, np.float64, np.float64))
            rest = []
            for first, block in blocks(batch.column(1)):
                kind, place, bounds, unknown = head.read(block)
                own = slice(first, first + len(block))
                value = model_.log_probabilities(head.before(kind, bounds), model_.rank[kind]) - inner_[kind]
                part = np.zeros(place.size)
                listed = place >= 0
                part[listed] = log[place[listed]]
                part[place == -2] = head.end_log
                # A word that is a unit has no part inside it; the others count with their logarithm.
                value += np.where((kind >= head.own) & listed, part, 0)
                size[own] = np.diff(bounds)
                known[own] = np.add.reduceat((listed | ((place == -2) & (ends > 0))).astype(np.int64), bounds[:-1])
                base[own] = np.add.reduceat(part, bounds[:-1])
                score[own] = np.add.reduceat(value, bounds[:-1])
                doc = first + np.repeat(np.arange(len(block)), np.diff(bounds))[place == -1]
                rest.append(pa.table({"doc": doc, "word": unknown}).group_by(["doc", "word"], use_threads=False).aggregate([([], "count_all")]))
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([row, none, pa.array(size), pa.array(known), pa.array(base), pa.array(score)], ["row", "word", "n", "known", "base", "score"])
            if rest and (m := (words_ := pa.concat_tables(rest).combine_chunks()).num_rows):
                word, often = (words_[name].combine_chunks() for name in ("word", "count_all"))
                yield pa.RecordBatch.from_arrays([row.take(words_["doc"].combine_chunks()), word, often, pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], ["row", "word", "n", "known", "base", "score"])

    # Rows are numbered before the texts are read; ids and folds come back by the same number, from the same written table.
    numbered = data.withColumn("row", F.monotonically_increasing_id())
    ids = numbered.select(F.struct("row", "doc_id", "held_out").alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = staged(ids.mapInArrow(run, f"row struct<row: bigint, doc_id: {kind}, held_out: boolean>, word binary, n bigint, known bigint, base double, score double"), "scored")
    texts = read.where("word is null").select("row.*", "n", "known", "base", "score")
    rest = read.where("word is not null").select(F.col("row.row").alias("row"), "word", F.col("n").alias("often"))
    rest = rest.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("often")).otherwise(0)).alias("more"), F.sum(F.col("often") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("log")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return texts.join(rest, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + zero("more")).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("log") - F.col("n") * F.lit(math.log10(tokens + distinct + 1))).alias("base_score"), (F.col("score") + zero("log")).alias("score"),
    )
