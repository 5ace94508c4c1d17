"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

A text is cut into segments that no piece crosses (a run of spaces with the characters after it, and
line ends), equal segments are encoded once, and all segments of a block are merged together: symbols
lie in one flat array, each round finds the smallest pair rank of every segment, merges it there, and
compacts the arrays, until no pair remains.

Defined results: a null text counts as empty and gives the end id only; equal texts give equal ids;
rows, also repeated ones, are kept as they are, and extra columns are left alone. A text of any length is
encoded whole; one without spaces and line ends is cut where no piece joins the characters, and what is left in one
segment takes its length times its rounds.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import column, runs, small_batches

SPACE = "▁"
#: Segments whose encodings a worker keeps, twice as many at most, and their characters.
KEPT, KEPT_CHARS = 250_000, 16 << 20
#: Characters that are encoded together.
BLOCK = 1 << 21
#: Longer segments are cut again.
LONG = 64
NONE = np.int64(1 << 40)


class Pieces:
    """The vocabulary of a BPE model file with byte fallback, and its pair table."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, a space put first and no normalisation are supported")
        self.names = [p.piece for p in model.pieces]
        kinds = np.array([p.type for p in model.pieces])
        scores = np.array([p.score for p in model.pieces], dtype=np.float64)
        if ((kinds == 4) | (kinds == 5)).any():
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.digits = [str(i) for i in range(len(self.names))]
        self.end = self.names.index("</s>")
        normal = np.flatnonzero(kinds == 1)
        self.ids = {self.names[i]: int(i) for i in normal}
        near = {ord(a) << 21 | ord(b) for i in normal for a, b in zip(self.names[i], self.names[i][1:])}
        self.neighbours = np.array(sorted(near | {0}), dtype=np.int64)
        self.surface = [b""] * len(self.names)
        self.byte = np.zeros(256, dtype=np.int64)
        for i, kind in enumerate(kinds):
            if kind == 1:
                self.surface[i] = self.names[i].replace(SPACE, " ").encode()
            elif kind == 6:
                value = int(self.names[i][1:-1], 16)
                self.byte[value] = i
                self.surface[i] = bytes([value])
            elif kind == 2:
                self.surface[i] = model.trainer_spec.unk_surface.encode()
        # Rank of a piece: equal scores share a rank, so that the leftmost pair wins among them.
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = rank.astype(np.int64)
        keys, made = [], []
        for i in normal:
            name = self.names[i]
            for cut in range(1, len(name)):
                left, right = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    made.append(int(i))
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_made = np.array(made, dtype=np.int64)[order]
        # A merge is taken at all its places at once only if the piece that it makes is in no pair of as good a rank.
        best = np.full(len(self.names), NONE)
        np.minimum.at(best, self.pair_keys >> 20, self.rank[self.pair_made])
        np.minimum.at(best, self.pair_keys & 0xFFFFF, self.rank[self.pair_made])
        self.alone = best <= self.rank
        self._slots()
        self.char_id = np.full(0x110000, -1, dtype=np.int64)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.char_id[ord(name)] = i
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("pieces with an inner space are not supported")
        self.cut = self._cuts()
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.size = 0

    def _cuts(self) -> re.Pattern:
        """Segments end where no piece goes on: around line ends, before spaces, and before those marks that
        in every piece follow only a space or another such mark."""
        ends = [c for c in "\n\r\t" if not any(c in n for n in self.ids if len(n) > 1)]
        marks = {c for n in self.ids if len(n) > 1 for c in n if not c.isalnum() and c != SPACE}
        before = {(a, b) for n in self.ids for a, b in zip(n, n[1:])}
        while bad := {b for a, b in before if b in marks and a != SPACE and a not in marks}:
            marks -= bad
        end, mark = re.escape("".join(ends)), re.escape("".join(sorted(marks)))
        rest = f"[^{SPACE}{end}{mark}]"
        first = f"[{mark}]" if marks else "(?!)"
        return re.compile(f"{SPACE}+{first}*{rest}*|{rest}+|{first}+{rest}*" + (f"|[{end}]" if ends else ""))

    def _slots(self) -> None:
        """An open hash table over the pair keys, for look-ups of whole arrays."""
        size = 1 << (int(self.pair_keys.size * 2 - 1).bit_length() + 1)
        self.mask = size - 1
        slots = np.full(size, -1, dtype=np.int64)
        at, left = self._hash(self.pair_keys), np.arange(self.pair_keys.size)
        self.probes = 0
        while left.size:
            self.probes += 1
            free = slots[at[left]] < 0
            slots[at[left[free]]] = left[free]
            left = left[slots[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask
        self.slot_key = np.where(slots >= 0, self.pair_keys[slots], -1)
        self.slot_made = np.where(slots >= 0, self.pair_made[slots], -1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & self.mask

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1. Every symbol is an id, bytes included."""
        keys = left << 20 | right
        at = self._hash(keys)
        found = np.full(keys.size, -1, dtype=np.int64)
        open_ = np.arange(keys.size)
        for _ in range(self.probes):
            held = self.slot_key[at[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.slot_made[at[open_[hit]]]
            open_ = open_[(held >= 0) & ~hit]
            if not open_.size:
                break
            at[open_] = (at[open_] + 1) & self.mask
        return found

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in one array, and where each one begins (with the end last)."""
        joined = "".join(segments)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ids = self.char_id[chars]
        wide = np.ones(chars.size, dtype=np.int64)
        rare = ids < 0
        if rare.any():
            wide[rare] = 1 + (chars[rare] > 0x7F) + (chars[rare] > 0x7FF) + (chars[rare] > 0xFFFF)
            symbols = np.repeat(ids, wide)
            spelt = chars[rare].astype("<u4").tobytes().decode("utf-32-le").encode()
            symbols[np.repeat(rare, wide)] = self.byte[np.frombuffer(spelt, dtype=np.uint8)]
        else:
            symbols = ids.copy()
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        sizes = np.diff(np.r_[0, np.r_[0, np.cumsum(wide)][ends]])
        owner = np.repeat(np.arange(len(segments)), sizes)
        done_symbols, done_owner = [], []
        made = np.full(symbols.size, -1, dtype=np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        made[inner] = self.pairs(symbols[inner], symbols[inner + 1])
        while symbols.size:
            # Segments without a pair are finished; compaction.
            ranks = np.where(made >= 0, self.rank[made], NONE)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks, first)
            size = np.diff(np.r_[first, owner.size])
            live = best < NONE
            if not live.all():
                keep = np.repeat(live, size)
                done_symbols.append(symbols[~keep])
                done_owner.append(owner[~keep])
                symbols, owner, made, ranks = symbols[keep], owner[keep], made[keep], ranks[keep]
                if not symbols.size:
                    break
                best, size = best[live], size[live]
                first = np.r_[0, np.cumsum(size)[:-1]]
            at = np.flatnonzero(ranks == np.repeat(best, size))
            # In a run of overlapping pairs every second one, from the left, is taken.
            lone = np.r_[True, np.diff(at) > 1]
            start = np.maximum.accumulate(np.where(lone, np.arange(at.size), 0))
            at = at[(np.arange(at.size) - start) % 2 == 0]
            # Equal ranks may make different pieces, and some merges make better pairs: then the leftmost only.
            own = owner[at]
            head = np.r_[True, own[1:] != own[:-1]]
            mixed = np.zeros(owner[-1] + 1, dtype=bool)
            mixed[own[self.alone[made[at]]]] = True
            mixed[own[1:][(made[at[1:]] != made[at[:-1]]) & ~head[1:]]] = True
            at = at[head | ~mixed[own]]
            symbols[at] = made[at]
            keep = np.ones(symbols.size, dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            new = place[at]
            symbols, owner, made = symbols[keep], owner[keep], made[keep]
            touched = np.zeros(symbols.size, dtype=bool)
            touched[new] = True
            touched[new[new > 0] - 1] = True
            stale = np.flatnonzero(touched)
            made[stale] = -1
            stale = stale[stale < symbols.size - 1]
            stale = stale[owner[stale] == owner[stale + 1]]
            made[stale] = self.pairs(symbols[stale], symbols[stale + 1])
        symbols, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(segments))
        return symbols[order], np.r_[0, np.cumsum(counts)]

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        found = self.cut.findall(SPACE + text.replace(" ", SPACE))
        if max(map(len, found)) <= LONG:
            return found
        return [p for s in found for p in ([s] if len(s) <= LONG else self.parts(s))]

    def parts(self, segment: str) -> list[str]:
        """A long segment cut where no piece has the two characters next to each other: no merge can cross it."""
        chars = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        pairs = chars[:-1] << 21 | chars[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pairs), self.neighbours.size - 1)
        cuts = np.flatnonzero(self.neighbours[at] != pairs) + 1
        return [segment[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(segment)])]

    def learn(self, segments: set[str]) -> None:
        """Encodes the segments that are not known: ids as text, their number, the text they decode to."""
        size = sum(map(len, segments))
        if self.known and (len(self.known) + len(segments) > KEPT or self.size + size > KEPT_CHARS):
            self.known, self.older, self.size = {}, self.known, 0
        self.size += size
        known, older = self.known, self.older
        new = []
        for s in segments.difference(known):
            if (held := older.get(s)) is not None:
                known[s] = held
            else:
                new.append(s)
        if not new:
            return
        ids, at = self.merge(new)
        listed, at, surface, digits = ids.tolist(), at.tolist(), self.surface, self.digits
        for k, s in enumerate(new):
            own = listed[at[k] : at[k + 1]]
            known[s] = (" ".join([digits[i] for i in own]), len(own), b"".join([surface[i] for i in own]).decode("utf-8", "replace"))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text with the end id, for callers that want them as lists."""
        out = []
        for row in self.rows(texts):
            out.append([int(x) for x in row[0].split(" ")])
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.surface[i] for i in ids])
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and self.names[first].startswith(SPACE):
            text = text[1:]
        return text.decode("utf-8", "replace")

    def rows(self, texts: list[str | None]) -> Iterator[tuple[str, int, str]]:
        """For each text: ids as text (with the end id), their number, the decoded text."""
        for _, block in runs(texts, BLOCK):
            cut = [self.segments(t) for t in block]
            self.learn(set().union(*cut))
            known = self.known
            for own in cut:
                got = [known[s] for s in own]
                ids = " ".join([g[0] for g in got])
                # The space put first goes again.
                text = "".join([g[2] for g in got])[1:]
                yield (f"{ids} {self.end}" if ids else str(self.end)), sum([g[1] for g in got]) + 1, text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One vocabulary for each worker process."""
    return Pieces(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: str = "doc_id", full: bool = False) -> DataFrame:
    """Encodes and decodes docs[text]. Columns: keep, n_tokens, and digests of the ids and of the decoded
    text; with full=True the ids (array<int>) and the decoded text instead of their digests."""
    small_batches(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()
    data = docs.select(docs[keep].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        model, watched = pieces(model_path), gc.isenabled()
        gc.disable()  # only tuples of texts are kept, in no cycles; scanning them again and again costs more than the merges
        try:
            for batch in batches:
                yield digests(model, batch)
        finally:
            if watched:
                gc.enable()

    def digests(model, batch):
        rows = list(model.rows(column(batch, "text")))
        key = batch.column(0)
        n = pa.array([r[1] for r in rows], pa.int64())
        if full:
            ids = pa.array([[int(x) for x in r[0].split(" ")] for r in rows], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([key, n, ids, pa.array([r[2] for r in rows], pa.string())], ["key", "n_tokens", "ids", "decoded"])
        a = pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string())
        b = pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([key, n, a, b], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rest = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return data.mapInArrow(run, f"key {kind}, n_tokens bigint, {rest}").withColumnRenamed("key", keep)
