"""Packing of documents into token sequences by the sum-of-squares rule.

Each task packs the documents it reads, one after the other. A level array counts the sequences filled up to each
level; a document goes to the level (or a new sequence) after which the sum of the squared counts of partially filled
levels is least, which keeps all levels about equally available. Documents longer than a sequence give whole sequences
first. When a task has no more documents, its emptiest open sequences are cut up to fill the others, and the one that is left is cut into
powers of two, so nothing is padded. Open sequences are what a task holds, besides one slice of texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyfold.llm.shared import slices

LENGTH = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
#: Latin letters, then ASCII punctuation (no apostrophe, which may join letters): two units of the vocabulary at most.
_TWO = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\]_{|}~]*)")
#: Words that a worker process holds.
_HELD = 400_000


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts. The vocabulary never joins ids across white space, so each different word between ASCII white space is
    encoded once and its ids are put in place wherever it stands. Of most words, letters and then punctuation, the two
    parts are words of their own, encoded once each as well. A fixed number of words is held: when there are more, those not met again
    since the last time go. A slice of texts adds its own words before that."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        # Places 0 and 1 are no words: nothing, and the end of a text.
        self.known: dict[bytes, int] = {b"": 0, b" ": 1}
        self.flat, self.start = np.array([END], np.uint32), np.array([0, 0, 1], np.int64)
        self.met = np.ones(2, bool)

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words, one after the other, and the place after each."""
        first = self.start[which]
        size = self.start[which + 1] - first
        ends = np.cumsum(size)
        total = int(ends[-1]) if ends.size else 0
        return self.flat[np.arange(total) + np.repeat(first - (ends - size), size)], ends

    def _add(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.start = np.concatenate([self.start, self.start[-1] + ends])
        self.flat = np.concatenate([self.flat, ids])
        self.met = np.concatenate([self.met, np.zeros(len(words), bool)])

    def _forget(self) -> None:
        """Words met again stay, half of what is held at most."""
        self.met[:2] = True
        stay = np.flatnonzero(self.met)[: _HELD // 2]
        words = list(self.known)
        self.known = {words[i]: place for place, i in enumerate(stay.tolist())}
        self.flat, ends = self._gather(stay)
        self.start = np.concatenate([np.zeros(1, np.int64), ends])
        self.met = np.zeros(stay.size, bool)

    def _learn(self, fresh: list[bytes]) -> None:
        # Lists of plain strings, not a tuple a word: Python's collector would go through those again and again.
        split = list(map(_TWO.fullmatch, b"\n".join(fresh).decode().split("\n")))
        two = [w for w, m in zip(fresh, split) if m]
        left, right = ["\n".join([m[k] for m in split if m]).lower().encode().split(b"\n") for k in (1, 2)]
        parts = {*left, *right}.difference(self.known)
        # Punctuation may be a part and a word of its own.
        rest = [w for w, m in zip(fresh, split) if not m and w not in parts]
        parts = list(parts)
        del split
        found, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        # Parts are one unit to the vocabulary, so each ends with the first id that ends a unit.
        for a in range(0, len(parts), 2000):
            some = parts[a : a + 2000]
            ids = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids
            found.append(np.array(ids, np.uint32))
            cuts = np.flatnonzero(self.ends[found[-1]]) + 1
            assert cuts.size == len(some)
            sizes.append(np.diff(cuts, prepend=0))
        for a in range(0, len(rest), 2000):
            many = self.tokenizer.encode_batch_fast([w.decode() for w in rest[a : a + 2000]], add_special_tokens=False)
            many = [x.ids for x in many]
            found.append(np.array(list(chain.from_iterable(many)), np.uint32))
            sizes.append(np.array(list(map(len, many)), np.int64))
        self._add(parts + rest, np.concatenate(found), np.cumsum(np.concatenate(sizes)))
        known = self.known
        is_new = [w not in known for w in two]
        two, left, right = [list(compress(x, is_new)) for x in (two, left, right)]
        if two:
            ids, cuts = self._gather(np.fromiter(map(known.__getitem__, chain.from_iterable(zip(left, right))), np.int64))
            self._add(two, ids, cuts[1::2])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > _HELD:
            self._forget()
        before = len(self.known)
        # ``bytes.split`` cuts at ASCII white space, no more and no less.
        words = [t.encode().split() for t in texts]
        fresh = set().union(*words).difference(self.known)
        if fresh:
            self._learn(list(fresh))
        for ws in words:
            ws.append(b" ")
        ends = np.cumsum([len(ws) for ws in words])
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64)
        self.met[which[which < before]] = True
        ids, after = self._gather(which)
        return np.split(ids, after[ends[:-1] - 1]) if texts else []


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, as later tasks of it meet the same words again."""
    return Encoder(path)


class Levels:
    """The level array: how many sequences are filled up to each level, and which."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.count, self.open = length, np.zeros(length + 1, np.int64), [[] for _ in range(length + 1)]
        self.made = 0

    def choose(self, size: int) -> int:
        """The level, 0 for a new sequence, that leaves the least sum of squares once ``size`` more tokens lie on it."""
        have, then = self.count[1 : self.length - size + 1], self.count[size + 1 : self.length + 1]
        change = 2 * (then - have) + 2
        if change.size:
            change[-1] = 1 - 2 * have[-1]
        change[have == 0] = np.iinfo(np.int64).max
        fresh = 2 * self.count[size] + 1 if size < self.length else 0
        if not change.size:
            return 0
        best = change.size - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= fresh else 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset of the next ``size`` tokens."""
        level = self.choose(size)
        if level:
            self.count[level] -= 1
            sequence = self.open[level].pop()
        else:
            sequence, self.made = self.made, self.made + 1
        if level + size < self.length:
            self.count[level + size] += 1
            self.open[level + size].append(sequence)
        return sequence, level


def _finish(held: dict[int, list], made: int, length: int) -> Iterator[tuple]:
    """Pieces of the sequences left open: the emptiest fill the others, the last is cut into powers of two."""
    fills = {s: sum(p[2].size for p in ps) for s, ps in held.items()}
    order = sorted(held, key=lambda s: (-fills[s], s))
    low, high = 0, len(order) - 1
    while low < high:
        room = length - fills[order[low]]
        pieces = held[order[high]]
        while room and pieces:
            doc, start, ids, total = pieces.pop()
            part = min(room, ids.size)
            if part < ids.size:
                pieces.append((doc, start, ids[: ids.size - part], total))
            held[order[low]].append((doc, start + ids.size - part, ids[ids.size - part :], total))
            room -= part
        fills[order[low]] = length - room
        if not pieces:
            del held[order[high]]
            high -= 1
        if not room:
            low += 1
    for place, sequence in enumerate(order[: high + 1]):
        pieces = held.pop(sequence)
        left = sum(p[2].size for p in pieces)
        if left < length:
            cuts = [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
        else:
            cuts = [length]
        cuts, offset = cuts[::-1], 0
        for doc, start, ids, total in pieces:
            while ids.size:
                part = min(cuts[-1] - offset, ids.size)
                yield doc, start, ids[:part], total, sequence, offset
                start, ids, offset = start + part, ids[part:], offset + part
                if offset == cuts[-1]:
                    cuts.pop()
                    sequence, made, offset = made, made + 1, 0


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids_crc32``,
    ``doc_tokens`` (with the closing id), ``sequence_id``, ``offset`` and, if asked, ``ids``.

    Every id lies in one piece and the pieces of a sequence follow each other from 0. A sequence holds ``length`` tokens or a power of
    two. A null or empty text is its closing id alone; rows that repeat, null ids and other columns do not matter. ``path`` names the
    vocabulary file, which must be at the same place for every executor."""
    place = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, levels, held = encoder(place), Levels(length), {}
        base = TaskContext.get().partitionId() << 40

        def rows(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*pieces)
            made = {
                "doc_id": pa.array(doc, kind),
                "start": pa.array(start, pa.int64()),
                "length": pa.array([x.size for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()),
                "sequence_id": pa.array([base + s for s in sequence], pa.int64()),
                "offset": pa.array(offset, pa.int64()),
            }
            if with_ids:
                ends = np.cumsum([0, *(x.size for x in ids)]).astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.record_batch(made)

        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for part in slices(batch, "text", 1_000_000):
                done: list[tuple] = []
                keys = part.column("doc_id").to_pylist()
                for doc, ids in zip(keys, coder.encode([t or "" for t in part.column("text").to_pylist()])):
                    total, start = ids.size, 0
                    while total - start >= length:
                        done.append((doc, start, ids[start : start + length], total, levels.made, 0))
                        levels.made, start = levels.made + 1, start + length
                    if start == total:
                        continue
                    sequence, offset = levels.place(total - start)
                    own = held.setdefault(sequence, [])
                    own.append((doc, start, ids[start:].copy(), total))
                    if offset + total - start == length:
                        at = 0
                        for d, s, x, n in held.pop(sequence):
                            done.append((d, s, x, n, sequence, at))
                            at += x.size
                if done:
                    yield rows(done, kind)
        last: list[tuple] = []
        for piece in _finish(held, levels.made, length):
            last.append(piece)
            if len(last) == 1000:
                yield rows(last, kind)
                last = []
        if last:
            yield rows(last, kind)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
