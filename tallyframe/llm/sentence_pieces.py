"""SentencePiece encoding (BPE models with byte fallback) that keeps the place of every piece in the text, and decoding.

A text is normalised by the model's compiled character map: at each place the longest key of the map is replaced, everything else passes.
Each normalised character remembers the byte of the text that it came from, so a piece, which is a run of normalised characters, is
projected to a span of bytes of the text. Normalised texts are cut where no piece of the vocabulary reaches across (before a space mark that
follows another character, and between characters that no piece brings together); merges never cross such a cut, so each distinct
chunk of a task is merged once and remembered, those of a batch side by side. Long chunks are merged with a heap, near linear in their length.

The model has a fixed size (MAX_MODEL_BYTES at most, checked) and travels in the closure; its path is a parameter. Models that are no BPE
models, put the space mark behind words, or have user-defined or unused pieces raise ValueError.

Defined results: null text encodes like the empty text (an end id alone, if asked for); null ids decode to the empty text. A character
without a piece becomes its bytes: the last one has the character's span, the others empty spans at its start. The mark put before a text
has an empty span, and so has the end id, at the text's end. Bytes that are no UTF-8 decode to U+FFFD each; ids outside the vocabulary raise
IndexError, as in the library. Repeated rows are encoded each for itself; columns named like the outputs are replaced.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

MAX_MODEL_BYTES = 16 << 20
#: Chunks of more characters are merged with a heap, and where a batch has fewer than FEW new chunks of a length, these one by one.
LONG, FEW = 48, 24
MARK = "▁"
# Fixed values of the model format: kinds of pieces, and the model type BPE.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_TYPE = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value, shift, i = value | (raw[i] & 127) << shift, shift + 7, i + 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            if key & 7 == 2:
                n, i = varint(i)
            else:
                n = {1: 8, 5: 4}[key & 7]
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


def character_map(compiled: bytes) -> dict[str, str]:
    """Key and replacement of each entry of a compiled map: the size of a double-array trie, its units, then replacements that end with NUL."""
    if not compiled:
        return {}
    (size,) = struct.unpack_from("<I", compiled)
    units, texts = np.frombuffer(compiled, "<u4", size // 4, 4), compiled[4 + size :]
    offsets = (units >> 10) << ((units & 512) >> 6)
    labels = np.arange(1, 256)
    found, open_nodes = {}, [(int(offsets[0]), b"")]
    while open_nodes:
        base, key = open_nodes.pop()
        places = base ^ labels
        inside = places < len(units)
        for c in labels[inside][(units[places[inside]] & 0x800000FF) == labels[inside]]:
            place = base ^ int(c)
            below, longer = place ^ int(offsets[place]), key + bytes([c])
            if units[place] >> 8 & 1:
                at = int(units[below] & 0x7FFFFFFF)
                found[longer.decode()] = texts[at : texts.index(b"\0", at)].decode()
            open_nodes.append((below, longer))
    return found


class Model:
    """What a model file says: pieces, scores, kinds, and how texts are normalised."""

    def __init__(self, raw: bytes):
        self.pieces, self.kinds, scores = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                normalizer |= dict(_fields(value))
        if trainer.get(3, 1) != BPE_TYPE or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models without user-defined or unused pieces and with leading space marks are taken")
        self.map = character_map(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.fallback = bool(trainer.get(35, 0))
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.end = self.ids[trainer.get(47, b"</s>").decode()]
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        #: Normal pieces by the rank of their score; a higher score merges first.
        self.ranks = {p: order[s] for p, s, k in zip(self.pieces, scores, self.kinds, strict=True) if k == NORMAL}
        self.bytes_at = self.ids.get("<0x00>", 0)

    def classes(self) -> np.ndarray | None:
        """A number for each character: 1 for the space mark, 0 for those that no longer piece has, and else the same for characters that stand
        side by side in some piece; no piece reaches across two classes, nor has a mark behind another character. None where that can't be told."""
        many = [p.lstrip(MARK) for p in self.ranks if len(p) > 1]
        if any(MARK in p for p in many):
            return None
        top = {c: c for p in many for c in p}

        def root(c: str) -> str:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        for p in many:
            for a, b in pairwise(p):
                top[root(a)] = root(b)
        numbers: dict[str, int] = {}
        out = np.zeros(0x110000, np.uint32)
        for c in top:
            out[ord(c)] = numbers.setdefault(root(c), len(numbers) + 2)
        out[ord(MARK)] = 1
        return out


def load_model(path: str) -> Model:
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
    return Model(raw)


def byte_lengths(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


class Normalizer:
    def __init__(self, model: Model):
        self.map, self.prefix, self.squeeze, self.mark = model.map, model.prefix, model.squeeze, MARK if model.escape else " "
        lengths: dict[str, set[int]] = {}
        for key in self.map:
            lengths.setdefault(key[0], set()).add(len(key))
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        alone = "".join(sorted(k for k in self.map if len(k) == 1))
        first, second = ("".join(sorted({k[i] for k in self.map if len(k) > 1})) for i in (0, 1))
        choices = ([f"[{re.escape(alone)}]"] if alone else []) + ([f"[{re.escape(first)}](?=[{re.escape(second)}])"] if first else [])
        self.keys_at = re.compile("|".join(choices)) if choices else None

    def _replaced(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The text after the map; for each of its characters the character of `text` it came from, and whether it opens what it came from."""
        out, origin, opens, at = [], [], [], 0

        def plain(upto: int) -> None:
            out.append(text[at:upto])
            origin.append(np.arange(at, upto))
            opens.append(np.ones(upto - at, bool))

        while self.keys_at and (hit := self.keys_at.search(text, at)):
            i = hit.start()
            n = next((n for n in self.lengths[text[i]] if i + n <= len(text) and text[i : i + n] in self.map), 0)
            plain(i if n else i + 1)
            at = i + max(n, 1)
            if n:
                new = self.map[text[i : i + n]]
                out.append(new)
                origin.append(np.full(len(new), i))
                opens.append(np.arange(len(new)) == 0)
        plain(len(text))
        return "".join(out), np.concatenate(origin), np.concatenate(opens)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the byte of `text` that it came from."""
        if not text:
            return "", np.zeros(1, np.int64)
        at_byte = np.arange(len(text) + 1) if text.isascii() else np.concatenate([[0], np.cumsum(byte_lengths(text))])
        if not self.map and not self.squeeze:
            return (self.mark + text if self.prefix else text).replace(" ", self.mark), np.concatenate([[0], at_byte]) if self.prefix else at_byte
        new, origin, opens = self._replaced(text)
        codes = np.frombuffer(new.encode("utf-32-le"), "<u4")
        begin, end = 0, at_byte[-1]
        if self.squeeze and len(codes):  # spaces that open a replacement go if a space, or the text's start, is before it
            space = codes == 32
            start = np.maximum.accumulate(np.where(opens, np.arange(len(codes)), 0))
            others = np.concatenate([[0], np.cumsum(~space)])
            leading = space & (others[:-1] == others[start])
            kept = ~(leading & np.where(start == 0, True, space[start - 1]))
            spaces_first = np.flatnonzero(~space)
            if not len(spaces_first):
                return "", np.zeros(1, np.int64)
            begin = at_byte[origin[spaces_first[0]]]
            codes, origin = codes[kept], origin[kept]
            filled = np.flatnonzero((codes != 32) & (codes != ord(self.mark)))
            if not len(filled):  # marks at the end go like spaces, the one put before the text too
                return "", np.zeros(1, np.int64)
            upto = filled[-1] + 1
            if upto < len(codes):
                end = at_byte[origin[upto]]
            codes, origin = codes[:upto], origin[:upto]
        elif self.squeeze:
            return "", np.zeros(1, np.int64)
        new = codes.astype("<u4").tobytes().decode("utf-32-le").replace(" ", self.mark)
        return (self.mark + new if self.prefix else new), np.concatenate([[begin] if self.prefix else [], at_byte[origin], [end]]).astype(np.int64)


def merged(chunk: str, ranks: dict[str, int]) -> list[str]:
    """The chunk's pieces: again and again the adjacent pair that is the best piece, the leftmost of equals, becomes one."""
    rank, none = ranks.get, 1 << 60
    if len(chunk) <= LONG:
        parts = list(chunk)
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return parts
    n = len(chunk)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a piece is known by where it starts; 0 for a start that is gone
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(chunk[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = ends[i]
        if j < n and (r := rank(chunk[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, j, ends[j]))

    while heap:
        _, i, j, k = heapq.heappop(heap)
        if ends[i] != j or ends[j] != k:
            continue
        ends[i], ends[j] = k, 0
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(chunk[i : ends[i]])
        i = ends[i]
    return out


class Merger:
    """Pieces of many short chunks at once. Chunks of one length are rows of a matrix of symbols (ids of pieces, and beyond them characters that
    are none); a step merges the best pair of every row, the leftmost of equals, so rows that still merge keep one length."""

    def __init__(self, model: Model):
        size = len(model.pieces)
        self.size, self.wide = size, size + 0x110000
        self.symbols = np.arange(0x110000) + size
        for piece in model.ranks:
            if len(piece) == 1:
                self.symbols[ord(piece)] = model.ids[piece]
        self.none = len(model.pieces)
        pairs = {}
        for piece, rank in model.ranks.items():
            for k in range(1, len(piece)):
                a, b = self._symbol(model, piece[:k]), self._symbol(model, piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.wide + b] = rank, model.ids[piece]
        self.keys = np.array([*sorted(pairs), 1 << 62])
        found = [pairs[k] for k in self.keys[:-1].tolist()] + [(self.none, 0)]
        self.ranks, self.made = (np.array([f[i] for f in found], np.int32) for i in (0, 1))

    def _symbol(self, model: Model, part: str) -> int | None:
        return int(self.symbols[ord(part)]) if len(part) == 1 else model.ids[part] if part in model.ranks else None

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair makes."""
        key = a * self.wide + b
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return self.ranks[at], self.made[at]

    def __call__(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in chunks, symbols of each) for chunks of one length."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "replace"), "<u4").reshape(len(chunks), -1)
        symbols, place = self.symbols[codes], np.arange(len(chunks))
        ranks, made = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1:
            row = np.arange(len(symbols))
            best = ranks.argmin(axis=1)
            ends = ranks[row, best] == self.none
            if ends.any():
                yield place[ends], symbols[ends]
                on = ~ends
                symbols, ranks, made, place, best = symbols[on], ranks[on], made[on], place[on], best[on]
                row = row[: len(symbols)]
                if not len(symbols):
                    return
            new, width = made[row, best], symbols.shape[1] - 1
            keep = np.ones(symbols.shape, bool)
            keep[row, best + 1] = False
            symbols = symbols[keep].reshape(len(row), width)
            symbols[row, best] = new
            keep = keep[:, 1:]  # of the pairs, the merged one goes
            ranks, made = (x[keep].reshape(len(row), width - 1) for x in (ranks, made))
            left, right = best > 0, best < width - 1
            for some, at in ((left, best - 1), (right, best)):
                r, k = row[some], at[some]
                ranks[r, k], made[r, k] = self._pairs(symbols[r, k], symbols[r, k + 1])
        yield place, symbols


class Encoder:
    """Ids and spans of texts, many at a time. Each distinct chunk has a number, under which its ids are kept, side by side with those of all
    others; with more than `most_chunks` of them all are forgotten."""

    def __init__(self, model: Model, most_chunks: int = 400_000):
        self.model, self.normal, self.classes, self.most = model, Normalizer(model), model.classes(), most_chunks
        self.merge = Merger(model)
        self.takes = np.array([0 if k == CONTROL else 1 if k in (BYTE, UNKNOWN) else len(p) for p, k in zip(model.pieces, model.kinds, strict=True)])
        places = np.arange(len(model.pieces)) - model.bytes_at
        self.is_byte = np.array(model.kinds) == BYTE
        self.continues = self.is_byte & (places & 0xC0 == 0x80)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ids_of(self, symbol: str) -> list[int]:
        """Of one character that is no piece."""
        return [self.model.bytes_at + b for b in symbol.encode("utf-8", "replace")] if self.model.fallback else [self.model.unknown]

    def _learn(self) -> None:
        """Ids of the chunks that have a number and no ids yet."""
        m, size, known = self.model, self.merge.size, len(self.begins) - 1
        new = list(islice(self.numbers, known, None))
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        order = np.argsort(sizes, kind="stable")
        found, lengths = [], np.zeros(len(new), np.int64)
        for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            some = [new[k] for k in places.tolist()]
            if not some or len(some[0]) > LONG or len(some) < FEW:
                found += [(k, [i for p in merged(c, m.ranks) for i in ([m.ids[p]] if p in m.ranks else self._ids_of(p))]) for k, c in zip(places.tolist(), some, strict=True)]
                continue
            for rows, symbols in self.merge(some):
                odd = symbols.max(axis=1) >= size
                found += [(k, [i for x in row for i in ([x] if x < size else self._ids_of(chr(x - size)))]) for k, row in zip(places[rows[odd]].tolist(), symbols[odd].tolist(), strict=True)]
                lengths[places[rows]] = symbols.shape[1]
                found.append((places[rows[~odd]], symbols[~odd]))
        for k, ids in found:
            if isinstance(k, int):
                lengths[k] = len(ids)
        begins = self.begins[-1] + np.concatenate([[0], np.cumsum(lengths)])
        fresh = np.empty(begins[-1] - begins[0], np.int32)
        for k, ids in found:
            at = begins[k] - begins[0]
            if isinstance(k, int):
                fresh[at : at + len(ids)] = ids
            else:
                fresh[at[:, None] + np.arange(ids.shape[1])] = ids
        self.ids, self.begins = np.concatenate([self.ids, fresh]), np.concatenate([self.begins, begins[1:]])

    def _chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The texts cut where no piece reaches across, and where each text's chunks begin."""
        text = "".join(texts)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        cut = np.zeros(len(text) + 1, bool)
        cut[begins] = True
        if self.classes is not None and text:
            c = self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
            joins = (c[1:] == c[:-1]) & (c[1:] > 0) | (c[:-1] == 1) & (c[1:] > 1)
            cut[1:-1] |= ~joins
        places, raw = np.flatnonzero(cut), text.encode("utf-8", "replace")
        at_byte = places if len(raw) == len(text) else np.concatenate([[0], np.cumsum(byte_lengths(text))])[places]
        chunks = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(at_byte.astype(np.int32)), pa.py_buffer(raw))
        return chunks, np.searchsorted(places, begins)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first bytes, ends) of the pieces of all texts, and where each text's begin."""
        if len(self.numbers) > self.most:
            self._forget()
        normal = [self.normal(t) for t in texts]
        chunks, per_text = self._chunks([n for n, _ in normal])
        coded = chunks.dictionary_encode()
        number = np.fromiter(map(self.numbers.__getitem__, coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()]
        if len(self.numbers) >= len(self.begins):
            self._learn()
        first, n = self.begins[number], self.begins[number + 1] - self.begins[number]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        offsets = upto[per_text]
        takes = self.takes[ids]
        takes[:-1][self.is_byte[ids[:-1]] & self.continues[ids[1:]]] = 0  # a character's last byte takes it
        # a text's places are followed by its end, so places of later texts are one further on for each text before
        ends = np.cumsum(takes) + np.repeat(np.arange(len(texts)), np.diff(offsets))
        at_byte = np.concatenate([a for _, a in normal]) if normal else np.zeros(1, np.int64)
        starts, ends = at_byte[ends - takes], at_byte[ends]
        if self.model.fallback or not len(ids):
            return ids, starts, ends, offsets
        opens = np.ones(len(ids), bool)  # neighbours without a piece are one unknown piece
        opens[1:] = (ids[1:] != self.model.unknown) | (ids[:-1] != self.model.unknown)
        opens[offsets[(offsets > 0) & (offsets < len(ids))]] = True
        return ids[opens], starts[opens], ends[np.append(opens[1:], True)], np.concatenate([[0], np.cumsum(opens)])[offsets]

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first bytes, ends) of the pieces of each text."""
        *found, offsets = self.flat(texts)
        for a, b in pairwise(offsets.tolist()):
            yield tuple(x[a:b] for x in found)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Decoder:
    def __init__(self, model: Model):
        # a control id parts the bytes at its sides, so it stands as a byte that no UTF-8 has until they are decoded
        shown = {CONTROL: lambda p: b"\xff", UNKNOWN: lambda p: model.unknown_text.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.raw = [shown.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.silent = {i for i, k in enumerate(model.kinds) if k == CONTROL}
        self.marked = {i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL and p.startswith(MARK)}
        self.bytes = {i for i, k in enumerate(model.kinds) if k == BYTE}
        self.strips, self.squeezes = model.prefix or model.squeeze, model.squeeze
        codecs.register_error("each-byte", _each_byte)
        kinds, shown = np.array(model.kinds), [b"" if i in self.silent else r for i, r in enumerate(self.raw)]
        self.is_silent, self.is_marked = kinds == CONTROL, np.isin(np.arange(len(kinds)), list(self.marked))
        self.sizes = np.array([len(r) for r in shown])
        self.places, self.blob = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(shown), np.uint8)

    def flat(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of many lists of ids. Bytes are gathered for all at once; lists with a control id ahead of another id, that open with a piece
        of marks alone while spaces are squeezed, or whose bytes are no UTF-8, send the whole batch one by one."""
        first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
        inner = self.is_silent[ids] if len(ids) else np.zeros(0, bool)
        inner[last] = False
        if len(ids) and not inner.any() and ids.min() >= 0 and not self.squeezes:
            sizes, places = self.sizes[ids], self.places[ids]
            if self.strips:
                opening = first[self.is_marked[ids[first]]]
                sizes[opening] -= 1
                places[opening] += 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            raw = self.blob[np.repeat(places - ends[:-1], sizes) + np.arange(ends[-1])]
            begins = ends[offsets]
            opens = begins[:-1][np.diff(begins) > 0]
            if not (raw[opens] & 0xC0 == 0x80).any():
                try:
                    bytes(raw).decode()
                    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(raw))
                except UnicodeDecodeError:
                    pass
        numbers = ids.tolist()
        return pa.array([self(numbers[a:b]) for a, b in pairwise(offsets.tolist())], pa.string())

    def __call__(self, ids: list[int] | None) -> str:
        ids = ids or []
        if ids and min(ids) < 0:
            raise IndexError("id out of range")
        parts = list(map(self.raw.__getitem__, ids))
        while parts and ids[len(parts) - 1] in self.silent:
            parts.pop()
        ids = ids[: len(parts)]
        if self.strips:  # the mark that opens a text is no space of it
            for n, i in enumerate(ids):
                if i in self.marked:
                    parts[n] = parts[n][1:]
                if i not in self.silent and not (self.squeezes and i in self.marked and not parts[n]):
                    break
        text = b"".join(parts)
        try:
            return text.decode()
        except UnicodeDecodeError:  # bytes of one run only make up characters
            out, n = [], 0
            while n < len(ids):
                k = n
                while k < len(ids) and (ids[k] in self.bytes) == (ids[n] in self.bytes):
                    k += 1
                out.append(b"".join(p for p, i in zip(parts[n:k], ids[n:k], strict=True) if i not in self.silent).decode("utf-8", "each-byte"))
                n = k
            return "".join(out)


def encode(docs: DataFrame, model: Model, text: str = "text", end: bool = True) -> DataFrame:
    """docs with `ids`, and `starts` and `ends`, the span of bytes of the text that each id stands for; with an end id if `end`."""

    def make():
        encoder = Encoder(model)

        def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids, starts, ends, offsets = encoder.flat(texts)
            if end:
                last = np.where(np.diff(offsets) > 0, np.append(ends, 0)[offsets[1:] - 1], 0)
                ids, starts, ends = (np.insert(x, offsets[1:], v) for x, v in ((ids, model.end), (starts, last), (ends, last)))
                offsets = offsets + np.arange(len(offsets))
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, starts, ends)]

        return columns_of

    numbers = T.ArrayType(T.IntegerType())
    return append_columns(docs, make, [T.StructField(n, numbers) for n in ("ids", "starts", "ends")])


def decode(df: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """df with `decoded`, the text of the ids."""

    def make():
        decoder = Decoder(model)

        def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            offsets = column.offsets.to_numpy()
            return [decoder.flat(column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0])]

        return columns_of

    return append_columns(df, make, [T.StructField("decoded", T.StringType())])


def op13_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Besides the digests, n_spanned: the bytes of the text up to which pieces reach."""
    import public_tokenizers

    model = load_model(model_path or public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode(docs, model).select("doc_id", "ids", F.element_at("ends", -1).cast("long").alias("n_spanned"))
    return decode(found, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "n_spanned"
    )
