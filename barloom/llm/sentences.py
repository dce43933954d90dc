"""SentencePiece encoding and decoding with the place of every piece in the original bytes.

A text is normalised by the longest rules of the model's compiled character map, a double-array trie, and each byte of the
result remembers the byte that it came from. The normalised text is cut where no piece reaches across, and each distinct
unit is merged once per task: best score first, then leftmost. Offsets of pieces in the normalised bytes are projected
back, so that every id has the span of original bytes that it stands for.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Pool, gathered
from .common import blocks, columns_of, flat, map_batches, quoted

#: The mark that stands for a space, and the types of pieces and models in a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
#: Units of up to SHORT characters are merged many at a time; longer ones go through a heap.
SHORT = 24
#: Units that a task remembers before it starts anew.
REMEMBER = 400_000
_NONE = np.iinfo(np.int32).max
_UNITS = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a message in protocol-buffer wire format."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = struct.unpack_from("<d" if kind == 1 else "<f", data, at)[0], at + size
        yield key >> 3, value


class CharacterMap:
    """Rules of a compiled character map: a double-array trie over UTF-8 bytes whose leaves point at replacements."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = np.frombuffer(data, np.uint32, size // 4, 4).tolist() if data else []
        self.replacements = data[4 + size :]
        plain = range(0x20, 0x7F)
        one = [b for b in plain if self.longest(bytes([b]), 0)]
        two = {a for a in plain for b in plain if (m := self.longest(bytes([a, b]), 0)) and m[1] == 2} if self.units else set()
        safe = "".join(regex.escape(chr(b)) for b in plain if b not in one and b not in two)
        # Characters that no rule begins with; the last before a longer character may begin one.
        self.safe = regex.compile(f"[{safe}]+(?![^\\x00-\\x7f])".encode()) if safe else None

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes replaced) of the longest rule that matches text at a place."""
        units, found = self.units, None
        if not units:
            return None
        node = _child_base(units[0], 0)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            unit = units[node]
            node = _child_base(unit, node)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                found = self.replacements[begin : self.replacements.index(b"\0", begin)], k + 1 - at
        return found

    def chunks(self, text: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(normalised, begin, end) for consecutive chunks of text: a rule's match, one character, or a run of plain ones.

        In a run each byte stands for itself; anything else is one chunk.
        """
        at = 0
        while at < len(text):
            if self.safe and (m := self.safe.match(text, at)):
                for k in range(at, m.end()):
                    yield text[k : k + 1], k, k + 1
                at = m.end()
                continue
            if rule := self.longest(text, at):
                to, size = rule
            else:
                lead = text[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                to = text[at : at + size]
            yield to, at, at + size
            at += size


def _child_base(unit: int, node: int) -> int:
    return node ^ (unit >> 10) << ((unit & 512) >> 6)


class Model:
    """A byte-fallback BPE model: pieces, their ids, which pairs merge into what, and how texts are normalised."""

    def __init__(self, data: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for n, value in fields(data):
            if n == 1:
                f = dict(fields(value))
                pieces.append((f.get(1, b"").decode(), float(f.get(2, 0.0)), f.get(3, NORMAL)))
            elif n in (2, 3):
                (trainer if n == 2 else normalizer).update(fields(value))
        self.dummy, self.squeeze, escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        kinds = np.array([t for _, _, t in pieces])
        wrong = [
            name
            for name, bad in {
                "model type": trainer.get(3, 1) != BPE,
                "no byte fallback": not trainer.get(35, 0) or (kinds == BYTE).sum() != 256,
                "space as suffix": trainer.get(24, 0),
                "spaces not escaped": not escape,
                "user-defined or unused pieces": not np.isin(kinds, (NORMAL, UNKNOWN, CONTROL, BYTE)).all(),
            }.items()
            if bad
        ]
        if wrong:
            raise ValueError(f"a model file of another kind: {', '.join(wrong)}")
        self.size = len(pieces)
        self.names = [p for p, _, _ in pieces]
        self.end = self.names.index(trainer.get(47, b"</s>").decode())
        ids = {p: k for k, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.map = CharacterMap(normalizer.get(2, b""))
        self.identity = not self.map.units and not self.squeeze
        self.of_byte = np.zeros(256, np.int32)
        for k in np.flatnonzero(kinds == BYTE).tolist():
            self.of_byte[int(self.names[k][3:5], 16)] = k
        self.byte_of = np.full(self.size, -1, np.int32)
        self.byte_of[self.of_byte] = np.arange(256)
        # Characters without a piece get ids from `size` on, one for each code point; no pair with them merges.
        self.of_char = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for p, k in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        scores = {s: r for r, s in enumerate(sorted({pieces[k][1] for k in ids.values()}, reverse=True))}
        pairs = [(ids[p[:c]] << 32 | ids[p[c:]], scores[pieces[k][1]], k) for p, k in ids.items() for c in range(1, len(p)) if p[:c] in ids and p[c:] in ids]
        pairs.sort()
        self.keys = np.array([k for k, _, _ in pairs] or [-1], np.int64)
        self.ranks, self.made = (np.array([p[i] for p in pairs] or [0], np.int32) for i in (1, 2))
        self._pairs: dict[int, tuple[int, int]] = {}
        # Where a mark follows another character, or at a newline, no piece reaches across.
        self.cut_marks = not any(MARK in p.lstrip(MARK) for p in ids)
        self.cut_lines = self.cut_marks and not any("\n" in p for p in ids)
        surfaces = [b"" if t == CONTROL else trainer.get(44, " ⁇ ".encode()) if t == UNKNOWN else bytes([self.byte_of[k]]) if t == BYTE else p.encode() for k, (p, _, t) in enumerate(pieces)]
        self.lengths = np.array([len(s) for s in surfaces], np.int64)  # in the normalised text
        shown = [s.replace(MARK.encode(), b" ") if t == NORMAL else s for s, (_, _, t) in zip(surfaces, pieces, strict=True)]
        first = [s[1:] if t == NORMAL and p[:1] == MARK and (self.dummy or self.squeeze) else s for s, (p, _, t) in zip(shown, pieces, strict=True)]
        self.shown = np.frombuffer(b"".join(shown + first), np.uint8)  # as decoded; at the beginning of a text from `size` on
        self.sizes = np.array([len(s) for s in shown + first], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.silent = kinds == CONTROL

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """text as pieces see it, and for each of its bytes, and its end, the place of the original byte it came from."""
        raw = text.encode()
        space, mark = b" ", MARK.encode()
        out: list[bytes] = []
        at: list[int] = []
        after_space = self.squeeze
        begin = end = 0
        empty = True
        for to, a, b in self.map.chunks(raw):
            if self.squeeze and empty and to == space:  # before the text begins
                begin = end = b
                continue
            if empty and self.dummy:
                out.append(mark)
                at += [begin] * 3
            empty = False
            if after_space:
                to = to.lstrip(space)
            if to:
                after_space = self.squeeze and to.endswith(space)
                shown = to.replace(space, mark)
                out.append(shown)
                at += [a] * len(shown)
            end = b
        whole = b"".join(out)
        if self.squeeze:
            while whole.endswith(mark):
                whole = whole[:-3]
                end = at[len(whole)]
                del at[len(whole) :]
        return whole.decode(), np.array([*at, end], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and product of each pair of ids."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.made[at]

    def merged(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, number of ids of each)."""
        sizes = np.array([len(u) for u in units], np.int64)
        order = np.argsort(sizes, kind="stable")
        n_short = int(np.searchsorted(sizes[order], SHORT, "right"))
        parts: list[np.ndarray] = [np.zeros(0, np.int64)]
        for a in range(0, n_short, 4096):
            rows = order[a : min(a + 4096, n_short)]
            rows = rows[sizes[rows] > 0]
            if len(rows):
                ids, sizes[rows] = self._short("".join([units[k] for k in rows.tolist()]), sizes[rows])
                parts.append(ids)
        for k in order[n_short:].tolist():
            parts.append(self._long(units[k]))
            sizes[k] = len(parts[-1])
        ids, n = self._fallen_back(np.concatenate(parts), sizes[order])
        counts = np.zeros(len(units), np.int64)
        counts[order] = n
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(n) - n
        return gathered(ids, starts, counts), counts

    def _fallen_back(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        odd = ids >= self.size
        if not odd.any():
            return ids.astype(np.int32), n
        code = ids - self.size
        many = np.where(odd, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        total = np.concatenate(([0], np.cumsum(many)))
        ends = np.cumsum(n)
        raw = np.frombuffer(code[odd].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        out = np.repeat(np.where(odd, 0, ids), many)
        out[np.repeat(odd, many)] = self.of_byte[raw]
        return out.astype(np.int32), total[ends] - total[ends - n]

    def _short(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(sizes.max())
        columns = np.arange(width)
        parts = np.full((len(sizes), width), -1, np.int64)
        parts[columns < sizes[:, None]] = self.of_char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ranks, made = np.full((len(sizes), width), _NONE, np.int32), np.zeros((len(sizes), width), np.int32)
        both = columns[1:] < sizes[:, None]
        ranks[:, :-1][both], made[:, :-1][both] = self.pair(parts[:, :-1][both], parts[:, 1:][both])
        n, live = sizes.copy(), np.arange(len(sizes))
        p, r, m = parts, ranks, made
        while True:
            at = r.argmin(axis=1)  # the first of the best
            row = np.arange(len(live))
            go = r[row, at] < _NONE
            if not go.all():
                parts[live[~go]] = p[~go]
                live, p, r, m, at = live[go], p[go], r[go], m[go], at[go]
                row = row[: len(live)]
            if not len(live):
                return parts[columns < n[:, None]], n
            product = m[row, at]
            # Without the boundary between parts `at` and `at + 1`: later parts and pairs move one place down.
            later = np.minimum(columns + (columns > at[:, None]), width - 1)
            p = np.take_along_axis(p, later, axis=1)
            later = np.minimum(columns + (columns >= at[:, None]), width - 1)
            r, m = np.take_along_axis(r, later, axis=1), np.take_along_axis(m, later, axis=1)
            p[row, at], r[:, -1], r[row, at] = product, _NONE, _NONE
            n[live] -= 1
            right = np.flatnonzero(at + 1 < n[live])
            r[right, at[right]], m[right, at[right]] = self.pair(p[right, at[right]], p[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1], m[left, at[left] - 1] = self.pair(p[left, at[left] - 1], p[left, at[left]])

    def _long(self, text: str) -> np.ndarray:
        if not self._pairs:
            self._pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        ids = self.of_char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ranks, _ = self.pair(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(ranks.tolist()) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self._pairs[a << 32 | b][1], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j < n and (found := self._pairs.get(ids[i] << 32 | ids[j])):
                    heapq.heappush(heap, (found[0], i, ids[i], ids[j]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def spelled(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """The texts that runs of n ids spell. Bytes that aren't UTF-8 become U+FFFD, one each."""
        ids = ids.astype(np.int64)
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        heard = ~self.silent[ids]
        while True:  # pieces before which a text is still empty lose a mark: the first, and with squeezed spaces all such
            total = np.concatenate(([0], np.cumsum(np.where(heard, self.sizes[ids], 0) if self.squeeze else heard)))
            first = heard & (total[:-1] == total[ends - n][owner]) & (ids < self.size)
            ids = np.where(first, ids + self.size, ids)
            if not self.squeeze or not first.any():
                break
        at = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.concatenate(([0], ends))]
        raw = gathered(self.shown, self.places[ids], self.sizes[ids])
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
        try:
            return spelled.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([self._repaired(ids[e - k : e].tolist(), x) for e, k, x in zip(ends.tolist(), n.tolist(), spelled.to_pylist(), strict=True)], pa.string())

    def _repaired(self, ids: list[int], spelled: bytes) -> str:
        try:
            return spelled.decode()
        except UnicodeDecodeError:
            out, held = [], b""
            for k in [*ids, -1]:
                if k >= 0 and (b := self.byte_of[k % self.size]) >= 0:
                    held += bytes([b])
                    continue
                while held:
                    for size in (1, 2, 3, 4):
                        try:
                            out.append(held[:size].decode())
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        size = 1
                        out.append("�")
                    held = held[size:]
                if k >= 0:
                    out.append(self.shown[self.places[k] : self.places[k] + self.sizes[k]].tobytes().decode())
            return "".join(out)


class Encoder:
    """Encodes texts, remembering the units it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.plain, self.exact = Pool(), Pool()

    def _learn(self, pool: Pool, keys: list[str], marked: bool) -> None:
        new = list(set(keys).difference(pool.at))
        if new:
            pool.add(new, *self.model.merged([x if x[:1] == "\n" else MARK + x for x in new] if marked else new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each, begins, ends): bytes of its text that an id stands for.

        The bytes of a character that has no piece are ids of their own; the last of them stands for the character, the
        others for nothing, as what is put before a text does.
        """
        m = self.model
        if len(self.plain.at) + len(self.exact.at) > REMEMBER:
            self._forget()
        sources: list[np.ndarray | None] = [None] * len(texts)
        plain: list[list[str]] = []
        odd: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            if m.identity:
                seen = (MARK if m.dummy and text else "") + text.replace(" ", MARK)
            else:
                seen, sources[k] = m.normalised(text)
            if m.cut_lines and seen[:1] == MARK and MARK * 2 not in seen:
                plain.append(seen[1:].replace("\n", f"{MARK}\n").split(MARK))
            else:
                plain.append([])
                if seen:
                    odd[k] = _UNITS.findall(seen) if m.cut_marks else [seen]
        keys = [x for some in plain for x in some]
        self._learn(self.plain, keys, True)
        others = [x for some in odd.values() for x in some]
        self._learn(self.exact, others, False)
        index = self.plain.index(keys)
        counts = np.array([len(some) for some in plain], np.int64)
        total, ends = np.concatenate(([0], np.cumsum(self.plain.sizes[index]))), np.cumsum(counts)
        n = total[ends] - total[ends - counts] if len(texts) else counts
        if odd:
            at, parts = ends - counts, []
            for k in range(len(texts)):
                parts.append(self.exact.get(self.exact.index(odd[k])) if k in odd else self.plain.get(index[at[k] : at[k] + counts[k]]))
                n[k] = len(parts[-1])
            ids = np.concatenate(parts)
        else:
            ids = self.plain.get(index)
        return ids, n, *self._spans(texts, sources, ids.astype(np.int64), n)

    def _spans(self, texts: list[str], sources: list[np.ndarray | None], ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        ends = np.cumsum(m.lengths[ids])
        if m.identity:  # every byte stands for itself, and a space for the three bytes of its mark
            raw = [t.encode() for t in texts]
            data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
            widths = np.where(data == 0x20, 3, 1)
            local = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            lead = np.where(sizes > 0, 3 * m.dummy, 0)
            source = np.repeat(local, widths)
            begins = np.concatenate(([0], np.cumsum(widths)))[np.concatenate(([0], np.cumsum(sizes)))]
            pieces = []
            for k in range(len(texts)):
                pieces += [np.zeros(lead[k], np.int64), source[begins[k] : begins[k + 1]], sizes[k : k + 1]]
            source = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
            seen = lead + np.diff(begins)
        else:
            source = np.concatenate(sources) if sources else np.zeros(0, np.int64)
            seen = np.array([len(s) - 1 for s in sources], np.int64)
        shift = np.repeat(np.arange(len(texts)), n)  # a text's sources hold one more place, its end
        first, last = source[ends - m.lengths[ids] + shift], source[ends + shift]
        byte = m.byte_of[ids]
        if (byte >= 0x80).any():
            inner = (byte >= 0x80) & (byte < 0xC0)
            lead_at = np.maximum.accumulate(np.where(inner, 0, np.arange(len(ids))))
            more = np.concatenate((inner[1:], [False]))
            first = first[lead_at]
            last = np.where((byte >= 0x80) & more, first, last)
        assert ends[-1] == seen.sum() if len(ids) else not seen.any()
        return first, last


@lru_cache(maxsize=1)
def encoder_of(data: bytes) -> Encoder:
    """The encoder that the tasks of one worker share, with what it remembers."""
    return Encoder(Model(data))


def _with_end(ids: np.ndarray, n: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Runs of n ids, each followed by its value of last."""
    return np.insert(ids, np.cumsum(n), last)


def encode(documents: DataFrame, model: str, end: bool = True, decoded: bool = False) -> DataFrame:
    """documents with ids, begins, ends (array<int>) and n_tokens; model is the path of a byte-fallback BPE model file.

    begins and ends are the bytes of the original text, in UTF-8, that each id stands for; with `end` an end id follows,
    which stands for nothing. Null text counts as empty and has no other id. Columns called ids, begins, ends or n_tokens
    are replaced; rows may repeat. With decoded, text becomes what the ids spell, in the same pass. A file of another kind
    (unigram models, no byte fallback, user-defined pieces) raises ValueError.
    """
    rows = documents.drop("ids", "begins", "ends", "n_tokens")
    data = Path(model).read_bytes()
    Model(data)
    shared = documents.sparkSession.sparkContext.broadcast(data)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            place = batch.schema.get_field_index("text")
            _, offsets = flat(batch.column(place))
            for i, j in blocks(offsets, 1 << 19):
                part = batch.slice(i, j - i)
                texts = [x or "" for x in part.column(place).to_pylist()]
                ids, n, begins, ends = encoder.encode(texts)
                columns = part.columns
                if decoded:
                    columns[place] = encoder.model.spelled(ids, n)
                if end:
                    sizes = np.array([len(t.encode()) for t in texts], np.int64)
                    ids, begins, ends, n = _with_end(ids, n, np.full(len(n), encoder.model.end)), _with_end(begins, n, sizes), _with_end(ends, n, sizes), n + 1
                at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (ids, begins, ends)]
                yield pa.RecordBatch.from_arrays([*columns, *lists, pa.array(n)], names=[*batch.schema.names, "ids", "begins", "ends", "n_tokens"])

    return map_batches(rows, task, f"{columns_of(rows)}, ids array<int>, begins array<int>, ends array<int>, n_tokens long")


def decode(encoded: DataFrame, model: str, to: str = "decoded") -> DataFrame:
    """encoded with column `to`: the text that column ids spells; null ids give null. A column of that name is replaced."""
    rows = encoded.drop(to)
    data = Path(model).read_bytes()
    Model(data)
    shared = encoded.sparkSession.sparkContext.broadcast(data)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = encoder_of(shared.value).model
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
            for i, j in blocks(np.concatenate(([0], np.cumsum(sizes))), 1 << 18):
                some = column.slice(i, j - i)
                texts = m.spelled(np.asarray(some.flatten(), np.int64), sizes[i:j])
                if some.null_count:
                    texts = pa.array([t if ok else None for t, ok in zip(texts.to_pylist(), some.is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, texts], names=[*batch.schema.names, to])

    return map_batches(rows, task, f"{columns_of(rows)}, {quoted(to)} string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids, in decimal with spaces, and of the decoded text in column text."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
