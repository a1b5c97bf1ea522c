"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a byte string, exactly one token can be the last of its
BPE encoding: the token that ends there and forms a valid pair with the last
token of the prefix before it.  A pair is valid when merging its joined bytes
gives the same two tokens back.  A table of these last tokens therefore holds
the encodings of all prefixes: appending extends it exactly, and an edit
recomputes only from the edit until the table agrees with the old one for as
many bytes as the longest token has.

Texts are cut by the tokenizer's pattern and each match is encoded on its own.  The tables of
many matches grow together, a prefix length at a time: a trie gives the tokens that start at
a byte, and a flat table the pairs that were tested before.
Null texts count as empty (no ids); repeated rows give repeated results.

Null texts count as empty and have no ids; repeated rows give repeated results; a very long
text is encoded whole; an empty table gives no rows.  Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratawise.llm.common import _CUT, UnitTable, doc_texts, ids_by_text, released, slices


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: Longer strings than this get a table of their own; strings whose tables grow together; pairs kept.
_LONG, _TOGETHER, _PAIRS = 64, 20_000, 1_000_000


class IntMap:
    """Numbers from 0 on by such numbers, in a flat table where numpy looks up many at once."""

    def __init__(self, bits: int):
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.used = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        hit = there == keys
        out = np.where(hit, self.values[slots], -1)
        left = np.flatnonzero(~hit & (there >= 0))
        while len(left):
            slots[left] = at = (slots[left] + 1) & self.last
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there; at least one slot has to stay free."""
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # one of those that meet here
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            left = left[~own]
            slots[left] = (slots[left] + 1) & self.last
        self.used += len(keys)


class PrefixBpe:
    """A rank vocabulary with the pair test that the prefix tables need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.step = max(ranks.values()) + 1
        self._valid: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._pairs = IntMap(_PAIRS.bit_length() + 1)
        self._lens = np.array([len(self.token.get(i, b"")) for i in range(self.step)], dtype=np.int64)
        nodes, ends = {}, [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = nodes.get(key, 0)
                if not node:
                    node = nodes[key] = len(ends)
                    ends.append(-1)
            ends[node] = rank
        self._edges, self._ends = IntMap(len(nodes).bit_length() + 1), np.array(ends, dtype=np.int32)
        self._edges.put(np.fromiter(nodes.keys(), dtype=np.int64), np.fromiter(nodes.values(), dtype=np.int32))

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by lowest rank; only for the short strings of the pair test."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def whole(self, t: int) -> bool:
        """Merging the token's bytes gives the token."""
        known = self._whole.get(t)
        if known is None:
            known = self._whole[t] = self.merge(self.token[t]) == [t]
        return known

    def valid(self, a: int, b: int) -> bool:
        key = a * self.step + b
        known = self._valid.get(key)
        if known is None:
            if len(self._valid) > _PAIRS:
                self._valid.clear()
            known = self._valid[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def _fits(self, before: np.ndarray | None, tokens: np.ndarray) -> np.ndarray:
        """Where the token may follow the one before it (None: begin the string)."""
        if before is None:
            firsts, where = np.unique(tokens, return_inverse=True)
            return np.fromiter(map(self.whole, firsts.tolist()), dtype=bool, count=len(firsts))[where]
        keys = before.astype(np.int64) * self.step + tokens
        known = self._pairs.get(keys)
        unknown = np.flatnonzero(known < 0)
        if len(unknown):
            new, where = np.unique(keys[unknown], return_inverse=True)
            token, merge = self.token, self.merge
            made = np.array([merge(token[a] + token[b]) == [a, b] for a, b in (divmod(k, self.step) for k in new.tolist())], dtype=np.int32)
            if self._pairs.used + len(new) > _PAIRS:
                self._pairs = IntMap(max(_PAIRS, len(new)).bit_length() + 1)
            self._pairs.put(new, made)
            known[unknown] = made[where]
        return known == 1

    def _tables(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        """Last tokens of the prefixes of strings sorted from long to short: an array a prefix length,
        with an item for each string that is so long."""
        longest = int(lens[0])
        over = np.searchsorted(-lens, -np.arange(longest + 1), side="left").tolist()  # strings longer than j
        tables: list[np.ndarray] = [np.full(len(lens), -1, dtype=np.int32)]
        found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(longest + 1)]
        for j in range(longest):
            if j:
                tables.append(self._last(found[j], tables, over[j - 1]))
                found[j] = []
            own, node, end = np.arange(over[j]), np.zeros(over[j], dtype=np.int64), j
            while len(own):  # all tokens that start at byte j; longer ones come earlier at each end
                node = self._edges.get(node << 8 | data[starts[own] + end])
                there = node >= 0
                own, node, end = own[there], node[there].astype(np.int64), end + 1
                token = self._ends[node]
                real = token >= 0
                found[end].append((j, own[real], token[real]))
                some = np.searchsorted(own, over[end])
                own, node = own[:some], node[:some]
        tables.append(self._last(found[longest], tables, over[longest - 1]))
        return tables

    def _last(self, found: list[tuple[int, np.ndarray, np.ndarray]], tables: list[np.ndarray], n: int) -> np.ndarray:
        """Last tokens at one prefix length, from the tokens found to end there."""
        last = np.full(n, -1, dtype=np.int32)
        for j, own, token in found:
            still = last[own] < 0
            own, token = own[still], token[still]
            if len(own):
                fits = self._fits(tables[j][own] if j else None, token)
                last[own[fits]] = token[fits]
        if (last < 0).any():
            raise ValueError("the vocabulary lacks a byte of this text")
        return last

    def _together(self, strings: list[bytes]) -> list[list[int]]:
        """The encodings of strings sorted from long to short, none empty."""
        lens = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        tables = self._tables(np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(lens) - lens, lens)
        flat = np.concatenate(tables)
        bases = np.cumsum([0] + [len(t) for t in tables])
        own, at, steps = np.arange(len(strings)), lens.copy(), []
        while len(own):  # from the last token of each string to its first
            token = flat[bases[at[own]] + own]
            steps.append((own, token))
            at[own] -= self._lens[token]
            own = own[at[own] > 0]
        ends = np.cumsum(np.bincount(np.concatenate([o for o, _ in steps]), minlength=len(strings)))
        ids = np.empty(ends[-1], dtype=np.int32)
        for k, (own, token) in enumerate(steps, 1):
            ids[ends[own] - k] = token
        listed, bounds = ids.tolist(), [0, *ends.tolist()]
        return [listed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_all(self, strings: list[bytes]) -> list[list[int]]:
        """The ids of many pattern matches."""
        out = [[t] if (t := self.ranks.get(s)) is not None else self.encode(s) if not 0 < len(s) <= _LONG else None for s in strings]
        rest = sorted((i for i, ids in enumerate(out) if ids is None), key=lambda i: -len(strings[i]))
        for a in range(0, len(rest), _TOGETHER):
            some = rest[a : a + _TOGETHER]
            for i, ids in zip(some, self._together([strings[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def extend(self, data: bytes, table: list[int], end: int) -> None:
        """Add the last tokens of the prefixes of data up to length ``end``."""
        get, known, step, longest = self.ranks.get, self._valid, self.step, self.longest
        for i in range(len(table), end + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = get(data[j:i])
                if t is None:
                    continue
                if j:
                    fits = known.get(table[j] * step + t)
                    if fits is None:
                        fits = self.valid(table[j], t)
                else:
                    fits = self.whole(t)
                if fits:
                    table.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of this text")

    def encode(self, data: bytes) -> list[int]:
        """The ids of one pattern match."""
        t = self.ranks.get(data)
        if t is not None:
            return [t]
        return PrefixTable(self, data).ids()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixTable:
    """Last tokens of all prefixes of one byte string."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.table = bpe, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.bpe.extend(self.data, self.table, len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many prefixes were recomputed."""
        old, shift = self.table, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.table, agree, done = old[: start + 1], 0, 0
        for i in range(start + 1, len(self.data) + 1):
            if i > start + len(new):
                if agree >= self.bpe.longest:
                    self.table += old[i - shift :]
                    break
            self.bpe.extend(self.data, self.table, i)
            t, done = self.table[-1], done + 1
            agree = agree + 1 if i > start + len(new) and t == old[i - shift] else 0
        return done

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the prefix of this length (default: all)."""
        at, out = len(self.data) if length is None else length, []
        while at:
            out.append(self.table[at])
            at -= len(self.bpe.token[self.table[at]])
        return out[::-1]


class EncodedText:
    """A text's ids, kept by unit so that appends and edits touch few units."""

    def __init__(self, encoder: TextEncoder, text: str = ""):
        self.encoder, self.units, self.unit_ids = encoder, [], []
        self.append(text)

    def append(self, text: str) -> None:
        tail = self.units.pop() if self.units else ""
        if self.unit_ids:
            self.unit_ids.pop()
        made = _CUT.split(tail + text)
        self.units += made
        self.unit_ids += self.encoder.units(made)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end], re-encoding the units it touches and their neighbours."""
        ends = np.cumsum([len(u) for u in self.units])
        a = max(0, int(np.searchsorted(ends, start, side="left")) - 1)
        b = min(len(self.units), int(np.searchsorted(ends, end, side="right")) + 2)
        base = int(ends[a - 1]) if a else 0
        old = "".join(self.units[a:b])
        made = _CUT.split(old[: start - base] + new + old[end - base :])
        self.units[a:b] = made
        self.unit_ids[a:b] = self.encoder.units(made)

    @property
    def text(self) -> str:
        return "".join(self.units)

    @property
    def ids(self) -> list[int]:
        return [t for u in self.unit_ids for t in u]


class TextEncoder:
    """Encodes units by cutting them with the pattern; equal matches are encoded once."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.bpe, self.find = PrefixBpe(load_ranks(ranks_path)), regex.compile(pattern).findall
        size = self.bpe.step
        self.lens = self.bpe._lens
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(self.bpe.token.get(i, b"") for i in range(size)), dtype=np.uint8)

    def units(self, units: list[str]) -> list[list[int]]:
        cut = list(map(self.find, units))
        pieces = list(dict.fromkeys(chain.from_iterable(cut)))
        ids = dict(zip(pieces, self.bpe.encode_all([p.encode() for p in pieces]), strict=True))
        return [ids[c[0]] if len(c) == 1 else [t for p in c for t in ids[p]] for c in cut]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in order, and where the bytes of each id end."""
        n = self.lens[ids]
        ends = np.cumsum(n)
        where = np.repeat(self.starts[ids] - (ends - n), n)
        where += np.arange(len(where))
        return self.flat[where], ends


_encoders: dict[tuple[str, str, int], tuple[TextEncoder, UnitTable]] = {}


def encoder(ranks_path: str, pattern: str, remembered: int = 400_000) -> tuple[TextEncoder, UnitTable]:
    """One encoder and its unit table per Python worker."""
    key = ranks_path, pattern, remembered
    if key not in _encoders:
        own = TextEncoder(ranks_path, pattern)
        _encoders[key] = own, UnitTable(own.units, remembered)
    return _encoders[key]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, with_ids: bool = False, remembered: int = 400_000) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    ``remembered`` is how many units a Python worker keeps between batches; a
    worker lives on after its stage, so a pipeline keeps fewer than a job of its own."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = encoder(ranks_path, pattern, remembered)
        for batch in batches:
            for piece in slices(batch):
                ids, at = ids_by_text(table, piece.column("text"))
                raw, ends = own.decode(ids)
                bounds = np.concatenate([[0], ends])[at].tolist()
                le, back = memoryview(ids.astype("<u4")).cast("B"), memoryview(raw)
                at = at.tolist()
                out = {
                    "doc_id": piece.column("doc_id"), "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(le[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return doc_texts(docs).mapInArrow(released(encode), schema)
