"""Byte-level BPE encoding and decoding on whole texts, in numpy inside tasks.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a slice of rows are encoded together: they
are sorted by length into padded matrices of one id per byte, and in each round every row merges its leftmost pair of
minimum rank. Pairs are looked up in an open-addressed hash table of (left id, right id); after a round rows are
compacted to the left, finished rows leave, and the matrix is narrowed. A piece longer than LONG bytes would take as many
rounds as it has bytes; it is merged with a heap over a linked list instead, with the same result.

A worker remembers the tokens of short parts of texts between white space, up to a bound in bytes.

Ranks are read from a file of "base64 rank" lines, whose path is a parameter.

Defined cases: a null or empty text has no tokens and decodes to no bytes; a text of any length is encoded whole, by
itself if it is long; of pairs of the same rank the leftmost goes first; repeated rows and null ids are encoded row by
row; an empty table gives an empty result; further columns do not reach the Python workers' output.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import slices

#: Bytes beyond which a piece is merged with a heap.
LONG = 256
#: Cells of one padded matrix.
CELLS = 2_000_000
#: Characters of a chunk that a worker remembers, and bytes of all that it remembers; then it starts afresh.
REMEMBERED_CHARS, REMEMBERED_BYTES = 40, 24_000_000
#: Bytes of text that are encoded at a time; their parts are Python strings, which take many times as much.
SLICE = 1_000_000
#: Bytes that a remembered chunk takes besides its characters and tokens: its string, its place and its row of arrays.
OVERHEAD = 200
NONE = np.int32(2**30)
#: The end of patterns that begin a match where white space begins; a space that isn't before a non-space;
#: and the parts between two such places.
_SPACED = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER_SPACE = re.compile(r" (?:\s|\Z)")
_PARTS = regex.compile(r"\s*\S+|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Bpe:
    """The merges of a rank file, and the kernels that encode and decode with them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.at_spaces = pattern.endswith(_SPACED)
        self._forget()
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.names = [str(i) for i in range(size)]
        self.lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.buffer = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """All (left, right) whose bytes joined are a token, in a table with linear probing."""
        found = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        left, right, merged = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
        keys = left << 32 | right
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 2))))
        self.table = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            at = slot[waiting]
            free = self.table[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            won = waiting[free][first]
            self.table[slot[won]], self.values[slot[won]] = keys[won], merged[won]
            waiting = np.setdiff1d(waiting, won, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)
            # a waiting key may find its new slot taken as well: it goes on in the next round

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        at = self.table[slot]
        out = np.where(at == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.table[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out

    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each row of a padded matrix, padded likewise, and their numbers; lengths are the rows' bytes."""
        rows, width = ids.shape
        out, sizes = np.zeros((rows, width), dtype=np.int32), np.zeros(rows, dtype=np.int64)
        own = np.arange(rows)
        ranks = np.where(np.arange(width - 1)[None, :] < (lengths - 1)[:, None], self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1), NONE)
        while len(own):
            if ranks.shape[1]:
                best = ranks.argmin(axis=1)
                least = ranks[np.arange(len(own)), best]
            else:
                best, least = np.zeros(len(own), dtype=np.int64), np.full(len(own), NONE)
            done = least == NONE
            if done.any():
                out[own[done], : ids.shape[1]], sizes[own[done]] = ids[done], lengths[done]
                keep = ~done
                own, ids, ranks, lengths, best, least = own[keep], ids[keep], ranks[keep], lengths[keep], best[keep], least[keep]
                if not len(own):
                    break
            # compaction: the right id of the pair leaves its row, and the pair leaves the ranks; every row loses one cell
            at = np.arange(len(own))
            ids[at, best] = least
            stay = np.ones(ids.shape, dtype=bool)
            stay[at, best + 1] = False
            ids = ids[stay].reshape(len(own), -1)
            stay = np.ones(ranks.shape, dtype=bool)
            stay[at, best] = False
            ranks = ranks[stay].reshape(len(own), -1)
            lengths = lengths - 1
            for side in (best, best - 1):
                has = np.flatnonzero((side >= 0) & (side + 1 < lengths))
                k = side[has]
                ranks[has, k] = self.pair_ranks(ids[has, k], ids[has, k + 1])
        return out, sizes

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges on one long piece: a heap of (rank, place) over a linked list."""
        ids = [int(self.byte_id[b]) for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        bytes_of, ranks = self.bytes_of, self.ranks
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := ranks.get(bytes_of[ids[x]] + bytes_of[ids[after[x]]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode_pieces(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces in order, number of tokens of each). A piece that is a token itself is that token."""
        get = self.ranks.get
        whole = np.array([get(x, -1) for x in raw], dtype=np.int32)
        sizes = np.ones(len(raw), dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        bytes_in = np.array([len(raw[i]) for i in rest], dtype=np.int64)
        order = np.argsort(bytes_in, kind="stable")
        rest, bytes_in = rest[order], bytes_in[order]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        start = 0
        while start < len(rest):
            least = int(bytes_in[start])
            if least > LONG:
                tokens = self._merge_long(raw[rest[start]])
                parts.append((rest[start : start + 1], tokens, np.array([len(tokens)])))
                start += 1
                continue
            # rows of about the same length: at most an eighth of the width is padding
            most = min(least + least // 8, LONG)
            stop = min(int(np.searchsorted(bytes_in, most, "right")), start + max(1, CELLS // most))
            group, lengths = rest[start:stop], bytes_in[start:stop]
            width = int(lengths.max())
            ids = np.zeros((len(group), width), dtype=np.int32)
            ids[np.arange(width)[None, :] < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join([raw[i] for i in group]), dtype=np.uint8)]
            tokens, n = self._merge_rows(ids, lengths)
            parts.append((group, tokens[np.arange(width)[None, :] < n[:, None]], n))
            start = stop
        for group, _, n in parts:
            sizes[group] = n
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), dtype=np.int32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        for group, tokens, n in parts:
            flat[ranges(starts[group], n)] = tokens
        return flat, sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts in order, offsets of each text's first token and the end)."""
        chunks: list[str] = []
        ends = []
        for text in texts:
            if text:
                chunks += self._chunks(text)
            ends.append(len(chunks))
        if not chunks:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        long = self._learn(list(dict.fromkeys(chunks)))
        place = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        for x in long:
            del self.known[x]
        sizes, firsts = self.sizes[place], self.firsts[place]
        chunk_ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.tokens[ranges(firsts, sizes)], chunk_ends[np.concatenate([[0], ends]).astype(np.int64)]

    def _chunks(self, text: str) -> list[str]:
        """Parts of text between which every match of the pattern ends: " x" is kept as "x", any other part as " " + part.

        With a pattern of the form " ?letters| ?digits| ?others|spaces not before a non-space|spaces", a match begins
        wherever white space begins, so a part is white space and what follows it. Where all of it are single spaces
        before non-spaces and lines are short, that is what split gives. With other patterns a text is one chunk.
        """
        if not self.at_spaces:
            return [" " + text]
        if _OTHER_SPACE.search(text):
            return [x[1:] if x[0] == " " and x[1:2] != " " and len(x) > 1 else " " + x for x in _PARTS.findall(text)]
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        if len(max(parts, key=len)) <= REMEMBERED_CHARS:
            return parts
        out: list[str] = []
        for x in parts:
            if len(x) <= REMEMBERED_CHARS:
                out.append(x)
            else:  # other white space inside, or one long part
                first, *rest = _PARTS.findall(x[1:] if x[0] == " " else " " + x)
                out.append(first[1:] if first[0] == " " and len(first) > 1 else " " + first)
                out += [" " + y for y in rest]
        return out

    def _learn(self, chunks: list[str]) -> list[str]:
        """Encode the chunks that aren't known: known has their places in firsts and sizes, which lead to tokens.

        Gives the long ones, which the caller takes out of known when it has read them; they lie behind the others,
        where the next call writes over them.
        """
        known = self.known
        new = [x for x in chunks if x not in known]
        if self.held + sum(len(x) for x in new) * 2 + OVERHEAD * len(new) > REMEMBERED_BYTES and known:
            self._forget()
            known, new = self.known, chunks
        if not new:
            return []
        new.sort(key=lambda x: len(x) > REMEMBERED_CHARS)
        pieces: list[str] = []
        counts = []
        for x in new:
            if x[:1] != " " and x.isalpha():
                pieces.append(" " + x)
                counts.append(1)
            else:
                found = self.find(x[1:] if x[:1] == " " else " " + x)
                pieces += found
                counts.append(len(found))
        index = {x: i for i, x in enumerate(dict.fromkeys(pieces))}
        codes = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        flat, sizes = self.encode_pieces([x.encode() for x in index])
        firsts = np.cumsum(sizes) - sizes
        tokens = flat[ranges(firsts[codes], sizes[codes])]
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(counts)])]
        start = len(known)
        self.firsts = _put(self.firsts, start, ends[:-1] + self.n_tokens)
        self.sizes = _put(self.sizes, start, np.diff(ends))
        self.tokens = _put(self.tokens, self.n_tokens, tokens)
        brief = sum(len(x) <= REMEMBERED_CHARS for x in new)
        known.update(zip(new, range(start, start + len(new)), strict=True))
        self.n_tokens += int(ends[brief])
        self.held += sum(map(len, new[:brief])) * 2 + int(ends[brief]) * 4 + OVERHEAD * brief
        return new[brief:]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.n_tokens = self.held = 0
        self.firsts, self.sizes, self.tokens = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows in order, offsets of each row's first byte and the end)."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.buffer[ranges(self.starts[ids], sizes)], ends[offsets]


def _put(held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """held with new written at a place; it grows by doubling."""
    if at + len(new) > len(held):
        held = np.concatenate([held[:at], np.zeros(max(at, len(new)) + len(new), held.dtype)])
    held[at : at + len(new)] = new
    return held


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for size numbers, for each start and size, in one array."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


_LOADED: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """The tokenizer of a rank file, made once in each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def default_files(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id and token_ids. path must be readable on every executor."""
    path, pattern = default_files(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in slices(batches, "text", SLICE):
            ids, offsets = bpe.encode(part.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "token_ids"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, token_ids array<int>")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of encoded: doc_id and the decoded bytes. Null ids decode to no bytes."""
    path, pattern = default_files(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = part.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                data, ends = bpe.decode(tokens, np.concatenate([[0], np.cumsum(sizes)]))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], ["doc_id", "bytes"])

    kept = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("token_ids"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, bytes binary")


def both_ways(batches: Iterator[pa.RecordBatch], bpe: Bpe, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """round_trip of batches of doc_id and text; what it holds at a time is bounded by SLICE and REMEMBERED_BYTES."""
    for part in slices(batches, "text", SLICE):
        ids, offsets = bpe.encode(part.column(1).to_pylist())
        data, ends = bpe.decode(ids, offsets)
        raw, names = data.tobytes(), bpe.names
        told = [",".join([names[i] for i in ids[a:b].tolist()]) for a, b in zip(offsets, offsets[1:], strict=False)]
        columns = [
            part.column(0),
            pa.array(np.diff(offsets), pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in told]),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]),
        ]
        named = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
            named.append("token_ids")
        yield pa.RecordBatch.from_arrays(columns, named)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row (and token_ids): encoded, then decoded from the ids.

    Both directions run in one pass over a slice, so that token lists do not travel between two Python stages.
    """
    path, pattern = default_files(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return both_ways(batches, load(path, pattern), with_ids)

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)
