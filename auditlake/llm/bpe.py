"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is merged on its own: leaf i of the tree holds (rank, i) of the pair of
symbol i and its right neighbour, the root is the leftmost pair of lowest rank, a merge
updates at most three leaves in logarithmic time, and the work ends when the root is empty.
Short pre-tokens are merged in lockstep, a row of one array per tree
(``merge_many``); long ones one by one (``merge``). The vocabulary file (a fixed, bounded file) is broadcast; texts stream through Arrow batches.

Every distinct word of a group of texts, and every distinct pre-token of those words, is
worked on once (Arrow's dictionary encoding); ids, decimals and bytes are then taken by position.

Defined results: a null or empty text has no ids; ids and texts are row by row, so repeated
rows give equal rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import pieces, text_bytes

#: fixed value: split pattern of the byte-level vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: code points that the library's pattern engine treats as white space
_SPACE = "\t\n\x0b\f\r \x85\xa0                　"
#: bytes after which a space begins a word: not those of ASCII white space, nor those that may begin another one
_WORD_BYTE = ~np.isin(np.arange(256), [*b"\t\n\x0b\f\r ", 0xC2, 0xE1, 0xE2, 0xE3])
_CUT = re.compile(rb" (?=[^\t\n\x0b\f\r \xc2\xe1\xe2\xe3])")
_NONE = 1 << 62
_PLACE = (1 << 40) - 1
LOCKSTEP_BYTES = 126  # longer pre-tokens are merged one by one
LOCKSTEP_LEAVES = 1 << 16  # leaves of all trees merged at a time
GROUP_BYTES = 8_000_000  # texts (and parts of one long text) encoded together


def byte_letters() -> dict[str, int]:
    """The vocabulary writes byte b as a printable character: itself where printable in
    Latin-1, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge(symbols: list[int], pairs: dict) -> list[int]:
    """Apply the lowest-ranked, leftmost merge again and again.
    pairs: a << 20 | b to (rank << 40, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    get = pairs.get
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        p = get(sym[i] << 20 | sym[i + 1])
        if p is not None:
            tree[size + i] = p[0] | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    while tree[1] != _NONE:
        i = tree[1] & _PLACE
        j = nxt[i]
        sym[i] = merged = get(sym[i] << 20 | sym[j])[1]
        sym[j] = -1
        nxt[i] = k = nxt[j]
        # the neighbours first: while leaf i is still the lowest, their updates end where they meet its path
        changed = []
        if j < n - 1 and tree[size + j] != _NONE:
            changed.append((size + j, _NONE))
        h = prv[i]
        if h >= 0:
            p = get(sym[h] << 20 | merged)
            low = _NONE if p is None else p[0] | h
            if tree[size + h] != low:
                changed.append((size + h, low))
        low = _NONE
        if k < n:
            prv[k] = i
            p = get(merged << 20 | sym[k])
            if p is not None:
                low = p[0] | i
        changed.append((size + i, low))
        for at, value in changed:
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value
    return [s for s in sym if s >= 0]


class Pairs:
    """Mergeable pairs as sorted arrays: ``of(a, b)`` gives ranks, -1 where a pair does not merge."""

    def __init__(self, pairs: dict):
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _NONE)
        self.rank = np.append(np.fromiter((r >> 40 for r, _ in pairs.values()), np.int64, len(pairs))[order], -1)
        self.merged = np.empty(len(pairs), dtype=np.int64)
        self.merged[self.rank[:-1]] = np.fromiter((m for _, m in pairs.values()), np.int64, len(pairs))[order]

    def of(self, a, b):
        key = np.where((a < 0) | (b < 0), np.int64(-1), a << 20 | b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], -1)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same from starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def merge_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, byte_id: np.ndarray, pairs: Pairs,
               by_pair: dict) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the tokens ``data[starts:starts + lengths]``, one after the other, and how many each token has.
    Those of up to LOCKSTEP_BYTES bytes are merged in lockstep, by classes of length; longer ones one by one."""
    counts = np.zeros(len(starts), dtype=np.int64)
    found = []
    class_of = np.where(lengths <= LOCKSTEP_BYTES, np.frexp(lengths.astype(np.float64))[1], -1)
    for c in np.unique(class_of).tolist():
        members = np.flatnonzero(class_of == c)
        if c < 0:
            for i in members.tolist():
                ids = merge(byte_id[data[starts[i]:starts[i] + lengths[i]]].tolist(), by_pair)
                counts[i] = len(ids)
                found.append((np.array([i]), np.array(ids, dtype=np.int64)))
            continue
        size = 1 << c
        step = max(1, LOCKSTEP_LEAVES // size)
        for a in range(0, len(members), step):
            part = members[a:a + step]
            sym = _lockstep(data, starts[part], lengths[part], size, byte_id, pairs)
            kept = sym >= 0
            counts[part] = kept.sum(axis=1)
            found.append((part, sym[kept]))
    at = _offsets(counts)
    out = np.empty(at[-1], dtype=np.int64)
    for part, ids in found:
        out[_ranges(at[part], counts[part])] = ids
    return out, counts


def _lockstep(data, starts, n, size: int, byte_id: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Tree r is row r; its last leaf and symbol are a sentinel that stands before the first symbol and after the last."""
    m, end = len(starts), size - 1
    place = np.arange(size)
    inside = place < n[:, None]
    sym = np.where(inside, byte_id[data[np.where(inside, starts[:, None] + place, 0)]], -1)
    nxt = np.where(place + 1 < n[:, None], place + 1, end).ravel()
    prv = np.tile(np.where(place > 0, place - 1, end), m)
    tree = np.full((m, 2 * size), _NONE, dtype=np.int64)
    rank = pairs.of(sym[:, :-1], sym[:, 1:])
    tree[:, size:-1] = np.where(rank >= 0, rank << 8 | place[:-1], _NONE)
    level = size >> 1
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level >>= 1
    sym, tree = sym.ravel(), tree.ravel()
    row = np.arange(m)
    while True:
        root = tree[row * (2 * size) + 1]
        going = root != _NONE
        row, root = row[going], root[going]
        if not len(row):
            return sym.reshape(m, size)
        base, i = row * size, root & 255
        merged = pairs.merged[root >> 8]
        j, h = nxt[base + i], prv[base + i]
        k = nxt[base + j]
        sym[base + i] = merged
        sym[base + j] = -1
        nxt[base + i] = k
        prv[base + k] = i
        left, right = pairs.of(sym[base + h], merged), pairs.of(merged, sym[base + k])
        at = np.concatenate([j, h, i]) + size
        tops = np.tile(base * 2, 3)
        tree[tops + at] = np.concatenate([np.full(len(row), _NONE), np.where(left >= 0, left << 8 | h, _NONE),
                                          np.where(right >= 0, right << 8 | i, _NONE)])
        while at[0] > 1:  # all leaves are equally deep
            at >>= 1
            child = tops + 2 * at
            tree[tops + at] = np.minimum(tree[child], tree[child + 1])


class Codec:
    """Encoder and decoder of one byte-level vocabulary (the JSON text of its file)."""

    def __init__(self, spec: str):
        import regex

        j = json.loads(spec)
        letters = byte_letters()
        vocab = j["model"]["vocab"]
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.byte_id = [0] * 256
        for ch, b in letters.items():
            self.byte_id[b] = vocab[ch]
        self.pairs = {}
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs[vocab[a] << 20 | vocab[b]] = (rank << 40, vocab[a + b])
        self.byte_ids, self.sorted_pairs = np.array(self.byte_id, dtype=np.int64), Pairs(self.pairs)
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.bytes_of.update({i: s.encode() for s, i in self.added.items()})
        self.added_bytes = {s.encode(): i for s, i in self.added.items()}
        top = max(self.bytes_of) + 1
        self.symbols = [self.bytes_of.get(i, b"") for i in range(top)]
        self.decimals = [str(i) for i in range(top)]
        self.pattern = regex.compile(PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]")
                                     .replace(r"\s", f"[{_SPACE}]"))
        self.special = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.added_bytes, key=len, reverse=True))) + b")") \
            if self.added else None

    def _segments(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts as one run of bytes, where texts, added tokens and what follows them begin, and where texts end."""
        parts, ends, size = [], [], 0
        for text in texts:
            has = text and self.special and any(s in text for s in self.added_bytes)
            for part in self.special.split(text) if has else [text]:
                if part:
                    parts.append(part)
                    size += len(part)
            ends.append(size)
        starts = _offsets(np.fromiter(map(len, parts), np.int64, len(parts)))[:-1]
        return np.frombuffer(b"".join(parts), dtype=np.uint8), starts, np.array(ends, dtype=np.int64)

    def _pre_tokens(self, words: list[bytes], plain: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all words, first those of plain words, and how many each word has. A plain word begins with a
        space before a non-space: the pattern begins a pre-token there whatever stands before, so that one
        search goes over all plain words together."""
        import pyarrow as pa

        together = [w for w, p in zip(words, plain.tolist()) if p]
        tokens = self.pattern.findall(b"".join(together).decode())
        counts = np.zeros(len(words), dtype=np.int64)
        if tokens:
            ends = np.frombuffer(pa.array(tokens, pa.large_string()).buffers()[1], np.int64, len(tokens) + 1)[1:]
            words_end = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
            counts[plain] = np.diff(np.searchsorted(ends, words_end) + 1, prepend=0)
        for i in np.flatnonzero(~plain).tolist():
            found = self.pattern.findall(words[i].decode())
            counts[i] = len(found)
            tokens += found
        return tokens, counts

    def _word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words in some order, where each word's begin, how many it has)."""
        import pyarrow as pa

        added = np.fromiter((w in self.added_bytes for w in words), bool, len(words))
        plain = np.fromiter((w[0] == 32 and len(w) > 1 and _WORD_BYTE[w[1]] for w in words), bool, len(words))
        cut = np.flatnonzero(~added)
        order = np.concatenate([np.flatnonzero(plain), cut[~plain[cut]], np.flatnonzero(added)])
        of_pattern = [words[i] for i in order[:len(cut)].tolist()]
        tokens, n_tokens = self._pre_tokens(of_pattern, plain[order[:len(cut)]])
        coded = pa.array(tokens, pa.large_string()).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary
        if len(distinct):
            at = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)
            data = np.frombuffer(distinct.buffers()[2], np.uint8, at[-1])
            merged, n_ids = merge_many(data, at[:-1], np.diff(at), self.byte_ids, self.sorted_pairs, self.pairs)
        else:
            merged, n_ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        ids = merged[_ranges(_offsets(n_ids)[which], n_ids[which])]
        upto = _offsets(n_ids[which])[_offsets(n_tokens)]
        special = [self.added_bytes[words[i]] for i in order[len(cut):].tolist()]
        ids = np.concatenate([ids, np.array(special, dtype=np.int64)])
        in_order = np.concatenate([np.diff(upto), np.ones(len(special), dtype=np.int64)])
        first, counts = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        first[order], counts[order] = _offsets(in_order)[:-1], in_order
        return ids, first, counts

    def encode_many(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes or None), one after the other, and how many each text has.

        Texts are cut into words before every space that a word's byte follows. Every distinct word of the texts is
        split and merged once; the ids of all words are taken by position."""
        import pyarrow as pa

        data, starts, ends = self._segments(texts)
        if not len(data):
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        begins = np.zeros(len(data), dtype=bool)
        begins[:-1] = (data[:-1] == 32) & _WORD_BYTE[data[1:]]
        begins[starts[1:] - 1] = False  # what follows belongs to another text
        begins[starts] = True
        at = np.flatnonzero(begins)
        buffers = [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]
        words = pa.Array.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
        which = words.indices.to_numpy()
        ids, first, counts = self._word_ids(words.dictionary.to_pylist())
        counts = counts[which]
        ids = ids[_ranges(first[which], counts)]
        return ids, np.diff(_offsets(counts)[np.searchsorted(at, ends)], prepend=0)

    def join_many(self, symbols, ids: np.ndarray, counts: np.ndarray, separator) -> list:
        """Per text its ids' symbols (of a list by id) joined."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pa.LargeListArray.from_arrays(_offsets(counts), pa.array(symbols).take(pa.array(ids)))
        return pc.binary_join(lists, separator).to_pylist()

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([(text or "").encode()])[0].tolist()

    def decode(self, ids) -> str:
        of = self.symbols
        return b"".join([of[i] for i in ids]).decode("utf-8", errors="replace")


def chunks(texts: list):
    """Lists of (row, bytes) of about GROUP_BYTES together; a longer text comes in several, cut where a word begins."""
    group, size = [], 0
    for row, text in enumerate(texts):
        text, at = text or b"", 0
        while True:
            end = len(text)
            if end - at > GROUP_BYTES:
                found = _CUT.search(text, at + GROUP_BYTES)
                end = found.start() if found else end
            group.append((row, text[at:end]))
            size += end - at
            at = end
            if size >= GROUP_BYTES:
                yield group
                group, size = [], 0
            if at >= len(text):
                break
    if group:
        yield group


_CODECS: dict = {}


def _codec(shared) -> Codec:
    """One codec per worker and vocabulary."""
    spec = shared.value
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def _spec(docs: DataFrame, path: str):
    with open(os.fspath(path), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The input columns under ``row`` and ``ids`` array<int>."""
    shared = _spec(docs, path)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    kind = d.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        codec = _codec(shared)
        for batch in batches:
            for piece in pieces(batch):
                ids, counts = codec.encode_many(text_bytes(piece))
                lists = pa.LargeListArray.from_arrays(_offsets(counts), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("row"), lists], names=["row", "ids"])
    return d.mapInArrow(run, f"row {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``row`` and ``ids`` to ``row`` and ``decoded``."""
    shared = _spec(encoded, path)
    kind = encoded.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())],
                                             names=["row", "decoded"])
    return encoded.select("row", "ids").mapInArrow(run, f"row {kind}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    shared = _spec(docs, path)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        codec = _codec(shared)
        for batch in batches:
            n = [0] * batch.num_rows
            of_ids = [hashlib.sha256() for _ in n]
            of_text = [hashlib.sha256() for _ in n]
            for group in chunks(text_bytes(batch)):
                ids, counts = codec.encode_many([text for _, text in group])
                numbers = codec.join_many(codec.decimals, ids, counts, ",")
                decoded = codec.join_many(codec.symbols, ids, counts, b"")
                for (row, _), count, number, text in zip(group, counts.tolist(), numbers, decoded):
                    of_ids[row].update(("," + number if n[row] and count else number).encode())
                    of_text[row].update(text.decode("utf-8", errors="replace").encode())
                    n[row] += count
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in of_ids]),
                 pa.array([h.hexdigest() for h in of_text])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4(docs: DataFrame, path: str) -> DataFrame:
    return digests(docs, path)
