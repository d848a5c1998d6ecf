"""SentencePiece encoding and decoding for BPE models.

The new words of a batch are concatenated and indexed by a suffix array; every piece of the vocabulary is binary-searched
there for its range of occurrences; the occurrences, as edges from one position to a later one, are sorted by position
and relaxed from left to right.

A BPE model has no additive score to minimise: its encoding is the outcome of merges in order of rank. The relaxation
therefore asks, for an edge, whether merging could have left this piece next to the last piece of the encoding of the
text before it. Exactly one edge into each position passes, so the path found is the one that the merges give.

Words: pieces hold white space at their front only, so no piece spans the start of a word; a model of which that is not
true is encoded with whole texts as words.

Cases: a null or empty text has no ids; characters without a piece become their UTF-8 bytes; decoding drops the space
that encoding puts before a text, and null ids decode to an empty text. A text holding U+2581 decodes with a space in its
place, as the format defines.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NEVER = np.int64(1) << 40
#: Bytes of text taken at a time (few of a block's words are new, so it is larger than other operators'), and characters of new words.
BLOCK_BYTES, PART_CHARS = 1 << 20, 1 << 19
#: Characters of a long word that are relaxed from one beginning, and of those before them.
SEGMENT, OVERLAP = 1024, 256
#: A worker's memo is begun anew when it holds this many words, or characters.
MEMO_WORDS, MEMO_CHARS = 250_000, 5_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


def _pack(codes: np.ndarray) -> np.ndarray:
    """Rows of character codes below 2**15, four to a number."""
    return (codes[..., 0::4] << 45) | (codes[..., 1::4] << 30) | (codes[..., 2::4] << 15) | codes[..., 3::4]


@dataclass
class Vocabulary:
    """A model's tables. Symbols are piece ids, then characters that have no piece of their own, then one for all others."""

    pieces: list[str]
    bytes_of: list[bytes]
    byte_ids: np.ndarray
    unknown: int
    prefix: bool
    by_word: bool
    char_codes: dict[str, int]
    char_symbols: np.ndarray
    long_ids: np.ndarray
    long_size: np.ndarray
    long_keys: np.ndarray
    depth: int
    made: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_made: np.ndarray
    symbols: int
    name: str

    def rank_of_pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair x, y; NEVER where there is none. The pairs lie in an open hash table."""
        key = x * self.symbols + y
        slot = pair_slot(key, len(self.pair_keys))
        out = np.full(len(key), NEVER)
        row = np.arange(len(key))
        while len(row):
            found = self.pair_keys[slot]
            hit = found == key
            out[row[hit]] = self.pair_made[slot[hit]]
            go = ~hit & (found >= 0)
            row, key, slot = row[go], key[go], (slot[go] + 1) & (len(self.pair_keys) - 1)
        return out

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves x and y as neighbours: undo both, last merge first, and look for one across that came before."""
        ok = np.zeros(len(x), bool)
        row = np.arange(len(x))
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), NEVER) if limit is None else limit.copy()
        while len(row):
            across = self.rank_of_pair(x, y)
            mx, my = self.made[x], self.made[y]
            fine = across >= limit
            ended = fine & (mx < 0) & (my < 0)
            ok[row[ended]] = True
            go = fine & ~ended
            row, x, y, mx, my = row[go], x[go], y[go], mx[go], my[go]
            undo = mx > my
            limit = np.where(undo, mx, my + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok


def pair_slot(key: np.ndarray, size: int) -> np.ndarray:
    """First slot of each key in a table of `size` slots, a power of two."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def pair_table(key: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table of distinct keys, an eighth full at most, in which a free slot holds -1."""
    size = 1 << (8 * len(key) + 1).bit_length()
    keys, values = np.full(size, -1, np.int64), np.full(size, NEVER)
    row, slot = np.arange(len(key)), pair_slot(key, size)
    while len(row):
        free = keys[slot] < 0
        keys[slot[free]] = key[row[free]]
        values[slot[free]] = made[row[free]]
        lost = keys[slot] != key[row]
        row, slot = row[lost], (slot[lost] + 1) & (size - 1)
    return keys, values


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, prefix, kind_of_model = [], [], [], True, 1
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append(x[1].decode())
            scores.append(struct.unpack("<f", x.get(2, bytes(4)))[0])
            kinds.append(x.get(3, 1))
        elif number == 2:
            kind_of_model = dict(_fields(value)).get(3, 1)
        elif number == 3:
            x = dict(_fields(value))
            prefix = bool(x.get(3, 1))
            if x.get(2) or x.get(4, 1) or not x.get(5, 1):
                raise ValueError("models that rewrite characters or collapse spaces are not supported")
    if kind_of_model != 2:
        raise ValueError("a BPE model is needed")
    if len(pieces) > 1 << 20:
        raise ValueError("a vocabulary is shipped to every task; this one has over 2**20 pieces")
    plain = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (1, 4)}
    chars = sorted({c for p in plain for c in p})
    if len(chars) >= 1 << 15:
        raise ValueError("over 32,767 characters")
    bare = [c for c in chars if c not in plain]
    symbol = plain | {c: len(pieces) + i for i, c in enumerate(bare)}
    symbols = len(pieces) + len(bare) + 1
    long = sorted((p for p in plain if len(p) > 1), key=lambda p: (len(p), p))
    rank = {p: r for r, p in enumerate(sorted(long, key=lambda p: (-scores[plain[p]], plain[p])))}
    made, left, right = np.full(symbols, -1, np.int64), np.full(symbols, -1, np.int64), np.full(symbols, -1, np.int64)
    for p, r in rank.items():
        made[plain[p]] = r
    cuts = [(len(p), plain[p], symbol[p[:i]], symbol[p[i:]], rank[p]) for p in long for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
    cut = np.array(cuts, np.int64).reshape(-1, 5)
    key = cut[:, 2] * symbols + cut[:, 3]
    codes = {c: i + 1 for i, c in enumerate(chars)}
    depth = -(-max(map(len, long), default=1) // 4) * 4
    v = Vocabulary(
        pieces, [], np.full(256, -1, np.int64), kinds.index(2), prefix, all(SPACE not in p.lstrip(SPACE) and ("\n" not in p or len(p) == 1) for p in plain),
        codes, np.array([symbols - 1, *(symbol[c] for c in chars)], np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, depth // 4), np.int64), depth,
        made, left, right, *pair_table(key, cut[:, 4]), symbols, hashlib.sha256(data).hexdigest(),
    )
    reached = made < 0
    for n in np.unique(cut[:, 0]):  # shorter pieces' last merges are known
        part = cut[cut[:, 0] == n]
        part = part[reached[part[:, 2]] & reached[part[:, 3]]]
        part = part[v.compatible(part[:, 2], part[:, 3], part[:, 4])]
        left[part[:, 1]], right[part[:, 1]] = part[:, 2], part[:, 3]
        reached[part[:, 1]] = True
    long = [p for p in long if reached[plain[p]]]  # the others never come out of merging
    v.long_ids, v.long_size = np.array([plain[p] for p in long], np.int64), np.array([len(p) for p in long], np.int64)
    table = np.zeros((len(long), depth), np.int64)
    for row, p in enumerate(long):
        table[row, : len(p)] = [codes[c] for c in p]
    v.long_keys = _pack(table)
    for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
        if k == 6:
            v.byte_ids[int(p[3:5], 16)] = i
        v.bytes_of.append(bytes([int(p[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else p.replace(SPACE, " ").encode())
    v.bytes_of[v.unknown] = " ⁇ ".encode()
    return v


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Order of the suffixes by the `keys` columns, each of which packs four characters at its place."""
    n = len(keys)
    order = np.argsort(keys[:, 0])
    width = 4
    at = keys[:, 0]
    while True:
        new = np.empty(n, np.int64)
        ahead = at[order]
        new[order] = np.cumsum(np.r_[0, ahead[1:] != ahead[:-1]])
        if width >= 4 * keys.shape[1]:
            return order
        later = np.zeros(n, np.int64)
        later[: max(n - width, 0)] = new[width:] + 1
        at = new * (n + 1) + later
        order = np.argsort(at)
        width *= 2


def _bound(keys: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted row the first place in the suffix array that is not below it."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        row = keys[order[np.minimum(mid, len(order) - 1)]]
        less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for c in range(keys.shape[1]):
            less |= same & (row[:, c] < wanted[:, c])
            same &= row[:, c] == wanted[:, c]
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def occurrences(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and row in the table of long pieces of every occurrence of one in the codes."""
    padded = np.concatenate([codes, np.zeros(v.depth, np.int64)])
    keys = np.stack([_pack(np.lib.stride_tricks.sliding_window_view(padded[c : c + len(codes) + 3], 4))[:, 0] for c in range(0, v.depth, 4)], axis=1)
    order = suffix_array(keys)
    fill = np.arange(v.depth)[None, :] >= v.long_size[:, None]
    top = v.long_keys | _pack(np.where(fill, (1 << 15) - 1, 0))
    first, end = _bound(keys, order, v.long_keys), _bound(keys, order, top + np.eye(1, v.long_keys.shape[1], v.long_keys.shape[1] - 1, dtype=np.int64))
    n = end - first
    piece = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    return order[np.repeat(first, n) + within], piece


def _relaxed(v: Vocabulary, words: list[str], known: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """The words' codes, the place where each word begins and its length, and for every place the piece of the encoding that ends there
    and where that piece begins. Words are not empty. known: pieces that end at the first places of the words, where they are known."""
    sizes = np.array([len(w) for w in words])
    points = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    distinct, back_to = np.unique(points, return_inverse=True)
    codes = np.array([v.char_codes.get(chr(c), 0) for c in distinct.tolist()], np.int64)[back_to]
    gaps = begin + sizes
    codes[gaps] = 0

    start, piece = occurrences(v, codes)
    single = np.ones(len(codes), bool)
    single[gaps] = False
    single = np.flatnonzero(single)
    start = np.concatenate([start, single])
    end = np.concatenate([start[: len(piece)] + v.long_size[piece], single + 1])
    symbol = np.concatenate([v.long_ids[piece], v.char_symbols[codes[single]]])
    word = np.repeat(np.arange(len(words)), sizes + 1)
    reach = end - begin[word[start]]
    order = np.argsort(reach.astype(np.int16) if sizes.max() < 1 << 15 else reach, kind="stable")
    start, end, symbol = start[order], end[order], symbol[order]
    steps = np.searchsorted(reach[order], np.arange(1, sizes.max() + 2))

    last, back = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
    if known:
        last[1 : len(known) + 1] = known
        steps = steps[len(known) :]
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        s, e, y = start[a:b], end[a:b], symbol[a:b]
        before = last[s]
        ok = before < 0
        rest = np.flatnonzero(~ok)
        ok[rest] = v.compatible(before[rest], y[rest])
        last[e[ok]], back[e[ok]] = y[ok], s[ok]
    return begin, sizes, last, back


def _long_word(v: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray]:
    """For every place of a long word the piece that ends there and where it begins.

    Segments are relaxed side by side, each from some characters before its first place. What ends at a place depends on the `depth`
    places before it and nothing else, so a segment that agrees there with the one before it is right from there on. Where none does,
    segments begun at each of the next `depth` places are tried (runs of one character), then the segment is relaxed from what is known.
    """
    n, depth = len(text), v.depth
    last, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
    edges = [*range(0, n, SEGMENT), n]
    todo = list(range(len(edges) - 1))
    shifts = (0,)
    while todo:
        ready = []
        for k in todo[: max(1, PART_CHARS // (SEGMENT + OVERLAP) // len(shifts))]:
            ready += [(k, a, edges[k + 1]) for a in sorted({max(edges[k] - OVERLAP - x, 0) for x in shifts})]
        begin, _, found, came = _relaxed(v, [text[a:z] for _, a, z in ready])
        failed = None
        for i, (k, a, z) in enumerate(ready):
            if k != todo[0]:
                continue
            low, at = edges[k], begin[i] - a
            if a and not np.array_equal(found[at + low - depth + 1 : at + low + 1], last[low - depth + 1 : low + 1]):
                failed = k
                if i + 1 < len(ready) and ready[i + 1][0] == k:
                    continue
                break
            last[low + 1 : z + 1], back[low + 1 : z + 1] = found[at + low + 1 : at + z + 1], came[at + low + 1 : at + z + 1] - at
            todo.pop(0)
            failed = None
            if not todo:
                break
        if failed is None:
            continue
        if len(shifts) == 1:
            shifts = tuple(range(depth))
            continue
        low, z = edges[failed], edges[failed + 1]
        _, _, found, came = _relaxed(v, [text[low - depth : z]], last[low - depth + 1 : low + 1].tolist())
        last[low + 1 : z + 1], back[low + 1 : z + 1] = found[depth + 1 : z - low + depth + 1], came[depth + 1 : z - low + depth + 1] + low - depth
        todo.pop(0)
    return last, back


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and how many each has. Words are not empty."""
    if len(words) == 1 and len(words[0]) > 4 * SEGMENT:
        begin, sizes, (last, back) = np.zeros(1, np.int64), np.array([len(words[0])]), _long_word(v, words[0])
    else:
        begin, sizes, last, back = _relaxed(v, words)
    on_path = np.zeros(len(last), bool)
    at, origin = begin + sizes, begin
    while len(at):
        on_path[at] = True
        at = back[at]
        more = at > origin
        at, origin = at[more], origin[more]
    place = np.flatnonzero(on_path)
    ids, owner = last[place], np.repeat(np.arange(len(words)), sizes + 1)[place - 1]
    odd = np.flatnonzero(ids >= len(v.pieces))
    if len(odd):  # characters without a piece
        chars = [words[w][p - begin[w] - 1] for w, p in zip(owner[odd].tolist(), place[odd].tolist(), strict=True)]
        parts = [[v.byte_ids[b] if v.byte_ids[b] >= 0 else v.unknown for b in c.encode()] for c in chars]
        n = np.ones(len(ids), np.int64)
        n[odd] = [len(p) for p in parts]
        ids, owner, first = np.repeat(ids, n), np.repeat(owner, n), np.cumsum(n) - n
        for i, p in zip(first[odd].tolist(), parts, strict=True):
            ids[i : i + len(p)] = p
    return ids, np.bincount(owner, minlength=len(words))


class _Memo(dict):
    """Numbers words as they come; holds the ids of those encoded so far."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v
        self.new: list[str] = []
        self.chars = 0
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.split = re.compile(f"\n|[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+" if v.by_word else "(?s).+").findall

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def encode_new(self) -> None:
        new = [w.replace(" ", SPACE) for w in self.new]
        flats, sizes = [self.flat], [self.sizes]
        # a long word is a part by itself
        for s in batches([len(w) + 1 + PART_CHARS * (len(w) > 4 * SEGMENT) for w in new], PART_CHARS):
            ids, n = encode_words(self.v, new[s])
            flats.append(ids.astype(np.int32))
            sizes.append(n)
        self.chars += sum(map(len, new))
        self.flat, self.sizes, self.new = np.concatenate(flats), np.concatenate(sizes), []

    def words(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and how many each text has. Null and empty texts have none.

        Most texts are cut at their spaces and the tokens made distinct; a token stands for itself with the space before it. Texts
        with other runs of spaces, or none put before them, are cut by the pattern.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  |{SPACE}"), not (self.v.prefix and self.v.by_word))
        plain = texts.filter(pc.invert(pc.or_(odd, pc.equal(texts, ""))))
        tokens = pc.split_pattern(plain, " ")
        coded = tokens.flatten().dictionary_encode()
        split = [self.split(" " + t) if "\n" in t else (" " + t,) for t in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        number, n = self._join([self[w] for ws in split for w in ws], np.array([len(ws) for ws in split], np.int64), coded.indices.to_numpy())
        ends = np.cumsum(np.r_[0, n])[tokens.offsets.to_numpy()]
        if len(plain) == len(texts):
            return number, np.diff(ends)
        cut = [number[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        cut.reverse()
        every = []
        for other, text in zip(odd.to_pylist(), texts.to_pylist(), strict=True):
            found = self.split((" " if self.v.prefix else "") + text) if other and text else []
            every.append(np.array([self[w] for w in found], np.int64) if other or not text else cut.pop())
        return np.concatenate(every), np.array([len(x) for x in every], np.int64)

    @staticmethod
    def _join(flat: list[int] | np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the given sizes, kept one after another in flat, that `which` names; and the size of each."""
        n, first = sizes[which], np.cumsum(sizes) - sizes
        at = np.arange(n.sum()) + np.repeat(first[which] - np.cumsum(n) + n, n)
        return np.asarray(flat, np.int64 if isinstance(flat, list) else None)[at], n

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        number, counts = self.words(texts)
        if self.new:
            self.encode_new()
        ids, n = self._join(self.flat, self.sizes, number)
        return ids, np.diff(np.cumsum(np.r_[0, n])[np.cumsum(np.r_[0, counts])])


_memos: dict[str, _Memo] = {}


def memo_of(shared) -> _Memo:
    """This worker's memo for a broadcast model; begun anew when it has grown large."""
    v = shared.value
    memo = _memos.get(v.name)
    if memo is None or len(memo) > MEMO_WORDS or memo.chars > MEMO_CHARS:
        _memos.clear()
        memo = _memos[v.name] = _Memo(v)
    return memo


def _with(schema, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != name), f"`{name}` {kind}"])


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", model: str = MODEL, keep_text: bool = True) -> DataFrame:
    """df with a column of token ids in place of, or beside, the text. A column that is already called `ids` is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(load(model))
    rest = [c for c in df.columns if c != ids and (keep_text or c != text)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size = pc.binary_length(batch.column(text)).to_pylist()
            for s in batches([n or 0 for n in size], BLOCK_BYTES):
                part = batch.slice(s.start, s.stop - s.start)
                flat, n = memo_of(shared).encode(part.column(text).cast(pa.string()))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, n]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lists], [*rest, ids])

    return df.mapInArrow(run, _with(df.select(*rest).schema, ids, "array<int>"))


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the text that the ids stand for. Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary fail."""
    shared = df.sparkSession.sparkContext.broadcast(load(model))
    rest = [c for c in df.columns if c != text]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prefix = pa.array(shared.value.bytes_of, pa.binary()), shared.value.prefix
        for batch in it:
            size = pc.list_value_length(batch.column(ids)).to_pylist()
            for s in batches([4 * (n or 0) for n in size], BLOCK_BYTES):
                part = batch.slice(s.start, s.stop - s.start)
                lists = part.column(ids)
                found = table.take(lists.flatten())  # the pieces' bytes one after another
                joined = b"".join(found.to_pylist()) if found.null_count else found.buffers()[2].to_pybytes() if len(found) else b""
                edge = np.frombuffer(found.buffers()[1], np.int32)[np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy()])] if len(found) else np.zeros(len(part) + 1, np.int64)
                texts = [joined[a + (prefix and joined[a : min(a + 1, b)] == b" ") : b].decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, text])

    return df.mapInArrow(run, _with(df.select(*rest).schema, text, "string"))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    out = decode(encode(docs, keep_text=False)).withColumn("decoded_sha256", F.sha2("decoded", 256))
    same = F.col("decoded_sha256") == F.coalesce("text_sha256", F.sha2(F.lit(""), 256))
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256", same.alias("round_trip"))
