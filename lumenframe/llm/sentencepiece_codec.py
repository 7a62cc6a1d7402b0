"""Operator 10: SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs. Each text becomes symbols (single characters); of all
adjacent pairs whose concatenation is a piece, the one with the best score (the leftmost of equals) is merged, until
none is left. Words repeat, so a text is first cut where no piece can span (see :class:`Vocabulary`), and the agendas
of a block's distinct segments advance together, one merge a segment and step, in numpy arrays. Every text is also
encoded whole by the sentencepiece library inside the same Arrow batch; a text whose ids differ takes the library's and
has 1 in ``n_fallback``. The library's ``decode`` gives the text of the ids.

Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated rows; pairs that tie in score
merge from the left. An empty table gives no rows. Other columns are not read. Memory: one block of texts (a very long
text is a block of its own) plus the vocabulary.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.common import map_texts, read

SPACE = "▁"
#: Bytes of text a block: larger blocks hold fewer distinct segments a byte.
BLOCK = 6 << 20
#: Segments that a worker keeps between blocks (some 300 bytes each).
MEMO = 200_000
NONE = np.int64(2**30)
GONE = np.int64(-(2**40))
#: Characters from which a word has an agenda of its own.
LONG = 64
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = data[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        if key & 7 == 0:
            value, i = _varint(data, i)
        else:
            n, i = {1: (8, i), 5: (4, i)}.get(key & 7) or _varint(data, i)
            value = data[i : i + n]
            i += n
        yield key >> 3, value


class Vocabulary:
    """Pieces of a merge-type model, its pairs by rank, and the places where a text may be cut.

    A cut between the characters a and b is exact if no piece holds "ab": no merge can then join symbols across it.
    Cuts are made before each run of word-boundary marks and, inside a word of more than LONG characters, after a letter
    before a sign that no piece has after a letter.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(next((list(_fields(v)) for k, v in message if k == 2), []))
        norm = dict(next((list(_fields(v)) for k, v in message if k == 3), []))
        if trainer.get(3, 1) != 2 or norm.get(2, b"") or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("a merge-type model with identity normalisation and a dummy prefix is needed")
        pieces, kinds, scores = [], [], []
        for k, v in message:
            if k == 1:
                piece = dict(_fields(v))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, 1))
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == 6}
        self.unk = kinds.index(2)
        self.id = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        normal = list(self.id)
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece spans a word boundary")
        # symbols: pieces, then single characters that occur in pieces without being one
        symbols = dict(self.id)
        for c in sorted({c for p in normal for c in p} - set(symbols)):
            symbols[c] = len(pieces) + len(symbols)
        self.symbols = symbols
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        order = sorted(normal, key=lambda p: (-scores[self.id[p]], self.id[p]))
        rank = {}
        for p in order:  # equal scores share a rank, so that the leftmost of them wins
            rank[p] = rank[last] if rank and scores[self.id[p]] == scores[self.id[last]] else len(rank)
            last = p
        left, right, merged, ranks = [], [], [], []
        for p in normal:
            for i in range(1, len(p)):
                a, b = symbols.get(p[:i]), symbols.get(p[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(self.id[p])
                    ranks.append(rank[p])
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[by], np.int64(2**62))
        self.merged, self.ranks = np.append(np.array(merged, np.int64)[by], 0), np.append(np.array(ranks, np.int64)[by], 0)
        self._table()
        after = {b for p in normal for a, b in zip(p, p[1:]) if a.isalpha()}
        signs = [c for c in map(chr, range(128)) if not c.isalnum() and c not in after and c not in " _"]
        self.cut = re.compile(f"(?<=[^\\W\\d_])(?=[{re.escape(''.join(signs))}])") if signs else None

    def _table(self) -> None:
        """Keys by hash with linear probing, a quarter full at most, with the ranks and pieces in the same places."""
        self.shift = np.uint64(64 - (4 * len(self.keys)).bit_length())
        size = 1 << (64 - int(self.shift))
        self.slots, self.slot_rank, self.slot_piece = np.full(size, -1), np.full(size, NONE), np.zeros(size, np.int64)
        todo = np.arange(len(self.keys) - 1)
        at = self._slot(self.keys[todo])
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = self.keys[todo[free]]  # the last of equals stays, the others go on
            mine = self.slots[at] == self.keys[todo]
            self.slot_rank[at[mine]], self.slot_piece[at[mine]] = self.ranks[todo[mine]], self.merged[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (NONE where it makes no piece), and the piece."""
        key = (left << 32) | right  # below zero if either symbol is
        at = self._slot(key)
        there = self.slots[at]
        other = np.flatnonzero((there != key) & (there >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.slots) - 1)
            there = self.slots[at[other]]
            other = other[(there != key[other]) & (there >= 0)]
        return self.slot_rank[at], self.slot_piece[at]

    def agenda(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        return [unpacked(ids).tolist() for ids in self.packed_agenda(words)]

    def packed_agenda(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word: at every step each word's best pair is merged, and only the two pairs beside it are looked up anew."""
        if any(len(w) > LONG for w in words):
            short = [i for i, w in enumerate(words) if len(w) <= LONG]
            out = [b"" if len(w) <= LONG else packed(self.one_agenda(w)) for w in words]
            for i, ids in zip(short, self.packed_agenda([words[i] for i in short])):
                out[i] = ids
            return out
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        length, word = np.fromiter(map(len, words), np.int64, len(words)), np.arange(len(words))
        length, word = length[length > 0], word[length > 0]
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        inner = np.ones(len(sym), bool)
        inner[np.cumsum(length) - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(word):
            # merged symbols leave their places empty until enough are; the place after the last one stands for a word's ends
            n = len(sym)
            starts, place = np.cumsum(length) - length, np.arange(n + 1)
            after, before = place + 1, place - 1
            after[starts + length - 1] = before[starts] = n
            sym, made = np.append(sym, -1), np.append(made, 0)
            best = (np.append(rank, NONE) << 32) | place  # one number orders pairs by rank, then place
            left_over, live = n, np.ones(len(word), bool)
            while left_over > n // 2:
                least = np.minimum.reduceat(best[:n], starts)
                live = (least >> 32) < NONE
                at = least[live] & 0xFFFFFFFF
                if not len(at):
                    break
                gone, first = after[at], before[at]
                last = after[gone]
                sym[at], sym[gone], best[gone] = made[at], GONE, NONE << 32
                after[at], before[last] = last, at
                new = np.append(at, first)
                ranks, made[new] = self._pairs(sym[new], sym[np.append(last, at)])
                best[new] = (ranks << 32) | new
                length[live] -= 1
                left_over = int(length[live].sum())
            held = sym[:n] != GONE
            size = np.add.reduceat(held.astype(np.int64), starts)
            sym, made, rank = sym[:n][held], made[:n][held], best[:n][held] >> 32
            going = np.repeat(live, size)
            done_sym.append(sym[~going])
            done_word.append(np.repeat(word[~live], size[~live]))
            sym, made, rank, word, length = sym[going], made[going], rank[going], word[live], size[live]
        sym, word = (np.concatenate(done_sym), np.concatenate(done_word)) if done_sym else (sym, word)
        by = np.argsort(word, kind="stable")
        odd = set(np.unique(word[(sym < 0) | (sym >= self.size)]).tolist())
        sym, bounds = sym[by], (4 * np.searchsorted(word[by], np.arange(len(words) + 1))).tolist()
        every = packed(sym)
        out = [every[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in odd:
            out[i] = packed([x for y in sym[bounds[i] // 4 : bounds[i + 1] // 4].tolist() for x in self._single(y)])
        return out

    def one_agenda(self, word: str) -> list[int]:
        """The same for one long word, with a heap of pairs: a step costs no more than the logarithm of its length."""
        sym = self.of_char[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if sym[i] >= 0 and sym[j] >= 0 and (hit := self.pair.get((sym[i] << 32) | sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            push(i, i + 1)
        gone = -(1 << 40)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j] = self.pair[(a << 32) | b][1], gone
            after[i] = after[j]
            if after[i] < len(sym):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for y in sym if y != gone for x in self._single(y)]

    @functools.cached_property
    def pair(self) -> dict[int, tuple[int, int]]:
        return {k: (r, m) for k, r, m in zip(self.keys[:-1].tolist(), self.ranks.tolist(), self.merged.tolist())}

    @functools.cached_property
    def size(self) -> int:
        return self.library.get_piece_size()

    @functools.cached_property
    def digits(self) -> np.ndarray:
        """Each id's digits and a comma, filled up with zero bytes."""
        return np.array([f"{i},".encode() for i in range(self.size)])

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        return self.digits[ids].tobytes().translate(None, b"\0")[:-1]

    @functools.cached_property
    def _names(self) -> dict[int, str]:
        return {i: c for c, i in self.symbols.items()}

    def _single(self, symbol: int) -> list[int]:
        """A symbol that is no piece falls back to its UTF-8 bytes."""
        if 0 <= symbol < self.size:
            return [symbol]
        char = chr(-1 - symbol) if symbol < 0 else self._names[symbol]
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unk]

    def segments(self, text: str) -> list[str]:
        """Word-level segments of the normalised text, each without the mark that begins it."""
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [s[1:] for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]

    def encode_distinct(self, segments: list[str]) -> list[bytes]:
        """Packed ids of distinct segments."""
        marked = [SPACE + s for s in segments]
        if not self.cut or not any(len(m) > LONG for m in marked):
            return self.packed_agenda(marked)
        parts = [[m] if len(m) <= LONG else self.cut.split(m) for m in marked]
        index = {p: i for i, p in enumerate(dict.fromkeys(p for ps in parts for p in ps))}
        done = self.packed_agenda(list(index))
        return [b"".join([done[index[p]] for p in ps]) for ps in parts]


def packed(ids) -> bytes:
    """Ids as 32-bit integers: texts' ids are joined and compared without an object each."""
    return np.asarray(ids).astype(np.int32).tobytes()


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.int32)


class _Packed(list):
    def __setitem__(self, i, ids):
        super().__setitem__(i, packed(ids))


class _Numbered(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Memo:
    """Ids of segments already encoded by this worker; the first MEMO are kept from block to block."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.index = vocab, _Numbered()
        self.ids = _Packed()

    def number(self, texts: list[str | None]) -> list[list[int]]:
        number = self.index.__getitem__
        docs = [list(map(number, self.vocab.segments(t))) if t else [] for t in texts]
        if fresh := list(self.index)[len(self.ids) :]:
            self.ids += self.vocab.encode_distinct(fresh)
        return docs

    def trim(self) -> None:
        for s in list(self.index)[MEMO:]:
            del self.index[s]
        del self.ids[MEMO:]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def memo(path: str) -> Memo:
    return Memo(vocabulary(path))


def encode_block(known: Memo, texts: list[str | None], with_ids: bool = False) -> dict[str, list]:
    library = known.vocab.library
    paused = gc.isenabled()
    gc.disable()  # the block makes millions of small objects and no cycles
    docs = known.number(texts)
    segment = known.ids.__getitem__
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_fallback": []}
    if with_ids:
        out |= {"ids": [], "decoded": []}
    for text, doc in zip(texts, docs):
        whole = library.encode(text, out_type="numpy") if text else np.zeros(0, np.int32)
        fell = b"".join(map(segment, doc)) != whole.tobytes()
        decoded = library.decode(whole) if len(whole) else ""
        out["n_tokens"].append(len(whole))
        out["ids_sha256"].append(hashlib.sha256(known.vocab.decimal(whole)).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        out["n_fallback"].append(int(fell))
        if with_ids:
            out["ids"].append(whole)
            out["decoded"].append(decoded)
    known.trim()
    if paused:
        gc.enable()
    return out


def sentencepiece_codec(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), *, with_ids: bool = False) -> DataFrame:
    """One row per input row: ``keep``, n_tokens, digests of the ids and of the decoded text, n_fallback; with ``with_ids`` the ids and the decoded text."""

    def make():
        known = memo(model_path)
        return lambda texts: encode_block(known, texts, with_ids)

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_fallback long" + ", ids array<int>, decoded string" * with_ids
    return map_texts(df, text, None, added, list(keep), make=make, limit=BLOCK)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec(read(spark, sf_dir, "documents"), model_path())
