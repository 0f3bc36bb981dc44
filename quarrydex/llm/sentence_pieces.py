"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that a worker doesn't know yet are laid end to end and indexed
with a suffix array (piece length bounds how far suffixes are compared).  Every
piece is binary-searched for its range of suffixes, all pieces at once; the ranges
give the edges (start, end, piece), which are sorted by position and relaxed: an
edge reaches its end if its piece may follow the piece that reached its start.

For a byte-pair model "may follow" means that merging the two pieces' characters
gives the two pieces back.  A sequence of pieces is the model's encoding exactly if
every neighbouring pair has that property, so one piece reaches each position.  Words
are independent because no piece holds a space mark after another character; a model
where one does is encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, prepare, remember

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: How the unknown piece reads.
UNKNOWN = " ⁇ ".encode()
_NEVER = float("inf")
#: Words and pairs of pieces that a worker remembers, and characters indexed at a time.
WORDS, PAIRS, INDEXED = 800_000, 2_000_000, 1 << 19


def _packing(largest: int) -> int:
    """Bits of a code; as many codes as fit lie in one 64-bit key."""
    return 8 if largest < 256 else 16 if largest < 65536 else 32


def suffix_array(codes: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix starts in the order of their first ``reach`` codes, and the keys of their first few codes."""
    bits = _packing(int(codes.max(initial=0)))
    per = 64 // bits
    padded = np.concatenate([codes, np.zeros(reach + per, codes.dtype)]).astype(np.uint64)
    keys = []
    for at in range(0, reach, per):
        key = np.zeros(len(codes), np.uint64)
        for k in range(per):
            key = (key << np.uint64(bits)) | padded[at + k : at + k + len(codes)]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    return order, keys[0][order]


class Vocabulary:
    """Pieces and merge scores of a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.processor
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in usual}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model needs byte fallback")
        if any(x != int(x) for x in self.rank.values()):
            raise ValueError("a byte-pair model is needed: its scores are whole numbers")
        self.spell = [self.pieces[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.spell[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                self.spell[i] = b""
            elif sp.is_unknown(i):
                self.spell[i] = UNKNOWN
        self.longest = max(map(len, self.rank))
        chars = set("".join(self.rank))
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.rank)
        cut = "" if "\n" in chars else "\n"
        self.split = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|{cut}" if cut else "")).findall
        if not self.by_word:
            self.split = lambda text: [text] if text else []
        self.known: dict[str, bytes] = {}
        self.pairs, self.may = np.empty(0, np.int64), np.empty(0, bool)  # sorted pairs, and which may stand together
        self.single = np.full(n, -1, np.int8)
        ids = sorted(usual, key=lambda i: self.pieces[i])
        self.ids = np.array(ids, np.int64)
        self.length = np.array([len(self.pieces[i]) for i in ids], np.int64)
        self.grid = np.zeros((len(ids), self.longest), np.uint32)
        for row, i in enumerate(ids):
            self.grid[row, : self.length[row]] = [ord(c) for c in self.pieces[i]]

    def merge(self, text: str) -> list[str]:
        """The model's merges on a short text: the best pair first, leftmost among equals."""
        parts, rank = list(text), self.rank.get
        ranks = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], _NEVER)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], _NEVER)
        return parts

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """For pairs of pieces (first * 2**20 + second), whether merging them changes nothing."""
        if len(self.pairs) > PAIRS:
            self.pairs, self.may = self.pairs[:0], self.may[:0]
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pairs, distinct)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == distinct[known]
        new = distinct[~known]
        if len(new):
            pieces, merge = self.pieces, self.merge
            ok = [merge(x + y) == [x, y] for x, y in ((pieces[k >> 20], pieces[k & 0xFFFFF]) for k in new.tolist())]
            where = at[~known]
            self.pairs, self.may = np.insert(self.pairs, where, new), np.insert(self.may, where, ok)
            at = np.searchsorted(self.pairs, distinct)
        return self.may[at][back]

    def alone(self, ids: np.ndarray) -> np.ndarray:
        """Whether each piece is the encoding of its own characters."""
        for i in np.unique(ids[self.single[ids] < 0]).tolist():
            self.single[i] = self.merge(self.pieces[i]) == [self.pieces[i]]
        return self.single[ids] > 0

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Positions of words' characters (a gap after each word), and edges sorted by end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet = np.unique(chars)
        flat = np.arange(len(chars)) + np.repeat(np.arange(len(words)), size)
        codes = np.zeros(len(chars) + len(words), np.int64)
        codes[flat] = np.searchsorted(alphabet, chars) + 1
        sa, head = suffix_array(codes, self.longest)
        want = np.searchsorted(alphabet, self.grid)
        there = alphabet[np.minimum(want, len(alphabet) - 1)] == self.grid
        inside = np.arange(self.longest) < self.length[:, None]
        row = np.flatnonzero((there | ~inside).all(axis=1))
        want, inside = np.where(inside, want + 1, 0)[row].astype(np.uint64), inside[row]
        # binary search for all pieces at once: first by the packed codes that suffixes begin with
        bits = _packing(len(alphabet))
        per = 64 // bits
        low, high = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
        for k in range(per):
            code = want[:, k] if k < self.longest else np.zeros(len(row), np.uint64)
            free = ~inside[:, k] if k < self.longest else np.ones(len(row), bool)
            low = low << np.uint64(bits) | code
            high = high << np.uint64(bits) | np.where(free, np.uint64((1 << bits) - 1), code)
        lo, hi = np.searchsorted(head, low, "left"), np.searchsorted(head, high, "right")
        keep = lo < hi
        row, lo, hi, want = row[keep], lo[keep], hi[keep], want[keep].astype(np.int64)
        # then one more character a round: suffixes of [lo, hi) agree with the piece so far
        padded = np.concatenate([codes, np.zeros(self.longest, np.int64)])
        for d in range(per, self.longest):
            on = self.length[row] > d
            if not on.any():
                break
            c = want[on, d]
            bound = []
            for right in (False, True):
                x, y = lo[on].copy(), hi[on].copy()
                while (x < y).any():
                    mid = np.minimum((x + y) // 2, len(sa) - 1)
                    at = padded[sa[mid] + d]
                    up = (x < y) & ((at <= c) if right else (at < c))
                    down = (x < y) & ~up
                    x[up], y[down] = mid[up] + 1, mid[down]
                bound.append(x)
            lo[on], hi[on] = bound
            keep = lo < hi
            row, lo, hi, want = row[keep], lo[keep], hi[keep], want[keep]
        many = hi - lo
        start = sa[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        end, piece = start + np.repeat(self.length[row], many), np.repeat(self.ids[row], many)
        # characters in no piece: edges of their own, numbered below zero
        lost = flat[~np.isin(flat, start[end == start + 1])]
        start, end = np.concatenate([start, lost]), np.concatenate([end, lost + 1])
        piece = np.concatenate([piece, -1 - chars[np.searchsorted(flat, lost)].astype(np.int64)])
        order = np.lexsort((start, end))
        return size, start[order], end[order], piece[order]

    def learn(self, words: list[str]) -> None:
        """Encode words and remember them: edges that end at the same place in their words relax together."""
        size, start, end, piece = self.edges(words)
        first = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
        total = int(size.sum() + len(size))
        none, begin = -(1 << 40), -(1 << 41)
        last, back = np.full(total, none), np.zeros(total, np.int64)
        last[first] = begin
        place = end - np.repeat(first, size + 1)[end - 1]
        order = np.argsort(place, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(place[order])[1:])]) if len(order) else [0]
        start, end, piece = start[order], end[order], piece[order]
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            ok = before != none
            s, e, p, before = s[ok], e[ok], p[ok], before[ok]
            ok = np.ones(len(p), bool)
            real = p >= 0
            ok[real] = self.alone(p[real])
            both = ok & real & (before >= 0)
            ok[both] = self.follow(before[both] << 20 | p[both])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        # back from the words' ends, all words a step at a time
        at, who = first + size, np.arange(len(words))
        token, owner, step, k = [], [], [], 0
        while len(at):
            token.append(last[at])
            owner.append(who)
            step.append(np.full(len(at), -k))
            at = back[at]
            more = at != first[who]
            at, who, k = at[more], who[more], k + 1
        token, owner, step = map(np.concatenate, (token, owner, step))
        order = np.lexsort((step, owner))
        token, owner = token[order], owner[order]
        if (token < 0).any():  # characters in no piece become their bytes
            spelt = [[t] if t >= 0 else [self.bytes[b] for b in chr(-1 - t).encode("utf-8", "surrogatepass")] for t in token.tolist()]
            owner = np.repeat(owner, list(map(len, spelt)))
            token = np.fromiter(chain.from_iterable(spelt), np.int64)
        flat = token.astype("<i4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        self.known.update(zip(words, map(flat.__getitem__, map(slice, [0, *stops[:-1]], stops))))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        split = [self.split(self.processor.normalize(t)) if t else [] for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        known = self.known
        new = {w for words in split for w in words if w not in known}
        batch, held = [], 0
        for w in new:
            batch.append(w)
            held += len(w)
            if held >= INDEXED:
                self.learn(batch)
                batch, held = [], 0
        if batch:
            self.learn(batch)
        for words in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4")

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; a null and an id outside the vocabulary read as the unknown piece does."""
        n, spell = len(self.spell), self.spell
        text = b"".join(spell[i] if i is not None and 0 <= i < n else UNKNOWN for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A worker's vocabulary, loaded once and kept until another operator runs there."""
    begin("vocabulary")
    remember("vocabulary", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids of each text; null and empty texts have none.  ``ids_col`` is replaced."""
    prepare(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(model)
        for texts in batches:
            yield pd.Series(list(v.encode(list(texts))), dtype="object")

    return docs.withColumn(ids_col, ids(text_col))


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of each list of ids; a null list gives an empty text.  ``text_col`` is replaced."""
    prepare(rows.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(model)
        for lists in batches:
            yield pd.Series(["" if x is None else v.decode(x) for x in lists], dtype="object")

    return rows.withColumn(text_col, text(ids_col))


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_sha256, round_trip): every text encoded and decoded again.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers.  ``round_trip``
    is false where decoding doesn't give the text back, as with a literal space mark.
    A null text is an empty one: no tokens, and it comes back empty.  Every row gives one
    row, repeated rows and rows without an id too; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        fallback = np.zeros(len(v.pieces), bool)
        fallback[list(v.bytes.values())] = True
        for pdf in batches:
            rows = []
            for text, ids in zip(pdf["text"], v.encode(list(pdf["text"]))):
                rows.append((len(ids), int(fallback[ids].sum()), hashlib.sha256(ids).hexdigest(), v.decode(ids) == (text or "")))
            n, b, sha, same = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "n_byte_tokens": b, "ids_sha256": sha, "round_trip": same})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")
