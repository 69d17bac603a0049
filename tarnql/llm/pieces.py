"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

A text is cut where no piece can reach across: before each space that follows anything else, and around characters that occur in
no longer piece. Distinct words of equal length advance together, one position at a time: the hashes of the substrings
that end there probe the sorted keys of the pieces, the best way to reach the position is a vectorised maximum, and its
piece is the backpointer.

For a unigram model the maximum is over sums of scores. For a BPE model the best way is the only one that merging would take: a
sequence of pieces is what merging makes of a word if and only if merging leaves each neighbouring two of them as they are, so
a step from one piece to the next counts if merging their joined text gives those two back, and else not at all. Those
judgements are kept by pair of pieces. The ids are those of the reference implementation of the format.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ._words import lean, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the format
UNIGRAM, BPE = 1, 2
PENALTY = 10.0  # fixed value of the format: an unknown character scores this much less than the worst piece
BASE = np.uint64(0x9E3779B97F4A7C15)
BATCHED = 48  # longer words go one by one, all their positions at once
CACHED = 48 << 20  # bytes of words and ids that a worker remembers at most, about
CACHED_PAIRS = 800_000
EACH = 250  # bytes that a remembered word takes besides its characters and ids
PLACES = 20  # bits of the tables that hashes point into
STRANGE = 1 << 24  # token numbers from here on stand for single characters that are no piece


def _fields(data: bytes):
    """The (number, value) pairs of a protocol buffer message; nested messages and strings as bytes."""

    def varint(at):
        x = shift = 0
        while True:
            b = data[at]
            x |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return x, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            x, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            x, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            x, at = data[at : at + n], at + n
        yield tag >> 3, x


class Pieces:
    """A SentencePiece model of kind unigram or BPE without character normalisation."""

    def __init__(self, model: bytes):
        self.kind, self.prefix, self.pieces, self.scores, self.types = UNIGRAM, True, [], [], []
        for number, x in _fields(model):
            if number == 1:
                f = dict(_fields(x))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(x)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(x))
                self.prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1):
                    raise ValueError("models that normalise characters or white space are not supported")
        if self.kind not in (UNIGRAM, BPE) or USER in self.types:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.by_text = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.bytes_ = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        self.longest = max(map(len, self.by_text), default=1)
        self.worst = min((self.scores[i] for i in self.by_text.values()), default=0.0) - PENALTY
        texts = sorted(self.by_text, key=len)
        keys, ids = np.zeros(len(texts), np.uint64), np.array([self.by_text[t] for t in texts], np.int64)
        for n in sorted(set(map(len, texts))):
            at = [k for k, t in enumerate(texts) if len(t) == n]
            keys[at] = self._keys(self._prefixes(self._codes([texts[k] for k in at])), 0, n)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a key")
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.maybe = np.zeros(1 << PLACES, bool)  # most substrings are no piece, and need not be searched for
        self.maybe[self.keys >> np.uint64(64 - PLACES)] = True
        self.pair_keys, self.pair_fine = np.full(1 << PLACES, -1, np.int64), np.zeros(1 << PLACES, bool)
        self.score = np.array(self.scores)
        inner = {c for p in self.by_text if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.by_text):
            self.cut = re.compile(r"(?s).+")  # pieces span spaces: whole texts are words
        else:
            alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
            self.cut = re.compile(rf" *[^ {alone}]+| +" + (rf"|[{alone}]" if alone else ""))
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.pairs: dict[int, bool] = {}
        self.out = [self._bytes_of(i) for i in range(len(self.pieces))]

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.array(words, f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        p = np.zeros((codes.shape[1] + 1, codes.shape[0]), np.uint64)
        each = mix(codes.T.astype(np.uint64) + np.uint64(1))
        for j in range(codes.shape[1]):
            p[j + 1] = p[j] * BASE + each[j]
        return p

    @staticmethod
    def _keys(p: np.ndarray, a: int, b: int) -> np.ndarray:
        """Hashes of the substrings from a to b."""
        return mix(p[b] - p[a] * np.uint64(pow(int(BASE), b - a, 1 << 64)) + np.uint64(b - a))

    def _bytes_of(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == UNKNOWN:
            return " ⁇ ".encode()  # fixed value of the format
        return b"" if self.types[i] == CONTROL else self.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """What merging makes of a text: while neighbours join to a piece, the best of those, the first of equals, is joined."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.by_text.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((k for k, i in enumerate(joined) if i is not None), key=lambda k: (self.scores[joined[k]], -k), default=None)
            if best is None:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _text(self, token: int) -> str:
        return "" if token < 0 else chr(token - STRANGE) if token >= STRANGE else self.pieces[token]

    def _follows(self, before: int, token: int) -> bool:
        key = (before + 1) << 32 | token
        ok = self.pairs.get(key)
        if ok is None:
            a, b = self._text(before), self._text(token)
            ok = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return ok

    def _fine(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """_follows for many pairs: a table with one place for each hash remembers recent judgements."""
        key = (before + 1) << 32 | token
        at = (mix(key.view(np.uint64)) >> np.uint64(64 - PLACES)).astype(np.int64)
        missed = np.flatnonzero(self.pair_keys[at] != key)
        if len(missed):
            new, which = np.unique(key[missed], return_inverse=True)
            judged = np.array([self._follows((x >> 32) - 1, x & 0xFFFFFFFF) for x in new.tolist()])
            ok = self.pair_fine[at]
            ok[missed] = judged[which]
            self.pair_keys[at[missed]], self.pair_fine[at[missed]] = key[missed], ok[missed]
            # two pairs may have written to one place in turn: the last key and its judgement must stay together
            self.pair_fine[at[missed]] = [self.pairs[x] for x in self.pair_keys[at[missed]].tolist()]
            return ok
        return self.pair_fine[at]

    def _packed_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of equal length, with their spaces as SPACE, four bytes an id."""
        codes, n, many = self._codes(words), len(words[0]), len(words)
        p = self._prefixes(codes)
        best, token, length = np.full((n + 1, many), -np.inf), np.full((n + 1, many), -1, np.int64), np.zeros((n + 1, many), np.int64)
        best[0] = 0
        for j in range(1, n + 1):
            low = max(0, j - self.longest)
            sizes = np.arange(j - low, 0, -1)
            keys = mix(p[j] - p[low:j] * self.powers[sizes][:, None] + sizes.astype(np.uint64)[:, None])
            k, w = np.nonzero(self.maybe[keys >> np.uint64(64 - PLACES)])
            keys = keys[k, w]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            k, w, t = sizes[k[hit]], w[hit], self.ids[at[hit]]
            single = np.ones(many, bool)
            single[w[k == 1]] = False
            odd = np.flatnonzero(single)
            if len(odd):
                k, w, t = np.concatenate((k, np.ones(len(odd), np.int64))), np.concatenate((w, odd)), np.concatenate((t, STRANGE + codes[odd, j - 1].astype(np.int64)))
            reach = best[j - k, w]
            if self.kind == BPE:
                reach[~self._fine(token[j - k, w], t)] = -np.inf
            else:
                reach = reach + np.where(t < STRANGE, self.score[np.minimum(t, len(self.score) - 1)], self.worst)
            np.maximum.at(best[j], w, reach)
            won = np.flatnonzero((reach == best[j, w]) & np.isfinite(reach))
            token[j, w[won]], length[j, w[won]] = t[won], k[won]
        path, end, going, step = np.zeros((many, n), np.int64), np.full(many, n), np.arange(many), n
        count = np.zeros(many, np.int64)
        while len(going):
            step -= 1
            at = end[going]
            path[going, step] = token[at, going]
            end[going] = at - length[at, going]
            count[going] += 1
            going = going[end[going] > 0]
        strange = (path >= STRANGE).any(1)
        # words that end earlier have their pieces at the right end of their row, in order
        flat, width = path.astype(np.int32).tobytes(), 4 * n
        first = (n - count) * 4
        return [self._packed(path[r, n - count[r] :].tolist()) if strange[r] else flat[r * width + f : (r + 1) * width] for r, f in enumerate(first.tolist())]

    def _hits(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """All pieces in a word: where they end (ascending, longer ones first), their lengths and ids. Each length probes all positions at once."""
        each = mix(self._codes([word])[0].astype(np.uint64) + np.uint64(1))
        h, found = np.zeros(len(word) + 1, np.uint64), []
        for size in range(1, min(self.longest, len(word)) + 1):
            h = h[: len(word) - size + 1] * BASE + each[size - 1 :]
            keys = mix(h + np.uint64(size))
            at = np.flatnonzero(self.maybe[keys >> np.uint64(64 - PLACES)])
            place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            hit = self.keys[place] == keys[at]
            found.append((at[hit] + size, np.full(hit.sum(), size), self.ids[place[hit]]))
        end, size, token = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-size, end))
        return end[order].tolist(), size[order].tolist(), token[order].tolist()

    def _tokens_of_one(self, word: str) -> list[int]:
        """The tokens of one word of any length."""
        n = len(word)
        best, token, length = [0.0] + [-np.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        ends, sizes, ids = self._hits(word)
        bpe, at, known = self.kind == BPE, 0, len(ends)
        for j in range(1, n + 1):
            single = False
            while at <= known:
                if at < known and ends[at] == j:
                    size, t = sizes[at], ids[at]
                    single = single or size == 1
                elif not single:
                    size, t, single = 1, STRANGE + ord(word[j - 1]), True
                    at -= 1
                else:
                    break
                at += 1
                before = best[j - size]
                if bpe:
                    if before == 0.0 and best[j] != 0.0 and self._follows(token[j - size], t):
                        best[j], token[j], length[j] = 0.0, t, size
                else:
                    reach = before + (self.scores[t] if t < STRANGE else self.worst)
                    if reach > best[j]:
                        best[j], token[j], length[j] = reach, t, size
        out = []
        while n:
            out.append(token[n])
            n -= length[n]
        return out[::-1]

    def _packed(self, tokens: list[int]) -> bytes:
        ids = []
        for t in tokens:
            if t < STRANGE:
                ids.append(t)
            elif self.bytes_:
                ids += [self.bytes_[b] for b in chr(t - STRANGE).encode()]
            elif not ids or ids[-1] != self.unknown:  # unknown characters in a row are one token
                ids.append(self.unknown)
        return np.array(ids, np.int32).tobytes()

    def _ids_of(self, words: set[str]) -> dict[str, bytes]:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, bytes] = {}
        for n, same in by_length.items():
            same.sort()
            shown = [w.replace(" ", SPACE) for w in same]
            if n <= BATCHED:
                found = (x for k in range(0, len(shown), 1 << 13) for x in self._packed_ids(shown[k : k + (1 << 13)]))
            else:
                found = (self._packed(self._tokens_of_one(w)) for w in shown)
            out.update(zip(same, found))
        return out

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, four bytes an id. Words of up to BATCHED characters are remembered, in CACHED bytes."""
        if self.held > CACHED:
            self.known.clear()
            self.held = 0
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
            self.pair_keys[:] = -1
        cut = []
        for t in texts:
            t = t.replace(SPACE, " ") if t else ""
            cut.append(self.cut.findall(" " + t if self.prefix and t else t))
        known = self.known
        fresh = self._ids_of({w for words in cut for w in words if w not in known})
        known |= fresh
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w, ids in fresh.items():
            if len(w) <= BATCHED:
                self.held += EACH + 4 * len(w) + len(ids)
            else:
                del known[w]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of some ids; bytes that are no UTF-8 become the replacement character."""
        data = b"".join(map(self.out.__getitem__, ids))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, built once in each worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encode(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", ids_col: str = "ids", check: str | None = None) -> DataFrame:
    """docs with the column ids_col: the piece ids of each row's text as array<int> (a column of that name is replaced).

    Null and empty texts have no ids. A U+2581 in a text is a space. check names a further boolean column: whether decoding the ids gives the text back (for
    null: the empty text). Other columns, also those with names used in here, pass through. The model is read on the
    driver and sent to the executors once; it has the size of its file, some hundred kilobytes.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(ids_col, *([check] if check else []))
    at = docs.columns.index(text_col)
    names = [*docs.columns, ids_col, *([check] if check else [])]

    def run(batches):
        pieces = loaded(model.value)
        for batch in batches:
            for b in slices(batch, at, 1 << 21):
                texts = b.column(at).cast(pa.string()).to_pylist()
                packed = pieces.encode_packed(texts)
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
                more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))]
                if check:
                    more.append(pa.array([pieces.decode(np.frombuffer(x, np.int32).tolist()) == (t or "").replace(SPACE, " ") for x, t in zip(packed, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names)

    schema = StructType(list(docs.schema.fields)).add(ids_col, ArrayType(IntegerType()))
    return docs.mapInArrow(lean(run), schema.add(check, "boolean") if check else schema)


def decode(rows: DataFrame, model_path: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with text_col: the text of the ids (null ids: null). The inverse of encode but for null texts and U+2581."""
    with open(model_path, "rb") as f:
        model = rows.sparkSession.sparkContext.broadcast(f.read())
    rows = rows.drop(text_col)
    at = rows.columns.index(ids_col)
    names = [*rows.columns, text_col]

    def run(batches):
        pieces = loaded(model.value)
        for b in batches:
            texts = [None if x is None else pieces.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add(text_col, "string"))
