"""SentencePiece BPE encoding and decoding by vectorised merge rounds over numpy symbol arrays."""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

BLANK = "▁"
#: Chunks kept with their ids: at most so many in each of two generations, of at most so many characters.
KEPT, KEPT_CHARS = 200_000, 64
#: Merge rounds before what is left (odd words of thousands of characters) goes by a queue.
ROUNDS = 300
FAR = np.iinfo(np.int64).max
#: Texts that models with normaliser rules, other kinds or other ways with blanks encode otherwise.
PROBES = ("a", " a  b ", "\tA\n", "ﬁ Ａ é e\u0301 ½ \u00a0x\u200b", "the the", "日本語\U00020000")

codecs.register_error("grovekit.bytewise", lambda e: ("�", e.start + 1))


class PieceModel:
    """Tables of a BPE model with byte fallback, and the two directions.

    Symbols are piece ids; a character that is no piece is the number of pieces
    plus its code point. Merges are found by (left, right) in a sorted table.
    """

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.bytes = [b""] * n
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        for i in plain:
            self.bytes[i] = names[i].replace(BLANK, " ").encode()
        self.bytes[lib.unk_id()] = lib.decode([lib.unk_id()]).encode()
        scores = {i: lib.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.runs = {len(p) for p in self.ids if p.strip(BLANK) == ""}
        pairs, touched, neighbours = {}, {}, set()
        for piece, i in self.ids.items():
            if len(piece) < 2 or piece.strip(BLANK) == "":
                continue
            neighbours.update(zip(piece, piece[1:], strict=False))
            for at in range(1, len(piece)):
                left, right = self._symbol(piece[:at]), self._symbol(piece[at:])
                if left is not None and right is not None:
                    rank = order[scores[i]]
                    pairs[left << 32 | right] = (rank, i)
                    for half in (left, right):
                        touched[half] = min(touched.get(half, FAR), rank)
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.rank, self.merged = keys, np.array([pairs[k][0] for k in keys.tolist()], np.int64), np.array([pairs[k][1] for k in keys.tolist()], np.int64)
        #: A merge whose result may at once merge on at the same or a better rank must go one at a time.
        self.alone = np.array([touched.get(m, FAR) <= r for r, m in zip(self.rank.tolist(), self.merged.tolist(), strict=True)])
        self.neighbours = np.array(sorted(ord(a) << 32 | ord(b) for a, b in neighbours), np.int64)
        self._slots()
        self.pairs: dict[int, tuple[int, int]] = {}
        # a character of no piece of two or more ends a chunk
        stop = "\n" if not any("\n" in p for p in self.ids if len(p) > 1) else ""
        self.chunk = re.compile(f"{BLANK}*[^{BLANK}{stop}]+{stop}*|{BLANK}+{stop}*" + f"|{stop}+" * bool(stop))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs_known: dict[int, list[int]] = {}
        for probe in PROBES:
            if np.frombuffer(self.encode([probe])[0], "<u4").tolist() != lib.encode(probe, add_bos=True, add_eos=True):
                raise ValueError(f"{path}: not a BPE model with byte fallback and no normalisation")

    def _symbol(self, part: str) -> int | None:
        return self.ids.get(part, self.n + ord(part) if len(part) == 1 else None)

    def _slots(self) -> None:
        """A hash table of the pairs, so that a lookup touches one or two places."""
        self.bits = max(16, int(2 * len(self.keys)).bit_length())  # at most half of the places are taken
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, probe = np.arange(len(self.keys)), 0
        while len(todo):
            at = self._slot(self.keys[todo], probe)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            todo, probe = todo[self.slots[at] != todo], probe + 1
        self.probes = probe

    def _slot(self, pairs: np.ndarray, probe: int) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & (1 << self.bits) - 1

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, -1 if it has none."""
        out = self.slots[self._slot(pairs, 0)].astype(np.int64)
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != pairs))
        for probe in range(1, self.probes):
            if not len(wrong):
                break
            out[wrong] = self.slots[self._slot(pairs[wrong], probe)]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != pairs[wrong])]
        out[wrong] = -1
        return out

    def _run(self, k: int) -> list[int]:
        """Ids of k blanks: all merges of blanks score alike, so the leftmost always comes first."""
        if k not in self.runs_known:
            stack: list[int] = []
            for _ in range(k):
                stack.append(1)
                while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                    stack[-2:] = [stack[-2] + stack[-1]]
            if len(self.runs_known) > 1000:
                self.runs_known.clear()
            self.runs_known[k] = [self.ids[BLANK * x] for x in stack]
        return self.runs_known[k]

    def _queue(self, symbols: list[int], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges one segment to its end, pair by pair in order of rank and place."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.pairs.get(symbols[i] << 32 | symbols[after[i]])):
                heapq.heappush(queue, (found[0], i, symbols[i], symbols[after[i]]))

        for i in range(len(symbols)):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self.pairs[left << 32 | right][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        keep = np.array(symbols) >= 0
        return place[keep], np.array(symbols)[keep]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, and the bounds of each word's.

        Each round finds the best-ranked pair of each segment and merges its
        leftmost non-overlapping occurrences (only the leftmost, where the result
        could merge on at a better rank), then compacts; segments without a pair
        leave. Words are first cut into segments where no piece holds the two
        characters side by side. After ROUNDS rounds the rest goes by a queue.
        """
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(chars):
            return chars, np.zeros(len(words) + 1, np.int64)
        starts = np.zeros(len(chars), bool)
        lengths = np.array([len(w) for w in words])
        starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        side = chars[:-1] << 32 | chars[1:]
        at = np.minimum(np.searchsorted(self.neighbours, side), len(self.neighbours) - 1)
        starts[1:] |= self.neighbours[at] != side
        distinct, back = np.unique(chars, return_inverse=True)
        symbols = np.array([self._symbol(chr(c)) for c in distinct.tolist()], np.int64)[back]
        place, segment = np.arange(len(chars)), np.cumsum(starts) - 1
        done, rounds = [], 0
        while len(symbols):
            if rounds == ROUNDS:
                heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
                for x, at in zip(np.split(symbols, heads[1:]), np.split(place, heads[1:]), strict=True):
                    done.append(self._queue(x.tolist(), at))
                break
            rounds += 1
            pair = symbols[:-1] << 32 | symbols[1:]
            at = self._find(pair)
            found = (at >= 0) & (segment[:-1] == segment[1:])
            rank = np.append(np.where(found, self.rank[at], FAR), FAR)
            heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            over = np.repeat(best == FAR, sizes)
            done.append((place[over], symbols[over]))
            hit = (rank == np.repeat(best, sizes)) & ~over
            where = np.flatnonzero(hit)
            if not len(where):
                break
            first = np.append(True, segment[where[1:]] != segment[where[:-1]])
            fresh = np.append(True, where[1:] != where[:-1] + 1)
            nth = np.arange(len(where)) - np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            alone = np.repeat(np.logical_or.reduceat(self.alone[at[where]], np.flatnonzero(first)), np.diff(np.append(np.flatnonzero(first), len(where))))
            where = where[np.where(alone, first, nth % 2 == 0)]
            symbols = symbols.copy()
            symbols[where] = self.merged[at[where]]
            keep = ~over
            keep[where + 1] = False
            symbols, place, segment = symbols[keep], place[keep], segment[keep]
        places, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(places, kind="stable")
        places, symbols = places[order], symbols[order]
        return symbols, np.searchsorted(places, np.append(0, np.cumsum(lengths)))

    def _ids(self, symbols: np.ndarray) -> list[int]:
        out = []
        for s in symbols.tolist():
            if s < self.n:
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in chr(s - self.n).encode()]
        return out

    def _chunks(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        words = [BLANK + c.lstrip(BLANK) if c.startswith(BLANK * 2) else c for c in chunks]
        symbols, bounds = self.merge(words)
        unknown = np.append(0, np.cumsum(symbols >= self.n))
        odd = (unknown[bounds[1:]] > unknown[bounds[:-1]]).tolist()
        raw, bounds = symbols.astype("<u4").tobytes(), bounds.tolist()
        for chunk, word, x, a, b in zip(chunks, words, odd, bounds, bounds[1:], strict=False):
            if not x and len(word) == len(chunk):
                yield chunk, raw[4 * a : 4 * b]
                continue
            ids, k = self._ids(symbols[a:b]), 1 + len(chunk) - len(word)
            if k > 1:  # if no piece took the last blank, it is one of the run
                ids = self._run(k) + ids[1:] if ids[0] == self.ids[BLANK] else self._run(k - 1) + ids
            yield chunk, np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        cut = [self.chunk.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        here, long, new = self.known, {}, []
        for c in {c for chunks in cut for c in chunks}.difference(here):
            if c in self.older:
                here[c] = self.older[c]
            else:
                new.append(c)
        for a in range(0, len(new), 20_000):
            for chunk, ids in self._chunks(new[a : a + 20_000]):
                (here if len(chunk) <= KEPT_CHARS else long)[chunk] = ids
        if long:
            here = here | long
        head, tail = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        return [b"".join([head, *map(here.__getitem__, chunks), tail]) for chunks in cut]

    def decode(self, ids: bytes) -> str:
        """Text of ids as encode() gives them; a malformed byte becomes U+FFFD."""
        raw = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "grovekit.bytewise")


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, path: str | None = None, decode: bool = True, id_cols: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(id columns, token_ids binary, n_tokens long, decoded string if asked for) of every row.

    token_ids holds little-endian unsigned 32-bit integers, begin and end ids
    included. Null and empty texts give just those two ids and decode to "".
    Repeated rows appear as often as given, ids may be null, an empty table gives
    no rows, other columns are ignored. The model file must exist on every node.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in parts(batches):
            ids = m.encode([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            cols = [*b.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            names = [*b.schema.names[:-1], "token_ids", "n_tokens"]
            if decode:
                cols.append(pa.array([m.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    schema = f"{kinds}, token_ids binary, n_tokens bigint" + ", decoded string" * decode
    return docs.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, schema)
