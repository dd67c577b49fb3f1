"""Token counts of a BPE vocabulary by a compiled finite-state transducer.

The tokenization of every prefix of a text ends in one determined token: the piece t
that ends there and for which (last token before t, t) is a stable pair, meaning that
merging the two pieces' characters gives back exactly the two. Since stability is a
matter of neighbouring tokens only, the state after a prefix is finite: the longest
suffix that may still grow into a piece, and, for each place where such a piece could
start, the token that ends there and its token count relative to now. Transitions carry
the change of the token count (negative when a character lets tokens fuse). States and
transitions are compiled when a text first needs them and kept in a hash table with a
bounded number of entries, emptied when full.

No piece has a space after another character, so a run of spaces followed by other
characters is a segment of its own, entered in the start state; segments that repeat are
counted once. Segments longer than ``PIECE`` characters are cut in chunks; all chunks run
at once from a guessed state, and a chunk is rerun until its entry state is its
predecessor's exit state (no state maps are built or composed).
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textops as tx
from lumen.llm.common import read_table

U = np.uint64
LIMIT = 4096
PIECE = 64
MAX_STATES, KNOWN_SEGMENTS = 250_000, 500_000
SPACE = "▁"


def vocabulary(path: str) -> tuple[list[str], list[float]]:
    """Pieces and scores of a sentencepiece BPE model with byte fallback; control,
    unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size())
           if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids]


class Automaton:
    """Lazily determinised transducer over characters (symbols)."""

    def __init__(self, pieces: list[str], scores: list[float]) -> None:
        self.text = pieces
        self.id = {p: i for i, p in enumerate(pieces)}
        self.score = scores
        # characters without a piece of their own are four symbols, by their UTF-8 length
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[:0x80], self.symbol[0x80:0x800], self.symbol[0x800:0x10000], self.symbol[0x10000:] = 0, 1, 2, 3
        self.chars = [""] * 4
        for p in pieces:
            if len(p) == 1:
                self.symbol[ord(p)] = len(self.chars)
                self.chars.append(p)
        self.symbol[32] = self.symbol[ord(SPACE)]
        # trie of all pieces with suffix links (breadth first)
        self.next: list[dict[str, int]] = [{}]
        self.link, self.depth, self.piece = [0], [0], [-1]
        for i, p in enumerate(pieces):
            node = 0
            for c in p:
                to = self.next[node].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[node][c] = to
                    self.next.append({})
                    self.link.append(0)
                    self.depth.append(self.depth[node] + 1)
                    self.piece.append(-1)
                node = to
            self.piece[node] = i
        queue = [0]
        for node in queue:
            for c, to in self.next[node].items():
                if node:
                    k = self.link[node]
                    while k and c not in self.next[k]:
                        k = self.link[k]
                    self.link[to] = self.next[k].get(c, 0)
                queue.append(to)
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.size = 1 << 20
        self._clear_table()
        self.start = self._state((0, ((-1, 0),)))

    def _clear_table(self) -> None:
        self.keys = np.full(self.size, -1, np.int64)
        self.to = np.zeros(self.size, np.int32)
        self.change = np.zeros(self.size, np.int32)
        self.filled = 0

    def _state(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def merged(self, text: str) -> list[int]:
        """The pieces of ``text`` by merging: the best-scored pair of neighbours first,
        the leftmost of equals."""
        parts, ident, score = list(text), self.id, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ident.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ident[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (-1: nothing, or a character without piece)."""
        key = (a, b)
        known = self.stable_pairs.get(key)
        if known is None:
            if a < 0:
                known = self.merged(self.text[b]) == [b]
            else:
                known = self.merged(self.text[a] + self.text[b]) == [a, b]
            if len(self.stable_pairs) > 2 * MAX_STATES:
                self.stable_pairs.clear()
            self.stable_pairs[key] = known
        return known

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """(next state, change of the token count). ``state``: trie node and, for the
        node and each of its suffixes down to the empty one, (token ending where that
        suffix starts, tokens there minus tokens now)."""
        if symbol < 4:
            return (0, ((-1, 0),)), symbol + 1
        c = self.chars[symbol]
        node, before = state
        at = {}
        k = node
        for entry in before:
            at[self.depth[k]] = entry
            k = self.link[k]
        k = node
        while k and c not in self.next[k]:
            k = self.link[k]
        new = self.next[k].get(c, 0)
        token, count = -1, 0
        k = new
        while k:                                   # pieces ending here, longest first
            p = self.piece[k]
            if p >= 0:
                prior, tokens = at[self.depth[k] - 1]
                if self.stable(-1, p) and (prior < 0 or self.stable(prior, p)):
                    token, count = p, tokens + 1
                    break
            k = self.link[k]
        if token < 0:
            raise ValueError(f"no stable piece ends in {c!r}")
        # only suffixes that can still grow stay in the state
        k = new
        while k and not self.next[k]:
            k = self.link[k]
        node, entries = k, []
        while True:
            d = self.depth[k]
            entries.append((token, 0) if d == 0 else (at[d - 1][0], at[d - 1][1] - count))
            if not k:
                break
            k = self.link[k]
        return (node, tuple(entries)), count

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.size.bit_length() + 1)).astype(np.int64)

    def _insert(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        if 2 * (self.filled + len(keys)) > self.size:
            old = self.keys >= 0
            keys, to, change = (np.concatenate(x) for x in (
                (self.keys[old], keys), (self.to[old], to), (self.change[old], change)))
            while 2 * len(keys) > self.size // 2:
                self.size *= 2
            self._clear_table()
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            first = todo[free]
            self.keys[slot[first]] = keys[first]
            won = self.keys[slot[todo]] == keys[todo]
            done = todo[won]
            self.to[slot[done]], self.change[slot[done]] = to[done], change[done]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
        self.filled += len(keys)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of many (state, symbol) pairs."""
        keys = state.astype(np.int64) * 8192 + symbol
        slot = self._slots(keys)
        missing = []
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slot[todo]]
            missing.append(todo[held < 0])
            todo = todo[(held >= 0) & (held != keys[todo])]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
        missing = np.concatenate(missing) if missing else todo
        if len(missing):
            new = np.unique(keys[missing])
            to, change = np.empty(len(new), np.int32), np.empty(len(new), np.int32)
            for i, key in enumerate(new.tolist()):
                after, change[i] = self.step(self.states[key >> 13], key & 8191)
                to[i] = self._state(after)
            self._insert(new, to, change)
            return self.follow(state, symbol)
        return self.to[slot], self.change[slot]

    def run(self, state: np.ndarray, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, token change) of runs of symbols between ``bounds``, all at once."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        state, tokens = state.astype(np.int32).copy(), np.zeros(len(size), np.int64)
        longest = -size[order]
        for k in range(int(size.max()) if len(size) else 0):
            live = order[:int(np.searchsorted(longest, -k, side="left"))]
            state[live], change = self.follow(state[live], symbols[bounds[live] + k])
            tokens[live] += change
        return state, tokens

    def count(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of the segments between ``bounds``."""
        if len(self.states) > MAX_STATES:
            self.reset()
        size = np.diff(bounds)
        chunks = -(-size // PIECE)
        segment = np.repeat(np.arange(len(size)), chunks)
        no = np.arange(len(segment)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        lo = bounds[segment] + no * PIECE
        hi = np.minimum(lo + PIECE, bounds[segment + 1])
        cuts = np.concatenate((lo, hi[-1:])) if len(lo) else np.zeros(1, np.int64)
        entry = np.full(len(segment), self.start, np.int32)
        out, tokens = self.run(entry, symbols, cuts)
        # scan: every later chunk enters where the one before leaves
        inner = np.flatnonzero(no > 0)
        while len(inner):
            redo = inner[entry[inner] != out[inner - 1]]
            if not len(redo):
                break
            entry[redo] = out[redo - 1]
            flat = np.concatenate([symbols[lo[i]:hi[i]] for i in redo])
            out[redo], tokens[redo] = self.run(entry[redo], flat, np.concatenate(([0], np.cumsum((hi - lo)[redo]))))
        total = np.zeros(len(size), np.int64)
        np.add.at(total, segment, tokens)
        return total


class Counter:
    """Token counts of text columns; segments met often are looked up."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.hasher = automaton, tx.Hasher()
        self.known, self.tokens = np.zeros(0, U), np.zeros(0, np.int64)

    def _segments(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        raw = data[at]
        text = raw.tobytes().decode("utf-8", errors="replace")
        chars = np.cumsum(np.concatenate(([0], (raw & 0xC0) != 0x80)))
        bounds = chars[np.concatenate(([0], np.cumsum(size)))]
        points = np.frombuffer(text.encode("utf-32-le", errors="replace"), "<u4")
        if len(points) != bounds[-1]:                 # ill-formed bytes: one segment at a time
            parts = [np.frombuffer(raw[i:j].tobytes().decode("utf-8", errors="replace").encode("utf-32-le"), "<u4")
                     for i, j in zip(np.cumsum(size) - size, np.cumsum(size))]
            points = np.concatenate(parts)
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return self.automaton.count(self.automaton.symbol[points], bounds)

    def add(self, data: np.ndarray, offsets: np.ndarray, out: np.ndarray, fresh: np.ndarray) -> None:
        """Adds to ``out`` the tokens of a chunk's documents, spaces before them where ``fresh``."""
        size = np.diff(offsets)
        some = size > 0
        lead = (some & fresh).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(size + lead)))
        buf = np.full(bounds[-1], 32, np.uint8)
        buf[np.arange(len(data)) + np.repeat(bounds[:-1] + lead - offsets[:-1], size)] = data
        n = len(buf)
        if not n:
            return
        space = buf == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[bounds[:-1][some]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        self.hasher._grow(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hasher.table[buf] * self.hasher.power[:n], out=total[1:])
        h = tx.mix((total[end] - total[start]) * self.hasher.inverse[start] + (end - start).astype(U))
        unique, at, back = np.unique(h, return_index=True, return_inverse=True)
        tokens = np.zeros(len(unique), np.int64)
        if len(self.known):
            slot = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
            seen = self.known[slot] == unique
            tokens[seen] = self.tokens[slot[seen]]
        else:
            seen = np.zeros(len(unique), bool)
        new = np.flatnonzero(~seen)
        if len(new):
            tokens[new] = self._segments(buf, start[at[new]], end[at[new]])
            if len(self.known) + len(new) > KNOWN_SEGMENTS:
                self.known, self.tokens = unique, tokens
            else:
                both = np.concatenate((self.known, unique[new]))
                order = np.argsort(both)
                self.known = both[order]
                self.tokens = np.concatenate((self.tokens, tokens[new]))[order]
        np.add.at(out, np.searchsorted(bounds, start, side="right") - 1, tokens[back])

    def count(self, column: pa.Array) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_null(column.type):
            column = pc.replace_substring(column, SPACE, " ")
        data, offsets = tx.column_bytes(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        for first, d, o, fresh in pieces_at_spaces(data, offsets):
            docs = len(o) - 1
            self.add(d, o, out[first:first + docs], np.full(docs, fresh))
        return out


def pieces_at_spaces(data: np.ndarray, offsets: np.ndarray, max_bytes: int = tx.CHUNK_BYTES
                     ) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Chunks of whole documents; a longer one in pieces cut before a space that follows
    another character, which begins a segment. The last field: document starts here."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        lo, hi = int(offsets[i]), int(offsets[max(j, i + 1)])
        if j > i:
            yield i, data[lo:hi], offsets[i:j + 1] - lo, True
            i = j
            continue
        fresh = True
        while lo < hi:
            cut = hi
            at = lo + max_bytes
            while at < hi:
                part = data[at - 1:at + max_bytes]
                begins = np.flatnonzero((part[1:] == 32) & (part[:-1] != 32))
                if len(begins):
                    cut = at + int(begins[0])
                    break
                at += max_bytes
            yield i, data[lo:cut], np.array([0, cut - lo], np.int64), fresh
            lo, fresh = cut, False
        i += 1


def process_cache() -> dict:
    """A registry of the Python process, kept by reused workers from task to task."""
    module = sys.modules.setdefault("_lumen_process_cache", types.ModuleType("_lumen_process_cache"))
    return module.__dict__.setdefault("kept", {})


def count_tokens(docs: DataFrame, pieces: list[str], scores: list[float], limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) per row of
    ``docs`` (doc_id, text): the tokens of the sentencepiece BPE with these pieces and
    byte fallback, one space put before a text, without begin or end tokens; strings of
    special tokens are ordinary text. Null and empty texts have no tokens. Whole texts
    are counted; repeated rows count alike; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = process_cache()
        name = hash((tuple(pieces), tuple(scores)))
        with np.errstate(over="ignore"):
            if name not in kept:
                kept.clear()
                kept[name] = Counter(Automaton(pieces, scores))
            for batch in batches:
                tokens = kept[name].count(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_tokens(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), *vocabulary(public_tokenizers.path(model)))
