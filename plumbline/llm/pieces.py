"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

A sequence of tokens is the encoding of its text exactly if every two neighbours are the encoding of
theirs. So each prefix of a text has one last token at most: that ending there whose neighbour, the
last token of the prefix before it, is compatible. An automaton names the tokens that end at each
place, a memo of pair tests picks the one that fits, and going back from the end recovers the ids.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import doc_frame, slices

#: Words that a worker remembers; when full, it starts anew. Places of its memo of pairs, where a newer pair takes an older one's.
WORDS, PAIR_BITS = 600_000, 21
SPACE = "▁"
#: An odd multiplier that spreads keys over a hash table.
_MIX, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1

codecs.register_error("replace_each_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """A SentencePiece BPE model with byte fallback and identity normalisation, read from its file.

    Refuses models whose text rules it does not follow (other kinds, character maps, white-space
    removal, user symbols, pieces with an inner space).
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        t, n = m.trainer_spec, m.normalizer_spec
        kinds = {p.type for p in m.pieces}
        inner = [p.piece for p in m.pieces if p.type == 1 and SPACE in p.piece.lstrip(SPACE)]
        if t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not n.add_dummy_prefix or t.treat_whitespace_as_suffix or kinds - {1, 2, 3, 6} or inner:
            raise ValueError("the model needs text rules that are not supported")
        self.piece = [p.piece for p in m.pieces]
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.score = [p.score for p in m.pieces]
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.unk, self.end = t.unk_id, t.eos_id
        raw = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" for p in m.pieces]
        raw[self.unk] = t.unk_surface.encode()
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.words: dict[str, int] = {}
        self.word_at, self.word_len, self.word_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pair_key, self.pair_fits = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)
        self.alphabet = np.unique(np.array([ord(c) for p in self.id for c in p]))
        self._build([(p, i) for p, i in self.id.items() if self.merged(p) == [i]])

    def _build(self, pieces: list[tuple[str, int]]) -> None:
        """The automaton: states of a prefix tree, moves in a hash table with linear probing, the token that each state completes."""
        moves: dict[int, int] = {}
        token = [-1]
        for p, i in pieces:
            state = 0
            for c in p:
                key = state << 21 | ord(c)
                if (to := moves.get(key)) is None:
                    to = moves[key] = len(token)
                    token.append(-1)
                state = to
            token[state] = i
        self.token = np.array(token, np.int64)
        bits = max(4, (4 * len(moves)).bit_length())
        self.move_shift, size = 64 - bits, 1 << bits
        self.move_key, self.move_to = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for key, to in moves.items():
            at = (key * _MIX & _ALL) >> self.move_shift
            while self.move_key[at] >= 0:
                at = (at + 1) % size
            self.move_key[at], self.move_to[at] = key, to

    def _matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stop, token, size) of every token in a row of code points: the automaton runs from all places at once."""
        found = []
        place, state, n = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(place):
            key = state << 21 | codes[place + n]
            at = ((key.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(self.move_shift)).astype(np.int64)
            have = self.move_key[at]
            while len(miss := np.flatnonzero((have != key) & (have >= 0))):
                at[miss] = (at[miss] + 1) % len(self.move_key)
                have[miss] = self.move_key[at[miss]]
            n += 1
            alive = have == key
            place, state = place[alive], self.move_to[at[alive]]
            token = self.token[state]
            done = token >= 0
            found.append((place[done] + n, token[done], np.full(done.sum(), n)))
            within = place + n < len(codes)
            place, state = place[within], state[within]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def merged(self, text: str) -> list[int]:
        """The defining procedure on a short text of known characters: join the best-scored pair, leftmost first, until none is left."""
        part: list[str | None] = list(text)
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (i := self.id.get(both := part[a] + part[b])) is not None:
                heapq.heappush(queue, (-self.score[i], a, both))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while queue:
            _, a, both = heapq.heappop(queue)
            b = nxt[a]
            if part[a] is None or b >= len(part) or part[a] + part[b] != both:
                continue
            part[a], part[b], nxt[a] = both, None, nxt[b]
            if nxt[b] < len(part):
                prv[nxt[b]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        return [self.id.get(p, -1) for p in part if p is not None]

    def fit(self, a: np.ndarray, b: np.ndarray, wanted) -> np.ndarray:
        """Whether the text of tokens a and b is encoded as these two. Pairs not in the memo are tested only where ``wanted`` of the answers so far."""
        key = a.astype(np.int64) << 20 | b
        at = (key * 0x9E3779B97F4A7C1 >> 20) & ((1 << PAIR_BITS) - 1)
        known = self.pair_key[at] == key
        out = known & self.pair_fits[at]
        if len(open_ := np.flatnonzero(~known & wanted(out))):
            new, back = np.unique(key[open_], return_inverse=True)
            told = np.array([self.merged(self.piece[x] + self.piece[y]) == [x, y] for x, y in zip((new >> 20).tolist(), (new & 0xFFFFF).tolist(), strict=True)])
            out[open_] = told[back]
            self.pair_key[at[open_]], self.pair_fits[at[open_]] = key[open_], out[open_]
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new words, all in one pass of the automaton and place by place, and remember them."""
        texts = [w if w[:1] in ("\n", SPACE) else SPACE + w for w in words]
        line = "\n".join(texts) + "\n"
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stop, token, size = self._matches(codes)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens + 1) - 1
        place = stop - np.repeat(ends - lens, lens + 1)[stop - 1]
        last, back = np.full(len(line) + 1, -1, np.int64), np.ones(len(line) + 1, np.int64)
        order = np.argsort(place.astype(np.int32), kind="stable")
        stop, token, size = stop[order], token[order], size[order]
        cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            s, t, n = stop[lo:hi], token[lo:hi], size[lo:hi]
            before = last[s - n]
            # at the start of a word and after an unknown character (no token ends there) anything fits
            free = before < 0
            last[s[free]], back[s[free]] = t[free], n[free]
            s, t, n, before = s[~free], t[~free], n[~free], before[~free]

            def still_open(ok: np.ndarray, s=s, t=t, n=n) -> np.ndarray:
                last[s[ok]], back[s[ok]] = t[ok], n[ok]
                return last[s] < 0

            ok = self.fit(before, t, still_open)
            last[s[ok]], back[s[ok]] = t[ok], n[ok]
        # back from the ends of all words at once; the places that are met are the token ends
        met, at, start = [], ends.copy(), ends - lens
        while len(at):
            met.append(at)
            at = at - back[at]
            at, start = at[at > start], start[at > start]
        met = np.sort(np.concatenate(met)) if met else np.zeros(0, np.int64)
        ids, width = last[met], np.ones(len(met), np.int64)
        odd = np.flatnonzero(ids < 0)
        spelt = [[self.byte[x] for x in chr(c).encode("utf-8", "surrogatepass")] for c in codes[met[odd] - 1].tolist()]
        width[odd] = [len(x) for x in spelt]
        ids = np.repeat(ids, width)
        ids[ids < 0] = list(chain.from_iterable(spelt))
        counts = np.diff(np.r_[0, np.cumsum(width)][np.searchsorted(met, ends, "right")], prepend=0)
        base, first = len(self.word_ids), len(self.words)
        self.words.update(zip(words, range(first, first + len(words)), strict=True))
        self.word_at = np.r_[self.word_at, base + np.cumsum(counts) - counts]
        self.word_len = np.r_[self.word_len, counts]
        self.word_ids = np.r_[self.word_ids, ids.astype(np.int32)]

    _CHUNK = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")

    def _cut(self, text: str) -> list[str]:
        """The words of a text: no token holds a character and then a space, or a line end, so each stands alone. A word that starts with neither had one space before it."""
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text:
            return self._CHUNK.findall(SPACE + text.replace(" ", SPACE))
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's end id last, and how many ids each text has."""
        cut = [self._cut(t) for t in texts]
        new = set().union(*cut) - self.words.keys() if self.words else set().union(*cut)
        if len(self.words) + len(new) > WORDS:
            self.words, self.word_at, self.word_len, self.word_ids = {}, self.word_at[:0], self.word_len[:0], self.word_ids[:0]
            new = set().union(*cut)
        if new:
            self.learn(sorted(new))
        words = np.fromiter(map(len, cut), np.int64, len(cut))
        row = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, words.sum())
        n = self.word_len[row]
        stop = np.cumsum(n)
        flat = self.word_ids[np.repeat(self.word_at[row] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        edge = np.r_[0, stop][np.cumsum(words)]
        return np.insert(flat, edge, self.end), np.diff(edge, prepend=0) + 1

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids: control ids are silent, the space put before the first piece goes, wrong bytes become U+FFFD one by one."""
        n = self.raw_len[flat]
        out = np.cumsum(n)
        data = self.raw[np.repeat(self.raw_at[flat] - (out - n), n) + np.arange(out[-1] if len(out) else 0)].tobytes()
        stops = np.r_[0, out][np.cumsum(counts)].tolist()
        begin = np.cumsum(counts) - counts
        first = [self.piece[flat[b]] if c else "" for b, c in zip(begin.tolist(), counts.tolist(), strict=True)]
        return [data[a + f.startswith(SPACE) : b].decode("utf-8", "replace_each_byte") for a, b, f in zip([0, *stops[:-1]], stops, first, strict=True)]


@lru_cache(1)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, ids, decoded), the ids of the whole text with the end id, and the text that they decode to.

    Row-wise, so nothing is shuffled and ids may be null or repeated. Null texts count as empty: the
    end id alone. ``model_path`` must be readable on every worker (it comes with the installed
    tokenizer files). An empty table gives an empty result; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at, to in slices(texts, 1 << 21):
                flat, counts = m.encode(texts[at:to])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), lists, pa.array(m.decode(flat, counts), pa.string())], ["id", "ids", "decoded"])

    return doc_frame(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string")
