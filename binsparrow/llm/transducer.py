"""Token counts by a finite-state transducer compiled from a tokenizer file.

A byte-level BPE tokenizer is compiled into one deterministic transducer over bytes. Each transition is annotated with the change of
the number of tokens: after every byte the sum of the annotations is the count that the text up to there has, so the sum over
a text is its count. The machine is the subset construction of two parts:

* the split into pre-tokens, which needs the kind of the last characters (letter, digit, white space, other, and the openings of 's 't 're 've 'm 'll 'd);
* BPE inside the open pre-token. Tokens follow each other in a BPE encoding if and only if every two neighbours are the encoding of their
  own string (Berglund and van der Merwe, 2023), so of all tokens that end a prefix exactly one fits behind the last token of what is before it.
  A state holds, for every suffix of the pre-token that begins some token, the place in the trie of tokens, the last token before it and the count
  there relative to now.

States are determinised as texts need them, as in lazy automata, and kept in tables up to STATES; then all but those in use are forgotten.

A slice of texts is cut into chunks of CHUNK bytes, which run side by side, one byte of every chunk at a time. What a chunk does to the state is its
state map: an entry state gives an exit state and a count. It is first found for the start state, then for the exits of the chunk
before, until no exit is new; runs from different states soon meet, and from there on the rest is known. The maps of a text's chunks are then composed by a
parallel prefix scan (doubling).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import only_cache

#: Bytes of a chunk, and about the bytes of texts whose chunks run side by side; a longer text is cut, and the state carried on.
CHUNK, SLICE_BYTES = 256, 4 << 20
#: States whose transitions are kept; a state takes 1.5 KB.
STATES = 120_000
#: Tokens whose followers are kept; each takes a bit for every token.
ROWS = 20_000
#: The state before a text, and the mark of a transition that is not compiled yet.
START, UNKNOWN = 0, -1

LETTER, DIGIT, SPACE, OTHER = "letter", "digit", "space", "other"
#: The contractions that are pre-tokens of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class Bpe:
    """BPE inside one pre-token as a nondeterministic machine over bytes.

    A state is a tuple of (trie node, last token before the node's string, tokens before it less tokens now); its first entry is the root: nothing
    of a next token is read. Entries from which no token can follow go, and of last tokens after which the same of the node's tokens
    may follow one stands for all, so that equal futures are one state.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, encode):
        """encode: the ids of a string by the library."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.letters = [letters[b] for b in range(256)]
        names = sorted(vocabulary)
        self.place = {name: i for i, name in enumerate(names)}  # tokens are known by their place in alphabetical order
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        if len({a + b for a, b in pairs}) < len(pairs) or {a + b for a, b in pairs} | set(self.letters) != set(names):
            raise ValueError("every token but the single bytes must come from one merge, and every byte must be a token")
        self._trie(names)
        self._spines(names, pairs)
        self.usable = np.array([encode(x) == [vocabulary[x]] for x in names])
        self.rows = {-1: np.packbits(self.usable).tobytes()}
        self.bars: dict[int, list[tuple[int, int, int]]] = {}
        self.same: dict[tuple[int, bytes], int] = {}
        self.kept: dict[tuple[int, int], int | None] = {}
        self.start = ((0, -1, 0),)

    def _trie(self, names: list[str]) -> None:
        """child, token: of a node by letter, and at it; below: the places of the longer tokens under it."""
        self.child: dict[tuple[int, str], int] = {}
        self.token: dict[int, int] = {}
        self.below: list[list[int]] = [[0, len(names)]]
        for i, name in enumerate(names):
            node = 0
            for depth, x in enumerate(name):
                to = self.child.get((node, x))
                if to is None:
                    to = self.child[node, x] = len(self.below)
                    self.below.append([i + (depth + 1 == len(name)), i])
                node = to
                if depth + 1 < len(name):
                    self.below[node][1] = i + 1
            self.token[node] = i

    def _spines(self, names: list[str], pairs: list[tuple[str, str]]) -> None:
        """What is needed to tell which tokens follow which.

        A merge across the border of u and t takes a piece from the right spine of u (u, its right part, the right part of that, ...) and one from the
        left spine of t, when both stand and are not yet merged into the next. Tokens are laid out so that those that have a
        token on their left spine are a run, and under it those that are merged late come first.
        """
        n = len(names)
        made = np.full(n, -1)  # the rank of the merge that makes a token
        right_of = np.full(n, -1)
        self.merges: dict[int, list[tuple[int, int]]] = {}
        under: dict[int, list[int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = self.place[a], self.place[b], self.place[a + b]
            made[whole], right_of[whole] = rank, right
            self.merges.setdefault(left, []).append((right, rank))
            under.setdefault(left, []).append(whole)
        self.made, self.right = made.tolist(), right_of.tolist()
        self.under = {t: sorted(c, key=lambda c: -self.made[c]) for t, c in under.items()}
        self.at, self.end = np.zeros(n, int), np.zeros(n, int)
        order: list[int] = []
        stack = [(t, False) for t in range(n) if self.made[t] < 0]
        while stack:
            t, done = stack.pop()
            if done:
                self.end[t] = len(order)
                continue
            self.at[t] = len(order)
            order.append(t)
            stack.append((t, True))
            stack.extend((c, False) for c in reversed(self.under.get(t, [])))

    def barred(self, piece: int) -> list[tuple[int, int, int]]:
        """(rank, from, to) of each merge of the piece, rank by rank: with a token across the border, and so the run of tokens that it bars."""
        known = self.bars.get(piece)
        if known is None:
            known = self.bars[piece] = []
            for token, rank in self.merges.get(piece, ()):
                if self.made[piece] < rank and self.made[token] < rank:
                    known.append((rank, self.at[token], self.at[token] + 1))
                    later = [c for c in self.under.get(token, ()) if self.made[c] >= rank]
                    if later:
                        known.append((rank, self.at[later[0]], self.end[later[-1]]))
        return known

    def row(self, last: int) -> bytes:
        """For every token, as bits, whether it can follow: whether no merge comes across the border while the two are made. Of equal pairs the left one
        merges first."""
        known = self.rows.get(last)
        if known is None:
            if len(self.rows) >= ROWS:
                self.rows = {-1: self.rows[-1]}
            blocked = np.zeros(len(self.made), bool)
            piece, limit = last, np.inf
            while piece >= 0:
                for rank, lo, hi in self.barred(piece):
                    if rank >= limit:
                        break
                    blocked[lo:hi] = True
                piece, limit = self.right[piece], self.made[piece]
            known = self.rows[last] = np.packbits(self.usable & ~blocked[self.at]).tobytes()
        return known

    def stands_for(self, node: int, last: int) -> int | None:
        """The token that stands for `last` before the node, None where nothing can follow."""
        if (node, last) in self.kept:
            return self.kept[node, last]
        lo, hi = self.below[node]
        part = np.unpackbits(np.frombuffer(self.row(last), np.uint8)[lo // 8 : hi // 8 + 1])[lo % 8 : lo % 8 + hi - lo].tobytes()
        found = self.same.setdefault((node, blake2b(part, digest_size=16).digest()), last) if 1 in part else None
        self.kept[node, last] = found
        return found

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after a byte, and how many tokens more the prefix has."""
        x, now, open_ = self.letters[byte], None, []
        for node, last, count in state:
            node = self.child.get((node, x))
            if node is None:
                continue
            token = self.token.get(node)
            if token is not None and now is None and self.row(last)[token >> 3] & 128 >> (token & 7):
                now = (token, count + 1)
            stand = self.stands_for(node, last)
            if stand is not None:
                open_.append((node, stand, count))
        token, more = now
        return ((0, self.stands_for(0, token), 0), *((n, u, c - more) for n, u, c in open_)), more

    def run(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        total = 0
        for b in data:
            state, more = self.step(state, b)
            total += more
        return state, total


class Machine:
    """The whole transducer: a state is (kind of the open pre-token, its BPE state, more, bytes of an unfinished character).

    `more` is, in white space, the last character and how many tokens fewer the run has without it, and else the characters of a contraction begun.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        model = made["model"]
        odd = any(model.get(c) for c in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if made["normalizer"] or model.get("type", "BPE") != "BPE" or odd or {k: (made["pre_tokenizer"] or {}).get(k) for k in plain} != plain:
            raise ValueError("only byte-level BPE files with the usual split and without a normalizer can be compiled")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in what is beside them cannot be compiled")
        self.special = [t.content.encode() for t in added]
        if len(self.special) > 1:
            raise ValueError("only one added token can be compiled")
        self.bpe = Bpe({x: i for x, i in model["vocab"].items() if x.encode() not in self.special}, model["merges"], lambda x: [t.id for t in self.tokenizer.model.tokenize(x)])
        self.kinds: dict[str, str] = {}
        self.clear([(None, self.bpe.start, "", b"")])

    def clear(self, keys: list[tuple]) -> None:
        """Forget all states but these, which are numbered anew; the first is the start."""
        self.number = {k: i for i, k in enumerate(keys)}
        self.keys = list(keys)
        self.next = np.full((max(1024, 2 * len(keys)), 256), UNKNOWN, np.int32)
        self.more = np.zeros(self.next.shape, np.int16)

    def forget(self, used: np.ndarray) -> np.ndarray:
        """Numbers of the used states after all others are forgotten."""
        old = np.unique(np.concatenate([[START], used]))
        self.bpe.same.clear()
        self.bpe.kept.clear()
        self.clear([self.keys[i] for i in old])
        return np.searchsorted(old, used).astype(np.int32)

    def compile(self, state: int, byte: int) -> None:
        key, more = self.step(self.keys[state], byte)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            if to == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, UNKNOWN)])
                self.more = np.concatenate([self.more, np.zeros_like(self.more)])
        self.next[state, byte], self.more[state, byte] = to, more

    def kind(self, char: str) -> str:
        """As the library's own split sees it."""
        known = self.kinds.get(char)
        if known is None:
            known = SPACE
            for kind, probe in ((LETTER, "a"), (DIGIT, "1"), (OTHER, ".")):
                if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(probe + char)) == 1:
                    known = kind
            self.kinds[char] = known
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        kind, bpe, note, pending = state
        if not pending and 0x80 <= byte < 0xC0:  # a chunk that begins inside a character, run from the start state for its map
            return state, 0
        pending += bytes([byte])
        lead = pending[0]
        if len(pending) < (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
            return (kind, bpe, note, pending), 0
        to, more = self.read(kind, bpe, note, pending.decode())
        return (*to, b""), more

    def read(self, kind: str | None, bpe: tuple, note, char: str) -> tuple[tuple, int]:
        """One character: (kind, BPE state, note) after it, and the change of the count."""
        new, data = self.kind(char), char.encode()

        def fresh(before: int = 0) -> tuple[tuple, int]:
            """The character opens a pre-token; `before` is what the closed ones changed."""
            state, more = self.bpe.run(self.bpe.start, data)
            if new == SPACE:
                return (SPACE, state, (char, more)), before + more
            return (new, state, "'" if char == "'" else ""), before + more

        def grown(note="") -> tuple[tuple, int]:
            state, more = self.bpe.run(bpe, data)
            return (new, state, note), more

        if kind is None:
            return fresh()
        if kind == SPACE:
            last, fewer = note
            if new == SPACE:  # the run grows
                state, more = self.bpe.run(bpe, data)
                return (SPACE, state, (char, more)), more
            if last != " ":  # the run's last character, another than a space, is a pre-token alone
                _, alone = self.bpe.run(self.bpe.start, last.encode())
                return fresh(alone - fewer)
            state, more = self.bpe.run(self.bpe.start, b" " + data)  # a last space goes with what follows
            return (new, state, ""), more - fewer
        if note.startswith("'") and new == LETTER:  # a quotation mark at the start of a pre-token, perhaps a contraction
            short = note + char
            if short in CONTRACTIONS:
                _, whole = self.bpe.run(self.bpe.start, short.encode())
                parts = [self.bpe.run(self.bpe.start, x.encode())[1] for x in (note[0], note[1:]) if x]
                return (None, self.bpe.start, ""), whole - sum(parts)
            if note == "'":
                to, more = fresh()
                return (to[0], to[1], short if any(c.startswith(short) for c in CONTRACTIONS) else ""), more
        if new == kind:
            return grown()
        return fresh()

    def _advance(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of counts for a byte of every chunk; transitions are compiled as needed."""
        to = self.next[states, data]
        if (to < 0).any():
            new = to < 0
            for code in np.unique(states[new].astype(np.int64) << 8 | data[new]).tolist():
                if self.next[code >> 8, code & 255] == UNKNOWN:
                    self.compile(code >> 8, code & 255)
            to = self.next[states, data]
        return to, self.more[states, data]

    def run_chunks(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, carried: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, exit state) of each text, chunks begin..begin+length of the data given in order.

        heads: the first chunk of each text; carried: the state in which each text begins.
        """
        n = len(begin)
        text = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
        first = np.zeros(n, bool)
        first[heads] = True
        # maps for the entry that is known: the text's own for its first chunk, the start state for the others
        entry = np.where(first, carried[text], START).astype(np.int32)
        order = np.argsort(-length, kind="stable")
        alive = np.searchsorted(-length[order], -np.arange(1, CHUNK + 1), "right")  # chunks that have a byte at each place
        path = np.zeros((CHUNK + 1, n), np.int32)
        sums = np.zeros((CHUNK + 1, n), np.int32)
        path[0, order] = entry[order]
        state, count = entry[order], np.zeros(n, np.int32)
        for p in range(CHUNK):
            m = alive[p]
            if not m:
                break
            to, more = self._advance(state[:m], data[begin[order[:m]] + p])
            state[:m] = to
            count[:m] += more
            path[p + 1, order[:m]], sums[p + 1, order[:m]] = to, count[:m]
        out, total = np.empty(n, np.int32), np.empty(n, np.int32)
        out[order], total[order] = state, count
        # nodes of the maps: (chunk, entry) -> exit, count
        chunks, entries, exits, counts = [np.arange(n)], [entry], [out], [total]
        ask = np.flatnonzero(~first)
        ask, want = ask, out[ask - 1]
        known = set()
        while len(ask):
            new = want != entry[ask]
            if known:
                new &= np.fromiter((c not in known for c in zip(ask.tolist(), want.tolist(), strict=True)), bool, len(ask))
            ask, want = ask[new], want[new]
            if not len(ask):
                break
            known.update(zip(ask.tolist(), want.tolist(), strict=True))
            end, gained = self._until_met(data, begin[ask], length[ask], want, path[:, ask], sums[:, ask], out[ask], total[ask])
            chunks.append(ask)
            entries.append(want)
            exits.append(end)
            counts.append(gained)
            nxt = ask + 1
            inside = nxt < n
            inside[inside] = ~first[nxt[inside]]
            ask, want = nxt[inside], end[inside]
        return _compose(np.concatenate(chunks), np.concatenate(entries), np.concatenate(exits), np.concatenate(counts), heads, carried, n)

    def _until_met(self, data, begin, length, entry, path, sums, out, total) -> tuple[np.ndarray, np.ndarray]:
        """Exit and count of chunks from other entries: run until the state is the one of the first run at that place."""
        n = len(begin)
        end, gained = np.empty(n, np.int32), np.empty(n, np.int32)
        live, state, count = np.arange(n), entry.astype(np.int32), np.zeros(n, np.int32)
        for p in range(CHUNK + 1):
            met = state == path[p, live]
            over = p == length[live]
            done = met | over
            if done.any():
                k = live[done]
                end[k] = np.where(met[done], out[k], state[done])
                gained[k] = np.where(met[done], count[done] + total[k] - sums[p, k], count[done])
                live, state, count = live[~done], state[~done], count[~done]
            if not len(live):
                return end, gained
            state, more = self._advance(state, data[begin[live] + p])
            count = count + more
        return end, gained

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text of a column; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        found = np.zeros(len(texts), np.int64)
        # texts are cut at the added token's string, which is one token itself
        cuts, owner = [offsets[:-1]], [np.arange(len(texts))]
        ends = [offsets[1:]]
        for mark in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, mark.decode()).to_numpy(zero_copy_only=False)).tolist():
                whole, at = data[offsets[k] : offsets[k + 1]].tobytes(), 0
                places = []
                while (at := whole.find(mark, at)) >= 0:
                    places.append(at)
                    at += len(mark)
                found[k] += len(places)
                ends[0] = ends[0].copy()
                ends[0][k] = offsets[k] + places[0]
                cuts.append(offsets[k] + np.array(places) + len(mark))
                ends.append(np.append(offsets[k] + np.array(places[1:], np.int64), offsets[k + 1]))
                owner.append(np.full(len(places), k))
        cuts, ends, owner = np.concatenate(cuts), np.concatenate(ends), np.concatenate(owner)
        some = ends > cuts
        for lo, hi, who in _slices(cuts[some], ends[some], owner[some]):
            np.add.at(found, who, self._slice(data, lo, hi))
        return found

    def _slice(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Counts of the parts lo..hi of the data, in order; a long one alone is walked in stretches, with the state carried over."""
        if len(self.keys) > STATES:
            self.forget(np.zeros(0, np.int32))
        total, state = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int32)
        at = lo
        while True:
            stop = np.minimum(hi, at + SLICE_BYTES)
            pieces = -(-(stop - at) // CHUNK)
            heads = np.cumsum(pieces) - pieces
            begin = np.repeat(at, pieces) + CHUNK * (np.arange(pieces.sum()) - np.repeat(heads, pieces))
            length = np.minimum(np.repeat(stop, pieces) - begin, CHUNK)
            count, state = self.run_chunks(data, begin, length, state, heads)
            total += count
            if (stop == hi).all():
                return total
            at = stop
            if len(self.keys) > STATES:
                state = self.forget(state)


def _slices(lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts in groups of about SLICE_BYTES; a longer part is a group of its own."""
    sizes, at = np.cumsum(hi - lo), 0
    while at < len(lo):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield lo[at:end], hi[at:end], owner[at:end]
        at = end


def _compose(chunk: np.ndarray, entry: np.ndarray, exit_: np.ndarray, count: np.ndarray, heads: np.ndarray, carried: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """State maps of chunks composed over each text by doubling: (count, exit state) of each text.

    A map is a set of nodes (chunk, entry) -> (exit, count); a node leads to the node of the next chunk whose entry is its exit.
    """
    key = chunk.astype(np.int64) << 32 | entry
    order = np.argsort(key)
    stop = np.zeros(n + 1, bool)
    stop[heads] = stop[n] = True
    ends = stop[chunk + 1]
    follow = np.searchsorted(key, chunk + 1 << 32 | exit_, sorter=order)
    nodes = len(key)
    step = np.where(ends, nodes, np.append(order, 0)[np.minimum(follow, nodes)])
    step = np.append(step, nodes)
    sums, last = np.append(count.astype(np.int64), 0), np.append(exit_, 0)
    while True:
        moved = step[:-1] < nodes
        if not moved.any():
            break
        k = np.flatnonzero(moved)
        to = step[k]
        sums[k] += sums[to]
        last[k] = last[to]
        step[k] = step[to]
    first = order[np.searchsorted(key, heads.astype(np.int64) << 32 | carried, sorter=order)]
    return sums[first], last[first].astype(np.int32)


_MACHINES: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    """One machine for each worker process, so that later tasks find its states."""
    only_cache("transducer", _MACHINES.clear)
    if path not in _MACHINES:
        _MACHINES[path] = Machine(path)
    return _MACHINES[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(m.counts(b.column("text")))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text), in one narrow pass.

    Counts are the library's for the whole text, without added begin, end or padding; the string of an added token counts as one, as the library takes
    it by default. Null texts are empty: 0 bytes, 0 tokens. Rows stay one by one, whatever their doc_id (null and repeated ones too); other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_counted(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
