"""Exact tokenizer encoding at corpus speed, for byte-level BPE files of the tokenizers library."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import only_cache

_BESIDE_SPACE = re.compile(r"\s | \s|^ | $")
_ANY_SPACE = "[" + "".join(rf"\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]"
_ODD_SPACE = rf"{_ANY_SPACE} | {_ANY_SPACE}|\A | \z"
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LINE = re.compile(r"(\S+)\n(\S+)")
_TAIL = frozenset(".,;:!?")
def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()
#: Chunks that a worker remembers before it starts anew; bounds its memory.
KNOWN_CHUNKS = 1_000_000
#: Text bytes that are encoded at once; a longer text goes whole.
SLICE_BYTES = 32 << 20
#: Words whose ids are strung together at once.
SLICE_WORDS = 500_000


class Encoder:
    """Encodes whole texts as the library does, each distinct chunk once.

    Byte-level BPE of this kind never merges across a single space that stands between two other
    characters: no pre-token holds such a space but as its first character. So a text is cut there,
    the library encodes every distinct chunk, and the ids are strung together. Spaces beside other white
    space are no cut. A text that holds the string of an added token goes to the library whole.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = dtype
        self.form = "<%d" + {"<u2": "H", "<u4": "I"}[dtype]
        self.bare, self.spaced = _Chunks(self, ""), _Chunks(self, " ")

    def chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():  # one pre-token: straight to the model
            ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        else:
            return self.whole(chunk)
        return struct.pack(self.form % len(ids), *ids)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian integers of the dtype; none for null."""
        if not text:
            return b""
        if any(x in text for x in self.added):
            return self.whole(text)
        for known in (self.bare, self.spaced):
            if len(known) > KNOWN_CHUNKS:
                known.clear()
        first, *rest = _SAFE_SPACE.split(text) if _BESIDE_SPACE.search(text) else text.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))


    def _learn(self, chunks: list[str]) -> None:
        """Encode the letter words among new chunks many at a time: each is one pre-token."""
        new = (c for c in chunks if c not in self.spaced)
        stems = list({s for c in new if (s := c[:-1] if c[-1:] in _TAIL else c).isalpha() and s not in self.spaced})
        width = int(self.dtype[-1])
        for at in range(0, len(stems), 2000):
            part = stems[at : at + 2000]
            e = self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False)
            data, cuts = np.array(e.ids, self.dtype).tobytes(), np.searchsorted(e.word_ids, np.arange(len(part) + 1)).tolist()
            for stem, i, k in zip(part, cuts, cuts[1:], strict=False):
                self.spaced[stem] = data[width * i : width * k]

    def encode_batch(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of every text of a batch, null as empty, in slices of about SLICE_BYTES of text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield from self._encode_slice(texts.slice(at, end - at))
            at = end

    def _encode_slice(self, texts: pa.Array) -> Iterator[bytes]:
        """Distinct chunks are found and strung together by column."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for x in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        if isinstance(plain, pa.ChunkedArray):
            plain = plain.combine_chunks()
        begin = plain.offsets.to_numpy().astype(np.int64)
        words = plain.values.dictionary_encode()
        index, kinds = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        for known in (self.bare, self.spaced):
            if len(known) > KNOWN_CHUNKS:
                known.clear()
        self._learn(kinds)
        firsts = [kinds[i] for i in index[begin[:-1]]]
        index[begin[:-1]] = len(kinds) + np.arange(len(firsts))
        runs = [*map(self.spaced.__getitem__, kinds), *map(self.bare.__getitem__, firsts)]
        width = int(self.dtype[-1])
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // width
        table, place = np.frombuffer(b"".join(runs), self.dtype), np.cumsum(size) - size
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(begin, begin[at] + SLICE_WORDS, "right")) - 1)
            part = index[begin[at] : begin[end]]
            n = size[part]
            stop = np.cumsum(n)
            ids = table[np.repeat(place[part] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
            cut = np.concatenate([[0], stop])[begin[at : end + 1] - begin[at]]
            for k in range(at, end):
                yield self.encode(texts[k].as_py()) if odd[k] else ids[cut[k - at] : cut[k - at + 1]].tobytes()
            at = end


class _Chunks(dict):
    """chunk -> bytes of the ids of the chunk behind a prefix."""

    def __init__(self, encoder: Encoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in _TAIL and chunk[-2:-1].isalpha():  # a letter and a mark never share a pre-token
            out = self[chunk[:-1]] + self.encoder.bare[chunk[-1]]
        elif "\n" in chunk and (cut := _LINE.fullmatch(chunk)):  # nor does a lone line end with what is beside it
            return self[cut[1]] + self.encoder.bare["\n"] + self.encoder.bare[cut[2]]
        else:
            out = self.encoder.chunk(self.prefix + chunk)
        self[chunk] = out
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder for each worker process, so that later tasks reuse its chunks."""
    only_cache("tokens", _ENCODERS.clear)
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]
