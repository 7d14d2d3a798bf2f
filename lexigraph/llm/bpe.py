"""Byte-level BPE, encoding and decoding, with a contiguous rank array per word.

A text is cut into words by the tokenizer's pattern. A word keeps two flat lists: its
parts' ids and the ranks of adjacent pairs. The lowest rank (the leftmost of equals) is
found by a scan, its boundary is deleted, and the two neighbouring ranks are refreshed.
Scans are quadratic, so words over ``LONG`` bytes use a heap over a linked list instead,
which merges in the same order. Results of words are remembered up to a fixed number of
bytes, and a long text goes through in runs of words, so that a worker holds little besides
the text and its ids.

The vocabulary file (tokenizers .json, byte-level, without normaliser) is read on the
driver and broadcast; its size is fixed by the file.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extended, raw_texts, release, slices, with_columns

LONG = 192
#: Bytes of memory for words' results (about 250 for a short word), and words taken at a time.
REMEMBERED = 32 << 20
RUN = 1 << 15
NONE = 1 << 30

# The word pattern of byte-level BPE, with white space as Unicode has it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Below U+0280 the classes are few ranges, and the standard library's faster engine will do.
LATIN = re.compile(PATTERN.format(S=SPACE, L=r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u027f", N=r"0-9\xb2\xb3\xb9\xbc-\xbe"))
ANY = regex.compile(PATTERN.format(S=SPACE, L=r"\p{L}", N=r"\p{N}"))
BELOW_0280 = bytes(range(0xCA))


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Codec:
    """Encodes and decodes as the tokenizers library does with add_special_tokens=False.

    Strings of added tokens inside a text become those tokens, the library's default.
    """

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, vocab = data["model"], data["model"]["vocab"]
        if model["type"] != "BPE" or data.get("normalizer") or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words aren't handled")
        characters = byte_characters()
        self.single = [vocab[c] for c in characters]
        back = {c: b for b, c in enumerate(characters)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.room = REMEMBERED

    def _short(self, ids: list[int]) -> list[int]:
        rank_of, made = self.pairs.get, self.made
        ranks = [rank_of(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 32 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] << 32 | ids[i + 1], NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        rank_of, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank_of(ids[i] << 32 | ids[j], NONE) != rank:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := rank_of(ids[a] << 32 | ids[after[a]], NONE)) != NONE:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.single[b] for b in raw]
        return self._short(ids) if len(raw) <= LONG else self._long(ids)

    def entry(self, word: str) -> tuple[bytes, bytes]:
        """The word's ids as 32-bit numbers, and the bytes that they decode to."""
        ids = [self.added[word]] if word in self.added else self.word(word)
        found = array("i", ids).tobytes(), b"".join(map(self.bytes_of.__getitem__, ids))
        if len(word) <= 64:
            self.room -= 220 + 4 * len(word) + len(found[0])
            if self.room < 0:
                self.known.clear()
                self.room = REMEMBERED
            self.known[word] = found
        return found

    def words(self, raw: bytes) -> Iterator[str]:
        """The text's words and added tokens, in order."""
        pattern = ANY if raw.translate(None, BELOW_0280) else LATIN
        text = raw.decode()
        find = lambda t: pattern.findall(t) if len(t) < 8 * RUN else (m.group() for m in pattern.finditer(t))
        if self.split is None or not any(t in text for t in self.added):
            return find(text)
        return chain.from_iterable([part] if i % 2 else find(part) for i, part in enumerate(self.split(text)))

    def encoded(self, raw: bytes) -> tuple[bytes, bytes]:
        """The text's ids as 32-bit numbers, and the bytes that they decode to."""
        get, new, ids, back = self.known.get, self.entry, bytearray(), bytearray()
        for words in batched(self.words(raw), RUN):
            found = [get(w) or new(w) for w in words]
            ids += b"".join([e[0] for e in found])
            back += b"".join([e[1] for e in found])
        return ids, back

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text.encode())[0], np.int32).tolist()

    @cached_property
    def decimals(self) -> list[str]:
        """Each id in decimal, made once: looking one up costs less than writing it."""
        return list(map(str, range(max(self.bytes_of) + 1)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")


_codecs: dict[int, Codec] = {}


def codec_of(spec: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    key = hash(spec)
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str | None = "ids", ids_text: str | None = None, n_tokens: str | None = "n_tokens", decoded: str | None = "decoded") -> DataFrame:
    """The rows with their token ids and the text that the ids decode to.

    ``ids``: array<int>; ``ids_text``: the same in decimal, joined by commas; ``n_tokens``:
    long; ``decoded``: string. None leaves a column out; a column of the same name is
    replaced. A null text counts as empty: no ids, decoded ''. Every row comes back, in its
    partition; nothing is shuffled.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    extra = [(n, t) for n, t in ((ids, T.ArrayType(T.IntegerType())), (ids_text, T.StringType()), (n_tokens, T.LongType()), (decoded, T.StringType())) if n]
    schema = extended(docs.schema, *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                found = [codec.encoded(raw) for raw in raw_texts(batch.column(text))]
                flat = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
                ends = np.cumsum([0, *(len(f[0]) // 4 for f in found)])
                new: dict = {}
                if ids:
                    new[ids] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                if ids_text:
                    new[ids_text] = pa.array([",".join(map(codec.decimals.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
                if n_tokens:
                    new[n_tokens] = pa.array(np.diff(ends), pa.int64())
                if decoded:
                    new[decoded] = pa.array([f[1].decode(errors="replace") for f in found], pa.string())
                del found
                columns = with_columns(batch, new)
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])
        release()

    return docs.mapInArrow(run, schema)
