"""Token counts of huge documents by overlap resynchronisation.

A text longer than one chunk is encoded as overlapping chunks, each with character
offsets. Two neighbouring encodings are spliced at a common boundary that is proven
stable: a token starts there in both, an ASCII space or line break stands right before
it, and ``AGREE`` tokens on either side are the same in both. If the overlap holds no such
place, the overlap is doubled and the chunk encoded again, up to the whole rest of the
text, which needs no splice.

Why such a boundary is stable: the tokenizer drops white space, its pre-tokens hold none,
added tokens hold none, and NFC and lower-casing never reach across a space. So no token
depends on characters beyond a space. For the same reason a short text may be counted word
by word, and the counts of words remembered (up to a fixed number).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extended, raw_texts, release, slices, with_columns

CHUNK = 16_384
OVERLAP = 512
AGREE = 4
REMEMBERED = 300_000
BREAKS = " \t\n\x0b\x0c\r"


class Counter:
    """Counts tokens as ``tokenizers`` does, without added begin or end tokens, truncation or padding."""

    def __init__(self, spec: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that take in white space aren't handled")
        if self.tokenizer.encode("a b", add_special_tokens=False).ids != [i for w in "ab" for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
            raise ValueError("a tokenizer that drops white space is needed")
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[bytes, int] = {}
        self.widened = 0

    def _encode(self, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        """(id, offset in the text) of each token of text[start:stop]."""
        e = self.tokenizer.encode(text[start:stop], add_special_tokens=False)
        return [(i, start + o[0]) for i, o in zip(e.ids, e.offsets, strict=True)]

    def _splice(self, text: str, left: list, right: list, start: int) -> tuple[int, int] | None:
        """Where a stable boundary stands in both: (index in left, index in right)."""
        at = {o: k for k, (_, o) in enumerate(left) if o > start}
        for j in range(AGREE, len(right) - AGREE + 1):
            o = right[j][1]
            i = at.get(o) if text[o - 1] in BREAKS else None
            if i is not None and i >= AGREE and left[i - AGREE : i + AGREE] == right[j - AGREE : j + AGREE]:
                return i, j
        return None

    def tokens(self, text: str) -> list[tuple[int, int]]:
        """(id, offset) of each token of a text of any length, by overlapping chunks."""
        out: list[tuple[int, int]] = []
        stop, n = min(self.chunk, len(text)), len(text)
        current = self._encode(text, 0, stop)
        while stop < n:
            overlap = self.overlap
            while True:
                start = max(0, stop - overlap)
                end = min(n, stop + self.chunk)
                following = self._encode(text, start, end)
                if start == 0:
                    out, current = [], following
                    break
                if found := self._splice(text, current, following, start):
                    i, j = found
                    out += current[:i]
                    current = following[j:]
                    break
                overlap *= 2
                self.widened += 1
                if start <= (out[-1][1] if out else 0):
                    out, current, overlap = [], self._encode(text, 0, stop), stop
            stop = end
        return out + current

    def counts(self, texts: list[bytes]) -> list[int]:
        """The number of tokens of each text; the library encodes only words not yet remembered."""
        split = [t.split() if len(t) <= self.chunk else None for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for ws in split if ws for w in ws if w not in self.known})
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        fresh = dict(zip(new, map(len, encoded), strict=True))
        self.known |= fresh
        count = self.known.__getitem__
        return [len(self.tokens(t.decode())) if ws is None else sum(map(count, ws)) for t, ws in zip(texts, split, strict=True)]


_counters: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows with n_bytes (UTF-8, long), n_tokens (long) and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Present columns of these names are
    replaced. Every row comes back, in its partition; nothing is shuffled.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = extended(docs.schema, ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value), chunk, overlap
        counter = _counters.get(key) or _counters.setdefault(key, Counter(shared.value, chunk, overlap))
        for whole in batches:
            for batch in slices(whole, text, 2 << 20):
                raw = raw_texts(batch.column(text))
                n = counter.counts(raw)
                columns = with_columns(batch, {"n_bytes": pa.array(map(len, raw), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])
        release()

    return docs.mapInArrow(run, schema)
