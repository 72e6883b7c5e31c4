"""Byte-pair encoding as a streaming transducer, and its decoder.

**Encoding.** Which merges apply at the right of a token border depends on what
follows it only up to a fixed distance, which the merge list determines
(``lookahead``). So a word is read into a buffer, the buffer is merged, and the
tokens that end at least that far from the end of the buffer are final: they are
emitted and leave the buffer. Memory depends on the merge list, not on the word.
Merges never cross the border of an emitted token, so what follows may be merged
on its own.

**Lookahead.** Merge i joins u and v. It takes place behind a border if v has
been built by then, so the ``len(v)`` symbols of v count, and if no earlier merge
has joined a part of v that lies at its right end with what follows; that merge
has a smaller number and needs its own lookahead from there:
``reach(i) = len(v_i) + max(reach(j) for j < i if u_j lies at the right end of v_i)``.
The largest reach is enough for every border. One pass over the list computes it.

**Decoding.** Ids are turned into pieces by a table; a state machine turns their
bytes into text as soon as characters are complete. Tokenizer files without a
decoder define decoding as the pieces joined by blanks.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts_of
from .tokens import Encoder, splitter, vocabulary_text


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Transducer:
    """Encodes single pre-tokens with constant memory."""

    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int], suffix: str = ""):
        self.suffix, self.ids = suffix, ids
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = self._lookahead(merges)
        self.letters = [letter.encode("utf-8").decode() for letter in byte_letters()]

    def _length(self, symbol: str) -> int:
        return len(symbol) - len(self.suffix) if self.suffix and symbol.endswith(self.suffix) else len(symbol)

    def _lookahead(self, merges) -> int:
        parts: dict[str, tuple[str, str]] = {}
        best: dict[str, int] = {}
        most = 1
        for u, v in merges:
            reach, end = 0, v
            while True:
                reach = max(reach, best.get(end, 0))
                if end not in parts:
                    break
                end = parts[end][1]
            reach += self._length(v)
            best[u] = max(best.get(u, 0), reach)
            most = max(most, reach)
            parts.setdefault(u + v, (u, v))
        return most

    def _merge(self, symbols: list[str]) -> list[str]:
        """All merges in order of rank, from left to right among equal ones."""
        n, rank = len(symbols), self.rank
        if n < 24:  # short words: look for the lowest rank again and again
            while len(symbols) > 1:
                best, at = None, 0
                for i in range(len(symbols) - 1):
                    r = rank.get((symbols[i], symbols[i + 1]))
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            return symbols
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, u, v = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or symbols[i] != u or symbols[j] != v:
                continue
            symbols[i], live[j] = u + v, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return [s for s, alive in zip(symbols, live) if alive]

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token whose bytes come piece by piece; each id as soon as it is final."""
        held: list[str] = []
        room = 4 * self.lookahead + 64
        for piece in pieces:
            for at in range(0, len(piece), room):
                held += map(self.letters.__getitem__, piece[at : at + room])
                if len(held) > 2 * room:
                    stable, size = [], 0
                    for token in self._merge(held.copy()):
                        size += len(token)
                        if size > len(held) - 1 - self.lookahead:  # the last symbol may still get the suffix
                            break
                        stable.append(token)
                    for token in stable:
                        yield self.ids[token]
                    held = held[sum(map(len, stable)) :]
        if held:
            held[-1] += self.suffix
            for token in self._merge(held):
                yield self.ids[token]

    def __call__(self, words: list[str]) -> list[list[int]]:
        return [list(self.stream((w.encode("utf-8", "surrogatepass"),))) for w in words]


class Decoder:
    """Ids to text, a few at a time."""

    def __init__(self, ids: dict[str, int], spec: dict):
        self.pieces = {i: s for s, i in ids.items()}
        self.joined = spec.get("decoder") is None
        if not self.joined and spec["decoder"]["type"] != "ByteLevel":
            raise ValueError("decoders other than none and ByteLevel are not known")
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: s.encode() if i in special else bytes(byte[c] for c in s) for i, s in self.pieces.items()} if not self.joined else {}

    def stream(self, ids: Iterable[int], at_once: int = 4096) -> Iterator[str]:
        """Text of the ids, piece by piece; characters whose bytes are not complete wait in the state."""
        if self.joined:
            first, get = True, self.pieces.__getitem__
            for part in _batches(ids, at_once):
                yield ("" if first else " ") + " ".join(map(get, part))
                first = False
            return
        state, get = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes.__getitem__
        for part in _batches(ids, at_once):
            yield state.decode(b"".join(map(get, part)))
        yield state.decode(b"", final=True)


def _batches(ids: Iterable[int], at_once: int) -> Iterator[list[int]]:
    if isinstance(ids, list):
        yield from (ids[i : i + at_once] for i in range(0, len(ids), at_once))
        return
    held = []
    for i in ids:
        held.append(i)
        if len(held) == at_once:
            yield held
            held = []
    if held:
        yield held


class Codec:
    """The transducer and decoder of a tokenizer file, with normal form and pre-tokens as the file says."""

    def __init__(self, vocabulary: str):
        import unicodedata

        spec = json.loads(vocabulary)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without byte fallback is known")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.transducer = Transducer(merges, model["vocab"], model.get("end_of_word_suffix") or "")
        self.decoder = Decoder({**model["vocab"], **added}, spec)
        split = splitter(spec)
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        space = regex.compile(r"\s+")

        def whole(chunks: list[str]) -> list[list[int]]:
            out = []
            for chunk in chunks:
                ids: list[int] = []
                for part in cut.split(chunk) if cut else [chunk]:
                    if part in added:
                        ids.append(added[part])
                    else:
                        plain = space.sub(" ", unicodedata.normalize("NFC", part))
                        lower = "".join(c.lower() for c in plain)
                        ids += chain.from_iterable(self.transducer(split(lower)))
                out.append(ids)
            return out

        self.encode = Encoder(self.transducer, split, whole)


_codecs: dict[int, Codec] = {}


def codec(vocabulary: str) -> Codec:
    key = hash(vocabulary)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def encode_texts(docs: DataFrame, vocabulary_path: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text; with ``digest`` their SHA-256 instead of ids and text.

    A null text is empty and has no tokens; null and repeated ids keep their
    rows; an empty table gives no rows. Texts are encoded whole.
    """
    vocabulary = vocabulary_text(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(vocabulary)
        decimal = [str(i) for i in range(max(use.decoder.pieces, default=0) + 1)]
        for batch in batches:
            for first, held in slices(batch):
                flat, counts = use.encode(held)
                a, b, end = [], [], 0
                for n in counts.tolist():
                    ids = flat[end : end + n].tolist()
                    end += n
                    if digest:
                        a.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                        h = hashlib.sha256()
                        for text in use.decoder.stream(ids):
                            h.update(text.encode())
                        b.append(h.hexdigest())
                    else:
                        a.append(ids)
                        b.append("".join(use.decoder.stream(ids)))
                columns = [batch.column(0).slice(first, len(held)), pa.array(counts.astype(np.int64)), pa.array(a, pa.string() if digest else pa.list_(pa.int64())), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = ["long", "long", "string" if digest else "array<long>", "string"]
    return texts_of(docs).mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds))))
