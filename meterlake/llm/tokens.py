"""Token ids of texts, by the tokenizers library or by the own transducer, word by word.

White space never lies inside a pre-token of these tokenizers, so a text is cut
at blanks and line ends, and a chunk between them is encoded once and looked up
afterwards. A pre-token is a chunk like any other; new ones are encoded some
hundreds at a time, as a text with blanks between them. The number of chunks that
are remembered is bounded.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import remembered

#: Chunks and pre-tokens that a worker remembers at most, but for those of the texts at hand.
REMEMBERED_CHUNKS = 700_000

#: Pre-tokens that the library encodes as one text.
TOGETHER = 500

#: Characters whose case and normal form need no context: Latin letters, digits, marks.
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-įı-ſ]*+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_text(path: str | None) -> str:
    """Content of a tokenizer file, read by the driver and sent along with the job (a few MB)."""
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return file.read()


def highest_id(vocabulary: str) -> int:
    spec = json.loads(vocabulary)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)


class Library:
    """Pre-tokens through the tokenizers library."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(vocabulary)["model"]
        self.suffix = model.get("end_of_word_suffix")
        self.last = np.zeros(max(model["vocab"].values(), default=0) + 1, bool)
        if self.suffix:
            self.last[[i for token, i in model["vocab"].items() if token.endswith(self.suffix)]] = True

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-tokens in one array, and how many each has.

        The last id of a pre-token carries the suffix, so the ids of many are cut there. Where that
        does not give as many pieces as there are pre-tokens, they are encoded one by one.
        """
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        together = self([" ".join(group) for group in groups]) if self.suffix else [[]] * len(groups)
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for group, found in zip(groups, together):
            found = np.array(found, np.uint32)
            size = np.diff(np.flatnonzero(self.last[np.minimum(found, len(self.last) - 1)]), prepend=-1)
            if len(size) != len(group) or size.sum() != len(found):
                found, size = flattened(self(group))
            ids.append(found)
            lengths.append(size)
        return np.concatenate(ids), np.concatenate(lengths)


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the lists in one array, and the length of each."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


def _simplified(texts: pa.Array) -> pa.Array:
    """Fewer different chunks with the same pre-tokens.

    In texts of plain letters only, A-Z is moved to a-z, and a full stop or
    comma between a letter and a blank, which is a pre-token of its own, is cut off.
    """
    odd = pc.match_substring_regex(texts, r"[^\x00-\x{17f}]|<\|")
    changed = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,][ \n])", r"\1 \2")
    return pc.if_else(odd, texts, changed)


class Encoder:
    """Ids of many texts at a time. ``split`` cuts a lower-case chunk into pre-tokens."""

    def __init__(self, words, split, whole, mark: str = "<|"):
        self.words, self.split, self.whole, self.mark = words, split, whole, mark
        self.code: dict[str, int] = {}
        self.store = Ragged()

    def _learn(self, chunks: list[str]) -> None:
        words = [c for c in chunks if c.isascii() and c.isalpha() and c.islower()]
        others = set(chunks).difference(words)
        cuts = {c: self.split(c.lower()) for c in others if _PLAIN.fullmatch(c) and self.mark not in c}
        odd = sorted(others.difference(cuts))
        missing = list(set(words).union(*cuts.values()).difference(self.code))
        if missing:
            self.code.update(zip(missing, self.store.add(self.words(missing))))
        cuts = {c: cut for c, cut in cuts.items() if cut != [c]}
        parts = np.fromiter(map(self.code.__getitem__, chain.from_iterable(cuts.values())), np.int64)
        ids, lengths = self.store.take(parts)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(np.fromiter(map(len, cuts.values()), np.int64, len(cuts)))]
        self.code.update(zip(cuts, self.store.append(ids, np.diff(ends, prepend=0))))
        if odd:
            self.code.update(zip(odd, self.store.add(self.whole(odd))))

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        pieces = pc.ascii_split_whitespace(_simplified(texts.cast(pa.large_string()).fill_null("")))
        counts = pc.list_value_length(pieces).fill_null(0).to_numpy(zero_copy_only=False)
        coded = pieces.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.code) > REMEMBERED_CHUNKS:
            self.code, self.store = {}, Ragged()
        missing = [c for c in chunks if c not in self.code]
        if missing:
            self._learn(missing)
        places = np.fromiter(map(self.code.__getitem__, chunks), np.int64, len(chunks))
        ids, lengths = self.store.take(places[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else places)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)


class Ragged:
    """Lists of ids in one growing array."""

    def __init__(self):
        self.flat, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        first, self.n = self.n, self.n + len(lengths)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : self.n], self.length[first : self.n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)
        return range(first, self.n)

    def add(self, lists: list[list[int]] | tuple[np.ndarray, np.ndarray]) -> range:
        """Lists of ids, or all their ids in one array and the lengths."""
        return self.append(*(lists if isinstance(lists, tuple) else flattened(lists)))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[places].astype(np.int64)
        before = np.cumsum(lengths) - lengths
        return self.flat[np.arange(int(lengths.sum())) + np.repeat(self.start[places] - before, lengths)], lengths


def library_encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for this vocabulary. Kept between tasks of the worker."""

    def make() -> Encoder:
        library = Library(vocabulary)
        return Encoder(library.words, splitter(json.loads(vocabulary)), library)

    return remembered(f"library {hash(vocabulary)}", make)


def splitter(spec: dict):
    """Finds the pre-tokens of a lower-case chunk by the pattern in the tokenizer file."""
    steps = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else [spec["pre_tokenizer"]]
    normal = spec["normalizer"]["normalizers"] if spec["normalizer"]["type"] == "Sequence" else [spec["normalizer"]]
    kinds = [s["type"] for s in steps], [s["type"] for s in normal]
    if kinds != (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]) or not steps[0]["invert"] or steps[0]["behavior"] != "Removed":
        raise ValueError(f"only word tokenizers that drop white space and case are known, not {kinds}")
    pattern = regex.compile(steps[0]["pattern"]["Regex"])
    return pattern.findall


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the id ``end`` to every text's ids."""
    after = np.cumsum(counts)
    return np.insert(ids, after, end).astype("<u4"), counts + 1
