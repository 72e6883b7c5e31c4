import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from meterlake.llm import binary_tokens, bpe, packing, tokens


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.vocabulary_text(None)


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_str(vocabulary)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def key(x):
    return (x[0] is None, x[0] or 0, *x[1:])


def test_encoders_equal_the_library(vocabulary, library):
    g = random.Random(1)
    letters = list("abcXYZ 's't123.,!?\n\t ́éÉßİıſǅΣςσ漢字😀🏽‍\x00\x1c\x1f\x85 ﻿½²ªµÅ가가") + ["<|endoftext|>", ", ", ". "]
    texts = ["".join(g.choice(letters) for _ in range(g.randint(0, 60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b", "a" * 5000, "thethethe" * 2000, "".join(g.choice("etaoinshrdlu") for _ in range(9000)), "", "word., Word, ... a.b, c. 'S, d'.", "A, B. C,\nD.", "H̱, Ẹ́."]
    expected = [ids_of(library, t) for t in texts]
    for encoder in (tokens.library_encoder(vocabulary), bpe.codec(vocabulary).encode):
        ids, counts = encoder(texts)
        found = np.split(ids, np.cumsum(counts)[:-1])
        assert [f.tolist() for f in found] == expected
    decoder = bpe.codec(vocabulary).decoder
    assert ["".join(decoder.stream(e, 7)) for e in expected] == library.decode_batch(expected, skip_special_tokens=False)


def test_many_words_are_encoded_together(vocabulary):
    g, library = random.Random(2), tokens.Library(vocabulary)
    words = sorted({"".join(g.choice("abcdefgé'ßz") for _ in range(g.randint(1, 9))) for _ in range(3000)})
    words = list(dict.fromkeys(part for w in words for part in tokens.splitter(json.loads(vocabulary))(w)))
    expected = library(words)
    sent = []
    encode = tokens.Library.__call__
    counting = type("Counting", (tokens.Library,), {"__call__": lambda self, texts: sent.extend(texts) or encode(self, texts)})(vocabulary)
    ids, lengths = counting.words(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == expected
    assert len(sent) <= len(words) / 100
    ids, lengths = library.words(["two words", "a"])  # not a word each, so there are more pieces than words
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == library(["two words", "a"])


def test_words_are_remembered_once(vocabulary):
    encoder = tokens.library_encoder(vocabulary)
    encoder(["unseenword unseenword, Unseenword"])
    held = encoder.store.n
    encoder(["unseenword", "UNSEENWORD unseenword. x"])
    assert encoder.store.n <= held + 2
    assert not hasattr(encoder, "known")


def test_transducer_emits_before_the_end_with_bounded_memory(vocabulary):
    t = bpe.codec(vocabulary).transducer
    g = random.Random(2)
    text = "".join(g.choice("etaoinshrdlu") for _ in range(40_000)).encode()
    read = 0

    def feed():
        nonlocal read
        for at in range(0, len(text), 500):
            read += 500
            yield text[at : at + 500]

    stream = t.stream(feed())
    first = [next(stream) for _ in range(50)]
    assert read < 20 * t.lookahead + 1000
    assert first + list(stream) == t([text.decode()])[0]


def test_lookahead_is_enough_for_a_small_merge_list():
    merges = [("a", "b"), ("b", "c"), ("c", "a"), ("ab", "c"), ("bc", "a"), ("abc", "abc"), ("ca", "b")]
    ids = {s: i for i, s in enumerate(["a", "b", "c", *("".join(m) for m in merges)])}
    t = bpe.Transducer(merges, ids)
    whole = bpe.Transducer(merges, ids)
    whole.lookahead = 1 << 20
    g = random.Random(3)
    for _ in range(100):
        word = "".join(g.choice("abc") for _ in range(2000))
        assert t([word]) == whole([word])


def test_byte_level_decoder_keeps_incomplete_characters():
    letters = bpe.byte_letters()
    ids = {c: i for i, c in enumerate(letters)}
    decoder = bpe.Decoder(ids, {"decoder": {"type": "ByteLevel"}, "added_tokens": []})
    text = "é漢😀x"
    assert "".join(decoder.stream([ids[letters[b]] for b in text.encode()], 1)) == text
    assert "".join(decoder.stream([ids[letters[0xF0]]], 1)) == "�"


def test_pack_and_unpack():
    g = np.random.default_rng(1)
    counts = np.array([0, 1, 4, 5, 0, 1000])
    ids = (g.integers(0, 1 << 32, counts.sum()) >> g.integers(0, 32, counts.sum())).astype(np.uint32)
    control, ends, data, data_ends = binary_tokens.pack(ids, counts)
    assert ends[-1] == len(control) and data_ends[-1] == len(data)
    assert (binary_tokens.unpack(control, data, counts) == ids).all()


def test_token_files_round_trip(spark, odd_docs, odd_rows, library, tmp_path):
    expected = sorted(((i, len(e) + 1, zlib.crc32(np.array([*e, 2], "<u4").tobytes())) for i, t in odd_rows for e in [ids_of(library, t)]), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    found = sorted(binary_tokens.token_files(odd_docs).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found] == expected
    starts = np.cumsum([0] + [e[1] for e in expected[:-1]])
    assert [r["start"] for r in found] == starts.tolist()
    binary_tokens.write_tokens(odd_docs, str(tmp_path / "t"))
    read = binary_tokens.read_tokens(spark, str(tmp_path / "t")).collect()
    assert sorted(map(str, [r["ids"] for r in read])) == sorted(str([*ids_of(library, t), 2]) for _, t in odd_rows)


def test_bpe_of_odd_rows(odd_docs, odd_rows, library):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    expected = [(i, len(e), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))) for i, t in odd_rows for e in [ids_of(library, t)]]
    assert sorted(map(tuple, bpe.encode_texts(odd_docs, digest=True).collect()), key=key) == sorted(expected, key=key)


def test_packing_of_odd_rows(odd_docs, odd_rows, library):
    found = packing.pack_documents(odd_docs, length=256).collect()
    expected = sorted((ids for _, t in odd_rows for ids in [[*ids_of(library, t), 1]]), key=str)
    assert sum(r["length"] for r in found) == sum(map(len, expected))
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in odd_rows:
        if [x[0] for x in odd_rows].count(i) == 1:
            ids, at = np.array([*ids_of(library, t), 1], "<u4"), 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(sequences) == list(range(len(sequences)))


def test_cutting_stock_covers_the_demand_with_few_patterns():
    g = np.random.default_rng(5)
    room = 64
    demand = np.zeros(room + 1, np.int64)
    for k in g.integers(1, room, 20_000):
        demand[k] += 1
    used = packing.solve(demand, room)
    assert (sum(p * n for p, n in used) == demand).all()
    assert all((p * np.arange(room + 1)).sum() <= room for p, _ in used)
    bound = (demand * np.arange(room + 1)).sum() / room
    assert sum(n for _, n in used) <= 1.02 * bound + room


def test_empty_tables(no_docs):
    assert binary_tokens.token_files(no_docs).count() == 0
    assert bpe.encode_texts(no_docs, digest=True).count() == 0
    assert packing.pack_documents(no_docs).count() == 0
