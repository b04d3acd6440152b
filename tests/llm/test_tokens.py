"""BPE, packing and token counts against the library and brute force."""

import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidara.llm import bpe, packing, token_counts
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, np.dtype("<u4")).tobytes()


def random_texts(n, seed=7):
    r = random.Random(seed)
    alphabet = ["a", "B", "é", "É", "ß", "'s", "'", "1", "²", ".", "!!", " ", "  ", "\n", "\x1d", "́", "Σ", "ς", "İ", "日", "🙂", "<|endoftext|>", "the", "tion", "_", "-", "’", "　", "ǅ", "ﬁ"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_encoder_is_the_library(library):
    enc = bpe.Encoder(PATH)
    for text in [t or "" for t in ODD] + random_texts(3000):
        assert enc.encode(text) == ids_of(library, text), repr(text)


def test_tree_concatenation_is_exact(library):
    enc = bpe.Encoder(PATH)
    for text in random_texts(400, 3) + ["x" * 500, "ab" * 300 + " " + "c" * 300]:
        parts = bpe.halves(text, 16)
        assert bpe.join_tree(enc, [(p, enc.encode(p)) for p in parts]) == ids_of(library, text), repr(text)


def test_words_of_two_large_vocabularies_are_merged_once(library):
    """What comes again after another 50,000 words is still known, and batches of known words run no merges."""
    letters = "abcdefghijklmnopqrst"
    words = ["".join(letters[i // 20**k % 20] for k in range(4)) for i in range(100_000)]
    enc, seen = bpe.Encoder(PATH), []
    plain = enc.merged
    enc.merged = lambda pieces: (seen.append(len(pieces)), plain(pieces))[1]
    for half in (words[:50_000], words[50_000:]) * 2:
        for _ in range(2):  # words met twice are known for good
            got = [x for i in range(0, len(half), 10_000) for x in enc.encode_batch([" ".join(half[j : j + 1000]) for j in range(i, i + 10_000, 1000)])]
    assert sum(seen) == len(words)
    assert got == [ids_of(library, " ".join(half[j : j + 1000])) for j in range(0, len(half), 1000)]


def counted(enc):
    """Notes how many characters are encoded from now on."""
    seen = []
    plain, batch = enc.merged, enc.encode_batch
    enc.merged = lambda pieces: (seen.append(sum(map(len, pieces))), plain(pieces))[1]
    enc.encode_batch = lambda texts: (seen.append(sum(len(str(t)) for t in texts)), batch(texts))[1]
    return seen


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "aab", "theinanreonat", "éaüß", "x"])
def test_letters_without_white_space_need_small_windows(library, alphabet):
    r = random.Random(len(alphabet))
    text = "".join(r.choice(alphabet) for _ in range(1_000_000 if len(alphabet) == 26 else 60_000))
    enc = bpe.Encoder(PATH)
    parts = [(p, enc.encode(p)) for p in bpe.halves(text, 8192)]
    seen = counted(enc)
    assert bpe.join_tree(enc, parts) == ids_of(library, text)
    assert sum(seen) < len(parts) * 2000


def test_random_runs_join_exactly(library):
    r = random.Random(12)
    enc = bpe.Encoder(PATH)
    for _ in range(40):
        text = "".join(r.choice(["th", "e", "ing", "a", "re", "on", "z", "'s", "é", "q"][: r.choice([5, 7, 10])]) for _ in range(r.randint(50, 1500)))
        parts = [(p, enc.encode(p)) for p in bpe.halves(text, r.choice([16, 40, 100]))]
        assert bpe.join_tree(enc, parts) == ids_of(library, text), repr(text)


def test_round_trip(odd_docs, no_docs, library):
    assert bpe.round_trip(no_docs, PATH).count() == 0
    want = sorted(
        (str(r.doc_id), len(ids_of(library, r.text)) // 4, sha256(ids_of(library, r.text)).hexdigest(), sha256(library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest())
        for r in odd_docs.collect()
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd_docs, PATH).collect())
    assert got == want
    few = bpe.encode(odd_docs, PATH, leaf=64)
    assert sorted((str(r.doc_id), r.ids) for r in few.collect()) == sorted((str(r.doc_id), ids_of(library, r.text)) for r in odd_docs.collect())


def first_fit_brute(lengths, capacity):
    """Plain best-fit decreasing, one item at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(bins) if room >= n]
        if fitting:
            bins[min(fitting, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 40) for _ in range(r.randint(0, 300))]
    runs = packing.plan(Counter(lengths), 40)
    rooms, item = {}, 0
    ordered = sorted(lengths, reverse=True)
    bounds = [x[0] for x in runs] + [len(lengths)]
    for (start, per, first, offset, length), stop in zip(runs, bounds[1:], strict=False):
        assert start == item
        for k in range(stop - start):
            seq = first + k // per
            assert ordered[item] == length and rooms.get(seq, 0) == offset + k % per * length
            rooms[seq] = rooms.get(seq, 0) + length
            item += 1
    assert item == len(lengths)
    assert sorted(40 - v for v in rooms.values()) == first_fit_brute(lengths, 40)


def test_pack(odd_docs, no_docs, library):
    assert packing.pack(no_docs, PATH).count() == 0
    rows = packing.pack(odd_docs, PATH, 256).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 256
    want = []
    for d in odd_docs.collect():
        ids = ids_of(library, d.text) + bytes(4)
        want += [(str(d.doc_id), i, b // 4, len(ids[b : b + 1024]) // 4, crc32(ids[b : b + 1024])) for i, b in enumerate(range(0, len(ids), 1024))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert sorted(256 - sum(r.length for r in own) for own in by_sequence.values()) == first_fit_brute([x[3] for x in want], 256)


def greedy(vocabulary, word):
    symbols, at, n = (*word, token_counts.END), 0, 0
    while at < len(symbols):
        stop = next((j for j in range(len(symbols), at, -1) if symbols[at:j] in vocabulary), None)
        if stop is None:
            return 1
        n, at = n + 1, stop
    return n


def test_automaton_is_greedy_longest_match():
    r = random.Random(1)
    for _ in range(300):
        vocabulary = {tuple(r.choice(b"abc") for _ in range(r.randint(1, 4))) + ((token_counts.END,) if r.random() < 0.4 else ()) for _ in range(r.randint(1, 12))} | {(token_counts.END,)} - ({(token_counts.END,)} if r.random() < 0.5 else set())
        automaton = token_counts.Automaton(vocabulary)
        for _ in range(20):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 9)))
            assert automaton.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_count_tokens(odd_docs, no_docs):
    assert token_counts.count_tokens(no_docs, PATH).count() == 0
    vocabulary = token_counts.vocabulary(PATH)
    want = sorted((str(r.doc_id), sum(greedy(vocabulary, w) for w in (r.text or "").encode().lower().split())) for r in odd_docs.where("length(text) < 1000 or text is null").collect())
    got = sorted((str(r.doc_id), r.n_pieces) for r in token_counts.count_tokens(odd_docs.where("length(text) < 1000 or text is null"), PATH).collect())
    assert got == want
