"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The trie of the vocabulary gets failure links; each link knows how many pieces are popped when it is followed, so counting
needs one step for each byte of a word and never builds a piece.

Rules for odd input: a null or empty text has no pieces; a word that the vocabulary cannot spell counts as one unknown
piece; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import small, spread, text_bytes

#: The symbol after the last byte of a word.
END = 256
REMEMBERED = 600_000


class Automaton:
    """Counts greedy longest-match pieces. vocabulary: tuples of symbols, of which END may only be the last."""

    def __init__(self, vocabulary: set[tuple[int, ...]]) -> None:
        self.next: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        whole = [False]
        for piece in vocabulary:
            at = 0
            for symbol in piece:
                to = self.next.get(at << 9 | symbol)
                if to is None:
                    to = len(whole)
                    self.next[at << 9 | symbol] = to
                    children[at].append((symbol, to))
                    children.append([])
                    whole.append(False)
                at = to
            whole[at] = bool(piece)
        #: Where to go on when no child fits (-1: nowhere), and how many pieces that pops.
        self.fail, self.pops = [-1] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for symbol, to in children[at]:
                queue.append(to)
                if whole[to]:
                    self.fail[to], self.pops[to] = 0, 1
                    continue
                back, popped = self.fail[at], self.pops[at]
                while back >= 0 and back << 9 | symbol not in self.next:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[to], self.pops[to] = self.next[back << 9 | symbol], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (unknown) if it cannot be spelt."""
        at, n = 0, 0
        for symbol in (*word, END):
            while (to := self.next.get(at << 9 | symbol)) is None:
                n += self.pops[at]
                at = self.fail[at]
                if at < 0:
                    return 1
            at = to
        while at:
            n += self.pops[at]
            at = self.fail[at]
            if at < 0:
                return 1
        return n


def byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> set[tuple[int, ...]]:
    """The pieces of a tokenizer file; one with the word end closes a word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, of = model["end_of_word_suffix"], byte_of_char()
    out = set()
    for name in model["vocab"]:
        last = len(name) > len(end) and name.endswith(end)
        body = name[: -len(end)] if last else name
        out.add((*(of[c] for c in body), *([END] if last else [])))
    return out


_loaded: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_pieces of each whole text, its words taken at white space and in lower case."""
    rows = text_bytes(spread(docs), F.col("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Automaton(vocabulary(path)), {}
        automaton, known = _loaded[path]
        for batch in small(batches):
            words, counts = [], []
            for text in batch["text"].to_pylist():
                split = text.lower().split()
                for w in set(split).difference(known):
                    known[w] = automaton.count(w)
                words.append(len(split))
                counts.append(sum(map(known.__getitem__, split)))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_words", "n_pieces"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_pieces long")
