"""BPE encoding and decoding, with tree concatenation for long texts.

A text of up to LEAF code points is encoded at once. A longer one is halved until its parts are that short; the parts are
encoded in parallel as rows of their own, wherever the cuts fall. Neighbours are then joined pairwise up the tree: a window around
the join is encoded anew and grows until it agrees with both sides at its outer ends.

Where pieces of the pattern begin near the join, the window grows to such a place on either side: what lies beyond cannot act on it.
Within one long run of letters it grows by tokens instead, and stops once a token of the window and one of the side meet
as the merges alone would have them: a sequence is the BPE encoding of its text exactly if each two neighbours in it are that of theirs.
So far more than the window is encoded anew only if such a place is far away and the text holds other marks than letters up to there.

Rules for odd input: a null text is the empty text and has no ids; very long texts are encoded whole; repeated rows give repeated rows, and
ties need no rule as rows are apart; a null id stays null; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidara.llm.common import DROP, small, spread

#: Code points in a part that is encoded at once.
LEAF = 32_768
#: Pieces that each Python worker remembers for good, and those met once of late that wait to be met again (some 50 MB in all).
REMEMBERED, WAITING = 160_000, 80_000
#: Rows that are encoded together.
TOGETHER = 1000
#: Marks a text that is not plain Latin: a control that the library does not take for white space, or a letter past Latin Extended-B (or the
#: dotted capital I, whose lower case is two characters).
STRANGE = "[\\x1c-\\x1f\\x{130}]|[^\\x00-\\x{24f}]"
WORD_AND_MARKS = "^(?P<word>[^\\x00-@\\[-`{-\\x7f]+)(?P<marks>[.,;:!?]*)$"
#: Characters on each side of a join to begin with, those after which tokens are used instead, and tokens to begin with.
WINDOW, FAR, TOKENS = 64, 4096, 16


class Encoder:
    """Encodes like the tokenizer file that it reads (a word BPE with word ends), remembering what it has seen.

    White space parts a text into chunks that never act on each other. A chunk of Latin letters, digits and signs is split into
    pieces by the file's own pattern; the library runs the merges of unseen pieces, all of a batch at once. Chunks with other
    characters, and texts that name a special token, go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "[^\\x00-\\x{10ffff}]"
        self.specials = re.compile(self.special if spec["added_tokens"] else "(?!)")
        self.pieces_of = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        plain = spec | {"normalizer": None, "added_tokens": []}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.path = path
        self.end = spec["model"]["end_of_word_suffix"]
        #: Outside: a control that the library does not take for white space, or anything past Latin Extended-B.
        self.odd = re.compile("[\x1c-\x1f]|[^\x00-ɏ]")
        self.controls = re.compile("[\x1c-\x1f]")
        self.known: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    @cached_property
    def texts(self) -> list[str]:
        """The text of each token. This and the next are read only where texts are joined or decoded, as they take tens of megabytes."""
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        out = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            out[i] = name
        return out

    @cached_property
    def names(self) -> list[bytes]:
        return [n.encode() for n in self.texts]

    @cached_property
    def ends(self) -> np.ndarray:
        return np.array([n.endswith(self.end) for n in self.texts])

    @cached_property
    def ranks(self) -> dict[tuple[str, ...], int]:
        with open(self.path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        return {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}

    def encode_batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Each distinct chunk of a batch is looked up once."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        if len(self.once) > WAITING:
            self.once = {}
        if len(self.known) > REMEMBERED:
            self.known = {}
        strange = pc.or_(pc.match_substring_regex(texts, STRANGE), pc.match_substring_regex(texts, self.special))
        chunks = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(strange, "", texts)))
        coded = chunks.values.dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy()
        # a word, or a word and the marks that end it, is one piece or two; other chunks are left to the pattern
        parts = pc.extract_regex(distinct, WORD_AND_MARKS)
        word, marks = (pc.fill_null(pc.struct_field(parts, name), "") for name in ("word", "marks"))
        by_pattern = pc.and_not(pc.greater(pc.binary_length(distinct), 0), pc.utf8_is_alpha(word))
        pieces = pa.chunked_array([pc.if_else(by_pattern, "", word), pc.if_else(by_pattern, "", marks)]).combine_chunks().dictionary_encode()
        # as a NumPy array first, which makes strings of all of them several times faster than to_pylist()
        ids = self.ids_of_pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        hard = np.flatnonzero(by_pattern.to_numpy(zero_copy_only=False))
        piece = pieces.indices.to_numpy().reshape(2, -1).T.copy()
        piece[hard, 0] = len(ids) + np.arange(len(hard))
        ids = [*ids, *self.ids_of(distinct.take(pa.array(hard)).to_numpy(zero_copy_only=False).tolist())]
        # the ids of all pieces, laid out one after the other, are dealt to the chunks
        width = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(width) - width
        piece = piece[code].ravel()
        many = width[piece]
        stop = np.cumsum(many)
        flat = np.frombuffer(b"".join(ids), np.dtype("<u4"))[np.repeat(start[piece] - (stop - many), many) + np.arange(many.sum())]
        bounds = np.r_[0, stop][2 * (chunks.offsets.to_numpy() - chunks.offsets[0].as_py())].tolist()
        out = [flat[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode_strange(texts[i].as_py())
        return out

    def encode_strange(self, text: str) -> bytes:
        """A text with characters that are not plain Latin, or with a special token."""
        if self.specials.search(text) or self.controls.search(text):
            return self.by_library([text])[0]
        return b"".join(self.ids_of(text.split()))

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.dtype("<u4")).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of these distinct pieces (or none of the empty one); one met for the second time is known for good."""
        known, once = self.known, self.once
        out = list(map(known.get, pieces))
        missing = [i for i, ids in enumerate(out) if ids is None]
        unseen = []
        for i in missing:
            if (ids := once.pop(piece := pieces[i], None)) is not None:
                known[piece] = out[i] = ids
            elif piece:
                unseen.append(i)
            else:
                out[i] = b""
        if unseen:
            new = [pieces[i] for i in unseen]
            for i, piece, ids in zip(unseen, new, self.merged(new), strict=True):
                once[piece] = out[i] = ids
        return out

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, by the file's pattern if it is Latin."""
        strange = [c for c in chunks if not c.isascii() and self.odd.search(c)]
        by_library = dict(zip(strange, self.by_library(strange), strict=True))
        split = [[] if c in by_library else self.pieces_of(c.lower()) for c in chunks]
        pieces = list({p for ps in split for p in ps})
        got = dict(zip(pieces, self.ids_of_pieces(pieces), strict=True)).__getitem__
        return [by_library[c] if c in by_library else b"".join(map(got, ps)) for c, ps in zip(chunks, split, strict=True)]

    def merged(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of each piece, in one call of the library."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.dtype("<u4"))
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        return map(ids.tobytes().__getitem__, map(slice, [0, *stops[:-1]], stops))

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' names with one space between, as a tokenizer without a decoder gives."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, np.dtype("<u4")).tolist()))

    def inside(self, i: int) -> bool:
        """Whether a token begins within a character."""
        return 0x80 <= BYTES[self.texts[i][0]] < 0xC0

    def meet(self, a: int, b: int) -> bool:
        """Whether the merges leave the text of two tokens as these two."""
        left, right = self.texts[a], self.texts[b]
        closed = right.endswith(self.end)
        symbols = list(left + right.removesuffix(self.end))
        if closed:
            symbols[-1] += self.end
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols == [left, right]


#: The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTES = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SHOWN)}

_loaded: dict[str, Encoder] = {}
DROP.append(_loaded.clear)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def halves(text: str, most: int = LEAF) -> list[str]:
    """The leaves of the tree, left to right."""
    if len(text) <= most:
        return [text]
    mid = len(text) // 2
    return [*halves(text[:mid], most), *halves(text[mid:], most)]


def join_pair(enc: Encoder, left: str, lid: bytes, right: str, rid: bytes, window: int = WINDOW) -> bytes:
    """Ids of left + right from the ids of each."""
    if left[-1:].isalpha() and right[:1].isalpha() and "'" not in left[-3:] and (begin_near(left, -FAR) is None or begin_near(right, FAR) is None):
        if (ids := join_letters(enc, np.frombuffer(lid, np.dtype("<u4")), np.frombuffer(rid, np.dtype("<u4")))) is not None:
            return ids
    whole = enc.specials.search(left[-4 * FAR :] + right[: 4 * FAR]) is not None
    while True:
        # a rim must begin where pieces do (or at the text's end), else its own ids depend on what lies outside the window
        a, b = max(0, len(left) - window), min(len(right), window)
        while 0 < a and not begins(left, a, whole):
            a -= 1
        while b < len(right) and not begins(right, b, whole):
            b += 1
        tail, head = left[a:], right[:b]
        old_tail, old_head = enc.encode(tail), enc.encode(head)
        if lid.endswith(old_tail) and rid.startswith(old_head):
            return lid[: len(lid) - len(old_tail)] + enc.encode(tail + head) + rid[len(old_head) :]
        if a == 0 and b == len(right):
            return enc.encode(left + right)
        window *= 4


def begins(text: str, at: int, space_only: bool) -> bool:
    """Whether a piece begins here, whatever lies before and after: at white space, or at a sign after a letter or around a digit.

    Near a special token only white space tells.
    """
    c = text[at]
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return True
    before = text[at - 1]
    if space_only or not c.isascii() or not before.isascii():
        return False
    return c.isdigit() or before.isdigit() or before.isalpha() and not c.isalpha()


def begin_near(text: str, far: int) -> int | None:
    """The nearest place to an end of the text (the last one if far is negative) where a piece begins, unless it is far."""
    n = len(text)
    places = range(n - 1, max(0, n + far), -1) if far < 0 else range(1, min(n, far))
    return next((i for i in places if begins(text, i, False)), 0 if far < 0 and n < -far else n if 0 < n < far else None)


def join_letters(enc: Encoder, left: np.ndarray, right: np.ndarray) -> bytes | None:
    """Ids of two sides whose join lies within a run of letters; None if the run's bytes do not part at characters.

    The window has some tokens of both sides. A side's own tokens are taken up to where one of its places between two tokens is
    such a place of the window too, and the tokens that meet there are left as they are by the merges.
    """
    k = TOKENS
    while True:
        tail, head = run_back(enc, left, k), run_on(enc, right, k)
        # at the run's own ends nothing is left to agree
        first, last = len(tail) < k, len(head) < k or len(head) == len(right)
        while not first and tail and enc.inside(tail[0]):
            tail = tail[1:]
        while not last and head and enc.inside(int(right[len(head)])):
            head = head[:-1]
        names = [enc.texts[i].removesuffix(enc.end) for i in (*tail, *head)]
        try:
            text = bytes(BYTES[c] for n in names for c in n).decode()
        except UnicodeDecodeError:
            return None
        if not text.isalpha() or text != text.lower():
            return None
        middle = np.frombuffer(next(enc.merged([text])), np.dtype("<u4"))
        widths = np.array([len(n) for n in names])
        place, inner = np.r_[0, np.cumsum(widths)], np.r_[0, np.cumsum([len(enc.texts[i].removesuffix(enc.end)) for i in middle])]
        begin = (0, 0) if first else agreed(enc, left, len(left) - len(tail), place[: len(tail) + 1], middle, inner, True)
        stop = (len(head), len(middle)) if last else agreed(enc, right, 0, place[len(tail) :], middle, inner, False)
        if begin is not None and stop is not None and begin[1] <= stop[1]:
            return left[: len(left) - len(tail) + begin[0]].tobytes() + middle[begin[1] : stop[1]].tobytes() + right[stop[0] :].tobytes()
        k *= 2


def agreed(enc: Encoder, side: np.ndarray, start: int, places: np.ndarray, middle: np.ndarray, inner: np.ndarray, is_left: bool) -> tuple[int, int] | None:
    """How many of a side's tokens from start on, and how many of the window's, lie before the place where the two agree."""
    for i in range(len(places)) if is_left else range(len(places) - 1, -1, -1):
        m = int(np.searchsorted(inner, places[i]))
        if m == len(inner) or inner[m] != places[i]:
            continue
        at = start + i
        if is_left and 0 < at and m < len(middle) and enc.meet(int(side[at - 1]), int(middle[m])):
            return i, m
        if not is_left and at < len(side) and 0 < m and enc.meet(int(middle[m - 1]), int(side[at])):
            return i, m
    return None


def run_back(enc: Encoder, ids: np.ndarray, k: int) -> list[int]:
    """The last tokens (k at most) of the last piece."""
    out = []
    for i in ids[::-1][:k].tolist():
        if out and enc.ends[i]:
            break
        out.append(i)
    return out[::-1]


def run_on(enc: Encoder, ids: np.ndarray, k: int) -> list[int]:
    """The first tokens (k at most) of the first piece; if that is all of it, there are fewer."""
    out = []
    for i in ids[:k].tolist():
        out.append(i)
        if enc.ends[i]:
            return out if len(out) < k else out[:-1]
    return out


def join_tree(enc: Encoder, parts: list[tuple[str, bytes]]) -> bytes:
    """Ids of all parts' texts run together: neighbours are joined, then the joined ones, up to the root."""
    while len(parts) > 1:
        up = [(l[0] + r[0], join_pair(enc, l[0], l[1], r[0], r[1])) for l, r in zip(parts[::2], parts[1::2])]
        parts = up + parts[len(up) * 2 :]
    return parts[0][1]


Finish = Callable[[Encoder, list[bytes]], list[pa.Array]]


def encoded(docs: DataFrame, path: str, names: list[str], schema: str, finish: Finish, leaf: int = LEAF) -> DataFrame:
    """doc_id and what finish makes of the ids of each document's whole text, in the task that has them."""
    docs = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    is_long = F.length("text") > leaf
    names = ["doc_id", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small(batches, TOGETHER):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *finish(enc, enc.encode_batch(batch["text"]))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, text in zip(batch["uid"], batch["doc_id"], batch["text"], strict=True):
                parts = halves(text.as_py(), leaf)
                yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()] * len(parts), pa.int64()), pa.array([doc_id.as_py()] * len(parts), batch["doc_id"].type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["uid", "doc_id", "part", "text"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                few = batch.slice(at, 16)
                yield few.append_column("ids", pa.array(enc.encode_batch(few["text"]), pa.binary()))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for doc_id, parts in zip(batch["doc_id"], batch["parts"], strict=True):
                ids = join_tree(enc, [(p["text"], p["ids"]) for p in parts.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], batch["doc_id"].type), *finish(enc, [ids])], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    short = docs.where(~is_long).mapInArrow(run, f"doc_id {kind}, {schema}")
    leaves = docs.where(is_long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(cut, f"uid long, doc_id {kind}, part int, text string")
    # every leaf is dealt by its place, so that the parts of one text are encoded by several tasks
    spread_out = leaves.repartition(F.col("uid"), F.col("part")).mapInArrow(each, f"uid long, doc_id {kind}, part int, text string, ids binary")
    gathered = spread_out.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("part", "text", "ids"))).alias("parts"))
    return short.unionByName(gathered.mapInArrow(join, f"doc_id {kind}, {schema}"))


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (binary) of every document's whole text."""
    return encoded(docs, path, ["ids"], "ids binary", lambda enc, ids: [pa.array(ids, pa.binary())], leaf)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""

    def digests(enc: Encoder, ids: list[bytes]) -> list[pa.Array]:
        decoded = [sha256(enc.decode(x)).hexdigest() for x in ids]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())]

    return encoded(docs, path, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of each row of ids."""
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small(batches):
            texts = [enc.decode(x).decode("utf-8") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
