"""Packing of sentences and blocks into chunks, as folds over arrays: no rows leave the JVM, and a group is one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import normal

#: Where a sentence ends.
SENTENCE_END = r"(?<=[.!?。！？])\s+"
BLOCK = "struct<text:string,kind:string>"


def checked(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to under size")


def sentence_pieces(text: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of at most size characters made of whole sentences, each beginning with the end of the piece before.

    A text that fits is one piece. If a sentence alone is too long, the text is cut into windows instead.
    """
    checked(size, overlap)
    sentences = F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")
    none = F.array().cast("array<string>")

    def add(acc: Column, s: Column) -> Column:
        now = acc["now"]
        longer = F.trim(F.concat(now, F.lit(" "), s))
        full = (now != "") & (F.length(longer) > size)
        rest = F.ltrim(F.substring(now, F.greatest(F.length(now) - overlap, F.lit(0)) + 1, F.lit(overlap)))
        return F.struct(F.when(full, F.concat(acc["out"], F.array(now))).otherwise(acc["out"]).alias("out"), F.when(full, F.trim(F.concat(rest, F.lit(" "), s))).otherwise(longer).alias("now"))

    packed = F.aggregate(sentences, F.struct(none.alias("out"), F.lit("").alias("now")), add, lambda a: F.when(a["now"] != "", F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))
    step = size - overlap
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int"), F.lit(1)) - 1), lambda i: F.trim(F.substring(text, i * step + 1, F.lit(size))))
    whole = (F.size(sentences) > 1) & F.forall(sentences, lambda s: F.length(s) <= size)
    return F.when(F.length(text) <= size, F.array(text)).when(whole, packed).otherwise(F.filter(windows, lambda w: w != ""))


def joined_length(blocks: Column) -> Column:
    """Characters of blocks joined by an empty line; 0 for none."""
    return F.greatest(F.aggregate(blocks, F.lit(-2), lambda n, b: n + F.length(b["text"]) + 2), F.lit(0))


def overlap_blocks(blocks: Column, overlap: int) -> Column:
    """The last blocks that make up overlap characters at most, but one at least; none for an overlap of 0."""
    none = F.array().cast(f"array<{BLOCK}>")
    if not overlap:
        return none

    def take(acc: Column, b: Column) -> Column:
        more = acc["size"] + F.length(b["text"])
        stop = acc["done"] | (F.size(acc["out"]) > 0) & (more > overlap)
        return F.struct(F.when(stop, acc["out"]).otherwise(F.concat(F.array(b), acc["out"])).alias("out"), F.when(stop, acc["size"]).otherwise(more).alias("size"), (stop | (more >= overlap)).alias("done"))

    return F.aggregate(F.reverse(blocks), F.struct(none.alias("out"), F.lit(0).alias("size"), F.lit(False).alias("done")), take, lambda a: a["out"])


def crosses(a: Column, b: Column) -> Column:
    """Whether two kinds of content must not share a chunk: verified and unverified tables."""
    return (a == "table") & (b == "unverified_table") | (a == "unverified_table") & (b == "table")


def chunk_groups(blocks: Column, size: int, overlap: int = 0) -> Column:
    """Blocks packed in order into chunks of at most size characters, as arrays of blocks; no chunk crosses the trust boundary."""
    checked(size, overlap)
    none, empty = F.array().cast(f"array<array<{BLOCK}>>"), F.array().cast(f"array<{BLOCK}>")

    def fit(carried: Column, b: Column) -> Column:
        # the longest suffix with which the block still fits
        return F.aggregate(carried, F.struct(carried.alias("left")), lambda a, _: F.struct(F.when(joined_length(F.concat(a["left"], F.array(b))) > size, F.slice(a["left"], 2, F.greatest(F.size(a["left"]) - 1, F.lit(0)))).otherwise(a["left"]).alias("left")), lambda a: a["left"])

    def add(acc: Column, b: Column) -> Column:
        now = acc["now"]
        border = F.exists(now, lambda x: crosses(x["kind"], b["kind"]))
        full = (F.size(now) > 0) & (border | (joined_length(F.concat(now, F.array(b))) > size))
        carried = F.when(border, empty).otherwise(fit(overlap_blocks(now, overlap), b)) if overlap else empty
        return F.struct(F.when(full, F.concat(acc["out"], F.array(now))).otherwise(acc["out"]).alias("out"), F.concat(F.when(full, carried).otherwise(now), F.array(b)).alias("now"))

    return F.aggregate(blocks, F.struct(none.alias("out"), empty.alias("now")), add, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))


def chunk_pages(blocks: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """doc_id, page, chunk, text and content_type of the chunks of each page. blocks: doc_id, page, place, text and kind.

    Blocks that are too long are cut at sentences first. A page is one group; chunks never span pages.
    """
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("place", "text", "kind"))).alias("b"))
    parts = F.flatten(F.transform("b", lambda b: F.transform(sentence_pieces(b["text"], size, overlap), lambda t: F.struct(t.alias("text"), b["kind"].alias("kind")))))
    each = pages.select("doc_id", "page", F.posexplode(chunk_groups(parts, size, overlap)).alias("chunk", "b"))
    kinds = F.array_distinct(F.transform("b", lambda b: b["kind"]))
    kind = F.when(F.array_contains(kinds, "unverified_table"), "unverified_table").when(F.size(kinds) == 1, F.get(kinds, 0)).otherwise("mixed")
    return each.select("doc_id", "page", "chunk", F.array_join(F.transform("b", lambda b: b["text"]), "\n\n").alias("text"), kind.alias("content_type"))


def merged_paragraphs(first: Column, second: Column) -> Column:
    """Two texts as one, each paragraph once by its normal form."""
    parts = F.transform(F.concat(F.split(first, "\n\n"), F.split(second, "\n\n")), lambda p: F.struct(normal(p).alias("key"), F.trim(p).alias("p")))
    once = F.filter(parts, lambda x, i: (x["key"] != "") & (F.array_position(F.transform(parts, lambda y: y["key"]), x["key"]) == i + 1))
    return F.array_join(F.transform(once, lambda x: x["p"]), "\n\n")


#: Fixed value: characters below which a chunk joins a neighbour.
LEAST_MERGED = 80
SECTIONED = "struct<text:string,kind:string,section:string>"


def merge_small(chunks: Column, least: int = LEAST_MERGED) -> Column:
    """A page's chunks (text, kind, section) with those that are under least characters, or only their section's heading, joined to the next;
    a small one at the end joins the one before. Nothing joins across the border of trust.

    Lengths are of the normal form. A joined chunk holds each paragraph once, is unverified if a part is, and takes the section of what
    follows a heading. Null texts and sections are empty.
    """
    part = lambda text, kind, section: F.struct(text.alias("text"), kind.alias("kind"), section.alias("section"))
    plain = F.transform(chunks, lambda c: part(F.coalesce(c["text"], F.lit("")), c["kind"], F.coalesce(c["section"], F.lit(""))))
    bare = lambda c: normal(c["text"]) == normal(c["section"])
    small = lambda c: (F.length(normal(c["text"])) < least) | bare(c)
    none = F.array().cast(f"array<{SECTIONED}>")

    def joined(a: Column, b: Column) -> Column:
        either = (a["kind"] == "unverified_table") | (b["kind"] == "unverified_table")
        kind = F.when(either, "unverified_table").when(a["kind"] == b["kind"], a["kind"]).otherwise("mixed")
        return part(merged_paragraphs(a["text"], b["text"]), kind, F.when(bare(a) & ~bare(b), b["section"]).otherwise(a["section"]))

    def onward(acc: Column, c: Column) -> Column:
        now = acc["now"]
        join = small(now) & ~crosses(now["kind"], c["kind"])
        return F.struct(F.when(join, acc["out"]).otherwise(F.concat(acc["out"], F.array(now))).alias("out"), F.when(join, joined(now, c)).otherwise(c).alias("now"))

    def back(acc: Column, c: Column) -> Column:
        now = acc["now"]
        join = (F.size(acc["kept"]) == 0) & small(now) & ~crosses(c["kind"], now["kind"])
        return F.struct(F.when(join, acc["kept"]).otherwise(F.concat(F.array(c), acc["kept"])).alias("kept"), F.when(join, joined(c, now)).otherwise(now).alias("now"))

    first = F.struct(none.alias("out"), F.get(plain, 0).alias("now"))
    forward = F.aggregate(F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0))), first, onward)
    ended = F.transform(F.array(forward), lambda f: F.aggregate(F.reverse(f["out"]), F.struct(none.alias("kept"), f["now"].alias("now")), back, lambda a: F.concat(a["kept"], F.array(a["now"]))))
    return F.when(F.size(chunks) > 0, F.get(ended, 0)).otherwise(none)


def merge_small_chunks(chunks: DataFrame, least: int = LEAST_MERGED) -> DataFrame:
    """doc_id, page, chunk, text, kind and section after merge_small. chunks: doc_id, page, place, text, kind and section; a page is one group."""
    pages = chunks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("place", "text", "kind", "section"))).alias("b"))
    parts = F.transform("b", lambda b: F.struct(*(b[c].alias(c) for c in ("text", "kind", "section"))))
    return pages.select("doc_id", "page", F.posexplode(merge_small(parts, least)).alias("chunk", "b")).select("doc_id", "page", "chunk", "b.*")
