"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is cut into pre-tokens on its own. Matching runs from left to right and
looks ahead only, so once two neighbours put a pre-token boundary at the same place, they agree from there on: the first such
place in an overlap is where they are stitched. White space looks ahead to what follows it, so a place behind white space is
no stitch: a piece that ended there would be cut otherwise than the text. The pieces between stitches are encoded one by one,
and their ids put together in order. Chunks that never meet (such as a run of letters longer than the overlap) are one chunk.
Decoding concatenates the bytes of the ids.

The chunks of one text are done by one task up to a share of them. A longer text is dealt out in shares, which overlap and are
stitched like chunks; where two shares never meet, the text is put together again and done by one task.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, materialize, per_worker

#: Code points of a chunk, of what it has in common with the next one, and of the chunks that one task takes of a text.
CHUNK = 1024
OVERLAP = 256
SHARE = 32_768
#: Boundaries so close to the end of what a chunk sees could still move.
MARGIN = 8

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encodes and decodes by a rank file."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        self.pattern = pattern or public_tokenizers.PATTERN
        with open(path or default_path(), "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.regex = regex.compile(self.pattern)
        top = max(self.ranks.values()) + 1
        self.bytes_of, self.digits_of = [b""] * top, [""] * top
        for token, rank in self.ranks.items():
            self.bytes_of[rank], self.digits_of[rank] = token, str(rank)

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens begin."""
        return [m.start() for m in self.regex.finditer(text)]

    def stitches(self, text: str, chunk: int, overlap: int, size: int | None = None, more: bool = False):
        """Where the chunks of the first `size` code points of text are stitched; and the places in the overlaps with what
        comes before and behind where neighbours could be. text goes on for an overlap behind `size` if there is `more`."""
        size = len(text) if size is None else size
        met: list[int] = []
        head: list[int] | None = None
        tail: set[int] = set()
        origin = 0
        for at in range(0, max(size, 1), chunk):
            own = min(at + chunk, size)
            seen = self.places(text, at, own + overlap, more)
            if head is None:
                head = [b for b in seen if b < overlap]
            else:
                joint = next((b for b in seen if b in tail), None)
                if joint is None:
                    seen = self.places(text, origin, own + overlap, more)
                else:
                    met.append(joint)
                    origin = at
            tail = {b for b in seen if b >= own}
        return met, head, sorted(tail)

    def places(self, text: str, begin: int, end: int, more: bool) -> list[int]:
        """Boundaries of text[begin:end], as places in text, but those behind white space and those that the end could move."""
        sure = end - MARGIN if more or end < len(text) else len(text)
        return [begin + b for b in self.boundaries(text[begin:end]) if b and begin + b < sure and not text[begin + b - 1].isspace()]

    def encode(self, text: str, at: list[int] | None = None) -> list[int]:
        """The ids of text, piece by piece between the places in at."""
        edges = [0, *(at or []), len(text)]
        ids: list[int] = []
        for a, b in zip(edges, edges[1:]):
            ids += self.encoding.encode_ordinary(text[a:b])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def digits(self, ids: list[int]) -> str:
        return " ".join([self.digits_of[i] for i in ids])


def codec(path: str | None = None) -> Codec:
    path = path or default_path()
    return per_worker(f"bytebpe:{path}", lambda: Codec(path))


def _by_one_task(docs: DataFrame, chunk: int, overlap: int, path: str | None) -> DataFrame:
    """All chunks of a text in one task."""

    def start():
        c = codec(path)

        def work(rows):
            out = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                text = text or ""
                ids = c.encode(text, c.stitches(text, chunk, overlap)[0])
                out["doc_id"].append(doc)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(c.digits(ids).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
            return out

        return work

    return map_slices(docs.select("doc_id", "text"), ENCODED, start)


def shares(docs: DataFrame, share: int = SHARE, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping shares of texts(row, doc_id, text): part i holds [i * share, (i + 1) * share + overlap). more: not the last."""

    def start():
        def work(rows):
            out = {k: [] for k in ("row", "doc_id", "part", "more", "text")}
            for row, doc, text in zip(rows["row"], rows["doc_id"], rows["text"], strict=True):
                for part, at in enumerate(range(0, len(text), share)):
                    out["row"].append(row)
                    out["doc_id"].append(doc)
                    out["part"].append(part)
                    out["more"].append(at + share < len(text))
                    out["text"].append(text[at : at + share + overlap])
            return out

        return work

    return map_slices(docs.select("row", "doc_id", "text"), "row long, doc_id long, part int, more boolean, text string", start, 16)


def pre_tokenise(parts: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP, share: int = SHARE, path: str | None = None) -> DataFrame:
    """Adds where the chunks of each share are stitched, and the places where it can meet its left neighbour (head) and its
    right one (tail), all as places in the text."""

    def start():
        c = codec(path)

        def work(rows):
            for k in ("inner", "head", "tail"):
                rows[k] = []
            for part, more, text in zip(rows["part"], rows["more"], rows["text"], strict=True):
                # What the last share has in common with the one before is also its own.
                for k, places in zip(("inner", "head", "tail"), c.stitches(text, chunk, overlap, min(share, len(text)), more), strict=True):
                    rows[k].append([part * share + b for b in places])
            return rows

        return work

    return map_slices(parts, "row long, doc_id long, part int, more boolean, text string, inner array<int>, head array<int>, tail array<int>", start, 32)


def stitch(parts: DataFrame) -> DataFrame:
    """The piece that each share encodes: from its stitch with the left neighbour to that with the right one. met is false
    if they never meet."""
    order = Window.partitionBy("row").orderBy("part")
    following = F.lead("head").over(order)
    joint = F.when(following.isNotNull(), F.array_min(F.array_intersect("tail", following)))
    parts = parts.withColumn("last", following.isNull()).withColumn("until", joint)
    parts = parts.withColumn("from", F.when(F.col("part") == 0, F.lit(0)).otherwise(F.lag("until").over(order)))
    met = F.col("from").isNotNull() & (F.col("last") | F.col("until").isNotNull())
    return parts.withColumn("met", F.min(met).over(Window.partitionBy("row")))


def _pieces(stitched: DataFrame, share: int, path: str | None) -> DataFrame:
    def start():
        c = codec(path)

        def work(rows):
            out = {k: [] for k in ("row", "doc_id", "part", "n", "digits", "bytes")}
            for row, doc, part, text, inner, a, b in zip(*(rows[k] for k in ("row", "doc_id", "part", "text", "inner", "from", "until")), strict=True):
                base = part * share
                ids = c.encode(text[a - base : None if b is None else b - base], [x - a for x in inner])
                out["row"].append(row)
                out["doc_id"].append(doc)
                out["part"].append(part)
                out["n"].append(len(ids))
                out["digits"].append(c.digits(ids))
                # Pieces begin and end between code points, so the bytes of each are whole UTF-8.
                out["bytes"].append(c.decode(ids).decode())
            return out

        return work

    return map_slices(stitched.select("row", "doc_id", "part", "text", "inner", "from", "until"), "row long, doc_id long, part int, n long, digits string, bytes string", start, 32)


def encode_documents(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, share: int = SHARE) -> DataFrame:
    """Ids of documents(doc_id, text), as digests, and the digest of the bytes that they decode to.

    A null text is empty, and an empty text has no ids and the digests of nothing. Repeated rows give repeated rows, other
    columns are left out, an empty table gives no rows. Only texts longer than a share are dealt out.
    """
    if not 0 < overlap <= chunk or share % chunk:
        raise ValueError("chunks are at least as long as their overlap, and shares are whole chunks")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    long = F.coalesce(F.length("text") > share, F.lit(False))
    short = _by_one_task(docs.where(~long), chunk, overlap, path)
    # A row number that a retried task finds again: the place of the row in its input split.
    numbered = docs.where(long).withColumn("row", F.monotonically_increasing_id())
    spread = shares(numbered, share, overlap).repartition("row", "part")
    cut = materialize(pre_tokenise(spread, chunk, overlap, share, path), "shares")
    # Only the boundaries go through the window; the texts of the shares join their stitches.
    stitched = stitch(cut.select("row", "part", "head", "tail")).select("row", "part", "from", "until", "met")
    joined = cut.select("row", "doc_id", "part", "text", "inner").join(stitched, ["row", "part"])
    done = _pieces(joined.where("met"), share, path)
    whole = (
        done.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "digits", "bytes"))).alias("parts"))
        .select(
            "doc_id",
            "n_tokens",
            F.sha2(F.concat_ws(" ", F.filter(F.col("parts.digits"), lambda x: x != "")), 256).alias("ids_sha256"),
            F.sha2(F.concat_ws("", "parts.bytes"), 256).alias("decoded_sha256"),
        )
    )
    # Texts whose shares never met are put together again from the part that each share has alone.
    apart = (
        joined.where(~F.col("met"))
        .groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", F.substring("text", 1, share).alias("text")))).alias("parts"))
        .select("doc_id", F.concat_ws("", "parts.text").alias("text"))
    )
    # One chunk as long as the text: stitching chunks that never met would scan it again and again.
    return short.unionByName(whole).unionByName(_by_one_task(apart, 1 << 31, overlap, path))


def op9_overlapping_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return encode_documents(read(spark, sf_dir, "documents"))
