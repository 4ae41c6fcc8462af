"""Media columns: interleaved document sequences with payloads resolved by digest.

HTML is parsed into an ordered array of text and media-reference structs. Media are stored once per digest of their
payload, as grey-scale PNG images of 8-bit samples, 64 to a row. References find their media by a join on the digest, and
keep the position and the caption that they have in their sequence.

Media lie in packs, one file per task that stored some, and an index table says where each digest's bytes are. The digest
join resolves a reference to that place; then the task that has a pack's references reads their payloads from it. So large
payloads are written once and read where they are asked for, and never shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import filesystem, map_slices, materialize, qualified, read, shared_path, ship

#: Bytes of a pack that one task reads at a time of dealing out.
PACK_SHARE = 32 << 20
ROW_BYTES = 64
LEVEL = 1
CHUNK_BYTES = 1 << 20
PNG = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:"

ITEM = "struct<position:int,kind:string,text:string,src:string,digest:string,caption:string,n_bytes:long>"


def padded(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of the row length."""
    return data + bytes(-len(data) % ROW_BYTES or (0 if data else ROW_BYTES))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """A payload of whole rows as an image; the same payload gives the same bytes."""
    import numpy as np

    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)  # each line begins with its filter, 0 for none
    lines[:, 1:] = rows
    data = zlib.compress(lines.tobytes(), LEVEL)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW_BYTES, len(rows), 8, 0, 0, 0, 0))
    body = b"".join(_chunk(b"IDAT", data[at : at + CHUNK_BYTES]) for at in range(0, len(data), CHUNK_BYTES))
    return PNG + head + body + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The payload of an image that to_png() made; checks signature, checksums and size."""
    import numpy as np

    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if shape[2:] != (8, 0, 0, 0, 0) or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey samples are read here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Samples' mean, deviation, entropy in bits, and which of the 64 columns are lighter than the mean."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    mean = float(share @ np.arange(256))
    deviation = float(share @ (np.arange(256) - mean) ** 2) ** 0.5
    used = share[share > 0]
    columns = x.reshape(-1, ROW_BYTES).sum(axis=0, dtype=np.int64) * ROW_BYTES > int(x.sum(dtype=np.int64))
    light = np.packbits(columns).tobytes().hex()
    return f"rows={len(x) // ROW_BYTES};mean={mean:.4f};sd={deviation:.4f};entropy={abs(float(-(used * np.log2(used)).sum())):.4f};columns={light}"


INDEX = "digest string, pack string, at long, size long"


def store(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes packs of the media of documents(text) under path, and returns their index: (digest, pack, at, size), one row per
    digest. A null text is empty.

    A task leaves out what it has already stored; of copies that different tasks stored, which are equal, the index has one.
    A pack is written beside its place and moved there when it is whole, so a retried task leaves the same bytes.
    """
    spark = docs.sparkSession
    path = qualified(spark, path or shared_path(spark, "media"))

    def start():
        context = TaskContext.get()
        seen: set[bytes] = set()
        places = {k: [] for k in ("digest", "pack", "at", "size")}
        pack = f"{path}/media-{context.partitionId():07d}.pack"
        files = sink = None

        def work(rows):
            nonlocal files, sink
            for text in rows["text"]:
                payload = padded((text or "").encode())
                digest = hashlib.sha256(payload)
                if digest.digest() in seen:
                    continue
                seen.add(digest.digest())
                if sink is None:
                    files, folder = filesystem(path)
                    files.create_dir(folder, recursive=True)
                    sink = files.open_output_stream(f"{filesystem(pack)[1]}.{context.taskAttemptId()}", compression=None)
                media = to_png(payload)
                for k, v in (("digest", digest.hexdigest()), ("pack", pack), ("at", sink.tell()), ("size", len(media))):
                    places[k].append(v)
                sink.write(media)

        def finish():
            if sink is not None:
                sink.close()
                name = filesystem(pack)[1]
                files.move(f"{name}.{context.taskAttemptId()}", name)
            return places

        work.finish = finish
        return work

    placed = materialize(map_slices(docs.select("text"), INDEX, start), "media-index")
    return materialize(one_each(placed), "media-digests")


#: Bytes of media that a task reads at a time; one that is larger is read alone.
FETCH_BYTES = 16 << 20


def fetched(places: DataFrame, fetch_bytes: int = FETCH_BYTES) -> DataFrame:
    """(digest, media) of places(digest, pack, at, size): the stored bytes, read from the packs in their order. By the sizes
    that the index knows, a task holds fetch_bytes of them at a time, or one that is larger."""
    ship(places.sparkSession)
    schema = T.StructType.fromDDL("digest string, media binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        name, source = None, None
        for batch in batches:
            digests, media, held = [], [], 0
            for digest, pack, at, size in zip(*(batch.column(c).to_pylist() for c in ("digest", "pack", "at", "size")), strict=True):
                if digests and held + size > fetch_bytes:
                    yield pa.RecordBatch.from_pydict({"digest": digests, "media": media}, schema=arrow)
                    digests, media, held = [], [], 0
                if pack != name:
                    if source is not None:
                        source.close()
                    files, inside = filesystem(pack)
                    name, source = pack, files.open_input_file(inside)
                digests.append(digest)
                media.append(source.read_at(size, at))
                held += size
            if digests:
                yield pa.RecordBatch.from_pydict({"digest": digests, "media": media}, schema=arrow)
        if source is not None:
            source.close()

    asked = places.select("digest", "pack", "at", "size")
    spread = asked.repartition("pack", F.floor(F.col("at") / PACK_SHARE)).sortWithinPartitions("pack", "at")
    return spread.mapInArrow(run, schema)


def one_each(media: DataFrame) -> DataFrame:
    """One row per digest of a media table, or of a table of figures about media."""
    rest = [c for c in media.columns if c != "digest"]
    return media.groupBy("digest").agg(F.first(F.struct(*rest)).alias("_m")).select("digest", "_m.*")


def pages_of(docs: DataFrame) -> DataFrame:
    """A page per document that shows its payload: (doc_id, html). The digest of the padded text is its reference."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(data)
    pad = F.when(size == 0, ROW_BYTES).otherwise(F.pmod(-size, F.lit(ROW_BYTES)))
    payload = F.concat(data, F.substring(F.lit(bytes(ROW_BYTES)), F.lit(1), pad))
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit("<article><p>"), escape(F.col("source")), F.lit(f'</p><figure><img src="{SCHEME}'), F.sha2(payload, 256), F.lit('" data-bytes="'), size.cast("string"), F.lit('"><figcaption>'), escape(F.col("lang")), F.lit("</figcaption></figure></article>"))
    return docs.select(F.col("doc_id").cast("long"), html.alias("html"))


#: Elements that end a stretch of text; those of them without content, and those that may be left open; elements whose text is
#: no content; those that a head may have; and media elements.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
OPEN_ENDED = frozenset("br hr dd dt li p td th tr".split())
HIDDEN = frozenset("script style template noscript title".split())
IN_HEAD = HIDDEN | frozenset("base link meta".split())
MEDIA = frozenset("img video audio source".split())


def parser():
    """An HTML parser whose items() are the ordered stretches of text and media references of a page.

    A head ends where its content does, also without an end tag. A caption belongs to the media of its own figure, before or
    behind it, or, if that has none, to those of the figures within; it ends with the figure or with what is around it, if
    not before. A caption outside figures is text. A script or style that is never closed hides the rest, as in browsers.
    """
    from collections import Counter
    from html.parser import HTMLParser

    class Sequence(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.text, self.caption, self.figures = [], [], None, []
            self.open, self.count, self.hidden, self.head = [], Counter(), 0, False

        def flush(self):
            words = " ".join("".join(self.text).split())
            self.text = []
            if words:
                self.found.append({"kind": "text", "text": words, "src": None, "digest": None, "caption": None, "n_bytes": None})

        def reference(self, given):
            self.flush()
            src, size = given.get("src"), given.get("data-bytes") or ""
            digest = src[len(SCHEME) :] if (src or "").startswith(SCHEME) else None
            self.found.append({"kind": "media", "text": None, "src": src, "digest": digest, "caption": given.get("alt"), "n_bytes": int(size) if size.isdecimal() and size.isascii() and len(size) < 19 else None})
            if self.figures:
                self.figures[-1]["own"].append(len(self.found) - 1)

        def handle_starttag(self, tag, attrs):
            if tag == "head":
                self.head = True
                return
            self.head = self.head and tag in IN_HEAD
            if tag in HIDDEN:
                self.enter(tag)
                self.hidden += 1
            elif self.hidden or self.head:
                return
            elif tag in MEDIA:
                self.reference(dict(attrs))
            elif tag in BLOCKS:
                if tag in ("figure", "figcaption"):
                    self.leave("figcaption")
                if self.caption is None:
                    self.flush()
                else:
                    self.caption.append(" ")
                if tag == "figure":
                    self.figures.append({"own": [], "inner": [], "caption": None})
                elif tag == "figcaption" and self.figures:
                    self.caption = []
                if tag not in OPEN_ENDED:
                    self.enter(tag)

        def handle_endtag(self, tag):
            if tag == "head":
                self.head = False
            elif tag in HIDDEN or tag in BLOCKS and not self.hidden:
                self.leave(tag)
                if tag in HIDDEN:
                    return
                if self.caption is None:
                    self.flush()
                else:
                    self.caption.append(" ")

        def handle_data(self, data):
            if self.hidden or self.head and not data.strip():
                return
            self.head = False
            (self.text if self.caption is None else self.caption).append(data)

        def enter(self, tag):
            self.open.append(tag)
            self.count[tag] += 1

        def leave(self, tag):
            """Ends the innermost open element of this name, and all within it."""
            while self.count[tag]:
                last = self.open.pop()
                self.count[last] -= 1
                if last in HIDDEN:
                    self.hidden -= 1
                elif last == "figcaption" and self.caption is not None:
                    self.figures[-1]["caption"] = " ".join("".join(self.caption).split())
                    self.caption = None
                elif last == "figure":
                    self.flush()
                    self.captioned(self.figures.pop())
                if last == tag:
                    return

        def captioned(self, figure):
            both = figure["own"] + figure["inner"]
            if figure["caption"] is not None:
                for i in figure["own"] or figure["inner"]:
                    self.found[i]["caption"] = figure["caption"]
                both = figure["own"] and figure["inner"]
            if self.figures:
                self.figures[-1]["inner"] += both

        def items(self, html: str):
            self.feed(html)
            self.close()
            while self.open:
                self.leave(self.open[-1])
            self.flush()
            return [{"position": i, **x} for i, x in enumerate(self.found)]

    return Sequence()


def sequences(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """pages(key, html) as (key, items): texts and media references in the order of the page. A null page has no items."""

    def start():
        def work(rows):
            return {key: rows[key], "items": [parser().items(x) if x else [] for x in rows["html"]]}

        return work

    return map_slices(pages.select(F.col(key).cast("long").alias(key), "html"), f"{key} long, items array<{ITEM}>", start)


def resolve(sequenced: DataFrame, media: DataFrame) -> DataFrame:
    """One row per item of each sequence, with what media(digest, ...) knows of it, payloads or figures: key, position,
    kind, text, src, digest, caption, n_bytes, and the columns of media. Texts and unknown digests have nulls there; sequences
    without items give no rows. media has one row per digest, see one_each().

    A digest that very many items share stays a plain join key: Spark splits such partitions of the item side at run time.
    """
    keys = [c for c in sequenced.columns if c != "items"]
    items = sequenced.select(*keys, F.inline("items"))
    return items.join(media, "digest", "left")


FIGURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(media: DataFrame) -> DataFrame:
    """Figures of each row of media(digest, media), from its stored bytes read back."""

    def start():
        def work(rows):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for stored in rows["media"]:
                payload = from_png(stored)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-ROW_BYTES:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["feature"].append(feature(payload))
            return {"digest": rows["digest"]} | out

        return work

    return map_slices(media.select("digest", "media"), FIGURES, start)


def document_media(docs: DataFrame) -> DataFrame:
    """Stores the texts of documents(doc_id, text, lang, source) as media, and resolves the reference on each one's page.

    Each digest that the pages refer to is joined with the index; its payload is read back from the pack and measured. What
    the payloads amount to, one row per digest, joins the references, which keep their positions and captions. So a payload
    that very many references share is read once, and Spark can split the second join where a digest is frequent.
    Null and empty texts are 64 zero bytes; repeated rows give repeated rows; other columns are left out; an empty table
    gives no rows.
    """
    index = store(docs)
    sequenced = materialize(sequences(pages_of(docs)), "sequences")
    wanted = sequenced.select(F.inline("items")).where("digest is not null").select("digest").distinct()
    figures = materialize(measured(fetched(index.join(wanted, "digest"))), "media-figures")
    found = resolve(sequenced, figures).where("kind = 'media'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op3_interleaved_media(spark, sf_dir: str) -> DataFrame:
    return document_media(read(spark, sf_dir, "documents"))
