"""The SimHash near-duplicate operator at a similarity: groups of texts whose sets of five-word shingles are 0.8 alike.

A pair at that similarity has SimHash fingerprints that differ in about 15 of 100 bits, so no small radius of a 64-bit
fingerprint catches it. Fingerprints here are wider, and eight segments of 23 bits are decoded to Golay keys each: such a pair
shares a key of a given segment with probability 0.61. Golay keys of 12 bits meet by chance, so each is put together with an
anchor, one of eight least shingle hashes, of which such a pair shares four in five. By the pigeonhole principle one of the
eight pairs of anchor and Golay key agrees but for 0.005 of the pairs. What meets is verified on the shingle sets.

Keys that more than a few sets share are not compared pairwise. A set of which more than a fifth of the shingles are in no
other such set is not alike to any of them, and leaves; so does a pair if either set lacks the shared shingles that it needs.
Sets that share the same shingles (one template, each with words of its own) are a class: two of them have just these in
common, so their sizes decide, and the smallest stands for all that are alike to it. The others are further from any set than
the smallest of them, so one speaks for all; only if it is alike to something do they come in themselves. What comes in meets
the next ones in each key's own order, what is alike is grouped, and what is left to decide are pairs of different groups
under one key: those are compared in full. No set has a limit of partners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.numbering import numbered
from .common import map_slices, materialize, per_worker, release
from .simhash import SEED, golay_keys, signed

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers so that the comparison is exact.
LEAST = (4, 5)
#: Pairs of anchor and segment; bits of a segment; 64-bit words of a fingerprint.
SEGMENTS, SEGMENT_BITS, WORDS = 8, 23, 8
#: Fingerprint bits of 512 that may differ before sets are compared; at 0.8 about 78 do, with a standard deviation of 8.
MOST_BITS = 106
#: Sets that are compared pairwise under one key, and how many of the next each meets where a key has more.
KEY_CROWD, NEXT = 8, 2


def shingles(text: str | None, width: int = SHINGLE, seed: int = SEED):
    """The sorted distinct XXH64 values of a text's word shingles; a shorter text is one shingle, one without words none."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return np.array([h(b" ".join(words), seed)] if words else [], np.uint64)
    return np.unique(np.array([h(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(width)))], np.uint64))


def _odd_numbers():
    import numpy as np

    return np.random.default_rng(SEED).integers(0, 1 << 63, SEGMENTS + WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(values):
    """The least of the values under each of eight multiplications, as 32-bit numbers."""
    import numpy as np

    odd = per_worker("nearcopies", _odd_numbers)[:SEGMENTS]
    out = np.full(SEGMENTS, (1 << 32) - 1, np.uint64)
    for at in range(0, len(values), 8192):
        out = np.minimum(out, ((values[at : at + 8192, None] * odd[None, :]) >> np.uint64(32)).min(axis=0))
    return out.astype("<u4")


def fingerprint(values):
    """The SimHash fingerprint of distinct shingle values: majority bits of WORDS mixtures of each."""
    import numpy as np

    odd = per_worker("nearcopies", _odd_numbers)[SEGMENTS:]
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(values), 8192):
        mixed = values[at : at + 8192, None] * odd[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * odd[::-1][None, :]
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(values), bitorder="little").view("<u8")


def marks(docs: DataFrame) -> DataFrame:
    """For each row: row (hash of doc_id and text), doc_id, set (hash of the shingle set, 0 without words), n, anchors, fp."""

    def start():
        from xxhash import xxh64_intdigest as h

        def work(rows):
            sets = [shingles(t) for t in rows["text"]]
            return {
                "row": rows["row"],
                "doc_id": rows["doc_id"],
                "set": [signed(h(s.tobytes(), SEED)) if len(s) else 0 for s in sets],
                "n": [len(s) for s in sets],
                "anchors": [anchors(s).tobytes() if len(s) else None for s in sets],
                "fp": [fingerprint(s).view("<i8").tolist() if len(s) else None for s in sets],
            }

        return work

    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long"), "text")
    return map_slices(rows, "row long, doc_id long, set long, n long, anchors binary, fp array<long>", start)


def row_key():
    """Rows with equal doc_id and text have equal keys; nulls are told from values."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def shared_anchors(sets: DataFrame) -> DataFrame:
    """(anchor, set) of sets(set, anchors): the numbered anchors that two sets or more have."""

    def start():
        import numpy as np

        def work(rows):
            least = np.frombuffer(b"".join(rows["anchors"]), "<u4").reshape(-1, SEGMENTS).astype(np.int64)
            return {"anchor": (np.arange(SEGMENTS)[None, :] << 32 | least).ravel(), "set": np.repeat(np.array(rows["set"], np.int64), SEGMENTS)}

        return work

    each = materialize(map_slices(sets.select("set", "anchors"), "anchor long, set long", start, 4096), "near-anchors")
    return each.join(each.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1"), "anchor", "left_semi")


def keys(anchored: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, set): each anchor of anchored(anchor, set) with the one or six Golay keys of its segment in sets(set, fp)."""

    def start():
        import numpy as np

        def work(rows):
            anchor, owner = np.array(rows["anchor"], np.int64), np.array(rows["set"], np.int64)
            bits = np.unpackbits(np.array(rows["fp"], "<i8").view(np.uint8).reshape(len(anchor), -1), axis=1, bitorder="little")
            at = (anchor >> 32)[:, None] * SEGMENT_BITS + np.arange(SEGMENT_BITS)[None, :]
            golay, count = golay_keys(np.take_along_axis(bits, at, axis=1).astype(np.int64) @ (1 << np.arange(SEGMENT_BITS)))
            used = np.arange(golay.shape[1])[None, :] < count[:, None]
            return {"key": (anchor[:, None] << 12 | golay)[used], "set": np.broadcast_to(owner[:, None], used.shape)[used]}

        return work

    return map_slices(anchored.join(sets.select("set", "fp"), "set").select("anchor", "set", "fp"), "key long, set long", start, 4096)


def _as(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """Rows with set, n, fp and other columns named for one side of a pair."""
    return rows.select("key", F.col("set").alias(name), *(F.col(c).alias(c + name) for c in ("n", "fp", *more)))


def _may_be_alike():
    """By sizes and fingerprints."""
    bits = sum((F.bit_count(F.col("fpa")[i].bitwiseXOR(F.col("fpb")[i])) for i in range(1, WORDS)), F.bit_count(F.col("fpa")[0].bitwiseXOR(F.col("fpb")[0])))
    return (F.least("na", "nb") * LEAST[1] >= F.greatest("na", "nb") * LEAST[0]) & (bits <= MOST_BITS)


def _in_order():
    return F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of sets(set, n, fp, anchors) that meet in an uncrowded key; and the rows (key, set) of
    crowded keys."""
    anchored = shared_anchors(sets)
    keyed = materialize(keys(anchored, sets), "near-keys")
    size = keyed.groupBy("key").agg(F.count("*").alias("_size")).where("_size > 1")
    met = materialize(keyed.join(size, "key"), "near-met")
    release(keyed)
    few = materialize(met.where(F.col("_size") <= KEY_CROWD).join(sets.select("set", "n", "fp"), "set"), "near-few")
    found = _as(few, "a").join(_as(few, "b"), "key").where((F.col("a") < F.col("b")) & _may_be_alike()).select("a", "b")
    found = materialize(found.distinct(), "near-pairs")
    release(few)
    return found, met.where(F.col("_size") > KEY_CROWD).select("key", "set")


def values_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(set, values) of rows(set, row): the upper halves of the distinct shingle values of each text, ascending, packed."""

    def start():
        import numpy as np

        def work(rows):
            return {"set": rows["set"], "values": [np.unique((shingles(t) >> np.uint64(32)).astype("<u4")).tobytes() for t in rows["text"]]}

        return work

    texts = docs.select(row_key().alias("row"), "text").join(rows, "row").select("set", "text")
    return materialize(map_slices(texts, "set long, values binary", start).dropDuplicates(["set"]), "near-sets")


def alike(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is LEAST or more, by their values(set, values)."""

    def start():
        import numpy as np

        top, bottom = LEAST

        def work(rows):
            out = {"a": [], "b": []}
            for a, b, x, y in zip(rows["a"], rows["b"], rows["va"], rows["vb"], strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * (top + bottom) >= (len(x) + len(y)) * top:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return work

    of = lambda c: values.select(F.col("set").alias(c), F.col("values").alias("v" + c))
    return materialize(map_slices(pairs.join(of("a"), "a").join(of("b"), "b"), "a long, b long", start), "near-links")


def own_shingles(values: DataFrame) -> DataFrame:
    """(set, own, d1, d2): how many values of each set are in no other, and two digests of those that are."""

    def start():
        import numpy as np

        def work(rows):
            held = [np.frombuffer(v, "<i4") for v in rows["values"]]
            return {"set": np.repeat(np.array(rows["set"], np.int64), list(map(len, held))), "value": np.concatenate(held)}

        return work

    each = map_slices(values.select("set", "values"), "set long, value int", start)
    digests = [F.bit_xor(F.xxhash64("value", F.lit(n))).alias(f"d{n}") for n in (1, 2)]
    whole = each.groupBy("set").agg(*digests)
    alone = each.groupBy("value").agg(F.count("*").alias("n"), F.min("set").alias("set")).where("n = 1")
    own = alone.groupBy("set").agg(F.count("*").alias("own"), *(d.alias(f"own_d{n}") for n, d in enumerate(digests, 1)))
    # Exclusive or takes the own values out again.
    rest = [F.col(f"d{n}").bitwiseXOR(F.coalesce(f"own_d{n}", F.lit(0))).alias(f"d{n}") for n in (1, 2)]
    return whole.join(own, "set", "left").select("set", F.coalesce("own", F.lit(0)).alias("own"), *rest)


def live_rows(crowded: DataFrame, sets: DataFrame, values: DataFrame) -> DataFrame:
    """(key, set, n, fp, shared, d1, d2) of the rows of crowded keys whose sets share enough shingles with others to be alike
    to one; d1 and d2 tell what they share."""
    crowd = values.join(crowded.select("set").distinct(), "set", "left_semi")
    shared = F.col("n") - F.col("own")
    live = sets.join(own_shingles(crowd), "set").select("set", "n", "fp", shared.alias("shared"), "d1", "d2")
    return materialize(crowded.join(live.where(F.col("shared") * LEAST[1] >= F.col("n") * LEAST[0]), "set"), "near-live")


CLASS = ("shared", "d1", "d2")


def classes(live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of live_rows(): links (a, b) of sets to the smallest of their class that they are alike to; the rows of heads, a
    class's smallest set and the smallest of its others, under all keys of the class; the others (set, head)."""
    sets = live.select("set", "n", "fp", *CLASS).distinct()
    first = sets.groupBy(*CLASS).agg(F.min(F.struct("n", "set", "fp")).alias("first"))
    named = sets.join(first, list(CLASS))
    joins = (F.col("n") + F.col("first.n")) * LEAST[0] <= F.col("shared") * (LEAST[0] + LEAST[1])
    named = materialize(named.withColumn("joins", joins), "near-classes")
    inside = named.where(F.col("joins") & (F.col("set") != F.col("first.set"))).select(F.col("first.set").alias("a"), F.col("set").alias("b"))
    others = named.where(~F.col("joins") & (F.col("set") != F.col("first.set")))
    second = others.groupBy(*CLASS).agg(F.min(F.struct("n", "set", "fp")).alias("head"))
    heads = first.select(*CLASS, F.col("first").alias("head")).unionByName(second)
    keys = live.select("key", *CLASS).distinct()
    rows = keys.join(heads, list(CLASS)).select("key", "head.set", "head.n", "head.fp", *CLASS)
    apart = others.join(second, list(CLASS)).select("set", F.col("head.set").alias("head"))
    return inside, materialize(rows, "near-heads"), apart.where("set <> head")


def _share_enough():
    return F.least("shareda", "sharedb") * (LEAST[0] + LEAST[1]) >= (F.col("na") + F.col("nb")) * LEAST[0]


def neighbours(live: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set of a crowded key with the next NEXT of it, in the key's own order."""
    placed = numbered(live.withColumn("_at", F.xxhash64("key", "set")), ["key"], ["_at"], "at")
    placed = materialize(placed, "near-placed")
    ahead = _as(placed, "a", "at", "shared").withColumn("at", F.explode(F.sequence(F.col("ata") + 1, F.col("ata") + NEXT)))
    beside = ahead.join(_as(placed, "b", "at", "shared").withColumnRenamed("atb", "at"), ["key", "at"])
    return beside.where(_share_enough() & _may_be_alike()).select(*_in_order())


def across(live: DataFrame, linked: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, under crowded keys that `linked` leaves in different groups and that could be alike. A
    key's largest group is not compared within itself."""
    named = components(linked).withColumnRenamed("node", "set")
    rows = live.join(named, "set", "left").withColumn("group", F.coalesce("root", "set")).drop("root")
    rows = materialize(rows, "near-grouped")
    sizes = rows.groupBy("key", "group").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    parted = rows.join(most.select("key", "most"), "key").withColumn("minor", F.col("group") != F.col("most")).drop("most")
    parted = materialize(parted, "near-parted")
    # A pair that meets under several keys is taken under the least of them, and from one side.
    held = parted.groupBy("set").agg(F.collect_set("key").alias("keys"))
    placed = materialize(parted.join(held, "set"), "near-parted-keys")
    met = _as(placed.where("minor"), "a", "group", "shared", "keys").join(_as(placed, "b", "group", "shared", "keys", "minor"), "key")
    once = (~F.col("minorb") | (F.col("a") < F.col("b"))) & (F.array_min(F.array_intersect("keysa", "keysb")) == F.col("key"))
    found = materialize(met.where((F.col("groupa") != F.col("groupb")) & _share_enough() & _may_be_alike() & once).select(*_in_order()), "near-across")
    release(rows, parted, placed)
    return found


def compared(rows: DataFrame, found: DataFrame, tried: DataFrame, values: DataFrame) -> DataFrame:
    """The links found, and those of rows(key, set, ...) of crowded keys: next ones first, then what is left in different
    groups. Pairs in tried(a, b) are not compared again."""
    beside = materialize(neighbours(rows).distinct().join(tried, ["a", "b"], "left_anti"), "near-beside")
    found = materialize(found.unionByName(alike(beside, values)), "near-links")
    known = tried.unionByName(beside)
    rest = materialize(across(rows, found).join(known, ["a", "b"], "left_anti"), "near-rest")
    if not rest.isEmpty():
        found = materialize(found.unionByName(alike(rest, values)), "near-links")
    release(beside, rest)
    return found


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets(set, n, anchors, fp, row), the texts of which are in docs, that join the groups of alike sets."""
    pairs, crowded = candidates(sets)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("set")).unionByName(crowded.select("set")).distinct()
    values = values_of(docs, sets.join(asked, "set", "left_semi").select("set", "row"))
    found = alike(pairs, values)
    if crowded.isEmpty():
        return found
    live = live_rows(crowded, sets, values)
    inside, heads, apart = classes(live)
    found = compared(heads, materialize(found.unionByName(inside), "near-links"), pairs, values)
    # Sets apart from their class's smallest come in where the one that speaks for them is in a group.
    grouped = components(found).select(F.col("node").alias("head"))
    more = materialize(apart.join(grouped, "head", "left_semi").select("set"), "near-apart")
    if not more.isEmpty():
        found = compared(heads.unionByName(live.join(more, "set", "left_semi").select(*heads.columns)), found, pairs, values)
    release(live, heads, more)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group that links join: the least doc_id, null last, then the least
    hash of the row. Rows are told apart by doc_id and text together; of rows equal in both one stays. Texts without words
    are equal to each other. An empty table gives no rows."""
    seen = materialize(marks(docs), "near-marks")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    of_set = seen.groupBy("set").agg(F.min(rank).alias("first"), F.min(F.struct("row", "n", "anchors", "fp")).alias("one"))
    grouped = materialize(of_set, "near-firsts")
    sets = grouped.select("set", "one.*").where("n > 0")
    named = components(links(docs, sets))
    rooted = grouped.join(named, grouped["set"] == named["node"], "left").select(F.coalesce("root", "set").alias("root"), "first")
    owners = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row")), "near-owners")
    kept = docs.withColumn("_row", row_key()).join(owners, "_row", "left_semi")
    repeated = seen.groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("rows")).where("rows > 1").select("_row")
    repeated = materialize(repeated.join(owners, "_row", "left_semi"), "near-repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(repeated, "_row", "left_anti").unionByName(once).select(docs.columns)
