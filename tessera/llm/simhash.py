"""Near-duplicate groups by SimHash fingerprints and Golay-code fuzzy hashing.

The binary Golay code of length 23 has a codeword within distance 3 of every word. A word's keys are the codewords within
distance 4: one if the word is within 2 of a codeword, else six. Two words that differ in one bit share a key, since the
codeword nearest to one is within 4 of the other. A fingerprint is cut into three segments. If two fingerprints differ in
at most two bits, then by the pigeonhole principle some segment is equal in both while the next one, cyclically, differs in
at most one bit. So each of the three cyclic pairs gives keys (segment, Golay key of the next segment), 18 at most, and any
linked pair meets in one of them. Meetings are verified by the Hamming distance.

Keys that very many fingerprints share are not compared pairwise: those fingerprints are linked exactly through the words
within one bit of them. Two fingerprints are within two bits if and only if such balls meet, and no ball word belongs to
more than 65 fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import map_slices, materialize, per_worker, read

SEED = 42
BITS = 64
MAX_BITS = 2
SHINGLE = 3
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints that may be compared pairwise under one key.
KEY_CROWD = 48

#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def golay_tables():
    """Keys of every 23-bit word by syndrome: the error patterns of weight 4 at most that have it, first the lightest."""
    import itertools

    import numpy as np

    remainder = np.zeros(23, np.int64)
    for bit in range(23):
        word = 1 << bit
        for top in range(22, 10, -1):
            if word >> top & 1:
                word ^= GENERATOR << (top - 11)
        remainder[bit] = word
    patterns = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            syndrome, error = 0, 0
            for b in bits:
                syndrome ^= int(remainder[b])
                error |= 1 << b
            patterns[syndrome, count[syndrome]] = error
            count[syndrome] += 1
    return remainder, patterns, count


def golay_keys(words):
    """For an array of 23-bit words: (n, 6) codewords, as their 12 message bits, and how many of the six count."""
    import numpy as np

    remainder, patterns, count = per_worker("golay", golay_tables)
    words = np.asarray(words, np.int64)
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(23):
        syndrome ^= np.where(words >> bit & 1, remainder[bit], 0)
    return (words[:, None] ^ patterns[syndrome]) >> 11, count[syndrome]


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED, at_once: int = 32_768) -> int:
    """Majority bits of the XXH64 values of the word shingles of a text, as an unsigned number; zero if there are none."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    ones, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for at in range(0, n, at_once):
        part = words[at : at + at_once + shingle - 1]
        hashes = np.array([h(b" ".join(x), seed) for x in zip(*(part[i:] for i in range(shingle)))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def start():
        def work(rows):
            return {"doc_id": rows["doc_id"], "fp": [signed(fingerprint_of(t, shingle)) for t in rows["text"]]}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", start)


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) for each distinct fp: three cyclic segment pairs, one or six keys each."""

    def start():
        import numpy as np

        def work(rows):
            fp = np.array(rows["fp"], np.int64).view(np.uint64)
            keys, owners = [], []
            for i, (at, width) in enumerate(SEGMENTS):
                then, then_width = SEGMENTS[(i + 1) % 3]
                exact = (fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
                near = (fp >> np.uint64(then) & np.uint64((1 << then_width) - 1)).astype(np.int64)
                golay, count = golay_keys(near)
                used = np.arange(6)[None, :] < count[:, None]
                keys.append((np.int64(i) << 40 | exact[:, None] << 12 | golay)[used])
                owners.append(np.broadcast_to(fp.view(np.int64)[:, None], used.shape)[used])
            return {"key": np.concatenate(keys), "fp": np.concatenate(owners)}

        return work

    return map_slices(fps.select("fp"), "key long, fp long", start, 4096)


def ball(fp: Column) -> Column:
    """The 65 words within one bit of a fingerprint."""
    flips = [1 << i for i in range(BITS - 1)] + [-(1 << (BITS - 1))]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(x).cast("long")) for x in flips))


def links(fps: DataFrame, crowd: int = KEY_CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that make the same components as all pairs within two bits.

    fps: distinct fp, materialised.
    """
    keys = materialize(fuzzy_keys(fps), "simhash-keys")
    size = keys.groupBy("key").agg(F.count("*").alias("n"))
    shared = size.where(F.col("n").between(2, crowd)).select("key")
    met = keys.join(shared, "key", "left_semi")
    a, b = met.select("key", F.col("fp").alias("a")), met.select("key", F.col("fp").alias("b"))
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & within).select("a", "b").distinct()
    crowded = keys.join(size.where(F.col("n") > crowd).select("key"), "key", "left_semi").select("fp").distinct()
    words = crowded.select("fp", F.explode(ball(F.col("fp"))).alias("word"))
    # Fingerprints that share a ball word are within two bits of each other; each is tied to the least of them.
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    tied = least.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(tied)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id that links reach, for each row.

    A null text is an empty one; texts without words have fingerprint zero and are linked like any others. Repeated rows
    stay; other columns are left out; an empty table gives no rows. A component without any doc_id has a null id.
    """
    marks = materialize(fingerprints(docs, shingle), "fingerprints")
    fps = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    named = components(links(fps))
    rooted = fps.join(named, fps["fp"] == named["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    owner = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(owner, "root").select("fp", "component_id")
    return marks.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_golay_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
