"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is bound from its letters' vectors, the first permuted twice and
the second once, by multiplication. A text's vector is the bundle (sum) of its trigrams' vectors, a language's prototype
the bundle over its training texts, and a text gets the language whose prototype has the highest cosine with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_slices, per_worker, read

DIMENSIONS = 512
SEED = 20_240_601
#: Letters are told apart up to this many: a to z, then other letters by code point; 0 is a word's edge.
ALPHABET = 64
#: Cells of the matrix of counts (texts by trigrams) that is multiplied at a time.
CELLS = 4_000_000
#: Languages whose trigram counts a task holds before it bundles them.
HELD_LANGUAGES = 24
UNKNOWN = "und"
#: Trigrams of a text that count in full towards a prototype; those of longer texts count for less, so that no text
#: outweighs the others. Weights are whole numbers of UNITs.
FULL_TRIGRAMS = 1000
UNIT = 1024
#: A text resembles a language if its cosine is at least LEEWAY of the QUANTILE of the cosines of correctly told learned
#: texts with about as many distinct trigrams (within a power of two). Few trigrams mean low cosines in any language.
QUANTILE = 0.01
LEEWAY = 2 / 3
#: Bits of the least number of distinct trigrams, 32, that is judged: cosines of fewer do not tell languages from gibberish.
LEAST_BITS = 6
#: Steps of a cosine in which learned texts are counted.
STEPS = 1000

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


class Profiles:
    """Letters, trigrams and their vectors. Equal seeds give equal vectors on every worker."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        import numpy as np

        self.symbols = np.zeros(0x110000, np.uint8)
        letters = [i for i in range(0x110000) if chr(i).isalpha()]
        spare = ALPHABET - 27
        self.symbols[letters] = [i - 96 if 97 <= i <= 122 else 27 + i % spare for i in letters]
        letter = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (ALPHABET, dimensions))
        self.first, self.second, self.third = np.roll(letter, 2, axis=1), np.roll(letter, 1, axis=1), letter
        self.place = np.full(ALPHABET**3, -1, np.int32)
        # A byte per component, so all trigrams that there can be take 128 MB.
        self.rows, self.vectors = 0, np.zeros((4096, dimensions), np.int8)

    def trigrams(self, texts: list[str]):
        """Owner (index of the text) and code of every trigram around a letter; runs of other characters are one edge."""
        import numpy as np

        low = [t.lower() for t in texts]
        whole = " ".join(["", *low, ""])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
        symbol = self.symbols[points]
        keep = np.ones(len(symbol), bool)
        keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0)
        symbol, owner = symbol[keep].astype(np.int32), np.append(owner, 0)[keep]
        code = (symbol[:-2] * ALPHABET + symbol[1:-1]) * ALPHABET + symbol[2:]
        middle = symbol[1:-1] > 0
        return owner[1:-1][middle], code[middle]

    def of(self, codes):
        """Vectors of distinct trigram codes, as a matrix."""
        import numpy as np

        new = codes[self.place[codes] < 0]
        if len(new):
            need = self.rows + len(new)
            if need > len(self.vectors):
                grown = np.zeros((min(max(need, 2 * len(self.vectors)), ALPHABET**3), self.vectors.shape[1]), np.int8)
                grown[: self.rows] = self.vectors[: self.rows]
                self.vectors = grown
            a, b, c = new // ALPHABET**2, new // ALPHABET % ALPHABET, new % ALPHABET
            self.vectors[self.rows : need] = self.first[a] * self.second[b] * self.third[c]
            self.place[new] = np.arange(self.rows, need)
            self.rows = need
        return self.vectors[self.place[codes]]

    def bundle(self, codes, counts):
        import numpy as np

        out = np.zeros(self.vectors.shape[1], np.int64)
        for at in range(0, len(codes), 8192):
            part = self.of(codes[at : at + 8192]).astype(np.float64)
            out += np.rint(counts[at : at + 8192].astype(np.float64) @ part).astype(np.int64)
        return out

    def encode(self, texts: list[str]):
        """Text vectors (n, dimensions), exact, and the number of trigrams of each."""
        return self.encoded(texts)[:2]

    def encoded(self, texts: list[str]):
        """Text vectors (n, dimensions), exact, and the numbers of trigrams and of distinct trigrams of each."""
        import numpy as np

        owner, code = self.trigrams(texts)
        sizes = np.bincount(owner, minlength=len(texts))
        out = np.zeros((len(texts), self.vectors.shape[1]))
        distinct = np.zeros(len(texts), np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(texts):
            till = min(len(texts), at + 64)
            part = code[ends[at] : ends[till]]
            codes = np.nonzero(np.bincount(part, minlength=1))[0]
            while till - at > 1 and (till - at) * len(codes) > CELLS:
                till = at + (till - at) // 2
                part = code[ends[at] : ends[till]]
                codes = np.nonzero(np.bincount(part, minlength=1))[0]
            if len(codes):
                column = np.zeros(codes[-1] + 1, np.int64)
                column[codes] = np.arange(len(codes))
                cell = (owner[ends[at] : ends[till]] - at) * len(codes) + column[part]
                counts = np.bincount(cell, minlength=(till - at) * len(codes)).reshape(till - at, len(codes))
                distinct[at:till] = np.count_nonzero(counts, axis=1)
                kind = np.float32 if sizes[at:till].max() < 1 << 24 else np.float64
                out[at:till] = counts.astype(kind) @ self.of(codes).astype(kind)
            at = till
        return out, sizes, distinct


def profiles(dimensions: int, seed: int) -> Profiles:
    return per_worker(f"langid:{dimensions}:{seed}", lambda: Profiles(dimensions, seed))


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, list[int]]:
    """The bundle of each language's texts in labelled(text, lang). Nulls in either column take no part.

    Every text counts, by its trigrams up to FULL_TRIGRAMS. A task sends one vector per language, and Spark adds them up, so what reaches the driver is a vector
    per language whatever the size of the corpus.
    """

    def start():
        import numpy as np

        p = profiles(dimensions, seed)
        counts: dict[str, np.ndarray] = {}
        sums: dict[str, np.ndarray] = {}

        def settle():
            for lang, n in counts.items():
                codes = np.nonzero(n)[0]
                sums[lang] = sums.get(lang, 0) + p.bundle(codes, n[codes])
            counts.clear()

        def work(rows):
            owner, code = p.trigrams(rows["text"])
            sizes = np.maximum(np.bincount(owner, minlength=len(rows["text"])), 1)
            weight = np.maximum(np.rint(UNIT * np.minimum(1.0, FULL_TRIGRAMS / sizes)), 1)[owner]
            langs = sorted(set(rows["lang"]))
            number = {lang: i for i, lang in enumerate(langs)}
            of = np.array([number[x] for x in rows["lang"]])[owner]
            for i, lang in enumerate(langs):
                if lang not in counts:
                    if len(counts) >= HELD_LANGUAGES:
                        settle()
                    counts[lang] = np.zeros(ALPHABET**3, np.int64)
                n = np.bincount(code[of == i], weights=weight[of == i], minlength=1)
                counts[lang][: len(n)] += n.astype(np.int64)
            return None

        def finish():
            settle()
            return {"lang": list(sums), "vector": [v.tolist() for v in sums.values()]}

        work.finish = finish
        return work

    clean = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sent = map_slices(clean, "lang string, vector array<long>", start)
    added = sent.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("vector")).collect()
    return {r["lang"]: [x["x"] for x in r["vector"]] for r in rows}


class Judge:
    """Tells the languages of texts by learned prototypes."""

    def __init__(self, learned: dict[str, list[int]], dimensions: int = DIMENSIONS, seed: int = SEED):
        import numpy as np

        self.profiles = profiles(dimensions, seed)
        self.names = sorted(learned)
        known = np.array([learned[x] for x in self.names], np.float64).reshape(len(self.names), dimensions)
        self.known = known / np.maximum(np.sqrt((known**2).sum(axis=1, keepdims=True)), 1e-300)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores, (1 + cosine) / 2. und, with score 0, where the text is null or has no letter, or nothing
        was learned; ties go to the first language by name."""
        names, scores, _ = self.sized(texts)
        return names, scores

    def sized(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Languages, scores, and the bits of the number of distinct trigrams."""
        import numpy as np

        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
        vectors, sizes, distinct = self.profiles.encoded([t or "" for t in texts])
        norms = np.sqrt((vectors**2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(norms[:, None] > 0, vectors @ self.known.T / norms[:, None], 0.0).round(9)
        best, told = cosine.argmax(axis=1), sizes > 0
        top = cosine[np.arange(len(best)), best].tolist()
        names = [self.names[b] if t else UNKNOWN for b, t in zip(best, told, strict=True)]
        scores = [round(min(1.0, max(0.0, (1 + c) / 2)), 6) if t else 0.0 for c, t in zip(top, told, strict=True)]
        return names, scores, [int(x).bit_length() for x in distinct]


def predict(docs: DataFrame, learned: dict[str, list[int]], dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred and score of docs(doc_id, held_out, text)."""

    def start():
        judge = Judge(learned, dimensions, seed)

        def work(rows):
            lang, score = judge(rows["text"])
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": lang, "score": score}

        return work

    return map_slices(docs.select("doc_id", "held_out", "text"), PREDICTED, start)


def least_cosines(labelled: DataFrame, learned: dict[str, list[int]]) -> dict[int, float]:
    """The least cosine that a text needs, by the bits of its number of distinct trigrams, from all rows of labelled(text,
    lang) that are told correctly. Spark counts them by bits and steps, so a small table reaches the driver."""

    def start():
        judge = Judge(learned)

        def work(rows):
            names, scores, bits = judge.sized(rows["text"])
            right = [i for i, n in enumerate(names) if n == rows["lang"][i]]
            return {"bits": [bits[i] for i in right], "step": [int((2 * scores[i] - 1) * STEPS // 1) for i in right]}

        return work

    clean = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counted = map_slices(clean, "bits int, step int", start).groupBy("bits", "step").agg(F.count("*").alias("n")).collect()
    by_bits: dict[int, list[tuple[int, int]]] = {}
    for r in counted:
        by_bits.setdefault(r["bits"], []).append((r["step"], r["n"]))
    least = {}
    for bits, steps in by_bits.items():
        if bits < LEAST_BITS:
            continue
        left = QUANTILE * sum(n for _, n in steps)
        for step, n in sorted(steps):
            left -= n
            if left <= 0:
                break
        least[bits] = LEEWAY * step / STEPS
    return least


def accepted(docs: DataFrame, learned: dict[str, list[int]], least: dict[int, float]) -> DataFrame:
    """The rows of docs(text, ...) whose text resembles a learned language, with the columns of docs.

    A number of trigrams that no learned text had takes the least cosine of the next smaller one; texts with fewer
    than any learned text or than LEAST_BITS allow stay if they have letters.
    """

    def start():
        judge = Judge(learned)
        need, last = [], -1.0
        for bits in range(64):
            last = least.get(bits, last)
            need.append(last)

        def work(rows):
            names, scores, bits = judge.sized(rows["text"])
            keep = [i for i, name in enumerate(names) if name != UNKNOWN and 2 * scores[i] - 1 >= need[bits[i]]]
            return {k: [v[i] for i in keep] for k, v in rows.items()}

        return work

    return map_slices(docs, docs.schema, start)


HELD_OUT = 5


def identify(docs: DataFrame) -> DataFrame:
    """The language of documents(doc_id, text, lang): learned from the rows that are not held out, for every row.

    doc_id, lang and other columns decide only who is learned from. A null doc_id is not held out. Repeated rows give
    repeated rows; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", F.coalesce(crc_mod("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"))
    learned = prototypes(rows.where(~F.col("held_out")))
    return predict(rows, learned)


def op4_hyperdimensional_langid(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
