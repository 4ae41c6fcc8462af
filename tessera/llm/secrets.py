"""Secret scans: keyword prefilter, anchored patterns near hits, checksums inside the match.

An Aho-Corasick automaton finds keywords in one pass over the text; each pattern is then tried at keyword hits only. Runs
of hexadecimal digits have no keyword, so they are sought where every twelfth code point and the next such one are both
hexadecimal digits, which any run of 24 must show. Tokens that carry their own checksum are reported only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, per_worker

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = ("assign", "access", "hex")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = {
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])"),
}
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}

ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
STRIDE = HEX_LEAST // 2
HEX_PAIR = re.compile(r"(?=[0-9a-f]{2})")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS62[r] + out
    return out.rjust(width, "0")


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode())) == check


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.automaton.add_word(word, (len(word), kind))
        self.automaton.make_automaton()

    def keyword_hits(self, text: str) -> dict[str, list[int]]:
        """Where keywords begin, by kind, ascending; letters in either case."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would move what follows
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        hits: dict[str, list[int]] = {}
        for end, (n, kind) in self.automaton.iter(low):
            hits.setdefault(kind, []).append(end - n + 1)
        return {k: sorted(set(v)) for k, v in hits.items()}

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind."""
        found = []
        for kind, starts in self.keyword_hits(text).items():
            pattern = ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind]
            done = 0
            for at in starts:
                if at < done or not (m := pattern.match(text, at)):
                    continue
                done = m.end()  # also a match that is dropped uses up its text
                if kind == "assign":
                    keep = len(m[2]) >= ASSIGN_LEAST
                elif kind == "access":
                    keep = m.end() - at >= ACCESS_LEAST
                else:
                    keep = checksum_holds(m[1], m[2])
                if keep:
                    found.append((kind, at, m.end()))
        done = 0
        for m in HEX_PAIR.finditer(text[::STRIDE]):
            at = m.start() * STRIDE
            if at < done:
                continue
            end = HEX.match(text, at).end()
            while at > done and text[at - 1] in "0123456789abcdef":
                at -= 1
            done = end
            if end - at >= HEX_LEAST:
                found.append(("hex", at, end))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scanner() -> Scanner:
    return per_worker("secrets", Scanner)


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in documents(doc_id, text).

    A null text is empty and has no spans, for which the lists are empty strings. Every row gives a row, repeated ones
    too; other columns are left out; an empty table gives no rows. Spans of different kinds may overlap.
    """

    def start():
        s = scanner()

        def work(rows):
            out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                spans = s.spans(text or "")
                base = [x for x in spans if x[0] in BASE]
                out["doc_id"].append(doc)
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(x[0] == kind for x in base))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(spans))
            return out

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), FOUND, start)


def redacted(text: str, spans, mark: str = "[{}]") -> str:
    """The text with each stretch of overlapping spans replaced by a mark that names the first one's kind."""
    out, at, end = [], 0, -1
    for kind, a, b in spans:
        if a >= end:
            out += [text[at:a], mark.format(kind)]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the secrets of its texts replaced by marks; null stays null, all other columns stay as they are."""
    from pyspark.sql import types as T

    schema = T.StructType([f if f.name != column else T.StructField(column, T.StringType()) for f in docs.schema])

    def start():
        s = scanner()

        def work(rows):
            rows[column] = [t and (redacted(t, found) if (found := s.spans(t)) else t) for t in rows[column]]
            return rows

        return work

    return map_slices(docs, schema, start)


def op8_checked_secrets(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return scan(read(spark, sf_dir, "documents"))


