"""Ids of the word-end BPE vocabulary, as little-endian unsigned 32-bit numbers.

Text is cut at ASCII white space, which never lies inside a pre-token of this vocabulary. Arrow cuts many texts at once and
finds their distinct words; those are encoded together, and the ids of all words are gathered from them.

Words of Latin characters are encoded by tiktoken over the same merges, which is faster than the tokenizers library. The two
give equal ids: tiktoken joins any two parts that make a token, the library only the two that the token was learned from, and
the token with the lowest rank goes first in both. So before a token of rank r is made, the merges below r have cut its
letters as they would cut the token standing alone. They differ from the library only if that cut is not the learned one;
then the library never makes the token, in no context, and it is left out of tiktoken's table. Other words go through the
library's own encode().
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import per_worker

#: Words beyond Latin that a worker holds; a full table is emptied, and frequent words are soon back.
KEEP_ODD = 200_000
#: Code points of a text that are cut into words at a time.
PORTION = 1 << 22

#: Rows and bytes of texts that are best encoded at a time: the more, the fewer distinct words among them.
ENCODE_ROWS, ENCODE_BYTES = 4096, 1 << 22

END = 1
WORD_END = "</w>"
#: Stands for the end of a pre-token; a word that holds it is odd.
MARK = "\x00"
#: Words with other characters than these, all in composed form, or with what could be a special token, are odd.
ODD = r"[^\x01-\x7E\x{A1}-\x{12F}\x{131}-\x{17F}]|<\|"
#: The vocabulary's pre-tokens, of words in lower case.
PRE_TOKEN = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def portions(text: str, size: int = PORTION) -> list[str]:
    """The text in parts that begin and end at ASCII white space."""
    if len(text) <= size:
        return [text]
    import re

    parts, at, space = [], 0, re.compile(r"[\t-\r ]")
    while len(text) - at > size:
        met = space.search(text, at + size)
        if met is None:
            break
        parts.append(text[at : met.start()])
        at = met.start()
    return [*parts, text[at:]]


def _gather(ids: np.ndarray, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids that lie in `order`, put in the order of their numbers; counts: the length of each run by its number."""
    size = counts[order]
    begin = np.empty(len(counts), np.int64)
    begin[order] = np.cumsum(size) - size
    upto = np.cumsum(counts)
    return ids[np.repeat(begin - (upto - counts), counts) + np.arange(len(ids))], counts


class WordEncoder:
    def __init__(self, path: str | None = None, keep_odd: int = KEEP_ODD):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.odd: dict[str, bytes] = {}
        self.keep_odd = keep_odd
        byte_of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        learned = json.loads(self.tokenizer.to_str())["model"]
        vocab = learned["vocab"]
        within = BPE(vocab, [tuple(pair) for pair in learned["merges"]])  # the same merges, without word ends
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        ranks = {}
        for token, rank in vocab.items():
            end = token.endswith(WORD_END)
            letters = token.removesuffix(WORD_END)
            self.ends[rank] = end
            model = self.tokenizer.model if end else within
            if len(letters) > 1 and [t.id for t in model.tokenize(letters)] != [rank]:
                continue  # the library never makes it
            ranks[b"".join(map(byte_of.__getitem__, letters)) + (MARK.encode() if end else b"")] = rank
        ranks[MARK.encode()] = len(self.ends)  # never left alone: a letter and the mark are the first to be joined
        self.joined = tiktoken.Encoding("words", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})

    def whole(self, word: str) -> bytes:
        got = self.odd.get(word)
        if got is None:
            if len(self.odd) >= self.keep_odd:
                self.odd.clear()
            got = self.odd[word] = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return got

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        odd = pc.match_substring_regex(words, ODD)
        low = pc.utf8_lower(words)
        letters = pc.and_not(pc.utf8_is_alpha(low), odd)
        mixed = pc.and_not(pc.invert(letters), odd)
        one = pc.binary_join_element_wise(low.filter(letters), pa.scalar(MARK, low.type), pa.scalar("", low.type))
        more = pc.replace_substring_regex(low.filter(mixed), PRE_TOKEN, "\\1" + MARK)
        ids = np.concatenate([self._marked(one), self._marked(more)])
        upto = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        tokens = np.concatenate([np.ones(len(one), np.int64), pc.count_substring(more, MARK).to_numpy()])
        others = [self.whole(w) for w in words.filter(odd).to_pylist()]
        order = np.argsort(np.where(odd.to_numpy(zero_copy_only=False), 2, mixed.to_numpy(zero_copy_only=False)), kind="stable")
        counts = np.empty(len(words), np.int64)
        counts[order] = np.concatenate([np.diff(upto[np.cumsum(tokens)], prepend=0), np.array([len(x) // 4 for x in others], np.int64)])
        return _gather(np.concatenate([ids, np.frombuffer(b"".join(others), "<u4")]), counts, order)

    def _marked(self, words: pa.Array) -> np.ndarray:
        """The ids of words whose pre-tokens are marked."""
        if not len(words):
            return np.zeros(0, "<u4")
        _, edges, data = words.buffers()
        at = np.frombuffer(edges, np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset : words.offset + len(words) + 1]
        return np.asarray(self.joined.encode_ordinary(str(memoryview(data)[at[0] : at[-1]], "utf-8")), "<u4")

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and how many each has."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = lists.flatten().dictionary_encode()
        flat, size = self.distinct(words.dictionary)
        of = words.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[of])])
        ids = flat[np.repeat((np.cumsum(size) - size)[of] - upto[:-1], size[of]) + np.arange(upto[-1])]
        edges = lists.offsets.to_numpy()
        return ids, np.diff(upto[edges - edges[0]])

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, each with the end id, and where each text's ids begin and end (n + 1 places).
        A null text is empty."""
        parts = [portions(t or "") for t in texts]
        flat = [x for p in parts for x in p]
        held = [self._cut(flat)] if len(flat) == len(texts) else [self._cut([x]) for x in flat]
        ids = np.concatenate([h[0] for h in held]) if held else np.zeros(0, "<u4")
        counts = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int64)
        first = np.cumsum([0, *map(len, parts)])
        ends = np.concatenate([[0], np.cumsum(counts)])[first[1:]]
        return np.insert(ids, ends, END), np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])

    def encode(self, text: str | None) -> bytes:
        """The ids of one text without the end id, as bytes."""
        return self.encode_many([text])[0][:-1].tobytes()


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder."""
    path = path or default_path()
    return per_worker(f"wordbpe:{path}", lambda: WordEncoder(path))
