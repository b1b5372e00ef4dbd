"""Token counts by rank-synchronous merging over ragged arrays of pre-tokens."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, shipped, slices

#: Texts of only these characters are lower-cased and split here: letters below U+0250 have no
#: combining marks and one-to-one lower case (U+0130 apart), and general punctuation is no letter,
#: number or white space. Every other text goes through the tokenizer's own normalizer.
_PLAIN = re.compile("[^\t-\r\x20-\x7e\x85\xa0-įı-ɏ‐-‧]")
_OTHER_NUMBERS = "²³¹¼½¾"
_SPACE = "\t-\r \x85\xa0"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{_OTHER_NUMBERS}]+|[\d{_OTHER_NUMBERS}]|(?:[^\w{_SPACE}]|_)+")
#: Distinct tokens that a Python worker keeps.
REMEMBERED = 800_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Splitter:
    """Normalizes and pre-tokenizes texts exactly as a lower-casing byte-level tokenizer file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        for t in spec["added_tokens"]:
            if not t["content"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"the added token {t['content']!r} is not matched as it stands in a raw text")
        #: By the name that :meth:`tokens` gives them, which no word of a text has.
        self.specials = {"\1" + t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_texts = sorted((s[1:] for s in self.specials), key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special_texts)) + ")") if self.specials else None
        self.characters = byte_characters()
        self.bytes = {c: b for b, c in self.characters.items()}

    def tokens(self, text: str) -> list[str]:
        """Strings that no pre-token crosses: what stands between white space in plain texts; in others
        the pre-tokens themselves, after a zero byte; and special strings, after a byte of one."""
        if any(map(text.__contains__, self.special_texts)):
            out: list[str] = []
            for i, part in enumerate(self.special_pattern.split(text)):
                out += ["\1" + part] if i % 2 else self.tokens(part)
            return out
        if not _PLAIN.search(text):
            return text.lower().split()
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return ["\0" + bytes(self.bytes[c] for c in piece).decode("utf-8") for piece, _ in shown]

    def pieces(self, token: str) -> list[str]:
        """The pre-tokens of a token that is no special string."""
        return [token[1:]] if token[0] == "\0" else _PIECE.findall(token)


def plain_tokens(texts, split: Splitter):
    """:meth:`Splitter.tokens` of an Arrow column of texts, as lists of strings, some of them empty.

    Plain texts are lower-cased and split as a column; the others go one by one.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, _PLAIN.pattern)
    for s in split.special_texts:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    low = pc.utf8_lower(pc.if_else(odd, "", texts))
    for space in "\x85\xa0":
        low = pc.replace_substring(low, space, " ")
    out = pc.ascii_split_whitespace(low)
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(rows):
        return out
    own = pa.array([split.tokens(t) for t in texts.take(pa.array(rows)).to_pylist()], out.type)
    at = np.arange(len(texts))
    at[rows] = len(texts) + np.arange(len(rows))
    return pa.concat_arrays([out, own]).take(pa.array(at))


def plain_pieces(tokens: list[str]):
    """The pre-tokens of tokens of plain texts, as an Arrow column of lists, some strings empty.

    Letters stay together; what is not a letter is set apart by spaces.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    apart = pc.replace_substring_regex(pa.array(tokens, pa.large_string()), r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\pL\pN]+)", r" \1 ")
    return pc.ascii_split_whitespace(apart)


class Merges:
    """Byte-pair merges as arrays: pair keys in order, their ranks and results, and symbols of bytes."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        shown = byte_characters()
        self.symbol = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.last_symbol = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int64)
        a, b, c = (np.array(x, np.int64) for x in zip(*((vocab[p], vocab[q], vocab[p + q]) for p, q in model["merges"]), strict=True))
        self.base = np.int64(len(vocab) + len(model["merges"]) + 1)
        keys = a * self.base + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int64), c[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (a large number if it has no merge) and its place among the keys."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], np.iinfo(np.int64).max), at

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all ``words`` after all merges, and where each word's symbols start.

        In every round each word merges all occurrences of its own lowest-rank pair, all words side
        by side; words without a mergeable pair leave.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        done: list = []
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.symbol[raw]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last_symbol[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(sym) > 1:
            rank, at = self.rank_of(sym[:-1], sym[1:])
            rank[owner[:-1] != owner[1:]] = np.iinfo(np.int64).max
            rank = np.append(rank, np.iinfo(np.int64).max)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, heads)
            least_of = np.repeat(least, np.diff(np.append(heads, len(sym))))
            alive = least_of != np.iinfo(np.int64).max
            hit = alive & (rank == least_of)
            places = np.flatnonzero(hit)
            if len(places):
                # Of touching pairs (the same symbol three times or more) every second one merges, from the left.
                fresh = np.append(True, np.diff(places) > 1)
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
                sym[places] = self.results[at[places]]
            gone = np.zeros(len(sym), bool)
            gone[places + 1] = True
            if not alive.all():
                out = ~alive
                done.append((owner[out], sym[out]))
            keep = alive & ~gone
            sym, owner = sym[keep], owner[keep]
        if len(sym):
            done.append((owner, sym))
        owner = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        return sym[order], np.concatenate([[0], np.cumsum(counts)])

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols survive in each word; long lists go in parts of bounded size."""
        out, part, total = [], [], 0
        for w in words:
            part.append(w)
            total += len(w)
            if total >= 2_000_000:
                out.append(np.diff(self.merge(part)[1]))
                part, total = [], 0
        if part:
            out.append(np.diff(self.merge(part)[1]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Token counts of texts; remembers the counts of tokens it has seen."""

    def __init__(self, path: str):
        self.split, self.merge, self.known = splitter(path), merges(path), {}

    def __call__(self, texts: list[str]) -> list[int]:
        tokens = [self.split.tokens(t) for t in texts]
        known = self.known
        new = list(set().union(*tokens) - known.keys() - self.split.specials.keys()) if tokens else []
        known.update(dict.fromkeys(self.split.specials, 1))
        parts = [self.split.pieces(t) for t in new]
        owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, parts), np.int64, len(parts)))
        unique = list({p for part in parts for p in part})
        count = dict(zip(unique, self.merge.counts([p.encode() for p in unique]).tolist(), strict=True))
        each = np.fromiter((count[p] for part in parts for p in part), np.int64, len(owner))
        known.update(zip(new, np.bincount(owner, weights=each, minlength=len(new)).astype(np.int64).tolist(), strict=True))
        out = [sum(map(known.__getitem__, t)) for t in tokens]
        if len(known) > REMEMBERED:  # the first tokens stay; these were for this call
            for t in new:
                del known[t]
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048, slice_bytes: int = 2_000_000) -> DataFrame:
    """Count the tokens of every whole text of ``docs`` (doc_id, text) as the tokenizer file at ``path`` gives them.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit. No begin, end or added special tokens;
    special strings inside a text count as the one token that the library makes of them.

    Pre-tokens of a slice of texts stand as ragged arrays; see :meth:`Merges.merge`. Null and empty
    texts have 0 bytes and 0 tokens; null, tied and repeated doc_ids are kept row by row; an empty
    table gives an empty result; only doc_id and text are read.
    """

    def run(batches):
        import pyarrow as pa

        count = kept(("counter", path), lambda: Counter(path))
        for batch in batches:
            for part in slices(batch, batch.column(1).to_pylist(), slice_bytes):
                texts = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    read = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

