"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token the last token of its encoding is unique. The table of these last
tokens is filled from left to right: the automaton of all vocabulary entries gives the tokens that
end at a position, and a token t is the last one exactly if the last token p of the prefix before
it and t are compatible, that is if merging the bytes of p and t gives p and t again. Following
the back-pointers from the end emits the ids; they equal those of merging by rank. Of a short
pre-token only the prefixes that its end asks for are filled in, and are remembered for other
pre-tokens that begin alike; there the vocabulary is asked for the suffixes themselves.

The compatibility test undoes merges at the border of the pair, highest rank first: if at some
stage the two border tokens have a merge whose rank is lower than the rank of what was undone,
merging would have joined them.

Edge cases: null counts as empty (no tokens; the digests are those of the empty string). Special
strings in a text become their special token, as is the library's default, and are decoded to
their string. A pre-token of any length takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from postlake.llm.common import droppable, map_text, table
from postlake.llm.op02_tokens import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens remembered in a Python worker, each of PIECE characters at most, and answers of fits().
MEMORY = 160_000
PIECE = 64
PAIRS = 150_000
#: Prefixes remembered beside them, of pre-tokens of PIECE bytes at most: the first ones and the latest (those of a few
#: pre-tokens at least, as no prefix of a pre-token should be worked out again and again).
PREFIXES = 25_000
PASSING = 5_000
#: Characters of joined ids that are decoded together (or those of one row).
JOINED = 400_000

FIELDS = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, by rule: printable
    Latin-1 stands for itself, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _known_kind(spec: dict, path: str) -> None:
    """An error for files that this encoder would give other ids than the library."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path}: only byte-level BPE without normaliser, prefix or suffix is known here")
    if missing := sorted(b for c, b in byte_letters().items() if c not in model["vocab"]):
        raise ValueError(f"{path}: no token for the bytes {missing[:5]}")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take more than their string are not known here")


class Bpe:
    """Encoder and decoder of one tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _known_kind(spec, path)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: raw(s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        most = max(self.bytes_of) + 1
        self._table = [self.bytes_of.get(i, b"") for i in range(most)]
        self._names = list(map(str, range(most)))
        self._bytes = pa.array(self._table, pa.large_binary())
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: rank of a pair's merge; by token the rank and the halves it was merged from (bytes: rank -1)
        self.rank_of_pair = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.rank, self.left, self.right = [-1] * most, [0] * most, [0] * most
        for r, (a, b) in reversed(list(enumerate(merges))):
            i = vocab[a + b]
            self.rank[i], self.left[i], self.right[i] = r, vocab[a], vocab[b]
        #: tokens that merging can give, by their bytes as Latin-1
        self.tokens = {raw(s).decode("latin-1"): i for s, i in vocab.items() if self.rank[i] >= 0 or len(s) == 1}
        #: lengths of the tokens with the same three last bytes, and of shorter ones, the longest first
        sizes: dict[str, set[int]] = {}
        for s in self.tokens:
            if len(s) > 2:
                sizes.setdefault(s[-3:], {1, 2}).add(len(s))
        self._sizes = {end: tuple(sorted(x, reverse=True)) for end, x in sizes.items()}
        self.words = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fits: dict[int, bool] = {}
        #: decimal ids of pre-tokens: the first that were met again soon, those met lately, and those met before them
        self._known: dict[str, str] = {}
        self._newer: dict[str, str] = {}
        self._older: dict[str, str] = {}
        #: last token and decimal ids of prefixes: the first ones, and the latest
        self._prefixes: dict[str, tuple[int, str]] = {}
        self._passing: dict[str, tuple[int, str]] = {}

    @cached_property
    def matches(self):
        """The automaton of all tokens; only long pre-tokens need it."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for s, i in self.tokens.items():
            made.add_word(s, (len(s), i))
        made.make_automaton()
        return made

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives the two tokens."""
        key = left << 32 | right
        if (known := self._fits.get(key)) is not None:
            return known
        rank, of_pair = self.rank, self.rank_of_pair.get
        undone = never = len(self.rank_of_pair)
        while True:
            if of_pair(left << 32 | right, never) < undone:
                ok = False
                break
            a, b = rank[left], rank[right]
            # merges happen by rising rank, of one rank from the left: the last one is undone first
            if a > b:
                undone, left = a, self.right[left]
            elif b >= 0:
                # a merge on the left with the same rank comes before this one
                undone, right = b + 1, self.left[right]
            else:
                ok = True
                break
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(data)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (length, token) in self.matches.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - length
            if begin == 0 or (last[begin] >= 0 and self.fits(last[begin], token)):
                last[end], size[end] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _begun(self, prefix: str) -> tuple[int, str]:
        """Last token and decimal ids of a prefix, its bytes as Latin-1."""
        token_of, fits, n = self.tokens.get, self._fits.get, len(prefix)
        for size in self._sizes.get(prefix[-3:], (2, 1)):
            k = n - size
            if k < 0:
                continue
            token = token_of(prefix[k:])
            if token is None:
                continue
            if not k:
                return token, self._names[token]
            rest = prefix[:k]
            before = self._prefixes.get(rest) or self._passing.get(rest)
            if before is None:
                before = self._begun(rest)
                held = self._prefixes if len(self._prefixes) < PREFIXES else self._passing
                if held is self._passing and len(held) >= PASSING:
                    held.clear()
                held[rest] = before
            ok = fits(before[0] << 32 | token)
            if self.fits(before[0], token) if ok is None else ok:
                return token, f"{before[1]},{self._names[token]}"
        raise ValueError("a prefix without a last token")

    def _word(self, word: str) -> str:
        """Ids of a pre-token. Five eighths of the memory hold the first words that were met again soon, as most words are
        rare; the rest holds the latest, and when its newer half is full, the older is forgotten."""
        got = self._known.get(word)
        if got is not None:
            return got
        got = self._newer.get(word) or self._older.get(word)
        if got is None:
            data = word.encode("utf-8", "surrogatepass")
            got = self._begun(data.decode("latin-1"))[1] if len(data) <= PIECE else ",".join(map(str, self.encode_word(data)))
        elif len(self._known) < MEMORY * 5 // 8:
            self._known[word] = got
            return got
        if len(word) <= PIECE:
            if len(self._newer) >= MEMORY * 3 // 16:
                self._older, self._newer = self._newer, {}
            self._newer[word] = got
        return got

    def encode_text(self, text: str) -> tuple[int, str]:
        """Number of ids and the decimal ids joined by commas."""
        out = []
        for i, part in enumerate(self.parts.split(text) if self.parts else [text]):
            if i % 2:
                out.append(str(self.special[part]))
                continue
            words = self.words.findall(part)
            got = list(map(self._known.get, words))
            for k in [k for k, x in enumerate(got) if x is None]:
                got[k] = self._word(words[k])
            out += got
        ids = ",".join(out)
        return ids.count(",") + 1 if out else 0, ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD, special tokens their string."""
        table = self._table
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    def decode_joined(self, texts: list[str]) -> list[str]:
        """Texts of decimal ids joined by commas, as decode() gives them, those of many rows together."""
        filled = [x for x in texts if x]
        if not filled:
            return [""] * len(texts)
        ids = pc.split_pattern(pa.array(filled, pa.large_string()), ",")
        raw = pa.ListArray.from_arrays(ids.offsets, self._bytes.take(ids.values.cast(pa.int64())))
        found = iter(pc.binary_join(raw, pa.scalar(b"", pa.large_binary())).to_pylist())
        return [next(found).decode("utf-8", "replace") if x else "" for x in texts]


def encoder(path: str) -> Callable[[], Callable[[list], list]]:
    def make():
        bpe = _loaded(path)

        def run(texts: list) -> list:
            digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            ns, a, b, held, size = [], [], [], [], 0
            for x in texts:
                n, ids = bpe.encode_text(x or "")
                ns.append(n)
                a.append(digest(ids))
                held.append(ids)
                size += len(ids)
                if size > JOINED:
                    b += map(digest, bpe.decode_joined(held))
                    held, size = [], 0
            b += map(digest, bpe.decode_joined(held))
            return [ns, a, b]

        return run

    return make


_CACHE: dict[str, Bpe] = {}
droppable(_CACHE.clear)


def _loaded(path: str) -> Bpe:
    if path not in _CACHE:
        _CACHE[path] = Bpe(path)
    return _CACHE[path]


def digests(docs: DataFrame, text: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and with the text unless it isn't wanted back."""
    return map_text(docs, text, encoder(path or vocabulary_path(VOCABULARY)), FIELDS, keep_text=keep_text)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with the array of ids."""
    p = path or vocabulary_path(VOCABULARY)

    def make():
        bpe = _loaded(p)
        return lambda texts: [[list(map(int, s.split(","))) if (s := bpe.encode_text(x or "")[1]) else [] for x in texts]]

    return map_text(docs, text, make, [(ids, pa.list_(pa.int32()))])


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, text: str = "text") -> DataFrame:
    """rows with the text of an array of ids (null ids: empty text)."""
    p = path or vocabulary_path(VOCABULARY)

    def make():
        bpe = _loaded(p)
        return lambda arrays: [[bpe.decode(x or []) for x in arrays]]

    return map_text(rows, ids, make, [(text, pa.string())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
