"""Token counts by overlap resynchronisation.

Every text longer than CHUNK characters is cut into overlapping chunks, which the tokenizers library
encodes with offsets, those of many texts together. Two neighbours are spliced at a boundary inside
their overlap that is proven stable: in both encodings a word (a piece of the tokenizer's own first
split) begins there, and it and the next word have the same places and ids. The first split runs from
left to right and words are encoded one by one, so from a common beginning of a word on both go on
alike; the last WORDS words of the left chunk and the first one of the right, which the cut may have
changed, prove nothing. If an overlap has no such place, it is doubled, in the end to the whole left
chunk, which then becomes one chunk with the right one. So a text without a split at all is encoded
in one piece: right in any case, but a single word of millions of characters costs some doublings.
Nothing is assumed about the vocabulary; texts up to CHUNK characters are one chunk.

Where the file's own rules keep words apart at blanks (blanks_part), the tokens of a chunk are those of
its segments between blanks, one after the other. The library then encodes a segment once, its number of
tokens is remembered, and of a chunk only the overlaps are encoded with offsets, to be spliced as above.
With files of other kinds the library encodes every chunk whole.

Edge cases: null counts as empty (0 bytes, 0 tokens). Special strings inside texts become special
tokens, as is the library's default. Repeated rows give repeated results; long texts cost GROUP
chunks of memory at a time beside the text itself.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postlake.llm.common import droppable, map_text, table

VOCABULARY = "word_bpe_49k.json"
#: Texts of more characters are cut into chunks of so many; neighbours share OVERLAP at first.
CHUNK = 4096
OVERLAP = 128
#: Words at the end of a chunk that its cut may have changed.
WORDS = 2
#: Characters that are encoded together.
GROUP = 500_000
#: A document of more tokens is over the limit.
LIMIT = 2048
#: What parts segments; other white space stays inside them.
BLANKS = " \n"
#: Segments remembered in a Python worker, each of PIECE characters at most.
MEMORY = 300_000
PIECE = 64
#: First splits that drop blanks, and of which no match holds a blank or looks beyond one.
SPLITS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}

FIELDS = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]


def load(path: str):
    """The tokenizer of a .json file, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blanks_part(spec: dict) -> bool:
    """Whether a text's tokens are those of its segments between blanks, by parts of the file that are known: normalisers
    that keep blanks and change nothing across them, a first split that drops them, added tokens without one."""
    listed = lambda part, key: [] if part is None else part[key] if part.get("type") == "Sequence" else [part]
    for n in listed(spec.get("normalizer"), "normalizers"):
        one_blank = n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " "
        if n.get("type") not in ("NFC", "Lowercase") and not one_blank:
            return False
    first, *rest = listed(spec.get("pre_tokenizer"), "pretokenizers") or [{}]
    if first.get("type") != "Split" or first.get("pattern", {}).get("Regex") not in SPLITS or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    if any(r.get("type") != "ByteLevel" or r.get("add_prefix_space") or r.get("use_regex", True) for r in rest):
        return False
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", [])):
        return False
    return spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec.get("post_processor")


class Counted:
    """A chunk and the numbers of tokens of its segments between blanks."""

    def __init__(self, text: str, counts: list[int], encode: Callable[[str], object]) -> None:
        self.text, self.counts, self.encode = text, counts, encode
        self.n = sum(counts)

    def __len__(self) -> int:
        return self.n

    def around(self, begin: int, end: int) -> tuple[object, int, int]:
        """The library's encoding of the whole segments that text[begin:end] touches, its place and the number of its first token."""
        x = self.text
        first = max(x.rfind(" ", 0, begin), x.rfind("\n", 0, begin)) + 1
        stop = min((k for b in BLANKS if (k := x.find(b, max(end - 1, first))) >= 0), default=len(x))
        before = sum(x.count(b, 0, first) for b in BLANKS)
        return self.encode(x[first:stop]), first, sum(self.counts[:before])


class Counts:
    """Numbers of tokens of segments without the marks at their ends: those met lately, and those met before
    them; both halves hold MEMORY together. Marks after a letter or digit are a word of their own."""

    def __init__(self, tokenizer, spec: dict) -> None:
        self.tokenizer = tokenizer
        added = "".join(t["content"] for t in spec.get("added_tokens", []))
        self.marks = "".join(c for c in string.punctuation if c != "'" and c not in added)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _keep(self, segment: str, n: int) -> None:
        if len(segment) <= PIECE:
            if len(self.known) >= MEMORY // 2:
                self.older, self.known = self.known, {}
            self.known[segment] = n

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _halves(self, segment: str) -> tuple[str, str]:
        """A segment's beginning and the marks at its end; an accent or a letter whose lower case has one goes on with marks."""
        core = segment.rstrip(self.marks)
        if core and core[-1] <= "\xff" and core[-1].isalnum():
            return core, segment[len(core) :]
        return segment, ""

    def _find(self, segment: str) -> int | None:
        n = self.known.get(segment)
        if n is None:
            n = self.older.get(segment)
            if n is not None:
                self._keep(segment, n)
        return n

    def _learn(self, segments: set[str]) -> dict[str, int]:
        """Numbers of tokens of segments that were not met lately."""
        found: dict[str, int] = {}
        new: dict[str, int] = {}
        sums = []
        for s in segments:
            n = self._find(s)
            if n is not None:
                found[s] = n
                continue
            core, marks = self._halves(s)
            if not marks:
                new[s] = 0
                continue
            a, b = self._find(core), self._find(marks)
            if a is None or b is None:
                new[core] = new[marks] = 0
                sums.append((s, core, marks))
            else:
                found[s] = a + b
                self._keep(s, a + b)
        for s, e in zip(new, self.tokenizer.encode_batch_fast(list(new), add_special_tokens=False), strict=True):
            found[s] = len(e)
            self._keep(s, found[s])
        for s, core, marks in sums:
            found[s] = found[core] + found[marks]
        return found

    def batch(self, chunks: list[str]) -> list[Counted]:
        known, split, missing = self.known.get, [], set()
        for c in chunks:
            segments = c.replace("\n", " ").split(" ")
            counts = list(map(known, segments))
            gaps = [i for i, n in enumerate(counts) if n is None]
            missing.update(segments[i] for i in gaps)
            split.append((counts, [(i, segments[i]) for i in gaps]))
        found = self._learn(missing)
        for counts, gaps in split:
            for i, s in gaps:
                counts[i] = found[s]
        return [Counted(c, counts, self._encode) for c, (counts, _) in zip(chunks, split, strict=True)]


#: What a worker has loaded, by path: the tokenizer, and its Counts where segments may be counted.
_CACHE: dict[str, tuple[object, Counts | None]] = {}
droppable(_CACHE.clear)


def _loaded(path: str) -> tuple[object, Counts | None]:
    if path not in _CACHE:
        tokenizer = load(path)
        spec = json.loads(tokenizer.to_str())
        _CACHE[path] = tokenizer, Counts(tokenizer, spec) if blanks_part(spec) else None
    return _CACHE[path]


class Part(NamedTuple):
    """An encoded chunk text[begin:end]; its tokens count from number first, which begins at place at."""

    begin: int
    end: int
    encoded: object
    first: int
    at: int


def words(part: Part, begin: int, end: int) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(place, end, number of the first token, ids) of the words of a part whose tokens start in text[begin:end]."""
    e, shift, number = part.encoded, part.begin, 0
    if isinstance(e, Counted):
        e, place, number = e.around(max(begin - shift, 0), min(end, part.end) - shift)
        shift += place
    n = len(e)
    k = None
    for place in range(max(begin - shift, 0), min(end, part.end) - shift):
        k = e.char_to_token(place)
        if k is not None:
            break
    if k is None:
        return []
    ids = e.ids
    out: list[tuple[int, int, int, list[int]]] = []
    last = object()
    while k < n:
        a, b = e.token_to_chars(k)
        if a + shift >= end:
            break
        word = e.token_to_word(k)
        if word is not None and word == last and out:
            out[-1][3].append(ids[k])
            out[-1] = (out[-1][0], b + shift, *out[-1][2:])
        else:
            out.append((a + shift, b + shift, k + number, [ids[k]]))
        last = word
        k += 1
    return [(a, b, k, tuple(i)) for a, b, k, i in out]


def splice(left: Part, right: Part, final: bool) -> tuple[int, int, int] | None:
    """(token of left, token of right, place) where two parts that share text[right.begin:left.end]
    may be joined, None if there is none; final: the left part ends with the text."""
    a = words(left, max(right.begin, left.at), left.end)
    a = a if final else a[: len(a) - WORDS]
    b = words(right, right.begin, left.end)
    # a character may become two words (İ in lower case): only a place that no word before reaches into can be told
    at = {w[0]: i for i, w in enumerate(b[:-1]) if i and b[i - 1][1] <= w[0]}
    for v, x, y in zip(a, a[1:], a[2:], strict=False):
        i = at.get(x[0])
        if i is None or v[1] > x[0]:
            continue
        w, z = b[i], b[i + 1]
        if (x[1], x[3]) == (w[1], w[3]) and (y[0], y[1], y[3]) == (z[0], z[1], z[3]):
            return x[2], w[2], x[0]
    return None


class Splicer:
    """Joins the parts of one text; emit(encoding, begin, end) gets the tokens that are settled."""

    def __init__(self, text: str, encode: Callable[[str], object], emit: Callable[[object, int, int], None], chunk: int, overlap: int) -> None:
        self.text, self.encode, self.emit, self.chunk, self.overlap = text, encode, emit, chunk, overlap
        self.left: Part | None = None

    def plan(self) -> Iterator[tuple[int, int]]:
        """Begin and end of each chunk."""
        begin, n = 0, len(self.text)
        while True:
            end = min(n, begin + self.chunk)
            yield begin, end
            if end >= n:
                return
            begin = end - min(self.overlap, self.chunk // 2)

    def feed(self, begin: int, end: int, encoded) -> None:
        right = Part(begin, end, encoded, 0, begin)
        left = self.left
        if left is None:
            self.left = right
            return
        share = left.end - begin
        while True:
            if found := splice(left, right, left.end == len(self.text)):
                i, j, at = found
                self.emit(left.encoded, left.first, i)
                self.left = Part(right.begin, right.end, right.encoded, j, at)
                return
            share *= 2
            if share >= left.end - left.at:  # nothing to hold on to: both become one
                self.left = Part(left.at, end, self.encode(self.text[left.at : end]), 0, left.at)
                return
            right = Part(left.end - share, end, self.encode(self.text[left.end - share : end]), 0, left.end - share)

    def close(self) -> None:
        self.emit(self.left.encoded, self.left.first, len(self.left.encoded))


def encode_long(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a whole text, from overlapping chunks."""
    ids: list[int] = []
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False)
    own = Splicer(text, encode, lambda e, i, j: ids.extend(e.ids[i:j]), chunk, overlap)
    for begin, end in own.plan():
        own.feed(begin, end, encode(text[begin:end]))
    own.close()
    return ids


def _groups(owns: list[Splicer], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, begin, end) of the chunks of all texts, in order, in groups of most characters."""
    out, size = [], 0
    for t, own in enumerate(owns):
        for begin, end in own.plan():
            if out and size + end - begin > most:
                yield out
                out, size = [], 0
            out.append((t, begin, end))
            size += end - begin
    if out:
        yield out


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> Callable[[], Callable[[list], list]]:
    def make():
        tokenizer, counts = _loaded(path)
        batch = counts.batch if counts else lambda chunks: tokenizer.encode_batch(chunks, add_special_tokens=False)
        encode = lambda x: batch([x])[0]

        def count(texts: list) -> list:
            n = [0] * len(texts)

            def counting(t: int):
                def emit(_, i: int, j: int) -> None:
                    n[t] += j - i

                return emit

            owns = [Splicer(x or "", encode, counting(t), chunk, overlap) for t, x in enumerate(texts)]
            for group in _groups(owns, GROUP):
                made = batch([owns[t].text[a:b] for t, a, b in group])
                for (t, a, b), e in zip(group, made, strict=True):
                    owns[t].feed(a, b, e)
                    if b == len(owns[t].text):
                        owns[t].close()
            size = [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts]
            return [size, n, [k > limit for k in n]]

        return count

    return make


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    return map_text(docs, text, counter(path or vocabulary_path(VOCABULARY), chunk, overlap, limit), FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
