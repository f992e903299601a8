"""BPE encoding and decoding with a public vocabulary file (word-end BPE).

Encoding keeps a doubly linked list of symbols per word piece and a priority queue of
(merge rank, position). The best pair is taken, entries whose symbols changed since they were
queued are stale and skipped, and a merge queues the two new neighbouring pairs. Decoding joins
the vocabulary strings of the ids.

White space separates pieces in every rule of the vocabulary's splitter, so the texts of a block
are cut at ASCII white space and each distinct cut is encoded once; the ids of a block are then put
together by one gather. Pieces are merged once per worker (a bounded memo of packed ids). Cuts of
ASCII and precomposed Latin characters are lowered and split here; any other cut goes through the
normaliser and the splitter that the vocabulary file itself describes, run by the tokenizers
library, so that letters, numbers and compositions are those of its Unicode tables. Merging is
done here for every cut.

Edge cases: null means empty; an empty text has no ids and decodes to ""; a text that spells a
special token yields its id, as the vocabulary's added tokens do; very long words are merged in
O(n log n), of any length; ties between equal ranks go to the leftmost pair; repeated rows give
equal rows; an empty table gives an empty result; other columns are carried along, but one that is
named like an output column is replaced by it.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .textops import in_blocks, mix, trimmed

MEMO_WORDS, MEMO_LENGTH, BLOCK = 1_000_000, 48, 1 << 21
# For each hash a random odd factor of every byte's place in a text of the memo.
_FACTORS = [np.random.default_rng(seed).integers(0, 1 << 63, MEMO_LENGTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (1, 2)]
# Precomposed Latin letters: composed already, lowered one by one; U+0130 alone is lowered to two characters.
_LATIN = r"^[\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]*$"
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


MEMO_PIECES = 30_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {b: chr(b) for b in plain}
    for b in range(256):
        stand.setdefault(b, chr(256 + len(stand) - len(plain)))
    return [stand[b] for b in range(256)]


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes of each text, and their number."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    start, size = ends[:-1] - ends[0], np.diff(ends)
    column = np.arange(len(raw)) - np.repeat(start, size)
    found = []
    for factors in _FACTORS:
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(mix(raw.astype(np.uint64) + factors[0]) * factors[np.minimum(column, MEMO_LENGTH)], out=total[1:])
        found.append(mix(total[start + size] - total[start] + size.astype(np.uint64)))
    return *found, size


class _Table:
    """Ids of texts by two hashes, sorted by the first."""

    def __init__(self) -> None:
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1 << 12, "<u4"), 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is missing."""
        if not len(self.one):
            return np.full(len(one), -1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), at, -1)

    def add(self, one: np.ndarray, two: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """New keys and their ids; of keys that share the first hash one is kept."""
        one, first = np.unique(one, return_index=True)
        at = np.searchsorted(self.one, one)
        fresh = np.ones(len(one), dtype=bool) if not len(self.one) else self.one[np.minimum(at, len(self.one) - 1)] != one
        one, first, at = one[fresh], first[fresh], at[fresh]
        ids = _gather(flat, count, first)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used // 4 + 2 * len(ids), "<u4")])
        self.flat[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(count[first]) - count[first]
        self.used += len(ids)
        for name, values in (("one", one), ("two", two[first]), ("start", start), ("count", count[first].astype(np.uint8))):
            setattr(self, name, np.insert(getattr(self, name), at, values))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _slices(self.flat, self.start[at], self.count[at].astype(np.int64)), self.count[at].astype(np.int64)


class _Memo:
    """A bounded memo of two generations: a full one becomes the old one, from which what is still used moves over.

    It holds numbers only: texts are known by 128 bits, their ids lie end to end (some 40 bytes a text).
    """

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.new, self.old = make, most // 2, _Table(), _Table()

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct texts end to end, and how many each has."""
        one, two, size = _keys(texts)
        at = self.new.find(one, two)
        known = np.flatnonzero(at >= 0)
        rest = np.flatnonzero(at < 0)
        was = self.old.find(one[rest], two[rest])
        moved, missing = rest[was >= 0], rest[was < 0]
        made = list(map(self.make, texts.take(pa.array(missing)).to_pylist()))
        parts = [self.new.ids(at[known]), self.old.ids(was[was >= 0]), (np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4)]
        flat, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        places = np.concatenate([known, moved, missing])
        back = np.empty(len(places), dtype=np.int64)
        back[places] = np.arange(len(places))
        add = np.flatnonzero((np.arange(len(places)) >= len(known)) & (size[places] <= MEMO_LENGTH) & (count < 256))
        if len(add):
            if len(self.new.one) + len(add) > self.most:
                self.old, self.new = self.new, _Table()
            self.new.add(one[places[add]], two[places[add]], _gather(flat, count, add), count[add])
        return _gather(flat, count, back), count[back]


class WordBpe:
    """A word-end BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # the library's rules without its vocabulary, which would be held in memory twice
        library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.made: list[int] = []  # by rank, the merged id
        nothing: dict[int, int] = {}
        ranks = [nothing] * (max(self.vocab.values()) + 1)  # by left id, the rank of each right id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            left = self.vocab[a]
            ranks[left] = ranks[left] or {}
            ranks[left].setdefault(self.vocab[b], rank)
            self.made.append(self.vocab[a + b])
        self.rank = [d.get for d in ranks]
        self.packed = {i: np.uint32(i).astype("<u4").tobytes() for i in self.strings}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        stand = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in stand]
        self.final = [self.vocab.get(c + self.end) for c in stand]
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.memo = _Memo(self._piece, MEMO_WORDS)
        self._known = functools.lru_cache(MEMO_PIECES)(self._piece)  # pieces inside of cuts that are more than letters and signs

    def merge(self, ids: list[int]) -> list[int]:
        """Merge symbols by rank with a heap over a doubly linked list; a queue entry is one integer, rank and place."""
        n, rank, made = len(ids), self.rank, self.made
        shift = n.bit_length()
        # the entry that stands for the pair at each place now; any other entry of that place is stale
        now, queue, left = [], [], ids[0]
        for i, right in enumerate(ids[1:]):
            r = rank[left](right)
            if r is None:
                now.append(-1)
            else:
                entry = r << shift | i
                now.append(entry)
                queue.append(entry)
            left = right
        if not queue:
            return ids
        now.append(-1)
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, place = heapq.heappop, heapq.heappush, (1 << shift) - 1
        while queue:
            entry = pop(queue)
            i = entry & place
            if now[i] != entry:
                continue  # stale: one of the two symbols has been merged since
            j = after[i]
            joined = ids[i] = made[entry >> shift]
            ids[j] = now[i] = now[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank[joined](ids[k])
                if r is not None:
                    entry = now[i] = r << shift | i
                    push(queue, entry)
            h = before[i]
            if h >= 0:
                r = rank[ids[h]](joined)
                if r is None:
                    now[h] = -1
                else:
                    entry = now[h] = r << shift | h
                    push(queue, entry)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        ids = list(map(self.inner.__getitem__, data))
        ids[-1] = self.final[data[-1]]
        if None in ids:
            ids = [x for x in ids if x is not None]
        return b"".join(map(self.packed.__getitem__, self.merge(ids) if len(ids) > 1 else ids))

    def _by_library(self, cut: str) -> bytes:
        """Packed ids of a cut whose normal form and pieces the vocabulary's own rules give; pieces come in stand-in letters."""
        found = []
        for piece, _ in self.split(self.normalize(cut)):
            ids = [self.vocab.get(c) for c in piece[:-1]] + [self.vocab.get(piece[-1] + self.end)]
            ids = [x for x in ids if x is not None]
            found += [self.packed[i] for i in (self.merge(ids) if len(ids) > 1 else ids)]
        return b"".join(found)

    def _other(self, cut: str) -> bytes:
        """Packed ids of a text without ASCII white space that is more than letters and one run of signs."""
        if not cut.isascii():
            return self._by_library(cut)
        return b"".join(map(self._known, self.pieces(cut.lower())))

    def _distinct(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without ASCII white space end to end, and how many each has."""
        here = pc.or_(pc.string_is_ascii(cuts), pc.match_substring_regex(cuts, _LATIN))
        lower = pc.utf8_lower(cuts)
        word = pc.utf8_rtrim(lower, characters=_SIGNS)
        # letters and at most one run of signs: the one or two pieces that the splitter would give
        plain = pc.and_(here, pc.utf8_is_alpha(word)).to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        words = word.take(pa.array(at)).dictionary_encode()
        letters, whole = (pc.utf8_length(x).to_numpy()[at] for x in (word, lower))
        signed = np.flatnonzero(whole > letters)
        tails = [x[n:] for x, n in zip(lower.take(pa.array(at[signed])).to_pylist(), letters[signed].tolist(), strict=True)]
        number = {tail: i for i, tail in enumerate(dict.fromkeys(tails))}
        ids, count = self.memo.all(words.dictionary)
        values = [*map(self._known, number), *map(self._other, cuts.take(pa.array(rest)).to_pylist())]
        parts = np.zeros((len(cuts), 2), dtype=np.int64)
        parts[at, 0] = words.indices.to_numpy() + 1
        after_words = len(words.dictionary) + 1
        parts[at[signed], 1] = np.fromiter(map(number.__getitem__, tails), dtype=np.int64, count=len(tails)) + after_words
        parts[rest, 0] = np.arange(len(rest)) + after_words + len(number)
        count = np.concatenate([[0], count, np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4])
        return _gather(np.concatenate([ids, np.frombuffer(b"".join(values), "<u4")]), count, parts.reshape(-1)), count[parts].sum(axis=1)

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that spell no special token, end to end, and how many each has."""
        cuts = pc.ascii_split_whitespace(texts)
        met = cuts.flatten().dictionary_encode()
        ids, count = self._distinct(met.dictionary)
        order = met.indices.to_numpy()
        total = np.concatenate(([0], np.cumsum(count[order])))
        return _gather(ids, count, order), np.diff(total[cuts.offsets.to_numpy() - cuts.offsets[0].as_py()])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.find_special.split(text) if self.special else [text]
        ids, count = self.encode_block(pa.array(parts[::2], pa.string()))
        found = [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(count)[:-1])]
        return b"".join(x for pair in zip(found, [*(self.packed[self.special[p]] for p in parts[1::2]), b""], strict=True) for x in pair)

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """The packed ids of each text of a column, null as empty; blocks of about ``BLOCK`` bytes are encoded together."""
        for lo, hi in in_blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), BLOCK):
            texts = column.slice(lo, hi - lo).fill_null("").cast(pa.string())
            special = np.zeros(hi - lo, dtype=bool)
            for token in self.special:
                special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
            ids, count = self.encode_block(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
            data, end = ids.astype("<u4").tobytes(), 0
            for i, n in enumerate(count.tolist()):
                begin, end = end, end + 4 * n
                yield self.encode(texts[i].as_py()) if special[i] else data[begin:end]

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of packed ids, joined as the library's decoder joins them; unknown ids are left out."""
        strings, numbers = self.strings, np.frombuffer(ids, "<u4").tolist()
        try:
            return " ".join(map(strings.__getitem__, numbers))
        except KeyError:
            return " ".join([strings[i] for i in numbers if i in strings])


def _gather(flat: np.ndarray, count: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The items ``order`` of ``flat``, which holds items of ``count`` values end to end."""
    return _slices(flat, (np.cumsum(count) - count)[order], count[order])


def _slices(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return flat[at]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One vocabulary per worker process."""
    return WordBpe(path)


@contextlib.contextmanager
def no_cycles():
    """Encoding makes no reference cycles; looking for them in large memos is wasted time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_documents(docs, path: str, text: str = "text", with_output: bool = False):
    """All columns of docs but the text, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    import hashlib

    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_output else [])]
    others = [c for c in docs.columns if c not in (text, *made)]
    kinds = {"n_tokens": LongType(), "ids": ArrayType(LongType()), "ids_sha256": StringType(), "decoded_sha256": StringType(), "decoded": StringType()}
    schema = StructType([*(docs.schema[c] for c in others), *(StructField(c, kinds[c]) for c in made)])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            count, ids_hash, text_hash, all_ids, all_text = [], [], [], [], []
            with no_cycles():
                for ids in bpe.encode_column(batch.column(text)):
                    decoded = bpe.decode(ids)
                    count.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_output:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int64))
                        all_text.append(decoded)
            made_columns = [pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if with_output:
                made_columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_text, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made_columns], names=[*others, *made])

    return docs.select(*others, text).mapInArrow(trimmed(run), schema)
