"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that stand side by side in no vocabulary token can never end up in one token, so
the place between them is a certain cut. A text falls apart at white space, at the splits of the
vocabulary's pre-tokenizer and at the certain cuts; every fragment is merged on its own, once, and the ids
are put together again. Results equal those of the tokenizers library for vocabularies of this kind: BPE
over byte symbols with a mark for word ends, NFC, lower case, white space dropped, no decoder.

Null texts count as empty; an empty text has no ids and decodes to an empty text. Repeated rows give
repeated results, other columns are kept or dropped by the caller.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
import weakref
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from gridloom.llm.common import Memo, release, small_batches

#: White space of the vocabulary's pattern. Fixed value.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_RARE = re.compile("[^\x00-ɏ]")
_OTHER_SPACE = re.compile("[\x1c-\x1f]")  # str.split() would cut here too
CHUNK_BYTES, WORD_BYTES = 64 << 20, 32 << 20  # what the memories of a worker may hold
FRAGMENT_BYTES = 8 << 20
ALONE = 4  # times as much where no other stage needs the worker's memory
GROUP_CHARS, MOST_AT_ONCE, SYMBOLS = 1 << 21, 64, 512
NO_RANK = 1 << 30


class Codec:
    """One vocabulary file, loaded once for each Python worker."""

    def __init__(self, path: str, times: int = 1):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.made_ids = np.array(self.made, dtype=np.int64)
        pairs = np.array(list(self.rank), dtype=np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), dtype=np.int64)[order]
        self.inner = {c: vocab[c] for c in byte_symbols() if c in vocab}
        self.last = {c: vocab[c + self.suffix] for c in self.inner if c + self.suffix in vocab}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in [*vocab.items(), *self.added.items()]:
            self.token[i] = t
        self.joined = self._pairs_inside(vocab)
        self.symbols = byte_symbols()
        self._tables()
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.library = Tokenizer.from_file(path)
        self.words = regex.compile(splits[0])
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        me = weakref.proxy(self)  # no cycle: what gc.freeze() has set aside is freed by its last reference alone
        self.memo = Memo(lambda chunk: b"".join(map(me.known_words.__getitem__, me._words(chunk))), times * CHUNK_BYTES)
        self.known_words = Memo(lambda word: me._word(word), times * WORD_BYTES)
        self.fragments = Memo(lambda fragment: me.merge([me.inner[c] for c in fragment]), FRAGMENT_BYTES)

    def _tables(self) -> None:
        """By code point of the symbols: what stands together in some token, first ids, ranks of first pairs. Symbols
        that end a word are numbered from SYMBOLS on."""
        self.complete = len(self.inner) == len(self.last) == 256 and len(self.pair_keys) > 0
        self.joined_table = np.zeros((SYMBOLS, SYMBOLS), bool)
        for pair in self.joined:
            if len(pair) == 2 and max(map(ord, pair)) < SYMBOLS:
                self.joined_table[ord(pair[0]), ord(pair[1])] = True
        self.symbol_ids = np.full(2 * SYMBOLS, -1, np.int64)
        for shift, ids in ((0, self.inner), (SYMBOLS, self.last)):
            for symbol, i in ids.items():
                self.symbol_ids[ord(symbol) + shift] = i
        self.symbol_ranks = np.full((2 * SYMBOLS, 2 * SYMBOLS), NO_RANK, np.int64)
        known = np.flatnonzero(self.symbol_ids >= 0)
        if self.complete:
            left, right = self.symbol_ids[known][:, None], self.symbol_ids[known][None, :]
            self.symbol_ranks[np.ix_(known, known)] = self._rank(left, right)

    def _pairs_inside(self, vocab: dict[str, int]) -> set[str]:
        """All pairs of neighbouring symbols inside a token; any other pair is a certain cut."""
        pairs = set()
        for token in vocab:
            body = token.removesuffix(self.suffix)
            pairs.update(map("".join, zip(body, body[1:])))
        return pairs

    def _words(self, chunk: str) -> list[str]:
        """Words of a chunk in byte symbols."""
        if not chunk.isascii() and _RARE.search(chunk):
            return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        if chunk.isalpha():
            words = [chunk]
        elif chunk[-1] in ".," and chunk[:-1].isalpha():
            words = [chunk[:-1], chunk[-1]]
        else:
            words = self.words.findall(chunk)
        if chunk.isascii() and chunk.isprintable():
            return words
        return ["".join(self.symbols_of(w)) for w in words]

    def symbols_of(self, word: str) -> list[str]:
        return [self.symbols[b] for b in word.encode("utf-8")]

    def _word(self, word: str) -> bytes:
        """A word cut at every certain cut; its fragments are merged one by one."""
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in self.joined]
        ids: list[int] = []
        for start, end in zip([0, *cuts], cuts):
            ids += self.fragments[word[start:end]]
        last = word[cuts[-1] if cuts else 0 :]
        ids += self.merge([*[self.inner[c] for c in last[:-1]], self.last[last[-1]]])
        return array("I", ids).tobytes()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def _words_at_once(self, words: list[str]) -> dict[str, bytes]:
        """Words of one length side by side: certain cuts are found in a table of symbol pairs, and words without
        one, a single fragment each, lose a symbol each in every step of merging."""
        by_length: dict[int, list[str]] = defaultdict(list)
        for word in words:
            by_length[len(word)].append(word)
        out = {}
        for length, group in by_length.items():
            if length > MOST_AT_ONCE or not self.complete:
                out.update((w, self._word(w)) for w in group)
                continue
            names = np.array(group, dtype=object)
            codes = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.int64)
            cut = ~self.joined_table[codes[:, :-1], codes[:, 1:]].all(axis=1)
            out.update((w, self._word(w)) for w in names[cut])
            names, codes = names[~cut], codes[~cut]
            codes[:, -1] += SYMBOLS
            ids = self.symbol_ids[codes]
            ranks = self.symbol_ranks[codes[:, :-1], codes[:, 1:]]
            while len(names):
                width = ids.shape[1] - 1
                best = ranks.argmin(axis=1) if width else np.zeros(len(ids), np.int64)
                rank = ranks[np.arange(len(ids)), best] if width else np.full(len(ids), NO_RANK)
                ends = rank == NO_RANK
                done = ids[ends].astype("<u4").tobytes()
                step = 4 * ids.shape[1]
                out.update((w, done[i * step : i * step + step]) for i, w in enumerate(names[ends]))
                names, ids, ranks, best, rank = names[~ends], ids[~ends], ranks[~ends], best[~ends], rank[~ends]
                if not len(names):
                    break
                place = np.arange(width)
                ids = np.take_along_axis(ids, place + (place > best[:, None]), axis=1)
                ids[np.arange(len(ids)), best] = self.made_ids[rank]
                place = place[:-1]
                ranks = np.take_along_axis(ranks, place + (place >= best[:, None]), axis=1)
                for side in (best - 1, best):
                    some = np.flatnonzero((side >= 0) & (side < width - 1))
                    at = side[some]
                    ranks[some, at] = self._rank(ids[some, at], ids[some, at + 1])
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges in order of rank, leftmost first; a heap keeps long fragments at n log n."""
        if len(ids) > 200:
            return self._merge_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(p, NO_RANK) for p in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NO_RANK:
                break
            i = ranks.index(rank)
            ids[i] = made[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    new = (ids[left], ids[after[left]])
                    if new in self.rank:
                        heapq.heappush(heap, (self.rank[new], left, new))
        return [x for x, a in zip(ids, alive) if a]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self._held, self._chunks(text))), dtype="<u4")

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The same for many texts, in order: each distinct chunk is met once for some ``GROUP_CHARS`` of text, and
        what is not known yet is merged together."""
        group, size = [], 0
        for text in texts:
            group.append(self._chunks(text))
            size += len(text or "")
            if size > GROUP_CHARS:
                yield from self._encoded(group)
                group, size = [], 0
        yield from self._encoded(group)

    def _encoded(self, group: list[list]) -> Iterator[np.ndarray]:
        memo, held, parts, whole = self.memo, {}, {}, []  # ``held`` is for this group alone, and small
        for chunk in set().union(*group):
            ids = memo.get(chunk) if chunk.__class__ is str else chunk
            if ids is not None:
                held[chunk] = ids
            elif chunk.isascii() and chunk.isalpha():
                whole.append(chunk)
            else:
                parts[chunk] = self._words(chunk)
        words = set(chain(whole, chain.from_iterable(parts.values())))
        known = {w: ids for w in words if (ids := self.known_words.get(w)) is not None}
        new = self._words_at_once([w for w in words if w not in known])
        for word, ids in new.items():
            self.known_words.put(word, ids)
        known |= new
        made = {chunk: known[chunk] for chunk in whole}
        made.update((chunk, b"".join([known[w] for w in line])) for chunk, line in parts.items())
        for chunk, ids in made.items():
            memo.put(chunk, ids)
        held |= made
        for chunks in group:
            yield np.frombuffer(b"".join(map(held.__getitem__, chunks)), dtype="<u4")

    def _held(self, chunk: str | bytes) -> bytes:
        return self.memo[chunk] if chunk.__class__ is str else chunk

    def _chunks(self, text: str | None) -> list[str | bytes]:
        """Runs between white space of the normalised text; ids of added tokens stand as bytes among them."""
        if not text:
            return []
        if self.special is None or not any(t in text for t in self.added):
            return self._plain(text)
        parts: list[str | bytes] = []
        for part in self.special.split(text):
            parts += [self._added(part)] if part in self.added else self._plain(part)
        return parts

    def _added(self, token: str) -> bytes:
        return np.array([self.added[token]], "<u4").tobytes()

    def _plain(self, text: str) -> list[str]:
        if _RARE.search(text):  # classes and cases of rare letters differ between Unicode versions
            return list(filter(None, self.library.normalizer.normalize_str(text).split(" ")))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: case by character
        text = text.lower()
        return text.split() if not _OTHER_SPACE.search(text) else [c for c in _SPACE.split(text) if c]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by one space, as for a vocabulary without decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, times: int = 1) -> Codec:
    if (path, times) not in _codecs:
        _codecs[path, times] = Codec(path, times)
        gc.collect()  # garbage would be set aside too, for good
        gc.freeze()  # what a worker has loaded need not be searched for garbage again and again
    return _codecs[path, times]


def forget() -> None:
    """Let go of the vocabularies of this worker and hand freed memory back to the system."""
    _codecs.clear()
    release()


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids, decoded text. Works in place, without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(path)
        for batch in batches:
            ids = list(code.encode_many(batch["t"]))
            yield pd.DataFrame({"k": batch["k"], "ids": [i.astype("i4") for i in ids], "decoded": [code.decode(i) for i in ids]})

    small_batches(docs.sparkSession)
    frame = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    return frame.mapInPandas(run, f"k {kind}, ids array<int>, decoded string").withColumnRenamed("k", key)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, number of ids, SHA-256 of the ids in decimal and of the decoded text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(path)
        for batch in batches:
            rows = []
            for ids in code.encode_many(batch["text"]):
                rows.append((len(ids), _sha(" ".join(map(str, ids.tolist()))), _sha(code.decode(ids))))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
