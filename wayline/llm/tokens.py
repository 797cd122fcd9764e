"""Token ids of whole texts, as Arrow batches, with a bounded cache of words."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a task keeps with their ids before it forgets them all; bounds its memory.
CACHE_WORDS = 500_000
#: Bytes of text that are turned into ids at a time.
SLICE_BYTES = 1 << 20


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine; each executor asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = name if os.path.isabs(name) else vocabulary(name)
    return WordEncoder(Tokenizer.from_file(path))


#: What the tokenizer's pre-tokenizer takes as one piece, in lower case, for words of the characters in _PLAIN.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_PLAIN = "^[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+$"


class WordEncoder:
    """Ids of texts whose tokenizer never joins what white space divides.

    Texts are cut at spaces and line ends and each distinct word is encoded once, by the library. Most words are encoded many at a
    time, with spaces between: each piece of a word ends with a token that is marked as a word's end, so counting a word's pieces tells
    where its ids end. Words with rarer characters, or with what may be a special token, are encoded one by one.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, words: pa.Array) -> None:
        """Encode ``words``, none of which is known."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        ids, sizes = [self.pool], []
        easy, hard = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        names = easy.to_pylist()
        pieces = pc.count_substring_regex(pc.utf8_lower(easy), _PIECES).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [" ".join(names[k : k + 2000]) for k in range(0, len(names), 2000)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            got = np.array(e.ids, np.int32)
            last = np.flatnonzero(self.ends[got]) + 1
            upto = np.cumsum(pieces[2000 * k : 2000 * k + 2000])
            if len(last) != upto[-1]:
                raise ValueError("a word's pieces were miscounted")
            ends = last[upto - 1]
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False):
            ids.append(np.array(e.ids, np.int32))
            sizes.append(np.array([len(e.ids)]))
        new = np.concatenate([np.empty(0, np.int64), *sizes])
        at = len(self.pool) + np.cumsum(new) - new
        self.known.update(zip([*names, *hard], range(len(self.size), len(self.size) + len(new)), strict=True))
        self.first, self.size, self.pool = np.concatenate([self.first, at]), np.concatenate([self.size, new]), np.concatenate(ids)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of ``words`` stands among the known ones."""
        names = words.to_pylist()
        if len(self.known) + len(names) > CACHE_WORDS:
            self.forget()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        if (at < 0).any():
            self._learn(words.filter(pa.array(at < 0)))
            at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of non-null ``texts`` one after another, and where each text's begin (one more at the end)."""
        flat = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
        if not pc.any(pc.match_substring(flat, "<|")).as_py():
            flat = pc.ascii_lower(flat)  # as the tokenizer does anyway
        split = pc.split_pattern(flat, " ")
        words = split.flatten().dictionary_encode()
        place = self._places(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        n = self.size[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.first[place] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = np.asarray(split.offsets, np.int64)
        return ids, ends[offsets - offsets[0]]


def encoded(batches: Iterator[pa.RecordBatch], name: str, id_col: str = "doc_id", text_col: str = "text") -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids of the rows, token ids, starts) for slices of about SLICE_BYTES of text; null texts have no tokens."""
    encoder = _encoder(name)
    for batch in batches:
        texts = pc.fill_null(batch.column(text_col).cast(pa.large_string()), "")
        ids = batch.column(id_col)
        for lo, hi in text_slices(texts):
            tokens, starts = encoder.encode(texts.slice(lo, hi - lo))
            yield ids.slice(lo, hi - lo), tokens, starts


def text_slices(texts: pa.Array, at_most: int = SLICE_BYTES, cuts: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``at_most`` bytes together, one row at least; if ``cuts`` are given, runs begin at some of these only."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.empty(0, np.int64)
    allowed = np.append(np.arange(len(texts)) if cuts is None else cuts, len(texts))
    lo, base = 0, 0
    while lo < len(texts):
        hi = int(np.searchsorted(ends, base + at_most, "right"))
        next_cut = int(np.searchsorted(allowed, lo, "right"))
        hi = int(allowed[max(next_cut, int(np.searchsorted(allowed, hi, "right")) - 1)])
        yield lo, hi
        lo, base = hi, int(ends[hi - 1])


def crc32_of(ids: np.ndarray) -> int:
    """Checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
