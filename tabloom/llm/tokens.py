"""Token ids of whole texts, through the tokenizers library, in Arrow batches.

A tokenizer that drops white space and never joins across it gives a text the
ids of its words, one after another. So each distinct word of a batch is encoded
once, words are looked up, and the ids are gathered; words met before by the same
Python worker come from a bounded memo. Words with combining marks, NUL or the
opening of a control token are encoded as they are, without the shortcuts below;
so are words where an ASCII mark follows a letter that the normalizer takes apart.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabloom.llm.common import caches, give_back, spread

END_ID = 2
#: Words that a worker remembers before it starts anew.
MEMO = 400_000
#: Words that the library gets in one string; the time per word grows with the string.
TOGETHER = 100
#: Words of small Latin letters: no normal form, lower case or split changes them.
LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
SEPARATOR = "\x00"
#: Code points that are looked at together.
CODES = 1 << 13
#: ASCII signs before which words are cut, for a character class.
MARKS = r"!-@\[-`{-~"

_encoders: dict[str, Encoder] = {}
caches["tokens"] = _encoders.clear


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """The worker's encoder for a file; workers are reused, so the memo serves several tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = memo
    return _encoders[path]


def taken_apart(normalizer) -> str:
    """All letters whose normal form holds more than letters, as the Turkish dotted I and letters with a nukta."""
    if normalizer is None:
        return ""
    out = []
    for first in range(0, 0x110000, CODES):
        known = pa.array([chr(c) for c in range(max(0x80, first), first + CODES) if not 0xD800 <= c < 0xE000], pa.string())
        known = known.filter(pc.match_substring_regex(known, r"^\p{L}$"))
        if not len(known):
            continue
        forms = pa.array(normalizer.normalize_str(" ".join(known.to_pylist())).split(" "))
        if len(forms) != len(known):
            forms = pa.array([normalizer.normalize_str(x) for x in known.to_pylist()])
        out += known.filter(pc.invert(pc.match_substring_regex(forms, r"^\p{L}+$"))).to_pylist()
    return "".join(out)


def token_widths(plain) -> np.ndarray:
    """Bytes of the text that each id of a byte-level model stands for."""
    model = json.loads(plain.to_str())["model"]
    suffix = model.get("end_of_word_suffix") or ""
    widths = np.zeros(max(model["vocab"].values(), default=-1) + 1, dtype=np.int64)
    for token, i in model["vocab"].items():
        widths[i] = len(token.removesuffix(suffix))
    return widths


class Encoder:
    most = MEMO

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # the same model for words that need no normalizer and no split
        self.plain = Tokenizer.from_str(json.dumps(json.loads(self.library.to_str()) | {"normalizer": None, "added_tokens": []}))
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_bytes])
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.separator = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        self.widths = token_widths(self.plain)
        apart = taken_apart(self.library.normalizer)
        self.odd = r"[\p{M}\x00]|<\|" + (f"|[{apart}][{MARKS}]" if apart else "")
        self._forget()
        give_back()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.pool = np.zeros(0, dtype=self.dtype)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def __call__(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), each text closed by ``end_id``, and their counts."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        pool, starts, lengths = self._words(coded.dictionary)
        index = coded.indices.to_numpy()
        per_word = lengths[index]
        flat = pool[spread(starts[index], per_word)]
        word_ends = np.concatenate([[0], np.cumsum(per_word)])
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
        counts = np.diff(word_ends[offsets])
        if end_id is None:
            return flat, counts
        out = np.full(len(flat) + len(counts), end_id, dtype=self.dtype)
        own = np.ones(len(out), dtype=bool)
        own[np.cumsum(counts + 1) - 1] = False
        out[own] = flat
        return out, counts + 1

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(words, self.odd).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~odd)) if odd.any() else words
        # a letter that stays letters and an ASCII mark after it never share a token; letters of either case do
        parts = pc.ascii_split_whitespace(
            pc.replace_substring_regex(pc.ascii_lower(plain), rf"(\p{{L}})([{MARKS}])", r"\1 \2")
        )
        coded = parts.flatten().dictionary_encode()
        which = self._remembered(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        piece = self.lengths[which]
        flat = self.pool[spread(self.starts[which], piece)]
        ends = np.concatenate([[0], np.cumsum(piece)])
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])]
        if not odd.any():
            return flat, bounds[:-1], np.diff(bounds)
        alone = [e.ids for e in self.library.encode_batch(words.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        starts, lengths = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        starts[~odd], lengths[~odd] = bounds[:-1], np.diff(bounds)
        lengths[odd] = [len(x) for x in alone]
        starts[odd] = len(flat) + np.cumsum(lengths[odd]) - lengths[odd]
        return np.concatenate([flat, *(np.array(x, dtype=self.dtype) for x in alone)]), starts, lengths

    def _remembered(self, words: list[str]) -> np.ndarray:
        if len(self.memo) + len(words) > self.most:
            self._forget()
        memo = self.memo
        new = [w for w in words if w not in memo]
        if new:
            letters, others = [], []
            for w in new:
                (letters if LETTERS(w) else others).append(w)
            flat, lengths = zip(self._measured(letters), self._encoded(self.library, others), strict=True)
            lengths = np.concatenate(lengths)
            memo.update(zip(letters + others, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, *flat])
        return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))

    def _measured(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of small letters and their counts, told apart by the bytes that the ids stand for."""
        joined = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        found = self.plain.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(x.ids for x in found), dtype=self.dtype)
        ends = np.cumsum(self.widths[flat])
        word_ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64))
        last = np.searchsorted(ends, word_ends)
        # every byte has its id and every word ends with one
        if len(ends) and ends[-1] == word_ends[-1] and (ends[last] == word_ends).all():
            return flat, np.diff(last, prepend=-1)
        return self._encoded(self.plain, words)

    def _encoded(self, library, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and their counts."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        joined = [f" {SEPARATOR} ".join(g) for g in groups]
        flat, counts = [np.zeros(0, dtype=self.dtype)], [np.zeros(0, dtype=np.int64)]
        for group, found in zip(groups, library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.separator[0]) if len(self.separator) == 1 else np.zeros(0, dtype=np.int64)
            if len(cuts) == len(group) - 1:
                flat.append(np.delete(ids, cuts))
                counts.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
            else:
                alone = [self.library.encode(w, add_special_tokens=False).ids for w in group]
                flat.append(np.array([i for x in alone for i in x], dtype=self.dtype))
                counts.append(np.array([len(x) for x in alone], dtype=np.int64))
        return np.concatenate(flat), np.concatenate(counts)
