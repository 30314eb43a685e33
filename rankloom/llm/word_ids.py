"""Token ids of texts by way of their distinct words.

Where a tokenizer turns white space into blanks and cuts there before it merges, a text's ids are those of its
words, one after another. NORMALIZER and PRE_TOKENIZER also cut between letters, digits and other signs. Texts are
therefore cut behind ASCII white space and between ASCII or Latin-1 letters, ASCII digits and other ASCII signs,
each distinct word is encoded once and remembered, and the ids of all texts are gathered with numpy. A cut never
stands before a sign that could combine with the one before it. Texts that hold an added token are cut behind
white space only. Tokenizers with other settings encode whole texts.

New words are encoded many in one call. Words of letters are one word to the tokenizer too, and where it marks the
ends of words by a suffix, the ids with this suffix tell them apart. Other words get the digit MARK behind them:
digits are tokens of their own, so the id of MARK only stands where a mark stood; words that hold this digit are
encoded one by one.
"""

from __future__ import annotations

import json
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MARK = "0"
CALL_WORDS = 64
#: A Python worker forgets its words, after a batch, when it holds more words or ids than these.
MEMORY_WORDS = 1 << 20
MEMORY_IDS = 1 << 23
#: Kinds of bytes; OTHER are those of signs beyond Latin-1 letters.
OTHER, BLANK, LETTER, DIGIT, SIGN = range(5)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[:128] = SIGN
KIND[[*range(9, 14), 32]] = BLANK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
APOSTROPHE, LATIN_1, TIMES, DIVIDE = 0x27, 0xC3, 0x97, 0xB7


def cuts_at_blanks(tokenizer) -> bool:
    """Whether this tokenizer's settings give a text the ids of its words."""
    facts = json.loads(tokenizer.to_str())
    known = (facts["normalizer"], facts["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
    added = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or MARK in t["content"])
        and not any(c.isspace() for c in t["content"])
        and re.search(r"[a-z][!-/:-@\[-`{-~]", t["content"])
        for t in facts["added_tokens"]
    )
    plain = not facts["model"].get("dropout") and not facts["truncation"] and not facts["padding"]
    return known and added and plain and len(tokenizer.encode(MARK, add_special_tokens=False).ids) == 1


def word_ends(tokenizer) -> np.ndarray:
    """Of each id, whether it ends a word; no id does where not every word's end shows."""
    from tokenizers.pre_tokenizers import ByteLevel

    facts = json.loads(tokenizer.to_str())
    model = facts["model"]
    suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
    ends = np.zeros(max([*vocab.values(), *(t["id"] for t in facts["added_tokens"])]) + 1, dtype=bool)
    if suffix and not model.get("ignore_merges") and all(c + suffix in vocab for c in ByteLevel.alphabet()):
        ends[[number for token, number in vocab.items() if token.endswith(suffix)]] = True
    return ends


class WordIds:
    """Encodes batches of texts and remembers the ids of their words."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.by_word = cuts_at_blanks(tokenizer)
        self.mark = tokenizer.encode(MARK, add_special_tokens=False).ids if self.by_word else None
        self.added = [t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]]
        self.ends = word_ends(tokenizer) if self.by_word else None
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(sizes.sum())), sizes

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
        """All ids of words of letters, how many each has, these words, and those the tokenizer cuts further."""
        calls = [words[i : i + CALL_WORDS] for i in range(0, len(words), CALL_WORDS)]
        ids, sizes = self._each([" ".join(call) for call in calls])
        # Each word has an end at least: as many ends as words, and each has one.
        call = np.repeat(np.arange(len(calls)), sizes)
        ends = np.bincount(call[self.ends[ids]], minlength=len(calls))
        one = ends == np.fromiter(map(len, calls), dtype=np.int64, count=len(calls))
        known = [w for words, good in zip(calls, one) if good for w in words]
        other = [w for words, good in zip(calls, one) if not good for w in words]
        ids = ids[one[call]]
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), known, other

    def _learn(self, words: list[str]) -> None:
        by_end = self.ends.any()
        ids, sizes, letters, cut = self._letters([w for w in words if by_end and w.isalpha()])
        rest = cut + [w for w in words if not (by_end and w.isalpha())]
        marked = [w for w in rest if MARK not in w]
        other = [w for w in rest if MARK in w]
        calls = [f" {MARK} ".join([*marked[i : i + CALL_WORDS], ""]) for i in range(0, len(marked), CALL_WORDS)]
        found, _ = self._each(calls)
        ends = np.flatnonzero(found == self.mark[0])
        if len(ends) != len(marked):
            raise ValueError(f"{len(ends)} marks found behind {len(marked)} words")
        more, more_sizes = self._each(other)
        self.numbers.update(zip(letters + marked + other, range(len(self.numbers), len(self.numbers) + len(words))))
        self.ids = np.concatenate([self.ids, ids, found[found != self.mark[0]], more])
        sizes = np.concatenate([sizes, np.diff(ends, prepend=-1) - 1, more_sizes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) one after another, and how many each text has."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.by_word:
            return self._each(texts.to_pylist())
        holds_added = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            holds_added |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if len(self.numbers) > MEMORY_WORDS or len(self.ids) > MEMORY_IDS:
            self._forget()
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]].copy()
        bounds = bounds - bounds[0]
        words, firsts = cut_words(raw, bounds, holds_added)
        words = words.dictionary_encode()
        known = words.dictionary.to_pylist()
        numbers = np.fromiter(map(self.numbers.get, known, repeat(-1)), dtype=np.int64, count=len(known))
        if len(unknown := np.flatnonzero(numbers < 0)):
            new = [known[i] for i in unknown]
            self._learn(new)
            numbers[unknown] = [self.numbers[w] for w in new]
        number = numbers[words.indices.to_numpy()]
        starts, sizes = self.starts[number], self.starts[number + 1] - self.starts[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
        return self.ids[places], np.diff(ends[np.searchsorted(firsts, bounds)])


def cut_words(raw: np.ndarray, bounds: np.ndarray, at_blanks: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Words of texts that lie in `raw` between `bounds`, without blanks, and the places of their first bytes.

    Their A-Z are lower-cased, also in `raw`. Texts `at_blanks` are cut there only and keep their case.
    """
    kind = KIND[raw]
    latin = np.flatnonzero(raw == LATIN_1)
    latin = latin[(raw[latin + 1] != TIMES) & (raw[latin + 1] != DIVIDE)]
    kind[latin] = kind[latin + 1] = LETTER
    filled = kind != BLANK
    if at_blanks.any():
        kind[filled & np.repeat(at_blanks, np.diff(bounds))] = OTHER
    first = filled.copy()
    here, before = kind[1:], kind[:-1]
    first[1:] &= ((here != before) | (here == DIGIT)) & (here != OTHER) & (before != OTHER)
    # 's, 't and the like are words of the tokenizer.
    first[1:] &= (raw[:-1] != APOSTROPHE) | (here != LETTER)
    first[1:] |= filled[1:] & ~filled[:-1]
    text_starts = bounds[:-1][bounds[:-1] < len(raw)]
    first[text_starts] = filled[text_starts]
    # J and a caron stay two signs, j and a caron become one: letters before a sign that may combine keep their case.
    upper = (kind == LETTER) & (raw >= 65) & (raw <= 90)
    upper[:-1] &= here != OTHER
    raw[upper] += 32
    firsts = np.flatnonzero(first)
    cuts = np.append(np.flatnonzero(first[filled]), np.count_nonzero(filled)).astype(np.int32)
    return pa.StringArray.from_buffers(len(firsts), pa.py_buffer(cuts), pa.py_buffer(raw[filled])), firsts
