"""Segments of texts, as vocabularies see them: cut before runs of blanks, where tokens verifiably never cross."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voltspan.llm.packing import byte_alphabet

#: A blank after something that isn't white space; not where it is the last character, as a tokenizer that puts a blank before its text itself has none to give.
_CUT = re.compile(r"(?<=\S)(?= )(?! \Z)")
_AWKWARD = re.compile(r"\s | \Z")


def parted(text: str) -> tuple[str, list[str]]:
    """The first segment of a text, and the others without the blank that each begins with."""
    if _AWKWARD.search(text):
        first, *rest = _CUT.split(text)
        return first, [s[1:] for s in rest]
    first, *rest = text.split(" ")
    return first, rest


def cut(text: str) -> list[str]:
    """The segments of a text, in order: all but the first begin with a blank, and end in something that is no white space (but the last)."""
    first, rest = parted(text)
    return ([first] if first else []) + [f" {s}" for s in rest]


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, special: bool):
    """The tokenizer of a byte-level file. special: whether its special tokens' strings in a text count as such.

    Raises if tokens could cross a cut: its pattern must be the byte-level one, which takes a blank only before what follows it, and its
    normalizer must leave texts as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} may have tokens across blanks")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return tokenizer


#: Segments of a word and marks after it, and all of these characters, whose classes every library knows alike; without their blank.
_EASY = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_PLAIN = re.compile(r"[\t\n\r!-~À-ÖØ-öø-ÿ ]*")
#: The byte-level pattern for such characters.
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of each run, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, empty ones too."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Runs(NamedTuple):
    """Rows of numbers: all of them, and how many each row has."""

    values: np.ndarray
    counts: np.ndarray

    def take(self, rows: np.ndarray) -> Runs:
        starts = np.cumsum(self.counts) - self.counts
        return Runs(self.values[spans(starts[rows], self.counts[rows])], self.counts[rows])

    def of(self, inner: Runs) -> Runs:
        """Each row's numbers as rows of inner, one after the other."""
        found = inner.take(self.values)
        return Runs(found.values, by_row(found.counts, self.counts))

    def then(self, other: Runs) -> Runs:
        return Runs(np.concatenate((self.values, other.values)), np.concatenate((self.counts, other.counts)))


#: Bytes of words and their ids that a worker remembers from run to run at most.
REMEMBERED = 16_000_000
#: What stands in RE2 for a text that is not cut at every blank: white space before a blank, or a blank at its end.
_AWKWARD_RE2 = r"[\t-\r\x1c-\x20\x{85}\pZ] | \z"


class Ids:
    """Ids of some texts by the tokenizer, each of their distinct words tokenised once, and not again while it is remembered."""

    def __init__(self, path: str, special: bool = True):
        self.tokenizer, self.path = byte_tokenizer(path, special), path
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        alphabet, words = byte_alphabet(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(words.values()) + 1, np.int64)  # bytes of each token
        self.size[list(words.values())] = [len(w) if all(c in alphabet for c in w) else 0 for w in words]
        self.words, self.known = pa.array([], pa.large_string()), Runs(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def whole(self, texts: list[str]) -> Runs:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return Runs(np.fromiter(chain.from_iterable(found), np.uint32), np.array(list(map(len, found)), np.int64))

    def lined(self, words: list[str]) -> Runs:
        """Ids of words that begin with a blank and have no other white space: they stand in lines, one after the other, as no token crosses a
        cut, and the tokens' sizes tell them apart."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            line = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            token_ends, ends = np.cumsum(self.size[line]), np.cumsum([len(w.encode()) for w in some])
            at = np.searchsorted(token_ends, ends)
            if token_ends[-1] != ends[-1] or (token_ends[at] != ends).any():
                raise ValueError(f"tokens of {self.path} cross blanks")
            ids.append(line)
            counts.append(np.diff(at, prepend=-1))
        return Runs(np.concatenate(ids), np.concatenate(counts))

    def recalled(self, words: pa.Array) -> Runs:
        """Ids of distinct words, a blank before each; only those that aren't remembered are tokenised. Beyond REMEMBERED bytes, only the latest call's stay, as far as they fit."""
        words = words.cast(pa.large_string())
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        others = words.filter(pa.array(new))
        every, known = pa.concat_arrays([self.words, others]), self.known.then(self.lined([f" {w}" for w in others.to_pylist()]))
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[new] = len(self.words) + np.arange(len(others))
        found = known.take(place)
        for self.words, self.known in ((every, known), (words, found), (words[:0], found.take(place[:0]))):
            if self.words.nbytes + self.known.values.nbytes + self.known.counts.nbytes <= REMEMBERED:
                break
        return found

    def encode(self, segments: pa.Array, blank: str) -> Runs:
        """Ids of segments with `blank` before them. Most are a word and marks: their distinct words and marks are tokenised. Others of plain
        characters are parted as the pattern parts them, and the rest, or those with a special token's string, are left whole."""
        found = pc.extract_regex(segments, _EASY) if blank else pa.nulls(len(segments), pa.struct([("word", segments.type), ("marks", segments.type)]))
        if self.special and pc.any(pc.match_substring(segments, self.special[0])).as_py() or len(self.special) > 1:
            found = pc.if_else(pa.array([any(x in f"{blank}{s}" for x in self.special) for s in segments.to_pylist()]), pa.scalar(None, found.type), found)
        easy = found.is_valid().to_numpy(zero_copy_only=False)
        matched = found.filter(pa.array(easy))
        word, marks = (matched.field(n).dictionary_encode() for n in ("word", "marks"))
        words = self.recalled(word.dictionary).then(self.whole(marks.dictionary.to_pylist()))
        places = np.stack((word.indices.to_numpy(), len(word.dictionary) + marks.indices.to_numpy()), 1).ravel()
        simple = Runs(places, np.full(len(word), 2)).of(words)
        rest = [f"{blank}{s}" for s in segments.filter(pa.array(~easy)).to_pylist()]
        parts = [_PLAIN_WORD.findall(s) if _PLAIN.fullmatch(s) and not any(x in s for x in self.special) else [s] for s in rest]
        place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(parts)))}
        inner = Runs(np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64), np.array(list(map(len, parts)), np.int64))
        others = inner.of(self.whole(list(place)))
        return simple.then(others).take(np.where(easy, np.cumsum(easy) - 1, len(simple.counts) + np.cumsum(~easy) - 1))

    def of(self, texts: pa.Array) -> Runs:
        """The ids of each text, none of a null one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        awkward = pc.match_substring_regex(texts, _AWKWARD_RE2)
        parts = pc.split_pattern(texts, " ")
        if pc.any(awkward).as_py():
            parts = pa.array([(lambda p: [p[0], *p[1]])(parted(t)) if a else p for t, a, p in zip(texts.to_pylist(), awkward.to_pylist(), parts.to_pylist(), strict=True)], pa.large_list(pa.large_string()))
        counts = pc.list_value_length(parts).to_numpy().astype(np.int64)
        values = parts.flatten()
        is_first = np.zeros(len(values), bool)
        is_first[np.cumsum(counts) - counts] = True  # each has one at least, if an empty one
        first, rest = values.filter(pa.array(is_first)).dictionary_encode(), values.filter(pa.array(~is_first)).dictionary_encode()
        place = np.zeros(len(values), np.int64)
        place[is_first], place[~is_first] = first.indices.to_numpy(), len(first.dictionary) + rest.indices.to_numpy()
        first, rest = first.dictionary, rest.dictionary
        del texts, parts, values, awkward, is_first  # as large as the texts
        return Runs(place, counts).of(self.encode(first, "").then(self.encode(rest, " ")))


@lru_cache(maxsize=1)
def ids_by(path: str) -> Ids:
    """The tokenizer that a worker keeps from task to task."""
    return Ids(path)
