"""Kernels that count the phrases of one document, or find the listed ones among its tokens, run inside Spark tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dialoom.functions import wordlists as wl

STOP = frozenset(wl.STOP_WORDS)


def fold_possessive(label: str) -> str:
    label = label.replace("_s_", "s_")
    return label[:-2] + "s" if label.endswith("_s") else label


def boundary_ok(first: str, last: str) -> bool:
    """As functions.text.boundary_ok, of words."""
    return first.split("_", 1)[0] not in STOP and last.rsplit("_", 1)[-1] not in STOP


def exact_places(tokens: Sequence[str], terms: Sequence[str], sizes: Sequence[int], stop_words: bool) -> list[tuple[int, int]]:
    """(place in the list, start) wherever so many words give a listed term, possessives folded.

    stop_words: terms of several words do not count with one at either end; single words never do, nor short ones.
    """
    listed: dict[str, int] = {}
    for at, term in enumerate(terms):
        listed.setdefault(term, at)
    # a word without underscore that a term begins with stands there as it is, or folded with an s
    firsts = {first for term in terms for p in (term.split("_", 1)[0],) for first in ((p, p[:-1]) if p.endswith("s") else (p,))}
    wanted = sorted(set(sizes))
    found = []
    for start, word in enumerate(tokens):
        if word not in firsts and "_" not in word:
            continue
        for size in wanted:
            words = tokens[start:start + size]
            if len(words) < size:
                break
            label = word if size == 1 else "_".join(words)
            if size > 1 and "_s" in label:
                label = fold_possessive(label)
            at = listed.get(label)
            if at is None or sizes[at] != size:
                continue
            if (len(word) > 2 and boundary_ok(word, word)) if size == 1 else (not stop_words or boundary_ok(word, words[-1])):
                found.append((at, start))
    return found


def containing_places(tokens: Sequence[str], terms: Sequence[str]) -> list[tuple[int, int]]:
    """(place in the list, start) wherever tokens hold the words of a listed term, one after the other."""
    known: dict[str, int] = {}
    code = np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens))
    distinct = list(known)
    text = "\n".join(distinct)
    ends = np.cumsum([len(t) + 1 for t in distinct])  # of every distinct token and the line break behind it
    after = ends.tolist()

    def holding(word: str) -> np.ndarray:
        """Where tokens hold the word. Distinct tokens are searched as one text, in which no word spans two."""
        if word == "":
            return np.ones(len(tokens), bool)
        held = np.zeros(len(distinct), bool)
        at = text.find(word)
        while at >= 0:
            token = int(ends.searchsorted(at, "right"))
            held[token] = True
            at = text.find(word, after[token])
        return held[code]

    places: dict[str, np.ndarray] = {}
    found = []
    for at, term in enumerate(terms):
        words = term.split("_")
        last = len(tokens) - len(words) + 1
        if last <= 0:
            continue
        for word in words:
            if word not in places:
                places[word] = holding(word)
        starts = reduce(np.logical_and, [places[word][i:i + last] for i, word in enumerate(words)])
        found.extend((at, start) for start in np.flatnonzero(starts).tolist())
    return found


def gram_labels(tokens: Sequence[str], size: int, stop_words: bool) -> tuple[list[str], list[int]]:
    """The phrases of so many words that count and where they start, as operators.terms.gram_rows has them."""
    begins, ends = ([w.split("_", 1)[0] not in STOP for w in tokens], [w.rsplit("_", 1)[-1] not in STOP for w in tokens])
    if size == 1:
        starts = [i for i, w in enumerate(tokens) if begins[i] and ends[i] and len(w) > 2]
        return [tokens[i] for i in starts], starts
    last = len(tokens) - size + 1
    starts = [i for i in range(last) if begins[i] and ends[i + size - 1]] if stop_words else list(range(last))
    labels = ["_".join(tokens[i:i + size]) for i in starts]
    return [fold_possessive(x) if "_s" in x else x for x in labels], starts


def counted_terms(texts: Sequence[Sequence[str]], sizes: Sequence[int], stop_words: bool) -> dict[str, tuple[int, int, int]]:
    """(size, how often, first position from 1) of the phrases of a document's token lists.

    Where two sizes give the same folded phrase, the longer one's numbers count.
    """
    found: dict[str, tuple[int, int, int]] = {}
    for size in sorted(sizes):
        many: Counter[str] = Counter()
        first: dict[str, int] = {}
        for tokens in texts:
            labels, starts = gram_labels(tokens, size, stop_words)
            many.update(labels)
            seen = dict(zip(reversed(labels), reversed(starts)))
            first = seen if not first else {**first, **{t: min(i, first.get(t, i)) for t, i in seen.items()}}
        found.update((term, (size, tf, first[term] + 1)) for term, tf in many.items())
    return found


class Texts:
    """Documents, each with its token lists, with their words as numbers.

    A document of one list, no word of which is "s" or holds an underscore, is `plain`: its phrases are
    never folded, so that the same words are the same phrase and no other words are.
    """

    def __init__(self, texts: pa.Array) -> None:
        rows = pc.list_flatten(texts)
        self.words = pc.list_flatten(rows)
        encoded = self.words.dictionary_encode()
        self.code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = encoded.dictionary
        known = self.known.to_pylist()
        self.place = {w: i for i, w in enumerate(known)}
        self.begins = np.array([w.split("_", 1)[0] not in STOP for w in known], bool)
        self.ends = np.array([w.rsplit("_", 1)[-1] not in STOP for w in known], bool)
        self.short = np.array([len(w) <= 2 for w in known], bool)
        odd = np.array([w == "s" or "_" in w for w in known], bool)[self.code]
        lists, held = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (texts, rows))
        self.at = np.r_[0, np.cumsum(held)].astype(np.int64)  # of every list
        self.of = np.r_[0, np.cumsum(lists)].astype(np.int64)  # of every document, in lists
        odds = np.r_[0, np.cumsum(odd)]
        first, last = self.at[self.of[:-1]], self.at[self.of[1:]]
        self.plain = (lists == 1) & (odds[last] == odds[first])

    def lists(self, doc: int) -> list[list[str]]:
        return [self.words[self.at[i]:self.at[i + 1]].to_pylist() for i in range(self.of[doc], self.of[doc + 1])]

    def numbered(self, size: int) -> bool:
        """Whether a phrase of so many words has a number."""
        return (len(self.known) + 1) ** size < 1 << 62

    def phrases(self, doc: int, size: int, stop_words: bool) -> tuple[np.ndarray, ...]:
        """(number, first place among all words, how often) of the distinct phrases of a plain document that count."""
        lo, hi = self.at[self.of[doc]], self.at[self.of[doc + 1]]
        code = self.code[lo:hi]
        last = max(len(code) - size + 1, 0)
        if size == 1:
            kept = self.begins[code] & self.ends[code] & ~self.short[code]
        else:
            kept = self.begins[code[:last]] & self.ends[code[size - 1:]] if stop_words else np.ones(last, bool)
        starts = np.flatnonzero(kept)
        number = code[starts]
        for i in range(1, size):
            number = number * len(self.known) + code[starts + i]
        number, first, many = np.unique(number, return_index=True, return_counts=True)
        return number, lo + starts[first], many

    def numbers(self, terms: Sequence[str], size: int) -> np.ndarray:
        """The numbers of those of the terms that are so many known words."""
        found = []
        for words in (term.split("_") for term in terms):
            if len(words) == size and all(w in self.place for w in words):
                found.append(reduce(lambda number, w: number * len(self.known) + self.place[w], words, 0))
        return np.array(found, np.int64)

    def labels(self, first: np.ndarray, size: int) -> pa.Array:
        """The phrases of so many words of plain documents that begin at these places among all words."""
        words = [self.known.take(pa.array(self.code[first + i])) for i in range(size)]
        return words[0] if size == 1 else pc.binary_join_element_wise(*words, "_")
