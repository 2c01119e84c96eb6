"""Quality rules by suffix array: how much of a text repeats itself.

The suffix array is over the words of a text. Its longest-common-prefix (LCP) intervals are the maximal repeated
substrings; a word is covered if it lies in a repeated substring of ``min_repeat`` words or more. A text is kept if it
passes the base rules, at most ``max_covered`` of its words are covered and no repeat is longer than ``longest``.
The same array gives the words in repeated three-word windows (the LCP intervals of three words or more).

Texts are worked on in blocks of a few hundred thousand words: one array for a block, in which suffixes of different
texts never share a prefix, as the first key is the text. So a task needs memory for one block, or one longest text.

Null and empty texts have no words: all counts are zero and they fail the base rules. Repeated rows give repeated
results; nothing depends on doc_id, which may be null. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_SPACE, col, map_blocks, split_words

#: Fixed values of the base rules: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def suffix_array(ids: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP of neighbours for concatenated texts; ``text`` is each word's text, ``end`` where it ends.

    Prefix doubling: after round m, suffixes are sorted by their first 2^m words. Only groups that are still tied are
    sorted again. The ranks of each round stay, so that the LCP is found by descending powers of two.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    rounds, width = [rank.astype(np.int32)], 1
    while True:
        last = np.append(new[1:], True)
        at = np.flatnonzero(~(new & last))
        if not len(at):
            break
        i = order[at]
        j = i + width
        both = rank[i] * (n + 2) + np.where(j < end[i], rank[np.minimum(j, n - 1)] + 1, 0)
        by = np.argsort(both, kind="stable")
        i, both = i[by], both[by]
        order[at] = i
        first = np.ones(len(at), bool)
        first[1:] = both[1:] != both[:-1]
        new[at] = first
        rank[i] = at[first][np.cumsum(first) - 1]
        rounds.append(rank.astype(np.int32))
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    end_a, end_b = end[a], end[b]
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(rounds[0][a] == rounds[0][b])
    a, b, end_a, end_b = a[live], b[live], end_a[live], end_b[live]
    got = np.zeros(len(live), np.int64)
    for m in range(len(rounds) - 1, -1, -1):
        ok = (a < end_a) & (b < end_b)
        ok &= rounds[m][np.where(ok, a, 0)] == rounds[m][np.where(ok, b, 0)]
        step = ok * (1 << m)
        a, b, got = a + step, b + step, got + step
    lcp[live + 1] = got
    return order, lcp


def lcp_intervals(order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """The LCP intervals of ``least`` words or more, repeats that no longer one at the same places extends to the right: (length, where it begins)."""
    found, stack = [], []
    for t in range(1, len(order) + 1):
        height, left = (int(lcp[t]) if t < len(order) else 0), t - 1
        while stack and stack[-1][0] > height:
            length, left = stack.pop()
            if length >= least:
                found.append((length, sorted(order[left:t].tolist())))
        if height and (not stack or stack[-1][0] < height):
            stack.append((height, left))
    return found


def deepest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each word, the length of the deepest LCP interval that holds the suffix that begins there."""
    deep = np.zeros(len(order), np.int64)
    deep[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return deep


def covered(deep: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in the union of the spans of repeats of ``least`` words or more."""
    at = np.flatnonzero(deep >= least)
    step = np.zeros(len(deep) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + deep[at], -1)
    return np.cumsum(step[:-1]) > 0


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WORD_SPACE)]
    return len(lines) - len(set(lines))


def text_statistics(texts: pa.Array, min_repeat: int) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat of each text."""
    ids, begin, words = split_words(texts)
    sizes = np.diff(begin)
    chars = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))[ids]))
    chars = chars[begin[1:]] - chars[begin[:-1]]
    symbols, lines = [], []
    for text in texts.to_pylist():
        symbols.append(sum(map(text.count, SYMBOLS)) if text else 0)
        lines.append(duplicate_lines(text) if text else 0)
    stop = begin[1:]
    text = np.repeat(np.arange(len(sizes)), sizes)
    deep = deepest(*suffix_array(ids.astype(np.int64), text, stop[text] if len(text) else text))
    per = lambda mask: np.bincount(text[mask], minlength=len(sizes)).astype(np.int64)
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, text, deep)
    return [sizes, chars, np.array(symbols, np.int64), np.array(lines, np.int64), per(covered(deep, 3)), per(covered(deep, min_repeat)), longest]


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, min_repeat: int = 10, max_covered_percent: int = 20, longest: int = 100) -> DataFrame:
    """doc_id and the columns of :data:`SCHEMA` for every row of ``docs``.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated three-word
    windows. kept: base passed, at most ``max_covered_percent`` of the words in repeats of ``min_repeat`` words or more,
    and no repeat longer than ``longest`` words.
    """

    def fn(texts: pa.Array) -> list:
        n, chars, symbols, lines, windows, cover, most = text_statistics(texts, min_repeat)
        failed = (n < min_words) | (100 * windows > max_repeat_percent * n)
        kept = ~failed & (100 * cover <= max_covered_percent * n) & (most <= longest)
        return [n, chars, symbols, lines, windows, failed, kept, cover, most]

    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return map_blocks(own, ["doc_id"], "text", SCHEMA, lambda: fn).withColumnRenamed("doc_id", doc_id)
