r"""Secret scans by a trigram inverted index.

1. Each rule's regular expression is parsed and turned into a Boolean query over lower-case byte trigrams that any match
   must hold (Cox, "Regular expression matching with a trigram index", 2012): a literal gives the AND of its trigrams,
   an alternation the OR of its branches, an optional or unbounded part nothing.
2. A block of texts is indexed: postings of the texts that hold each trigram of the queries.
3. A rule's query is answered by intersecting and joining postings; its expression runs over the candidates alone.
   A rule without mandatory trigrams (the hexadecimal one) runs over all texts.

The base rules have fixed names and come first; spans are whole matches, in code points, end exclusive. A null text is
an empty one and has no spans. Repeated rows give repeated results, a null doc_id is kept, other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

try:  # the parser moved in Python 3.11
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse as parser

from .common import col, map_texts, quoted


@dataclass(frozen=True)
class Rule:
    """``least`` characters of group ``group`` make a match count."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    base: bool = False
    compiled: re.Pattern = field(init=False, compare=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, self.flags))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if len(m[self.group]) >= self.least]


#: The three base rules, and well-known token formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # to its END line; without one, to the end of the base64 lines
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2})*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{1,15}={1,2})?)"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,12}://[^\s:/@]+:[^\s:/@]{3,}@[^\s/]"),
)

# A query is True (no condition), a trigram (bytes), or ("and" | "or", frozenset of queries).


def _all(parts) -> object:
    flat: set = set()
    for p in parts:
        if p is not True:
            flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not flat else flat.pop() if len(flat) == 1 else ("and", frozenset(flat))


def _any(parts) -> object:
    flat: set = set()
    for p in parts:
        if p is True:
            return True
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    return True if not flat else flat.pop() if len(flat) == 1 else ("or", frozenset(flat))


MOST_STRINGS = 64


def _words(node) -> tuple[set[str] | None, object]:
    """(all strings that a parsed expression can match, in lower case, or None; the query that its matches satisfy).

    ``done`` holds the strings of the run of known parts that is being read; where an unknown part begins, or the
    strings get too many, their query is taken and a new run begins.
    """
    done, query, whole = {""}, [], True
    for op, arg in node:
        new, extra = None, True
        if op is sre.LITERAL:
            new = {chr(arg).lower()}
        elif op is sre.IN and all(k is sre.LITERAL or k is sre.RANGE and v[1] - v[0] < 8 for k, v in arg):
            new = {chr(c).lower() for k, v in arg for c in (range(v[0], v[1] + 1) if k is sre.RANGE else [v])}
        elif op is sre.SUBPATTERN:
            new, extra = _words(arg[3])
        elif op is sre.BRANCH:
            each = [_words(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                new = set().union(*(s for s, _ in each))
            else:
                extra = _any(q if s is None else _of_strings(s) for s, q in each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            own, condition = _words(inner)
            if (least, most) == (0, 1) and own is not None:
                new = own | {""}
            elif least:
                extra = condition if own is None else _of_strings(own)
        elif op is sre.AT:
            new = {""}
        if new is not None and len(done) * len(new) <= MOST_STRINGS:
            done = {a + b for a in done for b in new}
            continue
        query += [_of_strings(done), extra]
        done, whole = {""}, False
        if new is not None and len(new) <= MOST_STRINGS:
            done = new
    return (done, True) if whole else (None, _all([*query, _of_strings(done)]))


def _of_strings(strings: set[str]) -> object:
    def grams(s: str) -> object:
        b = s.encode("utf-8")
        return _all(b[i : i + 3] for i in range(len(b) - 2)) if s.isascii() else True

    return _any(grams(s) for s in strings)


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The Boolean query over lower-case trigrams that every text with a match satisfies; True if there is none."""
    strings, query = _words(parser.parse(pattern, flags))
    return _all([query, True if strings is None else _of_strings(strings)])


def _trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


#: For each byte a number of 7 bits; trigrams of queries are of ASCII characters, and other bytes are in none of them.
SEVEN_BITS = np.where(np.arange(256) < 128, np.arange(256), 0).astype(np.uint32)


@lru_cache(8)
def _numbers(vocabulary: frozenset[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The trigrams in order, and the number from 1 of each, by its 21 bits."""
    terms = sorted(vocabulary)
    table = np.zeros(1 << 21, np.uint16)
    for k, t in enumerate(terms, 1):
        table[t[0] << 14 | t[1] << 7 | t[2]] = k
    return terms, table


class TrigramIndex:
    """Postings of a block of texts: for each trigram in use the sorted numbers of the texts that hold it."""

    def __init__(self, texts: list[bytes], vocabulary: frozenset[bytes]):
        terms, table = _numbers(vocabulary)
        self.n = len(texts)
        raw = SEVEN_BITS[np.frombuffer(b"\0\0\0".join(texts) + b"\0\0\0", np.uint8)]
        found = table[raw[:-2] << 14 | raw[1:-1] << 7 | raw[2:]]
        at = np.flatnonzero(found)
        starts = np.cumsum([0, *(len(t) + 3 for t in texts)])
        pairs = np.unique(found[at].astype(np.int64) * self.n + np.searchsorted(starts, at, "right") - 1) if self.n else np.zeros(0, np.int64)
        cut = np.searchsorted(pairs, np.arange(1, len(terms) + 2) * self.n)
        self.postings = {t: pairs[cut[k] : cut[k + 1]] - (k + 1) * self.n for k, t in enumerate(terms)}

    def answer(self, query) -> np.ndarray:
        """The numbers of the texts that satisfy a query, ascending."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.answer(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        found = parts[0]
        for p in parts[1:]:
            found = np.intersect1d(found, p, assume_unique=True)
        return found


@lru_cache(8)
def _queries(rules: tuple[Rule, ...]) -> tuple[list, frozenset[bytes]]:
    """The queries of rules, and all trigrams in them."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    return queries, frozenset().union(*map(_trigrams, queries))


def find_secrets(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, number of the rule, end) of every match in each text, sorted."""
    texts = [t or "" for t in texts]
    queries, vocabulary = _queries(rules)
    index = TrigramIndex([t.lower().encode("utf-8", "surrogatepass") if t.isascii() else _ascii_lower(t) for t in texts], vocabulary)
    out: list[list] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries)):
        for i in index.answer(query):
            out[i] += [(a, k, b) for a, b in rule.spans(texts[i])]
    for spans in out:
        spans.sort()
    return out


def _ascii_lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z alone


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row; spans are kind:start:end, comma-joined."""
    base = [r.kind for r in rules if r.base]
    schema = "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string"

    def fn(texts: list[str | None]) -> list:
        cols: list[list] = [[] for _ in range(len(base) + 2)]
        for spans in find_secrets(texts, rules):
            named = [(rules[k], f"{rules[k].kind}:{a}:{b}") for a, k, b in spans]
            for c, kind in zip(cols, base):
                c.append(sum(r.kind == kind for r, _ in named))
            cols[-2].append(sha256(",".join(s for r, s in named if r.base).encode()).hexdigest())
            cols[-1].append(",".join(s for _, s in named))
        return cols

    return map_texts(docs, [doc_id], text, schema, fn)


def mask_spans(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """``text`` with the union of the spans replaced, each run by one ``mask``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; rows and other columns stay (null texts too)."""
    others = [c for c in docs.columns if c != text]

    def fn(texts: list[str | None]) -> list:
        return [[t if not s else mask_spans(t, s, mask) for t, s in zip(texts, find_secrets(texts, rules))]]

    return map_texts(docs, others, text, f"{quoted(text)} string", fn).select(*map(col, docs.columns))
