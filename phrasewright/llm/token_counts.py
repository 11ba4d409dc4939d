"""Exact token counts of texts and of all their prefixes, by dynamic programming over prefixes.

For a byte-pair tokenizer with word ends, a sequence of tokens is the encoding of its string exactly if each
adjacent pair is. So the encoding of a prefix is the encoding of some shorter prefix and one more token that goes with
its last one; one pass over a word gives the state at each of its prefixes, from which one more step gives the count of the
prefix ended there. States are kept for distinct prefixes of words; a text's counts are running sums over its words. Any question of the form "how much of this text fits
into a budget" is then answered by lookup, without encoding again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import TABLE_ENTRIES, ChunkTable, odd_space, text_slices
from .common import ship
from .wordhash import hash_runs

#: Kinds of bytes of such characters: white space, letter, digit (each a word of its own), other.
_KIND = np.full(256, 3, np.uint8)
_DIGIT = 2
_KIND[[0x20, *range(9, 14)]], _KIND[[*range(97, 123), *range(128, 256)]], _KIND[48:58] = 0, 1, _DIGIT

#: Fixed value: how tokenizers of this family cut normalised text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for characters below U+0250, whose class, case and normal form do not depend on the Unicode version.
PLAIN_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|_)+"
#: Characters beyond white space, printable ASCII without the apostrophe, and Latin letters that stay one in lower case.
_NOT_SIMPLE = re.compile("[^\t-\r -&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0]|[^\x00-\u024f]")
#: Entries beyond which a table of words or prefixes starts anew; this bounds its memory only.
PREFIX_ENTRIES = 600_000
#: Letters beyond which a word's prefixes are not shared with other words, but for those of the long word before it.
LONG_WORD = 256
#: Runs between white space on which all agree; nothing in one changes how another is cut.
_CHUNK = re.compile("[^\t-\r ]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def stands_alone(c: str) -> bool:
    """Whether a character's normal form does not depend on those before it, nor theirs on it."""
    kind = unicodedata.category(c)
    if kind[0] in "MZ" or kind in ("Cc", "Cn", "Cs") or odd_space(c) or "\u1160" <= c <= "\u11ff":
        return False
    return not unicodedata.combining(c) and unicodedata.normalize("NFC", c) == c


class PrefixCounts:
    """Token counts of every prefix under one tokenizer file."""

    _made: dict[str, PrefixCounts] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tok, self.end = Tokenizer.from_file(path), model["end_of_word_suffix"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        #: Tokens that are their own encoding; no other can occur.
        self.vocab = {t for t in model["vocab"] if self._merge(self._symbols(t)) == [t]}
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != WORD_PATTERN:
            raise ValueError("this tokenizer file cuts words in another way")
        self.letters = byte_letters()
        self.going = {t: t for t in self.vocab if not t.endswith(self.end)}
        self.ending = {t[: -len(self.end)]: t for t in self.vocab if t.endswith(self.end) and t != self.end}
        #: the last three letters of a token -> the longest token that ends so
        self.going_reach, self.ending_reach = {}, {}
        for bodies, reach in ((self.going, self.going_reach), (self.ending, self.ending_reach)):
            for b in bodies:
                if len(b) > 2:
                    reach[b[-3:]] = max(len(b), reach.get(b[-3:], 0))
        self.goes: dict[tuple[str, str], bool] = {}
        #: prefix of a word -> (last token, count) while it goes on; one more step gives the count if it ends there
        self.prefixes: dict[str, tuple[str, int]] = {}
        #: the last long word and its states
        self.long: tuple[str, list] = ("", [("", 0)])
        self.any_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        #: whether a character stands alone; the library's normal form of a short run
        self.alone, self.normal = {}, {}
        self.table = ChunkTable(self._work)
        #: counts by the bytes of a word, and those of the generation before
        self.by_word, self.before = {}, {}
        self.plain_word = re.compile(PLAIN_WORD_PATTERN)

    @classmethod
    def of(cls, path: str) -> PrefixCounts:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _merge(self, parts: list[str]) -> list[str]:
        """Plain byte-pair encoding of a few symbols."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def _fits(self, left: str, token: str) -> bool:
        """Whether token can follow left in an encoding."""
        known = self.goes.get((left, token))
        if known is None:
            if len(self.goes) > 1_000_000:
                self.goes.clear()
            known = self.goes[left, token] = self._merge([*self._symbols(left), *self._symbols(token)]) == [left, token]
        return known

    def _step(self, states: list, word: str, j: int, bodies: dict[str, str], reach: dict[str, int]) -> tuple[str, int]:
        """The last token of word[:j] and its count, from the states of the shorter prefixes."""
        goes = self.goes
        first = j - reach.get(word[j - 3 : j], 2) if j > 2 else 0
        for i in range(first if first > 0 else 0, j):
            token = bodies.get(word[i:j])
            if token is not None:
                last, count = states[i]
                if not i:
                    return token, 1
                if last:
                    known = goes.get((last, token))
                    if known if known is not None else self._fits(last, token):
                        return token, count + 1
        return "", 0

    def _states(self, word: str) -> list[tuple[str, int]]:
        """(last token, count) of each prefix of a word that goes on; words share the states of shared prefixes."""
        if len(word) > LONG_WORD:
            return self._long_states(word)
        known = self.prefixes
        if len(known) > PREFIX_ENTRIES:
            known = self.prefixes = {}
        states, going, reach = [("", 0)], self.going, self.going_reach
        for j in range(1, len(word)):
            prefix = word[:j]
            state = known.get(prefix)
            if state is None:
                state = known[prefix] = self._step(states, word, j, going, reach)
            states.append(state)
        return states

    def _long_states(self, word: str) -> list[tuple[str, int]]:
        before, states = self.long
        low, high = 0, min(len(word), len(before))  # the prefix they share is found by halving
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if before.startswith(word[:mid]) else (low, mid - 1)
        states = states[: min(low + 1, len(word))]
        for j in range(len(states), len(word)):
            states.append(self._step(states, word, j, self.going, self.going_reach))
        self.long = word, states
        return states

    def _ended(self, word: str, at: list[int]) -> list[int]:
        """Tokens of word[:j] ended there, for each j."""
        states = self._states(word)
        return [self._step(states, word, j, self.ending, self.ending_reach)[1] for j in at]

    def word_count(self, word: str) -> int:
        """Tokens of a word of byte letters that ends there."""
        return self._step(self._states(word), word, len(word), self.ending, self.ending_reach)[1]

    def _plain(self, text: str) -> bool:
        return not _UNSURE.search(text) and not ("<" in text and any(s in text for s in self.special))

    def _words(self, text: str) -> list[str]:
        return self.plain_word.findall(text.lower())

    def _count(self, chunk: str) -> int:
        """Tokens of a chunk without white space."""
        if not self._plain(chunk):
            return len(self.tok.encode(chunk, add_special_tokens=False).ids)
        return sum(self.table[w] if w in self.table else self._work([w])[0] for w in self._words(chunk))

    def _work(self, words: list[str]) -> list[int]:
        letters = self.letters
        return [self.word_count("".join([letters[b] for b in w.encode()])) for w in words]

    def _measured_by_hash(self, texts: list[str], budget: int | None) -> list[tuple[int, int]]:
        """measure() for texts of simple characters: words are found and hashed on bytes; each distinct one, told apart byte by byte, is looked up once."""
        parts = [t.lower().encode() for t in texts]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        edge = np.cumsum([0, *map(len, parts)])
        kind = _KIND[raw]
        new = np.ones(len(raw), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[edge[:-1][edge[:-1] < len(raw)]] = True
        inside = kind > 0
        start = np.flatnonzero(new & inside)
        if not len(start):
            return [(0, len(t)) for t in texts]
        shown = np.cumsum(inside)  # a word's place among the bytes that are not white space
        own, letters_only = shown[start] - 1, raw[inside]
        size = np.diff(np.append(own, shown[-1]))
        back, hashes = pd.factorize(hash_runs(letters_only, own))
        first = np.zeros(len(hashes), np.int64)
        first[back[::-1]] = np.arange(len(back))[::-1]
        place = np.arange(len(letters_only)) - np.repeat(own, size)
        if (size != size[first][back]).any() or (letters_only != letters_only[np.repeat(own[first][back], size) + place]).any():  # two words with one hash
            every = [letters_only[a:b].tobytes() for a, b in zip(own.tolist(), np.append(own[1:], shown[-1]).tolist(), strict=True)]
            back, named = pd.factorize(np.array(every, object))
            first = np.zeros(len(named), np.int64)
            first[back[::-1]] = np.arange(len(back))[::-1]
        if len(self.by_word) > TABLE_ENTRIES:
            self.before, self.by_word = self.by_word, {}
        known, before, letters = self.by_word, self.before, self.letters
        whole, found = letters_only.tobytes(), []
        for at, n_bytes in zip(own[first].tolist(), size[first].tolist(), strict=True):
            w = whole[at : at + n_bytes]
            n = known.get(w)
            if n is None:
                n = before.get(w)
                if n is None:
                    n = self.word_count("".join([letters[b] for b in w]))
                known[w] = n
            found.append(n)
        total = np.concatenate(([0], np.cumsum(np.array(found)[back])))  # before each word, over all texts
        first_word = np.searchsorted(start, edge)
        out = []
        for d, text in enumerate(texts):
            low, high = int(first_word[d]), int(first_word[d + 1])
            n = int(total[high] - total[low])
            if budget is None or n <= budget:
                out.append((n, len(text)))
                continue
            # words up to k fit whole; of word k the longest prefix that still does
            k = int(np.searchsorted(total[low : high + 1], total[low] + budget, "right")) - 1 + low
            left, at = budget - int(total[k] - total[low]), len(raw[edge[d] : start[k]].tobytes().decode())
            word = raw[start[k] : start[k] + size[k]].tobytes().decode()
            ends = np.cumsum([len(c.encode()) for c in word[:-1]]).tolist()
            fits = max((j for j, n_j in enumerate(self._ended("".join([letters[b] for b in word.encode()]), ends), 1) if n_j <= left), default=0)
            out.append((n, at + fits))
        return out

    def measure(self, texts: list[str], budget: int | None) -> Iterator[tuple[int, int]]:
        """The token count of each text, and the length of its longest prefix within the budget (None: no bound)."""
        for a, b in text_slices(texts):
            simple = [not _NOT_SIMPLE.search(t) and "<|" not in t for t in texts[a:b]]
            by_hash = iter(self._measured_by_hash([t for t, x in zip(texts[a:b], simple, strict=True) if x], budget))
            words = [None if x else self._words(t) if self._plain(t) else [] for t, x in zip(texts[a:b], simple, strict=True)]
            self.table.learn([w for w in words if w])
            for text, own in zip(texts[a:b], words, strict=True):
                if own is None:
                    yield next(by_hash)
                    continue
                if self._plain(text):
                    n = sum(map(self.table.__getitem__, own))
                elif odd_space(text):
                    n = len(self.tok.encode(text, add_special_tokens=False).ids)
                else:
                    n = sum(map(self._count, text.split()))
                yield n, len(text) if budget is None or n <= budget else self.fitting(text, budget)

    def counts(self, texts: list[str]) -> Iterator[int]:
        """The token count of each text."""
        return (n for n, _ in self.measure(texts, None))

    def _normal(self, run: str) -> str:
        known = self.normal.get(run)
        if known is None:
            known = self.tok.normalizer.normalize_str(run)
            if len(run) <= LONG_WORD:
                if len(self.normal) > TABLE_ENTRIES:
                    self.normal.clear()
                self.normal[run] = known
        return known

    def _library_words(self, normal: str) -> list[tuple[str, tuple[int, int]]]:
        """Words of byte letters and their places in a text in normal form, as the library cuts it."""
        return self.tok.pre_tokenizer.pre_tokenize_str(normal)

    def _run_counts(self, run: str) -> np.ndarray:
        """prefix_counts() of a run without plain white space and special tokens.

        The run is cut before each character that stands alone; the library normalises each part and cuts the whole into words.
        A prefix has the words that end before it and the beginning of one more.
        """
        alone = self.alone
        for c in set(run).difference(alone):
            alone[c] = stands_alone(c)
        cuts = [0, *(i for i in range(1, len(run)) if alone[run[i]]), len(run)] if run else [0]
        parts = [self._normal(run[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        normal = "".join(parts)
        if normal != self.tok.normalizer.normalize_str(run):
            return np.array([len(self.tok.encode(run[:i], add_special_tokens=False).ids) for i in range(len(run) + 1)])
        place = np.cumsum([0, *map(len, parts)]).tolist()
        out, words = np.zeros(len(run) + 1, np.int64), self._library_words(normal)
        i, base = 0, 0  # cuts up to i have their counts; tokens of the words before
        begin = []  # for each cut, from where words can still change behind it, and the tokens before that
        last = None  # the word before: its beginning and the tokens before it, if it ends in an apostrophe
        for letters, (low, high) in words:
            while i < len(place) and place[i] <= low:
                out[cuts[i]] = base
                begin.append((place[i], base))
                i += 1
            last = last if last and normal[low - 1] == "'" else None
            first = i
            while i < len(place) and place[i] <= high:
                begin.append(last or (low, base))
                i += 1
            word, inside = normal[low:high], place[first:i]
            if word[0] == "'" and 1 < len(word) < 4:  # perhaps one of those that end a word after an apostrophe
                counts = [self._words_count(normal[low:p]) for p in inside]
            else:
                size = np.cumsum([0, *(len(c.encode()) for c in word)])
                counts = self._ended(letters, size[np.array(inside, int) - low].tolist())
            for k, n in enumerate(counts, first):
                out[cuts[k]] = base + n
            n = counts[-1] if inside and inside[-1] == high else self._words_count(word)
            last, base = (low, base) if word[-1] == "'" else None, base + n
        for k in range(i, len(place)):
            out[cuts[k]] = base
            begin.append((place[k], base))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
            for j in range(a + 1, b):  # inside a part
                low, before = begin[k]
                out[j] = before + self._words_count(normal[low : place[k]] + self._normal(run[a:j]))
        return out

    def _words_count(self, normal: str) -> int:
        return sum(self.word_count(w) for w, _ in self._library_words(normal))

    def _chunk_counts(self, chunk: str) -> np.ndarray:
        """prefix_counts() of a chunk without plain white space."""
        out, base, at = np.zeros(len(chunk) + 1, np.int64), 0, 0
        for m in self.any_special.finditer(chunk):
            own = self._run_counts(chunk[at : m.end() - 1])  # until its last character, a special token is text
            out[at : m.end()] = base + own
            base, at = base + int(own[m.start() - at]) + 1, m.end()
        out[at:] = base + self._run_counts(chunk[at:])
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """The exact count of text[:i] for every i from 0 to len(text)."""
        out, base, at = np.zeros(len(text) + 1, np.int64), 0, 0
        for m in _CHUNK.finditer(text):
            out[at : m.start()] = base
            out[m.start() : m.end() + 1] = base + self._chunk_counts(m.group())
            base, at = int(out[m.end()]), m.end()
        out[at:] = base
        return out

    def fitting(self, text: str, budget: int) -> int:
        """The length of the longest prefix with at most `budget` tokens."""
        used = 0
        for m in _CHUNK.finditer(text):
            n = self._count(m.group())
            if used + n > budget:
                return m.start() + int(np.flatnonzero(used + self._chunk_counts(m.group()) <= budget)[-1])
            used += n
        return len(text)


def count_tokens(df: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens), fitting_chars (code points of the longest prefix
    within the limit) of each text.

    Null text counts as empty. Every row gives one row, whatever its id; other columns are not carried.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PrefixCounts.of(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, fit = zip(*counts.measure(texts, limit), strict=True) if texts else ((), ())
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, n)), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
