"""BPE with word ends, by dynamic programming over prefixes.

For each prefix of a word there is exactly one token that its encoding ends with: a token that ends there and is
compatible with the last token of what comes before it. A suffix-link automaton over the vocabulary gives the tokens
that end at each place; the pair test decides; back-pointers give the ids. The vocabulary file is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept

#: Words kept by one worker (twice as many at most), none of them longer than this many characters: workers outlive their
#: tasks, and what they keep is missing to the next ones.
CACHE_WORDS, CACHE_LENGTH = 50_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, extra = [""] * 256, 256
    for b in range(256):
        symbols[b], extra = (chr(b), extra) if b in plain else (chr(extra), extra + 1)
    return symbols


class WordBpe:
    """An encoder and decoder for a tokenizer file of the kind: NFC, white space to spaces, lower case, split by a
    pattern, bytes as characters, BPE with a suffix at the end of words, no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("a tokenizer file of another kind")
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.texts: list[str] = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for content, i in [*model["vocab"].items(), *self.special.items()]:
            self.texts[i] = content
        # symbols: the character of a byte, or 256 further on if the word ends with it
        code = {s: chr(b) for b, s in enumerate(byte_symbols())}

        def coded(token: str) -> str:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            body = "".join(map(code.__getitem__, token.removesuffix(suffix) if ends else token))
            return body[:-1] + chr(ord(body[-1]) + 256) if ends else body

        ids = {coded(t): i for t, i in model["vocab"].items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (coded(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            if a + b in ids and a in ids and b in ids:
                whole = ids[a + b]
                self.merge.setdefault((ids[a], ids[b]), r)
                if whole not in self.rank:
                    self.rank[whole], self.halves[whole] = r, (ids[a], ids[b])
        for whole, (a, b) in self.halves.items():
            if max(self.rank.get(a, -1), self.rank.get(b, -1)) >= self.rank[whole]:
                raise ValueError("a merge comes before the merges that it needs")
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._automaton({s: i for s, i in ids.items() if len(s) == 1 or i in self.rank and self._own(i)})
        self._new: dict[str, tuple[bytes, int]] = {}
        self._old: dict[str, tuple[bytes, int]] = {}

    def _own(self, token: int) -> bool:
        """Whether the token's own symbols are encoded as that one token."""
        a, b = self.halves[token]
        return self._meets(a, b) == self.rank[token] and all(t not in self.rank or self._own(t) for t in (a, b))

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at the left (0) or right (1) edge while `token` is built, each with the rank that uses it up."""
        if (known := self._spines.get((token, side))) is None:
            inner = self.halves.get(token)
            known = [(token, 1 << 60)]
            if inner:
                below = self._spine(inner[side], side)
                known = [*below[:-1], (inner[side], self.rank[token]), *known]
            self._spines[token, side] = known
        return known

    def _meets(self, a: int, b: int) -> int | None:
        """The rank of the merge that joins neighbours a and b across their border, or None if nothing does.

        The tokens at the border grow in the order of ranks. A merge across happens if both its sides are there before
        anything uses either up; of equal ranks the one further left comes first.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.merge.get((x, y))
            if across is not None and across < x_ends and across <= y_ends:
                return across
            if i + 1 == len(left) and j + 1 == len(right):
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        """Whether the symbols of a and b together are encoded as a, b."""
        if (known := self._fits.get((a, b))) is None:
            if len(self._fits) > 4 * CACHE_WORDS:
                self._fits.clear()
            known = self._fits[a, b] = self._meets(a, b) is None
        return known

    def _automaton(self, tokens: dict[str, int]) -> None:
        """States are beginnings of tokens; a state's link is its longest proper suffix that is a state; `ends` lists
        the tokens that end in a state, longest first, each with its length."""
        step: list[dict[str, int]] = [{}]
        link, ends = [0], [()]
        for s, i in tokens.items():
            at = 0
            for c in s:
                if (to := step[at].get(c)) is None:
                    to = step[at][c] = len(step)
                    step.append({})
                    link.append(0)
                    ends.append(())
                at = to
            ends[at] = ((i, len(s)),)
        queue = deque(step[0].values())
        while queue:
            at = queue.popleft()
            ends[at] += ends[link[at]]
            for c, to in step[at].items():
                up = link[at]
                while up and c not in step[up]:
                    up = link[up]
                link[to] = step[up].get(c, 0)
                queue.append(to)
        self.step, self.link, self.ends = step, link, ends

    def word(self, word: str) -> tuple[bytes, int]:
        """The ids of one piece as little-endian 32-bit integers, and their number."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        symbols = raw[:-1] + chr(ord(raw[-1]) + 256)
        step, link, ends, known = self.step, self.link, self.ends, self._fits
        last, back, at = [-1], [0], 0
        for n, c in enumerate(symbols, 1):
            while at and c not in step[at]:
                at = link[at]
            at = step[at].get(c, 0)
            for token, size in ends[at]:
                before = last[n - size]
                if size == n or (known[before, token] if (before, token) in known else self.fits(before, token)):
                    last.append(token)
                    back.append(n - size)
                    break
            else:
                raise ValueError(f"no token ends {symbols[:n]!r}")
        out, n = [], len(symbols)
        while n:
            out.append(last[n])
            n = back[n]
        return np.array(out[::-1], "<u4").tobytes(), len(out)

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter; white space may stay as it is, since no piece holds any."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers. Strings of special tokens give their ids."""
        out = []
        for part in self.parts.split(text) if self.parts and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            new, old = self._new, self._old
            for w in self.pieces.findall(self.normal(part)):
                if (found := new.get(w)) is None:
                    found = old.get(w) or self.word(w)
                    if len(new) >= CACHE_WORDS:
                        self._old, self._new = old, new = new, {}
                    if len(w) <= CACHE_LENGTH:
                        new[w] = found
                out.append(found[0])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with spaces between them, as without a decoder."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(path: str) -> WordBpe:
    return kept(path, lambda: WordBpe(path))


def encode_column(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the text decoded from the ids) for every whole text; with
    ids=True also the ids as array<int>. A null text is empty: no ids, and the digests of nothing. Rows stay rows;
    other columns aren't looked at. The vocabulary file has to be at `path` on every executor."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            count, digest, back, all_ids = [], [], [], []
            for t in batch.column(1):
                raw = bpe.encode(t.as_py() or "")
                count.append(len(raw) // 4)
                digest.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(bpe.decode(raw).encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    all_ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
            cols = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
