"""Tokenizer calls that encode each distinct word once per worker.

Both vocabularies split a text at white space before they merge, so the ids of a text are the ids of its
white-space parts in turn.  Frequent parts are kept in a bounded table.  New parts are encoded by the library, or, for byte-level
vocabularies whose merges come in the order of their ids, by tiktoken's core with those ranks (``by_rank``), which gives the same
ids; a text whose parts could influence each other (runs of white space) goes to the library whole.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np

from keystrand.llm.common import held, slices

#: Words that a worker keeps between batches.
KEPT_WORDS = 1_000_000
MARKS = ".,;:!?"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def packed(tokenizer, texts: list[str]) -> list[bytes]:
    """Ids as little-endian unsigned 32-bit integers."""
    out = []
    for i in range(0, len(texts), 2000):
        out += [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
    return out


def simple(word: str) -> bool:
    """Letters of the first 256 code points only: no library or Unicode version takes them for anything else."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return word.isalpha()


def lowered(text: str) -> str:
    """The text in lower case, as a vocabulary without case has it, where that is certain to make no other difference."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


class Table(dict):
    """Ids by word.  A word that is not there gets an array to be filled, or None if white space in it may join its neighbour's.

    A plain word with a mark after it splits there in both vocabularies, so it is the word's ids and the mark's.
    """

    def __init__(self, drops_space: bool, marks: dict[str, bytes]):
        self.drops_space, self.marks, self.new, self.joined = drops_space, marks, {}, []

    def __missing__(self, word: str) -> bytearray | None:
        if not self.drops_space and (not word or word[0].isspace() or word[-1].isspace()):
            self[word] = None
            return None
        self[word] = out = bytearray()
        if word[-1] in self.marks and simple(word[:-1]):
            self.joined.append((word, self[word[:-1]], self.marks[word[-1]]))
        else:
            self.new[word] = out
        return out


#: Fixed value: the pattern by which byte-level vocabularies split a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_rank(path: str):
    """A faster coder for a byte-level vocabulary whose merges come in the order of the ids they make, else None.

    Then merging the pair of the lowest id first is the same as merging by the list: a pair that makes a token's bytes is
    always the listed one, as nothing outside those bytes takes part in the merges before it.
    """
    import json

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, merges = whole["model"]["vocab"], whole["model"].get("merges") or []
    split = whole.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or whole.get("normalizer") or whole["model"].get("end_of_word_suffix"):
        return None
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    if None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(vocab) != len(made) + 256:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    if any(c not in signs for t in vocab for c in t):
        return None
    import tiktoken

    return tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(signs[c] for c in t): i for t, i in vocab.items()}, special_tokens={})


class WordEncoder:
    """``encode(texts)``: the packed ids of each text.

    ``drops_space``: the vocabulary ignores white space (word-end vocabularies); else a single space belongs
    to the word after it (byte-level vocabularies).
    """

    def __init__(self, path: str, drops_space: bool, kept: int = KEPT_WORDS):
        self.tokenizer, self.drops_space, self.kept = load(path), drops_space, kept
        self.ranked = None if drops_space else by_rank(path)
        self.table = Table(drops_space, {m: packed(self.tokenizer, [m])[0] for m in MARKS})
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark, self.mark_text = next(((k, v.content) for k, v in sorted(added.items()) if v.special and v.content.startswith("<|")), (None, ""))
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.starts[[v for k, v in self.tokenizer.get_vocab().items() if k.startswith("\u0120")]] = True

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        before, between = ("", self.mark_text) if self.drops_space else (" ", " ")
        plain = [w for w in words if "<|" not in w] if between else []
        alone = [w for w in words if "<|" in w] if between else words
        return self._many(plain, between, before) | dict(zip(alone, packed(self.tokenizer, [before + w for w in alone]), strict=True))

    def _many(self, words: list[str], between: str, before: str) -> dict[str, bytes]:
        """One library call for 1000 words: their ids are told apart by the mark between them or by the space each starts with."""
        out: dict[str, bytes] = {}
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            line = before + between.join(some)
            ids = np.array(self.ranked.encode_ordinary(line) if self.ranked else self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark) if self.drops_space else np.flatnonzero(self.starts[ids])[1:]
            if len(cuts) != len(some) - 1:
                out.update(zip(some, packed(self.tokenizer, [before + w for w in some]), strict=True))
                continue
            raw, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
            skip, at = 4 if self.drops_space else 0, 0
            for w, end in zip(some, ends, strict=True):
                out[w] = raw[at:end]
                at = end + skip
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        if self.drops_space:
            parts, heads = [lowered(t).split() for t in texts], repeat(b"")
        else:
            parts = [t.split(" ") for t in texts]
            first = [p.pop(0) for p in parts]
            heads = [None if f[-1:].isspace() else h for f, h in zip(first, packed(self.tokenizer, first), strict=True)]
        get, out = self.table.__getitem__, []
        found = [list(map(get, p)) for p in parts]
        new, self.table.new = self.table.new, {}
        for word, ids in self._learn(list(new)).items():
            new[word][:] = ids  # the texts hold this array already
        joined, self.table.joined = self.table.joined, []
        for word, ids, mark in joined:
            new[word] = self.table[word]
            new[word][:] = ids + mark
        for text, head, own in zip(texts, heads, found, strict=False):
            try:
                if self.drops_space and not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
                    raise TypeError  # Python alone takes these four for white space
                out.append(head + b"".join(own))
            except TypeError:
                out.append(packed(self.tokenizer, [text])[0])
        if len(self.table) <= self.kept:
            self.table.update(zip(new, map(bytes, new.values()), strict=True))
        else:
            for w in new:
                del self.table[w]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts, out = [t or "" for t in texts], []
        for a, b in slices(texts):
            out += self._some(texts[a:b])
        return out

    def encode_parts(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words that are encoded each on its own, without a table."""
        odd = [w for w in words if any(c in w for c in "\x1c\x1d\x1e\x1f ")]
        found = self._learn([w for w in words if w not in set(odd)] if odd else words)
        found.update(zip(odd, packed(self.tokenizer, odd), strict=True))
        return [found[w] for w in words]


def worker_encoder(path: str, drops_space: bool, kept: int = KEPT_WORDS) -> WordEncoder:
    """The encoder of this Python worker: what one task learned serves the next."""
    return held(("encoder", path, drops_space, kept), lambda: WordEncoder(path, drops_space, kept))
