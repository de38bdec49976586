"""Token ids of whole texts through a public tokenizers file, with one library call per new word.

Texts are cut at single white-space characters, where no token of these vocabularies can reach
across; each distinct piece is encoded once and kept, and a text's ids are gathered from the
kept pieces with numpy. Texts where the cut would not be safe go to the library whole, so ids
always equal the library's.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain, islice
from unicodedata import is_normalized

import numpy as np

from .common import held

#: Distinct pieces kept in one Python worker; beyond it, the store starts anew.
MAX_PIECES = 500_000
#: White space other than the plain space and the line feed.
_ODD = re.compile("[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 for all i, in order."""
    total = int(lengths.sum())
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else starts
    return np.repeat(shift, lengths) + np.arange(total)


class _Pieces(dict):
    """Numbers for pieces; an unknown piece gets the next number and is noted."""

    def __init__(self, owner: "Encoder", prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.owner.size
        self.owner.size += 1
        self.owner.fresh.append(self.prefix + piece)
        return number


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.spaced = spec["pre_tokenizer"]["type"] == "ByteLevel"  # white space is part of tokens
        # The first token of a piece that begins with its only space alone begins with one; in
        # the other vocabulary the last token of a run of letters alone ends a word.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.edge[[i for t, i in vocab.items() if (t.startswith("Ġ") if self.spaced else t.endswith("</w>"))]] = True
        self.clear()

    def clear(self) -> None:
        self.size, self.fresh = 0, []
        self.plain, self.spaces = _Pieces(self, ""), _Pieces(self, " ")
        self.flat = np.empty(0, dtype=np.uint32)
        self.starts = np.empty(0, dtype=np.int64)
        self.lengths = np.empty(0, dtype=np.int64)
        self.unsafe = np.empty(0, dtype=bool)
        self.cores: dict[str, int] = {}
        self.core_flat = np.empty(0, dtype=np.uint32)
        self.core_starts = np.empty(0, dtype=np.int64)
        self.core_lengths = np.empty(0, dtype=np.int64)

    def _fast(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, piece: str) -> tuple[str, str]:
        """(letters, punctuation) if the piece is just that, and so has a token border between."""
        body = piece.rstrip(_PUNCTUATION)
        letters = body[1:] if self.spaced and body[:1] == " " else body
        if len(body) < len(piece) and letters.isalpha() and (letters.isascii() or letters.lower().isalpha()):
            return body, piece[len(body) :]
        return piece, ""

    def _simple(self, core: str) -> bool:
        """Whether the core may be encoded beside others and told apart by ``edge``."""
        if self.spaced:
            return core[:1] == " " and len(core) > 1
        return core.isalpha() and (core.isascii() or is_normalized("NFC", core) and core.lower().isalpha())

    def _encode_cores(self, cores: list[str]) -> None:
        lengths = np.zeros(len(cores), dtype=np.int64)
        parts: list[np.ndarray] = []
        order: list[int] = []
        simple = [k for k, c in enumerate(cores) if self._simple(c)]
        held = set(simple)
        alone = [k for k in range(len(cores)) if k not in held]
        for a in range(0, len(simple), 2000):
            some = simple[a : a + 2000]
            joined = ("" if self.spaced else " ").join([cores[k] for k in some])
            ids = np.array(self._fast([joined])[0], dtype=np.uint32)
            cut = np.flatnonzero(self.edge[ids])
            if len(cut) != len(some):
                alone += some
                continue
            lengths[some] = np.diff(np.append(cut, len(ids))) if self.spaced else np.diff(np.concatenate(([-1], cut)))
            parts.append(ids)
            order += some
        for k, ids in zip(alone, self._fast([cores[k] for k in alone])):
            lengths[k] = len(ids)
            parts.append(np.array(ids, dtype=np.uint32))
            order.append(k)
        starts = np.zeros(len(cores), dtype=np.int64)
        starts[order] = len(self.core_flat) + np.concatenate(([0], np.cumsum(lengths[order])[:-1]))
        self.core_flat = np.concatenate([self.core_flat, *parts])
        self.core_starts = np.concatenate([self.core_starts, starts])
        self.core_lengths = np.concatenate([self.core_lengths, lengths])

    def _learn(self) -> None:
        # Numbers are given out in order: these pieces follow those already encoded.
        pieces, self.fresh = self.fresh, []
        if not pieces:
            return
        cores, known = self.cores, len(self.cores)
        unsafe = np.zeros(len(pieces), dtype=bool)
        made: list[int] = []
        count = np.ones(len(pieces), dtype=np.int64)
        for a in range(0, len(pieces), 1000):
            some = pieces[a : a + 1000]
            odd = bool(_ODD.search("".join(some)))
            for k, p in enumerate(some, a):
                body, tail = p, ""
                if odd and _ODD.search(p):
                    unsafe[k] = self.spaced
                else:
                    body, tail = self._split(p)
                made.append(cores.setdefault(body, len(cores)))
                if tail:
                    made.append(cores.setdefault(tail, len(cores)))
                    count[k] = 2
        if len(cores) > known:
            self._encode_cores(list(islice(cores, known, None)))
        index = np.array(made, dtype=np.int64)
        n = self.core_lengths[index]
        total = np.concatenate(([0], np.cumsum(n)))
        ends = total[np.cumsum(count)]
        lengths = np.diff(np.concatenate(([0], ends)))
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, self.core_flat[ragged(self.core_starts[index], n)]])
        self.unsafe = np.concatenate([self.unsafe, unsafe])

    def _number(self, text: str) -> list[int]:
        plain = self.plain
        if not self.spaced:
            if text.isascii() and "<|" not in text:  # special tokens are told by their case
                text = text.lower()
            return list(map(plain.__getitem__, text.replace("\n", " ").split(" ")))
        spaces = self.spaces
        out: list[int] = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            out.append(plain["\n" + words[0] if i else words[0]])
            out += map(spaces.__getitem__, words[1:])
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, one after another, and the number of ids of each text."""
        # Millions of small lists without cycles: collector passes would only cost time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.size > MAX_PIECES:
            self.clear()
        whole, numbers = [], []
        for k, t in enumerate(texts):
            if self.spaced and ("  " in t or "\n\n" in t or " \n" in t or "\n " in t or t.endswith((" ", "\n"))):
                whole.append(k)
                numbers.append([])
            else:
                numbers.append(self._number(t))
        self._learn()
        count = np.fromiter(map(len, numbers), np.int64, len(texts))
        index = np.fromiter(chain.from_iterable(numbers), np.int64, int(count.sum()))
        bounds = np.concatenate(([0], np.cumsum(count)))
        if self.unsafe[index].any():
            bad = np.add.reduceat(np.append(self.unsafe[index], False).astype(np.int64), np.minimum(bounds[:-1], len(index)))
            whole = sorted({*whole, *np.flatnonzero((bad > 0) & (count > 0)).tolist()})
        n = self.lengths[index]
        ids = self.flat[ragged(self.starts[index], n)]
        total = np.concatenate(([0], np.cumsum(n)))[bounds]
        sizes = np.diff(total)
        if not whole:
            return ids, sizes
        parts, at = [], 0
        for k, own in zip(whole, self._fast([texts[k] for k in whole])):
            parts += [ids[total[at] : total[k]], np.array(own, dtype=np.uint32)]
            sizes[k] = len(own)
            at = k + 1
        return np.concatenate([*parts, ids[total[at] :]]), sizes


def encoder(path: str) -> Encoder:
    """This worker's encoder for ``path``; kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(("encoder", path), lambda: Encoder(path))
