"""Byte-pair encoding by an index from each pair to its places, and decoding.

All distinct pretokens of a batch lie in one array of symbols with links to the next and the
previous one. The index maps each mergeable pair to the places where it starts. The active ranks
are taken in ascending order: all places of the pair are merged at once, and the two pairs that
each merge makes are entered in their lists. A merge can only make pairs of higher rank, because
each token of the vocabulary is made by one merge (checked on loading), so no rank comes back.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from unicodedata import normalize

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import docs_of, fields, held, map_texts, pick
from .tokens import vocabulary_path

#: Distinct pieces of text kept between batches in one worker.
MAX_PIECES = 400_000
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairIndexBPE:
    """A tokenizers file of the kind "lower case, white space dropped, word ends marked"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.first = np.array([self.vocab[symbols[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([self.vocab[symbols[b] + self.suffix] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [self.vocab[a + b] for a, b in pairs]
        if len(set(made)) != len(made):
            raise ValueError("two merges make one token; ranks could come back")
        left, right = (np.array([self.vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.width = max(self.tokens) + 1
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order
        self.made = np.array(made, dtype=np.int64)
        self.left, self.right = left, right
        self.pretoken = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, int] = {}
        self.n: list[int] = []
        self.id_text: list[str] = []
        self.token_text: list[str] = []
        self.words: dict[str, int] = {}
        self.word_ids: list[list[int]] = []

    # -- encoding -------------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], -1)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of ``words`` (the UTF-8 bytes of one pretoken, none empty)."""
        if not words:
            return []
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        size = len(text)
        # One cell more at the end stands for "no symbol".
        sym = np.append(self.first[text], -1)
        sym[ends - 1] = self.last[text[ends - 1]]
        nxt = np.append(np.arange(1, size + 1), size)
        nxt[ends - 1] = size
        prv = np.append(np.arange(-1, size - 1), size)
        prv[0] = size
        prv[ends[:-1]] = size
        rank = self._ranks(sym[:-1], sym[nxt[:-1]])
        places = np.flatnonzero(rank >= 0)
        order = places[np.argsort(rank[places], kind="stable")]
        ranks, starts = np.unique(rank[order], return_index=True)
        index: dict[int, list] = {int(r): [part] for r, part in zip(ranks, np.split(order, starts[1:]))}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.concatenate([np.atleast_1d(x) for x in lists]) if len(lists) > 1 else np.atleast_1d(lists[0])
            a, b = self.left[r], self.right[r]
            after = nxt[at]
            live = (sym[at] == a) & (sym[after] == b)
            at, after = at[live], after[live]
            if a == b and len(at) > 1:
                at = self._apart(np.unique(at), nxt)
                after = nxt[at]
            if not len(at):
                continue
            then = nxt[after]
            sym[at] = self.made[r]
            sym[after] = -1
            nxt[at] = then
            prv[then] = at
            prv[size] = size
            before = prv[at]
            # In a run like abab, the symbol after may itself have merged just now.
            new = self._ranks(sym[before], sym[at])
            self._enter(index, heap, before[new >= 0], new[new >= 0])
            new = self._ranks(sym[at], sym[nxt[at]])
            self._enter(index, heap, at[new >= 0], new[new >= 0])
        keep = sym[:size] >= 0
        ids = sym[:size][keep].tolist()
        bounds = [0, *np.cumsum(keep)[ends - 1].tolist()]
        return [ids[x:y] for x, y in zip(bounds, bounds[1:])]

    @staticmethod
    def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of overlapping places of a pair of equal symbols, every other one from the left."""
        out, taken = [], -1
        for p in at.tolist():
            if p != taken:
                out.append(p)
                taken = int(nxt[p])
        return np.array(out, dtype=np.int64)

    @staticmethod
    def _enter(index: dict, heap: list, places: np.ndarray, ranks: np.ndarray) -> None:
        if not len(places):
            return
        if len(places) < 64:
            pairs = zip(ranks.tolist(), places.tolist())
        else:
            order = np.argsort(ranks, kind="stable")
            found, starts = np.unique(ranks[order], return_index=True)
            pairs = zip(found.tolist(), np.split(places[order], starts[1:]))
        for r, p in pairs:
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(heap, r)

    def pretokens(self, text: str) -> list[bytes]:
        """The pretokens of a stretch without special tokens, as UTF-8 bytes."""
        if text.isascii():
            text = text.lower()
        else:
            # Letter by letter, as the library does: a final sigma stays a plain one.
            text = normalize("NFC", text).replace("Σ", "σ").lower()
        return [w.encode() for w in self.pretoken.findall(text)]

    def _learn(self, fresh: list[str]) -> None:
        """Encode new white-space-delimited pieces; their pretokens are encoded once each."""
        shapes: list[list] = []
        new: dict[bytes, int] = {}
        for piece in fresh:
            shape: list = []
            at = 0
            for m in self.cut.finditer(piece) if self.cut and "<" in piece else ():
                shape += self.pretokens(piece[at : m.start()])
                shape.append(self.special[m[0]])
                at = m.end()
            shape += self.pretokens(piece[at:] if at else piece)
            for w in shape:
                if isinstance(w, bytes) and w not in self.words:
                    new.setdefault(w, len(new))
            shapes.append(shape)
        base = len(self.word_ids)
        self.word_ids += self.encode_words(list(new))
        self.words.update((w, base + k) for w, k in new.items())
        for shape in shapes:
            ids = [i for w in shape for i in (self.word_ids[self.words[w]] if isinstance(w, bytes) else [w])]
            self.n.append(len(ids))
            self.id_text.append(" ".join(map(str, ids)))
            self.token_text.append(self.decode(ids))

    def _numbers(self, texts: list[str]) -> list[list[int]]:
        if len(self.pieces) > MAX_PIECES:
            self.clear()
        pieces, out, fresh = self.pieces, [], []
        for text in texts:
            if text.isascii() and "<|" not in text:  # special tokens are told by their case
                text = text.lower()
            row = []
            for p in text.replace("\n", " ").split(" "):
                k = pieces.get(p)
                if k is None:
                    k = pieces[p] = len(pieces)
                    fresh.append(p)
                row.append(k)
            out.append(row)
        self._learn(fresh)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, special tokens' strings included, none added."""
        rows = self._numbers(texts)
        id_text = self.id_text
        return [[int(i) for k in row if self.n[k] for i in id_text[k].split(" ")] for row in rows]

    # -- decoding -------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids`` joined by spaces (the file names no decoder); unknown ids drop."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])

    def digests(self, texts: list[str]) -> dict[str, list]:
        """Numbers of ids, and SHA-256 of the written ids and of the decoded text."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            rows = self._numbers(texts)
            n, id_text, token_text = self.n, self.id_text, self.token_text
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for row in rows:
                row = [k for k in row if n[k]]
                out["n_tokens"].append(sum(map(n.__getitem__, row)))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(id_text.__getitem__, row)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(" ".join(map(token_text.__getitem__, row)).encode()).hexdigest())
            return out
        finally:
            if collecting:
                gc.enable()


def bpe(path: str) -> PairIndexBPE:
    """This worker's encoder for ``path``; kept between tasks."""
    return held(("bpe", path), lambda: PairIndexBPE(path))


def encode_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs(doc_id, text)``.

    Null and empty texts have no ids and decode to the empty text. Null doc_ids and repeated
    rows pass through; other columns are ignored. Ids equal the tokenizers library's.
    """
    path = vocabulary or vocabulary_path("word_bpe_49k.json")

    def kernel(texts: list[str]) -> dict:
        ids = bpe(path).encode(texts)
        return {"ids": ids, "decoded": [bpe(path).decode(x) for x in ids]}

    return map_texts(pick(docs, doc_id="long", text="string"), kernel, fields(ids="longs", decoded="string"))


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``encode_texts``, with digests in place of the ids and the decoded text."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    return map_texts(pick(docs, doc_id="long", text="string"), lambda texts: bpe(path).digests(texts), fields(n_tokens="long", ids_sha256="string", decoded_sha256="string"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(docs_of(spark, sf_dir))
