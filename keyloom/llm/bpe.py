"""BPE encoding and decoding (operator 1).

Encoding gives exactly the tokens that repeated lowest-rank merging gives, in
time linear in the word: an Aho-Corasick automaton over the reversed tokens
finds the longest token that starts at each place, tokens are laid down from
the left, longest first, and a token stays only if it is *compatible* with
the one before it, that is if merging their joined text would give these two
tokens again. A place from which no token fits is marked and never visited
again. Decoding gathers bytes through an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, ship

#: Words whose tokens are kept per worker; then the store starts anew.
WORD_CACHE = 150_000
#: Longer words are not kept.
WORD_CHARS = 60
#: Texts without these characters need no normalizer but lower-casing, and PLAIN cuts them as the vocabulary's own pattern does.
OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")
LETTERS, DIGITS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
#: The pattern and the normalizers that PLAIN stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: The last character of a word is another symbol than the same character inside it.
LAST = 0x400


def _byte_texts() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = (b for b in range(256) if b not in own)
    text = {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return [text[b] for b in range(256)]


class _Words(dict):
    """Ids of the words met so far, by their text before byte mapping; a bounded store."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.bpe.encode_word(word.translate(self.bpe.ascii) if word.isascii() else "".join(map(self.bpe.bytes.__getitem__, word.encode())))
        if len(word) <= WORD_CHARS:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """Tables of one vocabulary, from the text of its JSON file.

    The model must be byte-level with a word-end suffix or none, each merge
    making its own token, in the order of their ids, and its pre-tokeniser
    must drop white space.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec)
        self.normalizer, self.pre = tok.normalizer, tok.pre_tokenizer
        conf = json.loads(spec)
        model, self.special = conf["model"], {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = [n["type"] for n in (conf["normalizer"] or {}).get("normalizers", [])]
        cuts = (conf["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = steps == NORMALIZERS and bool(cuts) and cuts[0].get("pattern") == {"Regex": PATTERN}
        self.bytes = _byte_texts()
        self.ascii = {i: self.bytes[i] for i in range(128)}
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.left, self.right, self.merges = [-1] * size, [-1] * size, {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b if not suffix or not a.endswith(suffix) else a[: -len(suffix)] + b]
            self.left[z], self.right[z] = x, y
            self.merges[x, y] = z
        made = [z for z in range(size) if self.left[z] >= 0]
        if [*self.merges.values()] != sorted(self.merges.values()) or len(made) != len(self.merges):
            raise ValueError("merges don't follow the order of token ids")
        self.suffix = suffix
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)
        units = {i: self._units(t) for t, i in vocab.items() if self.left[i] < 0 or self.compatible(self.left[i], self.right[i], i)}
        self.length = [0] * size
        by_text = {u: i for i, u in units.items()}
        self.starts = ahocorasick.Automaton()
        for i, u in units.items():
            self.length[i] = len(u)
            self.starts.add_word(u[::-1], i)
        self.starts.make_automaton()
        self.shorter = [-1] * size
        for i, u in units.items():
            for n in range(len(u) - 1, 0, -1):
                if (j := by_text.get(u[:n])) is not None:
                    self.shorter[i] = j
                    break
        texts = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            texts[i] = t
        pieces = [t.encode() + b" " for t in texts]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.decimal = [str(i).encode() for i in range(size)]

    def _units(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def compatible(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether merging the joined text of tokens a and b gives a, b again.

        Merges are undone from the last to the first on both sides of the
        border; at each step no merge across it may come before the one that
        was undone. Equal merges run from left to right.
        """
        left, right, merges = self.left, self.right, self.merges
        while True:
            across = merges.get((a, b))
            if across is not None and across < before:
                return False
            if a > b and left[a] >= 0:
                before, a = a, right[a]
            elif left[b] >= 0:
                before, b = b + 1, left[b]
            elif left[a] >= 0:
                before, a = a, right[a]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= WORD_CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.compatible(a, b)
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Tokens of one pre-tokenised word."""
        text = word[:-1] + chr(ord(word[-1]) + LAST) if self.suffix else word
        n = len(text)
        longest = [-1] * n
        for end, token in self.starts.iter(text[::-1]):
            at = n - 1 - end
            if longest[at] < 0 or self.length[token] > self.length[longest[at]]:
                longest[at] = token
        tokens: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + self.length[token]
                if not dead[end] and (not tokens or self._fits(tokens[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not tokens:
                    return ()  # symbols outside the vocabulary are dropped with their word
                dead[at] = 1
                last = tokens.pop()
                at -= self.length[last]
                token = self.shorter[last]
        return tuple(tokens)

    def _segment(self, text: str) -> Iterator[int]:
        """Ids of a text without special tokens."""
        ids = self.words.__getitem__
        if self.plain and not OTHER.search(text):
            return chain.from_iterable(map(ids, PLAIN.findall(text.lower())))
        return chain.from_iterable(self._chunk(c.decode()) for c in text.encode().split())

    def _chunk(self, text: str) -> Iterator[int]:
        """Ids of a text without ASCII white space; as that ends every word, each such part is coded alone."""
        if self.plain and not OTHER.search(text):
            return self._segment(text)
        words = self.pre.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)
        return chain.from_iterable(self.encode_word(w) for w, _ in words)

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; strings of special tokens become those tokens."""
        if not self.marks or not any(s in text for s in self.special):
            return list(self._segment(text))
        ids: list[int] = []
        for i, part in enumerate(self.marks.split(text)):
            if i % 2:
                ids.append(self.special[part])
            elif part:
                ids.extend(self._segment(part))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Token texts joined by one space, as for a vocabulary without a decoder."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        end = np.cumsum(size)
        return self.blob[np.arange(end[-1]) + np.repeat(start - end + size, size)][:-1].tobytes().decode()


_loaded: dict[int, Bpe] = {}


def _bpe(spec: str) -> Bpe:
    """The tables of a vocabulary, built once per worker process."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


#: Columns that ``encode`` can give: Spark's type, Arrow's type, and their value from ids and decoded text.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda bpe, ids, text: ids),
    "n_tokens": ("long", pa.int64(), lambda bpe, ids, text: len(ids)),
    "decoded": ("string", pa.string(), lambda bpe, ids, text: text),
    "ids_sha256": ("string", pa.string(), lambda bpe, ids, text: hashlib.sha256(b" ".join(map(bpe.decimal.__getitem__, ids))).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda bpe, ids, text: hashlib.sha256(text.encode()).hexdigest()),
}


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """Encode and decode every text.

    ``vocabulary``: path of a tokenizers JSON file on the driver; its text is
    broadcast (a fixed file of a few MB). Returns one row per input row:
    ``doc_id`` and the columns that ``outputs`` names, all of ``ids`` (array
    of int), ``n_tokens``, ``decoded`` (string), ``ids_sha256`` and
    ``decoded_sha256`` unless told otherwise. A null text counts as empty: no
    ids, empty decoded text. Repeated rows stay repeated; an empty table
    gives an empty result. Other columns of the input are not read. A text
    with very many special tokens takes a time in proportion to its length.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    decodes = bool({"decoded", "decoded_sha256"} & {*outputs})

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        bpe = _bpe(spec.value)
        values = [OUTPUTS[k][2] for k in outputs]
        for key, text in it:
            ids = bpe.encode(text or "")
            decoded = bpe.decode(ids) if decodes else ""
            yield key, *[f(bpe, ids, decoded) for f in values]

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), *[(k, OUTPUTS[k][1]) for k in outputs]])
    return map_rows(kept, rows, ", ".join(["doc_id long", *[f"{k} {OUTPUTS[k][0]}" for k in outputs]]), arrow)
