"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that its encoding ends with. An Aho-Corasick automaton
over the vocabulary (its states and suffix links are those of a suffix automaton's matches, for many words at once) gives all
tokens that end at each place; such a token is the last one of that prefix if it is
compatible with the last token of the prefix before it, that is, if no merge across the border between the two would
come before the merges that made them. Following the last tokens back from the end gives the ids. This is linear in the
text, however long a piece is, and gives the ids of merging by rank.

The vocabulary file is that of the tokenizers library (its path is a parameter; each worker reads it once): a BPE model
with a suffix for word ends, NFC and lower case, a splitting pattern and byte-level symbols.

Nulls: a null text is empty; an empty text has no ids and decodes to the empty text. Repeated rows give equal rows.
Columns but doc_id and text are not read by encode_digests(); encode() keeps them all.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import Memo, in_arrow, table

#: Words, and pieces, that a worker remembers before the older ones go; it holds twice as many at most. Fewer where other stages share the machine.
MEMORY, SHARED_MEMORY = 250_000, 100_000


def byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: The ids of a piece as text, their number, and the text they decode to.
Found = tuple[str, int, str]
SPLIT_ONLY = frozenset("\x1c\x1d\x1e\x1f")


class Bpe:
    def __init__(self, path: str, memory: int = MEMORY):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, symbols = model["end_of_word_suffix"] or "", byte_symbols()
        self.tokens: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        #: A symbol is one character: a byte, or from U+0200 on a byte that ends its word.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            token = vocab[a + b[: len(b)]]
            self.merge[vocab[a], vocab[b]] = (rank, token)
            made.setdefault(token, (rank, vocab[a], vocab[b]))
        self.made = made
        self.end = bool(end)
        self.fits: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            last = end and text.endswith(end) and text != end
            body = text[: -len(end)] if last else text
            if not self.reachable(token) or not all(c in symbols for c in body):
                continue
            data = [symbols[c] for c in body]
            self.automaton.add_word("".join(map(chr, data[:-1])) + chr(data[-1] + 0x200 * bool(last)), (token, len(data)))
        self.automaton.make_automaton()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.blanks = regex.compile(r"\s+").split
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.known_pieces, self.words = Memo(self.look, memory), Memo(self.word, memory)

    def spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens on one border of a token from the whole down, each with the rank of the merge that ends it."""
        out = self.spines[right].get(token)
        if out is None:
            out, x, ends = [], token, float("inf")
            while True:
                out.append((x, ends))
                if x not in self.made:
                    break
                ends, a, b = self.made[x]
                x = b if right else a
            self.spines[right][token] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between the two tokens alone. Equal ranks go from the left."""
        heads, merge = self.spine(right, False), self.merge.get
        for x, x_ends in self.spine(left, True):
            for y, y_ends in heads:
                m = merge((x, y))
                if m and m[0] < x_ends and m[0] <= y_ends:
                    return False
        return True

    def reachable(self, token: int) -> bool:
        """Whether a token is the encoding of its own text, which holds if each merge in it is."""
        ok = self.alone.get(token)
        if ok is None:
            _, a, b = self.made.get(token, (0, None, None))
            ok = self.alone[token] = a is None or (self.reachable(a) and self.reachable(b) and self._inner(token, a, b))
        return ok

    def _inner(self, token: int, a: int, b: int) -> bool:
        """Whether the border between a token's halves holds until the token's own merge."""
        rank = self.made[token][0]
        heads = self.spine(b, False)
        return not any((m := self.merge.get((x, y))) and m[0] < x_ends and m[0] <= y_ends and m[0] < rank for x, x_ends in self.spine(a, True) for y, y_ends in heads)

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        symbols = data.decode("latin-1")
        if self.end:
            symbols = symbols[:-1] + chr(data[-1] + 0x200)
        token_at, start_at = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        fits, token_at[0] = self.fits, -2
        for at, (token, n) in self.automaton.iter(symbols):
            if token_at[at + 1] >= 0:
                continue
            start = at + 1 - n
            if start:
                before = token_at[start]
                if before < 0:
                    continue
                pair = before << 32 | token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) > 1_000_000:
                        fits.clear()
                    ok = fits[pair] = self.compatible(before, token)
                if not ok:
                    continue
            token_at[at + 1] = token
            start_at[at + 1] = start
        out: list[int] = []
        at = len(symbols)
        while at:
            if token_at[at] < 0:
                raise ValueError(f"no token ends prefix {at} of {piece!r}")
            out.append(token_at[at])
            at = start_at[at]
        out.reverse()
        return out

    def look(self, piece: str) -> Found:
        ids = self.encode_piece(piece)
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    def word(self, word: str) -> Found:
        """As look(), of all pieces between two blanks; the pattern matches no blank."""
        pieces = self.pieces(word)
        if len(pieces) == 1:
            return self.known_pieces[pieces[0]]
        ids, n, back = zip(*map(self.known_pieces.__getitem__, pieces))
        return " ".join(ids), sum(n), " ".join(back)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # no final sigma

    def found(self, text: str) -> list[Found]:
        """The pieces of a text in order, those between two blanks together."""
        if "<|" in text and len(parts := self.cut(text)) > 1:
            special = self.special
            return [x for i, p in enumerate(parts) for x in ([(str(special[p]), 1, self.tokens[special[p]])] if i % 2 else self.found(p))]
        text = self.normal(text)
        if not SPLIT_ONLY.isdisjoint(text):  # str.split() takes these as blanks, the pattern doesn't
            return [x for part in self.blanks(text) if part for x in [self.words[part]]]
        return list(map(self.words.__getitem__, text.split()))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.found(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """As the library does for a vocabulary without decoder: the tokens, with blanks between."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@functools.lru_cache(2)
def loaded(path: str, memory: int = SHARED_MEMORY) -> Bpe:
    return Bpe(path, memory)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_digests(docs: DataFrame, path: str | None = None, memory: int = MEMORY) -> DataFrame:
    """Per document: n_tokens, and the SHA-256 of its ids and of what they decode to."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, memory)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1).to_pylist():
                some, counts, tokens = zip(*found) if (found := bpe.found(text or "")) else ((), (), ())
                n.append(sum(counts))
                ids.append(hashlib.sha256(" ".join(some).encode()).hexdigest())
                back.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, decoded: bool = True, memory: int = SHARED_MEMORY) -> DataFrame:
    """All columns of docs, and ids array<int> and (if asked for) decoded string, replacing columns of these names."""
    path = path or vocabulary()
    docs = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, memory)
        for batch in batches:
            ids, tokens = [], []
            for text in batch.column("text").to_pylist():
                found = bpe.found(text or "")
                ids.append(np.array(" ".join([x[0] for x in found]).split(), dtype=np.int32))
                tokens.append(" ".join([x[2] for x in found]) if decoded else "")
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column, *([pa.array(tokens, pa.string())] if decoded else [])], names=[*batch.schema.names, "ids", *(["decoded"] if decoded else [])])
        loaded.cache_clear()  # a worker may go on with another operator's tasks

    added = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    return in_arrow(docs, run, StructType([*docs.schema.fields, *added[: 1 + decoded]]), 1 << 20)


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
