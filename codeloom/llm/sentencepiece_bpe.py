"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

An agenda of adjacent symbol pairs, ordered by score and then from the left, drives the merges. A text is
first cut wherever two neighbouring characters stand together in no piece: no merge can cross such a place,
so the parts are encoded on their own and remembered. Every part that an Arrow batch brings new is also
encoded by the sentencepiece library, and any difference raises.

Null texts are empty; an empty text has the end id only. Rows are independent: ties, repeated rows, empty
tables and extra columns need no rule beyond one result row per input row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, tokenizer_path

MARK = "▁"
#: Distinct parts of words a worker remembers.
MEMO = 700_000


class Mismatch(RuntimeError):
    """Our ids differ from the library's."""


class PieceModel:
    """A BPE model read through the library: pieces, scores, byte pieces and the pairs that occur inside pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = lib.id_to_piece(list(range(n)))
        self.names, self.end = names, lib.eos_id()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.bytes_of = {i: bytes([int(names[i][3:-1], 16)]) for i in special if lib.is_byte(i)}
        self.byte_ids = {b[0]: i for i, b in self.bytes_of.items()}
        self.hidden = special - set(self.bytes_of)
        self.ids = {names[i]: i for i in range(n) if i not in special and not lib.is_unused(i)}
        place = {x: k for k, x in enumerate(sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True))}
        #: Of each piece: its place by score above 54 bits, then room for a position, then its id in 22 bits.
        self.code = {p: place[lib.get_score(i)] << 54 | i for p, i in self.ids.items()}
        self.joined = joined = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        # A text may be cut before a mark if no piece holds a mark behind another character, and between a
        # letter and a sign if no piece holds a letter before that sign.
        letters = {c for p in self.ids for c in p if c.isalpha() and c < "\u0250"}
        signs = [c for c in ",.;:!?|)\"'#*$%&-" if not any(x + c in joined for x in letters)]
        kind = "".join(map(re.escape, sorted(letters)))
        after = "".join(map(re.escape, [*signs, MARK]))
        by_word = not any(p[0] != MARK and p[1] == MARK for p in joined)
        self.cut = re.compile(f"{MARK}*[{kind}]+(?=[{after}]|\\Z)|{MARK}*[^{MARK}]+|{MARK}+").findall if by_word else lambda text: [text]
        self.guard = next((c for c in "\n\t\x01" if not any(c in p for p in self.ids)), None)
        self.parts: dict[str, tuple[int, ...]] = {}
        self.said: dict[str, bytes] = {}

    def merge(self, part: str) -> list[int]:
        """Ids of one part by the agenda. An entry is void once its two symbols no longer make its piece."""
        symbols, code = list(part), self.code.get
        if len(symbols) == 1:
            agenda = []
        else:
            agenda = [c + (i << 22) for i, pair in enumerate(map(str.__add__, part, part[1:])) if (c := code(pair)) is not None]
        if agenda:
            before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
            heapify(agenda)
            while agenda:
                entry = heappop(agenda)
                i = entry >> 22 & 0xFFFFFFFF
                j = after[i]
                if j < 0 or not symbols[i]:
                    continue
                pair = symbols[i] + symbols[j]
                if (c := code(pair)) is None or c + (i << 22) != entry:
                    continue
                symbols[i], symbols[j] = pair, ""
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (c := code(pair + symbols[k])) is not None:
                        heappush(agenda, c + (i << 22))
                if (h := before[i]) >= 0 and (c := code(symbols[h] + pair)) is not None:
                    heappush(agenda, c + (h << 22))
        out: list[int] = []
        ids = self.ids
        for s in symbols:
            if s:
                if s in ids:
                    out.append(ids[s])
                else:
                    out += [self.byte_ids[b] for b in s.encode()]
        return out

    def encode_part(self, part: str) -> tuple[int, ...]:
        """Ids of a part, cut once more wherever two neighbours stand together in no piece."""
        if len(part) < 24 and part.lstrip(MARK).isalpha():
            return tuple(self.merge(part))
        out: list[int] = []
        at, joined = 0, self.joined
        for i in range(1, len(part) + 1):
            if i == len(part) or part[i - 1 : i + 1] not in joined:
                out += self.merge(part[at:i])
                at = i
        return tuple(out)

    def cuts(self, text: str) -> list[str]:
        """Parts of a text, white space escaped as the mark, with the mark that the library puts first."""
        return self.cut((MARK + text).replace(" ", MARK)) if text else []

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the batch's new parts and hold them against the library."""
        if len(self.parts) > MEMO:
            self.parts.clear(), self.said.clear()
        new = [c for c in set().union(*texts) if c not in self.parts]
        if not new:
            return
        # The library puts a mark first. Parts that start otherwise stand behind a character that joins nothing.
        guard = self.guard or ""
        lead = self.lib.encode(guard) if guard else []
        theirs = self.lib.encode([c[1:] if c[0] == MARK and len(c) > 1 else guard + c for c in new], num_threads=1)
        for c, ids in zip(new, theirs, strict=True):
            own = self.encode_part(c)
            if c[0] != MARK or len(c) == 1:
                if not guard:
                    raise Mismatch("the vocabulary joins every character to another, so parts can't be held against the library")
                ids = ids[len(lead) :]
            if list(own) != ids:
                raise Mismatch(f"{c!r}: {own} here, {ids} in the library")
            self.parts[c] = own
            self.said[c] = " ".join(map(str, own)).encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts with the end id."""
        cut = [self.cuts(t) for t in texts]
        self.learn(cut)
        return [[*chain.from_iterable(map(self.parts.__getitem__, cs)), self.end] for cs in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, runs of byte pieces read as UTF-8, the mark as a space, the first one dropped."""
        out, run = [], b""
        for i in ids:
            if (b := self.bytes_of.get(i)) is not None:
                run += b
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = b""
            if i not in self.hidden:
                out.append(self.names[i].replace(MARK, " "))
        text = "".join(out) + run.decode("utf-8", "replace")
        return text.removeprefix(" ")


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One per worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids``: array of int, the end id last. Columns named ``ids`` are replaced."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    @F.pandas_udf("array<int>")
    def ids(col):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model(path).encode(col.fillna("").tolist()))

    return docs.withColumn("ids", ids(text_or_empty(text)))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: the number of ids and SHA-256 of the ids and of the text that the library decodes from them."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        tail = str(m.end).encode()
        for b in slices(batches, 256):
            cut = [m.cuts(t) for t in b.column(1).to_pylist()]
            m.learn(cut)
            number, coded, plain = [], [], []
            for cs in cut:
                ids = [*chain.from_iterable(map(m.parts.__getitem__, cs)), m.end]
                number.append(len(ids))
                coded.append(hashlib.sha256(b" ".join([*map(m.said.__getitem__, cs), tail])).hexdigest())
                plain.append(hashlib.sha256(m.lib.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(number, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
