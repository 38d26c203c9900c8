"""SentencePiece encoding and decoding of merge-type vocabularies (BPE), by a score-ordered agenda.

A text is normalised as the model says (spaces become U+2581, one in front), then every character is a symbol.  The agenda holds the
adjacent pairs whose joined text is a piece, best score first, leftmost first among equals; the best pair merges and offers its
new neighbours, until the agenda is empty.  What is no piece falls back to its UTF-8 bytes, or to the unknown piece.

Symbols never merge across two neighbouring characters that no piece of the vocabulary holds side by side, so a text is cut
there without changing the result: before spaces, and between letters and others, as far as the vocabulary allows.  Parts are
remembered, up to ``REMEMBERED`` of them, per Python worker.

Texts pass through in Arrow batches, never shuffled.  Each batch can be checked against the sentencepiece library (``agrees``): the
library encodes every part that is new; where the vocabulary can write any text, all ids of a row must decode to its text, else to
what the library decodes them to.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import add_columns, long_field, text_field

SPACE = "▁"
REMEMBERED, LONGEST = 500_000, 48
#: Up to so many characters the agenda is a list, above a heap.
SHORT, NOWHERE = 24, float("inf")
#: Two classes of characters that make up all but the space mark; which ones is only a matter of speed.
LETTERS, OTHERS = r"[^\W\d_²³¹]", rf"(?:[^\w{SPACE}]|[\d_²³¹])"
# Fixed values of the model format: kinds of pieces, and the kind of model.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def wire(body: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message: whole numbers, or the raw bytes of anything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = body[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(body):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, body[at : at + size]
        at += size


class Vocabulary:
    """Pieces of a model file: id by text, score and kind by id, and the rules of normalisation."""

    def __init__(self, model: bytes):
        fields = list(wire(model))
        self.pieces, self.scores, self.kinds = [], [], []
        for number, body in fields:
            if number == 1:
                piece = dict(wire(body))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
        training = dict(chain.from_iterable(wire(b) for n, b in fields if n == 2))
        rules = dict(chain.from_iterable(wire(b) for n, b in fields if n == 3))
        if training.get(3, 1) != MERGES:
            raise ValueError("not a merge-type model")
        if rules.get(2) or training.get(24) or USER in self.kinds or not rules.get(5, 1):
            raise ValueError("character maps, trailing space marks, unescaped spaces and user-defined pieces are not supported")
        self.byte_fallback = bool(training.get(35, 0))
        self.unknown_text = training.get(44, " ⁇ ".encode())
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.reserved = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (UNKNOWN, CONTROL, BYTE)}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, UNUSED)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for p, i in self.reserved.items() if self.kinds[i] == BYTE}
        #: Place of a piece in the agenda: the best score is the smallest.
        self.order = {p: -self.scores[i] for p, i in self.ids.items()}
        self.unused = {p for p, i in self.ids.items() if self.kinds[i] == UNUSED}
        # The finest cut that parts no piece: between letters and others and before spaces, before spaces only, or none.
        mixed = re.compile(f"{LETTERS}{OTHERS}|{OTHERS}{LETTERS}|[^{SPACE}]{SPACE}")
        spaced = re.compile(f"[^{SPACE}]{SPACE}")
        if not any(map(mixed.search, self.ids)):
            parts = f"{SPACE}*(?:{LETTERS}+|{OTHERS}+)|{SPACE}+"
        elif not any(map(spaced.search, self.ids)):
            parts = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        else:
            parts = ".+"
        self.parts = re.compile(parts, re.DOTALL)
        self.known = Known(self)
        byte_of = {i: b for b, i in self.bytes.items()}
        # 0xFF is in no UTF-8 text: it marks what the short way of decoding does not handle.
        self.surface = [
            bytes([byte_of[i]]) if k == BYTE else b"\xff" if k == CONTROL else self.unknown_text if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
        ]
        self.decimal = [str(i) for i in range(len(self.pieces))]

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", SPACE)

    @property
    def lossless(self) -> bool:
        """Whether ids that are right decode to the text they were made of, space marks as spaces."""
        return self.byte_fallback and not self.squeeze and self.prefix

    def denormal(self, text: str) -> str:
        return text.replace(SPACE, " ")

    def merged(self, text: str) -> list[str]:
        """The agenda over one text: the pieces (or single characters that are none) it ends with."""
        if len(text) <= SHORT and not self.unused:
            return self.merged_short(text)
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        order, split = self.order.get, {}
        agenda = [(place, k, k + 1, text[k : k + 2]) for k in range(n - 1) if (place := order(text[k : k + 2])) is not None]
        if self.unused:
            split.update((joined, (joined[0], joined[1])) for _, _, _, joined in agenda if joined in self.unused)
        heapify(agenda)
        while agenda:
            _, left, right, joined = heappop(agenda)
            own, other = symbols[left], symbols[right]
            # Left or right may have grown or gone since the pair was offered.
            if not own or not other or len(own) + len(other) != len(joined):
                continue
            symbols[left], symbols[right] = joined, ""
            follows, leads = after[right], before[left]
            after[left] = follows
            if follows >= 0:
                before[follows] = left
                pair = joined + symbols[follows]
                if (place := order(pair)) is not None:
                    heappush(agenda, (place, left, follows, pair))
                    if pair in self.unused:
                        split[pair] = joined, symbols[follows]
            if leads >= 0:
                pair = symbols[leads] + joined
                if (place := order(pair)) is not None:
                    heappush(agenda, (place, leads, left, pair))
                    if pair in self.unused:
                        split[pair] = symbols[leads], joined
        if not split:
            return [x for x in symbols if x]
        out: list[str] = []
        todo = [x for x in reversed(symbols) if x]
        while todo:
            piece = todo.pop()
            if piece in split:
                todo += reversed(split[piece])
            else:
                out.append(piece)
        return out

    def merged_short(self, text: str) -> list[str]:
        """The same with the agenda as a list in the order of the text: the first of its smallest places is the best pair."""
        symbols, order = list(text), self.order.get
        agenda = [order(text[k : k + 2], NOWHERE) for k in range(len(text) - 1)]
        while agenda:
            best = min(agenda)
            if best == NOWHERE:
                break
            k = agenda.index(best)
            symbols[k] = joined = symbols[k] + symbols[k + 1]
            del symbols[k + 1], agenda[k]
            if k < len(agenda):
                agenda[k] = order(joined + symbols[k + 1], NOWHERE)
            if k:
                agenda[k - 1] = order(symbols[k - 1] + joined, NOWHERE)
        return symbols

    def encode_part(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.merged(part):
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out = list(chain.from_iterable(map(self.known.__getitem__, self.parts.findall(self.normal(text)))))
        if not self.byte_fallback:  # a run of unknown pieces is one
            out = [x for k, x in enumerate(out) if x != self.unknown or not k or out[k - 1] != x]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control pieces give nothing, bytes that form no character give U+FFFD each."""
        end = len(ids)
        while end and self.kinds[ids[end - 1]] == CONTROL:
            end -= 1
        if not end:
            return ""
        if not self.squeeze:
            try:
                text = b"".join(map(self.surface.__getitem__, ids[:end])).decode()
                first = ids[0]
                strip = self.prefix and self.kinds[first] == NORMAL and self.pieces[first].startswith(SPACE)
                return text[1:] if strip else text
            except UnicodeDecodeError:
                pass
        out, run, seen, start = [], bytearray(), False, True
        for i in [*ids[:end], None]:
            kind = None if i is None else self.kinds[i]
            if kind == BYTE:
                run += self.surface[i]
                continue
            if run:
                out.append(characters(bytes(run)))
                run.clear()
            start = start and not seen and not any(out)
            if kind in (None, CONTROL):
                seen = False
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_text.decode())
                seen = False
                continue
            piece = self.pieces[i]
            seen = start and (self.prefix or self.squeeze) and piece.startswith(SPACE)
            out.append((piece[1:] if seen else piece).replace(SPACE, " "))
            seen = seen and not self.squeeze
        return "".join(out)


class Known(dict):
    """Ids of the parts met so far; long parts are not kept, and a full memory starts anew.

    ``fresh`` collects the parts encoded since it was set, ``wrong`` holds those that the library encodes otherwise.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.fresh: dict[str, tuple[int, ...]] | None = None
        self.wrong: set[str] = set()

    def __missing__(self, part: str) -> tuple[int, ...]:
        got = self.vocabulary.encode_part(part)
        if self.fresh is not None:
            self.fresh[part] = got
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = got
        return got

    def check(self, theirs) -> None:
        """Compares the fresh parts with the library, which is set to add no space in front."""
        fresh, self.fresh = self.fresh or {}, {}
        if fresh:
            self.wrong.update(p for (p, ids), their in zip(fresh.items(), theirs.encode(list(fresh), num_threads=1), strict=True) if list(ids) != their)


def characters(run: bytes) -> str:
    """UTF-8 bytes as text, U+FFFD for each byte that begins no whole character."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


@lru_cache(maxsize=2)
def library(model: bytes):
    """The library twice: as the model says, and without the space in front, for parts of a text."""
    from sentencepiece import SentencePieceProcessor

    # A message given twice is merged: these are the rules of normalisation (3) without a prefix (3) and without squeezing (4).
    plain = bytes([3 << 3 | 2, 4, 3 << 3, 0, 4 << 3, 0])
    return SentencePieceProcessor(model_proto=model), SentencePieceProcessor(model_proto=model + plain)


FIELDS = {
    "ids": T.StructField("ids", T.ArrayType(T.IntegerType())), "n_tokens": long_field("n_tokens"), "ids_sha256": text_field("ids_sha256"),
    "decoded": text_field("decoded"), "decoded_sha256": text_field("decoded_sha256"), "agrees": T.StructField("agrees", T.BooleanType()),
}


def encoded(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids",), begin: bool = False, end: bool = True) -> DataFrame:
    """Every row of ``docs`` with the columns named in ``outputs`` (see ``FIELDS``): ids, their number and digest, what they decode to and
    its digest, and whether the sentencepiece library agrees: the same ids for every part of the text, and the right text back.

    A missing text is an empty one: it has the begin and end ids asked for, and decodes to nothing.  Texts are encoded whole,
    however long; memory grows with the longest one.  Equal rows get equal results, columns called like an output are
    replaced, an empty table gives no rows.  The model file is read on the driver and travels with the tasks (its size is
    that of a vocabulary, not of the data).
    """
    model = Path(model_path).read_bytes()
    special = dict(zip(("<s>", "</s>"), (begin, end), strict=True))

    def compute(batch: pa.RecordBatch) -> list:
        own = vocabulary(model)
        head, tail = ([own.reserved[p] for p, wanted in special.items() if wanted and p == q] for q in special)
        texts = [x or "" for x in batch.column("text").to_pylist()]
        made: dict[str, list] = {name: [] for name in outputs}
        known, theirs = own.known, library(model) if "agrees" in made else None
        if theirs:
            known.fresh = known.fresh if known.fresh is not None else {}
        for text in texts:
            ids = head + own.encode(text) + tail
            if "ids" in made:
                made["ids"].append(ids)
            if "n_tokens" in made:
                made["n_tokens"].append(len(ids))
            if "ids_sha256" in made:
                made["ids_sha256"].append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
            if made.keys() & {"decoded", "decoded_sha256", "agrees"}:
                decoded = own.decode(ids)
                if "decoded" in made:
                    made["decoded"].append(decoded)
                if "decoded_sha256" in made:
                    made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if theirs:
                    made["agrees"].append(decoded == own.denormal(text) if own.lossless else decoded == theirs[0].decode(ids))
        if theirs:
            known.check(theirs[1])
            if known.wrong:
                made["agrees"] = [fine and known.wrong.isdisjoint(own.parts.findall(own.normal(t))) for fine, t in zip(made["agrees"], texts, strict=True)]
        return [made[name] for name in outputs]

    return add_columns(docs, [FIELDS[name] for name in outputs], compute, [c for c in docs.columns if c not in outputs])


def piece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, agrees) of every whole text; see ``encoded`` for nulls and long texts."""
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "agrees")
    return encoded(docs.select("doc_id", "text"), model_path, names).select("doc_id", *names)
