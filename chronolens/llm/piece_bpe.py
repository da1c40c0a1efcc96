"""SentencePiece BPE encoding by a prefix table of last tokens, and decoding.

Every prefix of a text has one last token: of all pieces that end there (found by an automaton over the pieces), the
only one that is compatible with the last token of the prefix before it, compatible meaning that merging the two pieces'
joined text gives exactly these two back. Ids are then read off backwards. Pieces never cross certain neighbouring
characters (derived from the vocabulary), so texts fall into segments whose ids are remembered. Runs of two or more
spaces are the exception: their pieces share one score, last tokens are then not unique, and such segments are merged
directly. Characters outside the vocabulary become byte pieces.

Defined cases: a null text encodes as an empty one; rows that repeat give a row each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table

SPACE = "▁"
CACHED_SEGMENTS = 400_000
CACHED_PAIRS = 1_000_000
_LETTER, _REST = r"[^\W\d_²³¹]", r"[\W\d_²³¹]"
_codecs: dict[str, PieceCodec] = {}


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only models without text normalization, with a leading space, are supported")
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == model.SentencePiece.NORMAL]
        if any(p.type in (model.SentencePiece.USER_DEFINED, model.SentencePiece.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.end = self.library.eos_id()
        self.id_of = {text: i for i, text, _ in normal}
        self.text_of = {i: text for i, text, _ in normal}
        self.score = {text: score for _, text, score in normal}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = {c for text in self.id_of for c in text}
        if self.chars - self.id_of.keys():
            raise ValueError("a character of a piece is no piece itself")
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            if self._merge(text) == [i]:  # else no merge order ever ends in this piece
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.runs = {len(text) for text in self.id_of if not text.strip(SPACE)}
        self.segments = self._segment_pattern()
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _segment_pattern(self) -> re.Pattern:
        """Cut before a space after any other character and, where no piece mixes them, between letters and the rest."""
        letter, mixed = re.compile(_LETTER), False
        for text in self.id_of:
            for a, b in zip(text, text[1:], strict=False):
                if b == SPACE and a != SPACE:
                    raise ValueError("a piece has a space after another character")
                mixed |= a != SPACE and bool(letter.match(a)) != bool(letter.match(b))
        if mixed:
            return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        return re.compile(f"{SPACE}*{_LETTER}+|{SPACE}*(?:(?![{SPACE}\n]){_REST})+|{SPACE}+|\n")

    def _merge(self, text: str) -> list[int]:
        """Ids of a text of known characters by the merges themselves: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of[p] for p in parts]

    def _spaces(self, text: str) -> list[int]:
        """Ids of a segment that begins with two or more spaces: a word that can takes the last one first."""
        body = text.lstrip(SPACE)
        run = len(text) - len(body)
        if body and len(self.text_of.get((joined := self._known(SPACE + body))[0], "")) > 1:
            return self._run(run - 1) + list(joined)
        return self._run(run) + (list(self._known(body)) if body else [])

    def _run(self, count: int) -> list[int]:
        """Ids of `count` spaces. All space pieces have one score, so always the leftmost pair that can join joins."""
        parts: list[int] = []
        for _ in range(count):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [self.id_of[SPACE * n] for n in parts]

    def _compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left, right] = self._merge(self.text_of[left] + self.text_of[right]) == [left, right]
        return fits

    def _prefix_table(self, text: str) -> list[int]:
        last, pairs = [-1] * (len(text) + 1), self.pairs
        for at, (piece, size) in self.automaton.iter(text):  # by end, longest first
            if last[at + 1] < 0:
                before = at + 1 - size
                if not before:
                    last[at + 1] = piece
                elif (left := last[before]) >= 0 and (fits if (fits := pairs.get((left, piece))) is not None else self._compatible(left, piece)):
                    last[at + 1] = piece
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= len(self.text_of[last[at]])
        return ids[::-1]

    def _known(self, segment: str) -> tuple[int, ...]:
        return self.known[segment][0] if segment in self.known else self._learn(segment)[0]

    def _learn(self, segment: str) -> tuple[tuple[int, ...], str]:
        ids: list[int] = []
        if segment.startswith(SPACE * 2):
            ids = self._spaces(segment)
        elif self.chars.issuperset(segment):
            ids = self._prefix_table(segment)
        else:
            known = ""
            for c in [*segment, ""]:
                if c and c in self.chars:
                    known += c
                    continue
                ids += self._prefix_table(known) if known else []
                known = ""
                ids += [self.byte_ids[b] for b in c.encode()]
        found = (tuple(ids), " ".join(map(str, ids)))
        if len(segment) <= 64:
            if len(self.known) >= CACHED_SEGMENTS:
                self.known.clear()
            self.known[segment] = found
        return found

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids with the end id, and the same in decimal, joined by one space."""
        if not text:
            return [self.end], str(self.end)
        known, learn = self.known.get, self._learn
        parts = [known(s) or learn(s) for s in self.segments.findall(SPACE + text.replace(" ", SPACE))]
        return [*chain.from_iterable(p[0] for p in parts), self.end], " ".join([*(p[1] for p in parts), str(self.end)])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; with full also ids and decoded."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part, rows = batch.iloc[lo : lo + 500], []
                for doc_id, text in zip(part["doc_id"], part["text"].fillna(""), strict=True):
                    ids, joined = own.encode(text)
                    decoded = own.decode(ids)
                    row = (doc_id, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, ids, decoded) if full else row)
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                out = pd.DataFrame(rows, columns=names if full else names[:4])
                out["doc_id"] = pd.array(out["doc_id"], "Int64") if kind in ("int", "bigint") else out["doc_id"]
                yield out

    more = ", ids array<int>, decoded string" if full else ""
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
