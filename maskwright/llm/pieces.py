"""SentencePiece BPE encoding by a table of last tokens, and decoding.

BPE has one encoding for every prefix of a text, so one last token, and it is the
only vocabulary entry that ends there and is *compatible* with the last token of
the prefix before it: merging the two pieces' joined text gives the two back. An
automaton finds all entries that end at each place; the table then holds a token
for each prefix, and the ids are recovered from the end backwards. Merges follow the model's rule: of
all neighbours whose join is an entry, the best score, then the leftmost.

The model puts a dummy space in front and writes spaces as U+2581. No entry has
another character before a U+2581, so a text falls into units (a run of them, then
other characters) that encode on their own. Units repeat: those met are kept, up
to a stated number, as are pair tests. Characters outside the vocabulary become byte ids.

Null texts are empty and get the end id alone. Repeated rows are rows of their own;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"


class PrefixEncoder:
    def __init__(self, model: str, unit_limit: int = 300_000, pair_limit: int = 2_000_000):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.score, self.number, self.byte, self.piece = {}, {}, {}, {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.score[piece], self.number[piece], self.piece[i] = sp.get_score(i), i, piece
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("this model has pieces with a space after other characters")
        if len(self.byte) != 256:
            raise ValueError("this model has no byte pieces")
        #: neighbours that some entry has; a token ends between any others
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.single = {p for p in self.score if len(p) == 1}
        if any(c not in self.single for pair in self.joined for c in pair):
            raise ValueError("this model has pieces of characters that are no pieces themselves")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.number.items():
            if self.merge(piece) == [piece]:  # others are never reached
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.vocabulary = sp.vocab_size()
        self.pairs, self.units, self.older = {}, {}, {}
        self.unit_limit, self.pair_limit, self.end = unit_limit, pair_limit, sp.eos_id()
        self.decimal = [str(i) for i in range(self.vocabulary)]
        self.size = {i: len(p) for i, p in self.piece.items()}

    def merge(self, text: str) -> list[str]:
        """The merges as such; only for the short texts of entries and pairs of them."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, joined, encode as these two."""
        if len(self.pairs) >= self.pair_limit:
            self.pairs.clear()
        a, b = self.piece[left], self.piece[right]
        good = self.pairs[left * self.vocabulary + right] = a[-1] + b[0] not in self.joined or self.merge(a + b) == [a, b]
        return good

    def tokens(self, text: str) -> list[int]:
        """The ids of a text of known characters. ``last[i]``: the last token of
        its first i characters."""
        n = len(text)
        last, done = [-1] * (n + 1), 0
        pairs, vocabulary = self.pairs, self.vocabulary
        for end, (size, piece) in self.automaton.iter(text):
            if end < done:
                continue
            before = end + 1 - size
            if before:
                left = last[before]
                good = pairs.get(left * vocabulary + piece)
                if not good and (good is False or not self.compatible(left, piece)):
                    continue
            done = end + 1
            last[done] = piece
        out, size = [], self.size
        while n:
            piece = last[n]
            out.append(piece)
            n -= size[piece]
        out.reverse()
        return out

    def ids(self, unit: str) -> list[int]:
        """The ids of a unit, cut where no entry joins the neighbours."""
        out, start, joined = [], 0, self.joined
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1 : i + 1] not in joined:
                part = unit[start:i]
                start = i
                if len(part) == 1:
                    number = self.number.get(part)
                    out += [self.byte[b] for b in part.encode()] if number is None else [number]
                else:
                    known = self.units.get(part)
                    if known is None:
                        known = self.tokens(part)
                        if len(part) < 200:
                            self.keep(part, known)
                    out += known
        return out

    def keep(self, unit: str, ids: list[int]) -> None:
        """Units met are kept in two generations, so there are at most twice the limit."""
        if len(self.units) >= self.unit_limit:
            self.older, self.units = self.units, {}
        self.units[unit] = tuple(ids)

    def find(self, unit: str) -> tuple[int, ...]:
        """A unit that the younger table doesn't have."""
        ids = self.older.get(unit)
        if ids is None:
            ids = self.ids(unit)
        if len(unit) < 200:
            self.keep(unit, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids, the end id among them."""
        if not text:
            return [self.end]
        parts = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]
        if "" in parts:  # runs of spaces go before the characters that follow
            runs, parts, gap = parts, [], 0
            for run in runs:
                gap += 1
                if run:
                    parts.append(SPACE * gap + run)
                    gap = 0
            if gap:
                parts.append(SPACE * gap)
        else:
            parts = [SPACE + x for x in parts]
        get, find = self.units.get, self.find
        out = []
        for part in parts:
            out += get(part) or find(part)
            if get.__self__ is not self.units:
                get = self.units.get
        out.append(self.end)
        return out

    def as_text(self, ids: list[int]) -> str:
        """The ids in decimal, joined by a space."""
        decimal = self.decimal
        return " ".join([decimal[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


#: the encoder of this Python worker, which Spark reuses from task to task
_KEPT: dict[str, PrefixEncoder] = {}


def encoder(model: str) -> PrefixEncoder:
    if model not in _KEPT:
        _KEPT.clear()
        _KEPT[model] = PrefixEncoder(model)
    return _KEPT[model]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids = [own.encode(t) for t in pc.fill_null(piece.column(1), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of the ids of :func:`encode_documents`."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = [own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            sizes, shas, back = [], [], []
            for at in range(0, batch.num_rows, 256):
                for text in pc.fill_null(batch.column(1).slice(at, 256), "").to_pylist():
                    ids = own.encode(text)
                    sizes.append(len(ids))
                    shas.append(hashlib.sha256(own.as_text(ids).encode()).hexdigest())
                    back.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(back)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
