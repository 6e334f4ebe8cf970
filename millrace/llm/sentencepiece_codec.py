"""SentencePiece BPE encoding and decoding from a table of each prefix's last token.

The last token of a prefix's encoding is unique: among the pieces that end there, exactly the one that the
encoding of the text before it can stand next to. So one pass over the text stores that token for every
prefix and the ids are read off backwards. An Aho-Corasick automaton lists the pieces that end at a
position; two pieces may stand next to each other when their concatenation encodes to just these two.

Pieces hold the space mark only in front, and some control characters not at all, so a text falls into
segments that no merge crosses; segments met before are taken from a bounded cache.

A null text counts as empty, whose ids are the begin and end ids alone. A very long text is coded whole, in memory that grows with it. Repeated rows and null ids pass
through; an empty table gives no rows. Only the id and text columns are read, so other columns may have any name. Only models of this kind are accepted: BPE with byte fallback,
identity normalisation with a dummy prefix, no user-defined pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import RecentCache, bounded_batches

SPACE = "▁"
NEVER = float("inf")
#: Tokens from here on stand for characters outside the vocabulary.
STRANGE = 1 << 20
CACHED_SEGMENTS, CACHED_PAIRS, CACHED_LENGTH = 350_000, 400_000, 48  # segments in each of two generations
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if len(model.pieces) > STRANGE or model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or kinds - {1, 2, 3, 6}:
            raise ValueError("only byte-fallback BPE models with identity normalisation are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == 1}  # low is merged first
        self.bytes_at = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        self.bos, self.eos = (self.packed[self.pieces.index(p)] for p in ("<s>", "</s>"))
        self.history: dict[int, tuple] = {}
        self.automaton = ahocorasick.Automaton()
        for number, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == 1:
                self.history[number] = states = self.merge(piece)
                if states[-1][0] == piece:  # else the piece is never the result of merges
                    self.automaton.add_word(piece, (number, len(piece)))
        self.automaton.make_automaton()
        self.segments = self.segment_finder()
        self.pairs: dict[int, bool] = {}
        self.recent = RecentCache(lambda new: map(self.segment, new), CACHED_SEGMENTS)

    def segment_finder(self):
        """Finds segments that no piece crosses: letters, or other characters, with the space marks before them."""
        alone = set(map(chr, range(32))) - {c for p in self.cost if len(p) > 1 for c in p}
        apart = re.escape("".join(sorted(alone)))
        single = f"|[{apart}]" if alone else ""
        letters, others = r"[^\W\d_]+", rf"(?:(?![{SPACE}{apart}])[\W\d_])+"
        for pattern in (f"{SPACE}*{letters}|{SPACE}*{others}|{SPACE}+{single}", f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+{single}"):
            found = re.compile(pattern).findall
            if all(found(p) == [p] for p in self.cost):
                return found
        raise ValueError("a piece holds the space mark after another character")

    def merge(self, text: str) -> tuple[tuple[str, str, float], ...]:
        """First symbol, last symbol and cost of the next merge, after each merge of ``text``."""
        symbols, states = list(text), []
        while True:
            costs = [self.cost.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
            best = min(costs, default=NEVER)
            states.append((symbols[0], symbols[-1], best))
            if best == NEVER:
                return tuple(states)
            at = costs.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def states(self, token: int) -> tuple:
        if token >= STRANGE:
            return ((chr(token - STRANGE), chr(token - STRANGE), NEVER),)
        return self.history[token]

    def may_meet(self, a: int, b: int) -> bool:
        """Whether a then b encodes to just these: the merges within each end before one across comes first."""
        left, right, i, j = self.states(a), self.states(b), 0, 0
        while True:
            across = self.cost.get(left[i][1] + right[j][0], NEVER)
            next_left, next_right = left[i][2], right[j][2]
            if across < next_left and across <= next_right:
                found = False
                break
            if next_left == next_right == NEVER:
                found = True
                break
            if next_left <= next_right:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[a << 22 | b] = found
        return found

    def tokens(self, segment: str) -> list[int]:
        """Piece numbers; STRANGE plus the code point for a character outside the vocabulary."""
        last, known = [-1] * len(segment), self.pairs.get
        for end, (piece, length) in self.automaton.iter(segment):
            if last[end] < 0:
                start = end - length
                if start >= 0:
                    before = last[start]
                    if before < 0:
                        before = STRANGE + ord(segment[start])
                    meets = known(before << 22 | piece)
                    if meets is None:
                        meets = self.may_meet(before, piece)
                    if not meets:
                        continue
                last[end] = piece
        tokens, at = [], len(segment) - 1
        while at >= 0:
            token = last[at]
            tokens.append(token if token >= 0 else STRANGE + ord(segment[at]))
            at -= len(self.pieces[token]) if token >= 0 else 1
        tokens.reverse()
        return tokens

    def segment(self, segment: str) -> tuple[bytes, str]:
        tokens = self.tokens(segment)
        if max(tokens) < STRANGE:
            return b"".join([self.packed[t] for t in tokens]), "".join([self.shown[t] for t in tokens])
        ids = []
        for t in tokens:
            ids += [t] if t < STRANGE else [self.bytes_at[b] for b in chr(t - STRANGE).encode()]
        return b"".join([self.packed[i] for i in ids]), self.surface(ids)

    def surface(self, ids: list[int]) -> str:
        """The text of ids, the space of the dummy prefix included."""
        out, held = [], bytearray()
        for i in ids:
            if self.kinds[i] == 6:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if self.kinds[i] == 1:
                out.append(self.shown[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def round_trips(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32-bit, with begin and end) and the text decoded from them, of each text."""
        split = [self.segments(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        met = set().union(*split)
        known = self.recent.covering(met)
        for segments in split:
            found = [known[s] for s in segments]
            yield b"".join([self.bos, *[x[0] for x in found], self.eos]), "".join([x[1] for x in found]).removeprefix(" ")
        for s in met:
            if len(s) > CACHED_LENGTH:
                del known[s]

    def decode(self, ids: list[int]) -> str:
        return self.surface(ids).removeprefix(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = codec(path)
    for batch in batches:
        done = list(pieces.round_trips(batch.column(1).to_pylist()))
        ids = pa.array([d[0] for d in done], pa.binary())
        counts = pa.array([len(d[0]) // 4 for d in done], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), counts, ids, pa.array([d[1] for d in done], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(encode_batches, path=model_path), ENCODED)
