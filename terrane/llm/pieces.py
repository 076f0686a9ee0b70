"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terrane.llm.shared import text_slices, trimmed

SPACE = "▁"
SPLIT = "\n"  # in no piece
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Marks of space with the Latin letters or the other characters after them: no piece reaches across these joints.
UNITS = re.compile(f"{SPACE}*[{LATIN}]+|{SPACE}*[^{SPACE}{LATIN}\n]+|{SPACE}+|\n")
JOINT = re.compile(f"[^{SPACE}]{SPACE}|[{LATIN}][^{LATIN}]|[^{SPACE}{LATIN}][{LATIN}]|\n")
#: Bytes that each of the two generations of cached units holds, about; those of an entry besides its characters; characters of the longest unit to keep.
CACHE_BYTES, ENTRY_BYTES, CACHE_CHARS = 20 << 20, 200, 32
#: Pairs whose compatibility is remembered, a power of two; each takes 8 bytes, and a new one takes the place of an old one.
PAIR_SLOTS = 1 << 20
#: Bytes of text that a task works on at a time.
PIECE_SLICE = 1 << 18


class PieceCodec:
    """Encodes as a merge-type SentencePiece model does, without sampling, begin or end ids.

    An Aho-Corasick automaton gives the longest piece at a position. The encoder takes the longest one
    that is compatible with the piece before it, steps back on failure and keeps a bitfield of positions from which no encoding continues. Two pieces are compatible if merging their characters
    afresh by score, leftmost first on ties, gives back the two. Characters without a piece become bytes.
    Texts are encoded unit by unit; what common units and pairs give is kept in bounded caches.
    Only models with identity normalization, a dummy prefix and kept white space are taken.
    """

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("this codec takes merge-type models with identity normalization and byte fallback")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not taken")
        if any(map(JOINT.search, self.ids)):
            raise ValueError("a piece reaches across units")
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        shown = {kinds.BYTE: lambda p: bytes([int(p.piece[3:5], 16)]), kinds.CONTROL: lambda p: b"", kinds.UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode()}
        #: The bytes that an id, written in decimal, decodes to.
        self.surfaces = {str(i): shown.get(p.type, lambda p: p.piece.replace(SPACE, " ").encode())(p) for i, p in enumerate(model.pieces)}
        self.matcher = ahocorasick.Automaton()
        # a piece that merging never makes is never part of an encoding
        made = {p for p in self.ids if len(self._merge(p)) == 1}
        for piece in made:
            self.matcher.add_word(piece, piece)
        self.matcher.make_automaton()
        self.most = max(map(len, made))
        ahead = lambda text: next((self.ids[text[:k]] for k in range(len(text), 0, -1) if text[:k] in made), 0)
        #: The id of the longest piece that starts what a walk of the automaton has matched; of a piece, that of the next shorter one, 0 if there is none.
        self.longest = {p[:k]: ahead(p[:k]) for p in made for k in range(1, len(p) + 1)}
        self.texts = [p.piece for p in model.pieces]
        self.shorter = [ahead(p[:-1]) if p in made else 0 for p in self.texts]
        self.sizes = list(map(len, self.texts))
        self.forget()

    def _merge(self, text: str) -> list[str]:
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: int, b: int) -> bool:
        first, second = self.texts[a], self.texts[b]
        fit = self._merge(first + second) == [first, second]
        self.pairs[(a * 40_503 + b) & PAIR_SLOTS - 1] = a << 32 | b << 1 | fit
        return fit

    def _walk(self, unit: str) -> list[int]:
        """The ids of the unit's pieces; -1 - c for a character c without a piece."""
        if not self.pairs:
            self.pairs = array("q", bytes(8 * PAIR_SLOTS))
        n, pairs, reach, longest, shorter, sizes, most = len(unit), self.pairs, self.matcher.longest_prefix, self.longest, self.shorter, self.sizes, self.most
        failed = bytearray(n + 1)
        found: list[int] = []
        at = last = 0
        while at < n:
            piece = longest.get(unit[at : at + reach(unit[at : at + most])], 0)
            if not piece:
                # no piece starts here: bytes, with which nothing merges
                found.append(-1 - ord(unit[at]))
                at, last = at + 1, 0
                continue
            while True:
                while piece:
                    if not failed[at + sizes[piece]]:
                        if not last:
                            break
                        held = pairs[(last * 40_503 + piece) & PAIR_SLOTS - 1] ^ (last << 32 | piece << 1)
                        if held == 1 or (held and self._fits(last, piece)):
                            break
                    piece = shorter[piece]
                if piece:
                    break
                failed[at] = 1
                tried = found.pop()
                at -= sizes[tried]
                last = found[-1] if found and found[-1] > 0 else 0
                piece = shorter[tried]
            found.append(piece)
            at, last = at + sizes[piece], piece
        return found

    def split(self, unit: str) -> list[str]:
        """The unit's pieces; a character without a piece stands alone."""
        return [self.texts[i] if i > 0 else chr(-1 - i) for i in self._walk(unit)]

    def _unit(self, unit: str) -> str:
        found = self._walk(unit)
        if found and min(found) > 0:
            return ",".join(map(str, found))
        return ",".join(str(i) for f in found for i in ([f] if f > 0 else self._character(chr(-1 - f))))

    def _character(self, c: str) -> list[int]:
        return [self.ids[c]] if c in self.ids else [self.byte_ids[b] for b in c.encode()]

    def forget(self) -> None:
        """Empties the caches, so that a worker that lives on for other stages holds none of them."""
        self.pairs = array("q")
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.young_bytes = 0

    def ids_text(self, text: str) -> str:
        """The ids of the whole text, in decimal, joined by commas."""
        out, young = [], self.young
        for found in UNITS.finditer(SPACE + text.replace(" ", SPACE)) if text else ():
            unit = found[0]
            ids = young.get(unit)
            if ids is None:
                ids = self.old.get(unit) or self._unit(unit)
                if len(unit) <= CACHE_CHARS:
                    self.young_bytes += len(unit) + len(ids) + ENTRY_BYTES
                    if self.young_bytes > CACHE_BYTES:
                        # units of the last generation that recur come back from it
                        self.old, self.young, self.young_bytes = young, {}, 0
                        young = self.young
                    young[unit] = ids
            out.append(ids)
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.ids_text(text).split(",")] if text else []

    def text_of(self, ids: str) -> str:
        """What ids, in decimal and joined by commas, decode to, without the dummy prefix; runs of bytes as UTF-8, each stray byte as U+FFFD."""
        each = ids.split(",") if ids else []
        raw = b"".join(map(self.surfaces.__getitem__, each))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            # a byte that starts no character stands alone
            text, at = "", 0
            while at < len(raw):
                size = next((n for n in (1, 2, 3, 4) if _whole(raw[at : at + n])), 0)
                text += raw[at : at + size].decode() if size else "\ufffd"
                at += size or 1
        first = next((i for i in each if self.surfaces[i]), None)
        return text[1:] if first and self.texts[int(first)].startswith(SPACE) else text

    def decode(self, ids: Iterable[int]) -> str:
        return self.text_of(",".join(map(str, ids)))


def _whole(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec for each worker and model."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode_documents(docs: DataFrame, model_path: str, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The `keep` columns with n_tokens, ids (joined by commas) and decoded of each whole text.

    A null text counts as empty; an empty text has no ids and decodes to "". Rows aren't moved, merged or
    dropped: repeated rows give repeated results, an empty table an empty one, other columns are left out unless kept.
    `model_path` names a file that every executor has. A text is worked on whole: a task takes about 85 bytes for each byte
    of its longest one.
    """
    return _mapped(docs, model_path, list(keep), text, False)


def digest_documents(docs: DataFrame, model_path: str, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """As encode_documents, with ids_sha256 and decoded_sha256 for the ids and the decoded text."""
    return _mapped(docs, model_path, list(keep), text, True)


def _mapped(docs: DataFrame, model_path: str, keep: list[str], text: str, digests: bool) -> DataFrame:
    chosen = docs.select(*keep, docs[text].alias("__text"))
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    schema = T.StructType([f for f in chosen.schema.fields if f.name != "__text"] + [T.StructField("n_tokens", T.LongType(), False)] + [T.StructField(n, T.StringType(), False) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_path)
        for batch in text_slices(batches, "__text", PIECE_SLICE):
            counts, first, second = [], [], []
            for value in batch.column(len(keep)):
                ids = pieces.ids_text(value.as_py() or "")
                decoded = pieces.text_of(ids)
                counts.append(ids.count(",") + bool(ids))
                first.append(hashlib.sha256(ids.encode()).hexdigest() if digests else ids)
                second.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[*keep, "n_tokens", *names])
        pieces.forget()

    return chosen.mapInArrow(trimmed(run), schema)
