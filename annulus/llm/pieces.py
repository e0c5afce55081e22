"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text begins as its characters. An agenda holds the adjacent pairs whose joint string is a piece of the vocabulary,
by score and then from the left; the best pair is merged, which takes its old neighbours' entries out of force and adds
two new ones, until the agenda is empty. What no piece covers falls back to bytes.

Merges can't cross a place where no piece holds the two characters side by side, so a text falls into units that are
merged on their own: runs of characters that occur in longer pieces, with the word marks before them. A unit's ids are
remembered inside a task, so a frequent word meets the agenda once. For each Arrow batch, the library encodes the
units that are new in it, or on demand its whole texts, and texts are marked by whether both agree.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = float("inf")
MARK = "▁"  # fixed value: the word mark of SentencePiece


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """Bytes that are no text become one replacement character each, as the library has it."""
    if not isinstance(error, UnicodeDecodeError):
        raise error
    return "�", error.start + 1


class Units(dict):
    """unit -> packed ids; units of up to ``longest`` characters are remembered. fresh: those met since they were last checked."""

    def __init__(self, encode: Callable[[str], bytes], longest: int = 64):
        super().__init__()
        self.encode, self.longest = encode, longest
        self.fresh: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.fresh[unit] = self.encode(unit)
        if len(unit) <= self.longest:
            self[unit] = ids
        return ids


class Pieces:
    """Whole texts to packed ids (little-endian unsigned 32-bit integers) and back.

    path: a model of type BPE with byte fallback and without symbols of the user's; any other is an error. keep: the
    number of units that are remembered between texts.
    """

    def __init__(self, path: str, *, keep: int = 500_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = formats.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds, own = formats.ModelProto.SentencePiece.Type, list(model.pieces)
        if model.trainer_spec.model_type != formats.TrainerSpec.ModelType.BPE or not model.trainer_spec.byte_fallback or any(p.type == kinds.USER_DEFINED for p in own):
            raise ValueError("only merge-type models with byte fallback and without symbols of the user's")
        self.plain = not model.normalizer_spec.precompiled_charsmap and not model.normalizer_spec.remove_extra_whitespaces and model.normalizer_spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.strips = self.prefix or model.normalizer_spec.remove_extra_whitespaces
        self.all_spaces = model.normalizer_spec.remove_extra_whitespaces
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.unknown = self.library.unk_id()
        whole = {i: p for i, p in enumerate(own) if p.type in (kinds.NORMAL, kinds.UNUSED)}
        self.ids = {p.piece: i for i, p in whole.items()}
        self.places = {p.piece: -p.score for p in whole.values()}  # in the agenda: the highest score first
        self.unused = {p.piece for p in whole.values() if p.type == kinds.UNUSED}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(own) if p.type == kinds.BYTE}
        # what each id decodes to: a byte, nothing for marks of begin and end, the surface of what is unknown, a piece's text
        surface = model.trainer_spec.unk_surface.encode()
        raw = {i: bytes([b]) for b, i in self.bytes.items()} | {i: p.piece.replace(MARK, " ").encode() for i, p in whole.items()}
        self.raw = [raw.get(i, surface if i == self.unknown else b"") for i in range(len(own))]
        self.whole = frozenset(whole)
        longer = [p for p in self.ids if len(p) > 1]
        self.pairs = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.apart = next(c for c in "\n\t\x01" if not any(c in p for p in longer))
        self.split = self._units_pattern({c for p in longer for c in p})
        self.keep = keep
        self.units = Units(self._unit)

    def _units_pattern(self, joined: set[str]) -> re.Pattern[str]:
        """Units of a normal text. joined: the characters of longer pieces; any other is a unit.

        Letters, with what may follow them inside a piece, are followed by nothing else inside a piece, so a unit ends
        with them: marks, then other characters, then letters.
        """
        some = lambda s: "[" + "".join(map(re.escape, sorted(s))) + "]" if s else "(?!)"
        if any(b == MARK for a, b in map(tuple, self.pairs) if a != MARK):  # a mark is a character as any other
            return re.compile(f"{some(joined)}+|[\\s\\S]")
        letters = {c for c in joined if c.isalpha()}
        while more := {b for a, b in map(tuple, self.pairs) if a in letters} - letters:
            letters |= more
        other = joined - letters - {MARK}
        return re.compile(f"{MARK}*(?:{some(other)}*{some(letters)}+|{some(other)}+)|{MARK}+|[\\s\\S]")

    def merge(self, unit: str) -> list[str]:
        """The pieces of a unit, by the agenda: a list of the pairs' places if it is short, a heap if it is long."""
        halves: dict[str, tuple[str, str]] = {}
        kept = (self._by_list if len(unit) <= 48 else self._by_heap)(list(unit), halves)
        if not halves:
            return kept
        out, todo = [], kept[::-1]
        while todo:  # pieces that may be merged but not used are taken apart again
            s = todo.pop()
            if s in halves:
                todo += reversed(halves[s])
            else:
                out.append(s)
        return out

    def _by_list(self, symbols: list[str], halves: dict) -> list[str]:
        place, unused = self.places.get, self.unused
        agenda = [place(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            joint = symbols[i] + symbols[i + 1]
            if unused and joint in unused:
                halves[joint] = (symbols[i], symbols[i + 1])
            symbols[i] = joint
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = place(symbols[i - 1] + joint, NEVER)
            if i < len(agenda):
                agenda[i] = place(joint + symbols[i + 1], NEVER)
        return symbols

    def _by_heap(self, symbols: list[str], halves: dict) -> list[str]:
        n, places = len(symbols), self.places
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            joint = symbols[left] + symbols[right]
            if joint in places:
                heapq.heappush(agenda, (places[joint], left, right, len(joint)))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of the two was merged meanwhile
            if a + b in self.unused:
                halves[a + b] = (a, b)
            symbols[left], symbols[right] = a + b, ""
            beyond = after[left] = after[right]
            if beyond >= 0:
                before[beyond] = left
                offer(left, beyond)
            if before[left] >= 0:
                offer(before[left], left)
        return [s for s in symbols if s]

    def _unit(self, unit: str) -> bytes:
        if len(unit) > self.units.longest:
            cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.pairs), len(unit)]
            if len(cuts) > 2:
                return b"".join(self.units[unit[a:b]] for a, b in zip(cuts, cuts[1:]))
        pieces = self.merge(unit)
        ids = list(map(self.ids.get, pieces))
        if None in ids:
            ids = [i for p, own in zip(pieces, ids) for i in ([own] if own is not None else map(self.bytes.__getitem__, p.encode()))]
        return array("I", ids).tobytes()  # four bytes each, little-endian on all platforms Spark runs on

    def normal(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str, *, begin: bool = True, end: bool = True) -> bytes:
        if len(self.units) > self.keep:
            self.units.clear()
        body = b"".join(map(self.units.__getitem__, self.split.findall(self.normal(text))))
        return (array("I", [self.begin]).tobytes() if begin else b"") + body + (array("I", [self.end]).tobytes() if end else b"")

    def decode(self, packed: bytes) -> str:
        codecs.register_error("one_each", _each_byte)
        ids = memoryview(packed).cast("I")
        if len(ids) and not self.raw[ids[0]]:
            ids = ids[1:]
        if len(ids) and not self.raw[ids[-1]]:
            ids = ids[:-1]
        parts = list(map(self.raw.__getitem__, ids))
        if b"" in parts:  # a mark ends a run of bytes
            held = "".join(b"".join(x).decode("utf-8", "one_each") for some, x in itertools.groupby(parts, bool) if some)
        else:
            held = b"".join(parts).decode("utf-8", "one_each")
        # only a piece of the vocabulary loses its first mark: a space that comes as a byte is none
        if self.strips and next((i in self.whole for i in ids if self.raw[i]), False):
            held = held.lstrip(" ") if self.all_spaces else held.removeprefix(" ")
        return held

    def checked(self) -> bool:
        """Whether the library gives the ids of all units that are new since the last call, which it encodes in one batch.

        Each is set behind a character that joins with nothing, so that it is encoded as a unit.
        """
        fresh, self.units.fresh = self.units.fresh, {}
        ahead = array("I", self.library.encode(self.apart)).tobytes()
        theirs = self.library.encode([self.apart + u.replace(MARK, " ") for u in fresh], num_threads=1)
        return all(array("I", x).tobytes() == ahead + y for x, y in zip(theirs, fresh.values()))


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    word = lambda i: F.reverse(F.substring(ids, 4 * i + 1, 4))
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(word(i)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def round_trip(docs: DataFrame, path: str, *, begin: bool = True, end: bool = True, check: str = "units", step: int = 128) -> DataFrame:
    """doc_id, ids, decoded, agrees: for each row of ``docs`` its packed ids, and the text that they decode to.

    path: the model's file, at the same place on every machine. agrees: whether the library gives the same. With check="units" it is
    asked for the units that a batch of ``step`` texts met first in its task, with "texts" for all ids and decoded texts as
    wholes (about three times the work); with "" it isn't asked, and agrees is null. A disagreement marks its whole batch.
    Null text counts as empty. Ids of documents may be of any type, null or repeated; extra columns are ignored; an empty
    table gives no row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = part.column("text").to_pylist()
                ids = [pieces.encode(t, begin=begin, end=end) for t in texts]
                decoded = [pieces.decode(x) for x in ids]
                agrees = None
                if check == "units":
                    agrees = pieces.checked()
                elif check:
                    theirs = pieces.library.encode(texts, add_bos=begin, add_eos=end, num_threads=1)
                    agrees = [array("I", x).tobytes() for x in theirs] == ids and pieces.library.decode(theirs, num_threads=1) == decoded
                said = pa.array([agrees] * len(texts), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), said], names=["doc_id", "ids", "decoded", "agrees"])

    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = t.schema["doc_id"]
    return t.mapInArrow(work, T.StructType([kind, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())]))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with a column decoded: the text of their packed ids; null ids give null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    kept = rows.drop("decoded")
    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))
