"""BPE encoding and decoding of whole texts, equal to the tokenizers library's own results.

Where no token can reach across (white space; letters beside punctuation), a text is cut into pieces; each
worker keeps the ids of pieces it has seen. A piece longer than `LONG` bytes is encoded
by tree concatenation: its halves are encoded apart, down to `LEAF` characters, and at each join a
growing window of tokens from both sides is encoded again until its outer tokens agree with both
sides. Neighbouring tokens that BPE keeps together stay valid, so the joined ids are exact; windows
that reach both ends are the whole piece.

A null text is taken as empty: no ids, decoded "". Very long texts without white space are dealt out as
leaves over all tasks and joined afterwards, one text a row.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text

#: Bytes of a piece beyond which it is encoded as a tree; characters of its leaves.
LONG, LEAF = 4096, 2048
#: Pieces of a generation (about 200 bytes each); a worker remembers two of them, and forgets the older one when the newer is full.
CACHE = 200_000
#: Unknown pieces that the model gets at a time.
LEARN = 4096
#: Ids that are decoded at a time; a longer text is decoded alone.
DECODE_IDS = 1 << 18
WINDOW = 8
#: Characters of a text beyond which its parts are encoded as rows of their own.
SPREAD = 1 << 20
#: Fixed values, as in the tokenizer file.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
ASCII_SPACE = re.compile("[\x20\x09-\x0D]+")


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        inner = {**spec, "added_tokens": [], "model": {**spec["model"], "end_of_word_suffix": None}}
        self._inner_spec, self._inner = json.dumps(inner), None
        self.long, self.leaf = long, leaf
        #: What the pieces of `split_pieces` rely on; any other tokenizer encodes whole texts by the library.
        self.by_pieces = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        self._plain = None
        #: Tokens that end a word.
        self._ends_word = np.array([bool(self.suffix) and (self.tokenizer.id_to_token(i) or "").endswith(self.suffix) for i in range(self.tokenizer.get_vocab_size())], bool)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @property
    def inner(self):
        """The model for parts that do not end a word."""
        if self._inner is None:
            from tokenizers import Tokenizer

            self._inner = Tokenizer.from_str(self._inner_spec)
        return self._inner

    def part(self, text: str, last: bool) -> list[int]:
        model = (self.tokenizer if last else self.inner).model
        return [t.id for t in model.tokenize(text)]

    def tree(self, text: str, last: bool = True) -> list[int]:
        """Ids of one word of the model's alphabet, from halves."""
        if len(text) <= self.leaf:
            return self.part(text, last)
        half = len(text) // 2
        return self.join(self.tree(text[:half], False), self.tree(text[half:], last), last)

    def spelled(self, ids: list[int], last: bool) -> str:
        text = "".join(self.tokenizer.id_to_token(i) for i in ids)
        return text.removesuffix(self.suffix) if last and self.suffix else text

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        width = WINDOW
        while True:
            a, b = left[-width:], right[:width]
            ends = last and len(b) == len(right)
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            new = self.part(self.spelled(a, False) + self.spelled(b, ends), ends)
            # the outer tokens of the window stay, unless nothing lies beyond them
            if (whole_left or new[0] == a[0]) and (whole_right or new[-1] == b[-1]) and (len(new) > 1 or (whole_left and whole_right)):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            width *= 2

    def piece(self, text: str) -> list[int]:
        """Ids of a piece without white space."""
        if len(text.encode()) <= self.long or any(s in text for s in self.specials):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, None)]
        return [i for word, _ in words for i in self.tree(word)]

    def join_all(self, leaves: list[list[int]]) -> list[int]:
        """Ids of one word from its leaves' ids, joined as a tree."""
        count = len(leaves)
        while len(leaves) > 1:
            count = len(leaves)
            leaves = [self.join(leaves[i], leaves[i + 1], i + 2 >= count) if i + 1 < count else leaves[i] for i in range(0, count, 2)]
        return leaves[0]

    def parts(self, text: str, size: int) -> Iterator[tuple[int, bool, str]]:
        """(word, last, part): runs of pieces (word -1), and parts of words too long for a run."""
        run: list[str] = []
        held, word = 0, 0
        for piece in ASCII_SPACE.split(text):
            if len(piece) <= size or any(s in piece for s in self.specials):
                run.append(piece)
                held += len(piece) + 1
                if held > size:
                    yield -1, True, " ".join(run)
                    run, held = [], 0
                continue
            yield -1, True, " ".join(run)
            run, held = [], 0
            normal = self.tokenizer.normalizer.normalize_str(piece) if self.tokenizer.normalizer else piece
            for own, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, None)]:
                for at in range(0, len(own), size):
                    yield word, at + size >= len(own), own[at : at + size]
                word += 1
        yield -1, True, " ".join(run)

    @property
    def plain(self):
        """The model alone, for words of its alphabet with a space between."""
        if self._plain is None:
            from tokenizers import Tokenizer, pre_tokenizers

            self._plain = Tokenizer(self.tokenizer.model)
            self._plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return self._plain

    def _learn(self, piece: bytes) -> bytes:
        if len(piece) > self.long:
            ids = self.piece(piece.decode())
        elif _LATIN.fullmatch(piece):
            ids = [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(_BYTE_LETTERS))]
        else:
            ids = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        return np.array(ids, np.int32).tobytes()

    def _learn_all(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Ids of each piece. Those of known letters are one word each, and go to the model together."""
        for at in range(0, len(pieces), LEARN):
            some = pieces[at : at + LEARN]
            plain = [len(p) <= self.long and _LATIN.fullmatch(p) is not None for p in some] if self.suffix else [False] * len(some)
            words = [p for p, own in zip(some, plain, strict=True) if own]
            text = _SPACED[np.frombuffer(b" ".join(words), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32) if words else np.zeros(0, np.int32)
            # a word's last token has the suffix, and no other
            ends = np.flatnonzero(self._ends_word[ids]) + 1
            if len(ends) == len(words) and (not len(ends) or ends[-1] == len(ids)):
                data, stops = ids.tobytes(), [0, *(4 * ends).tolist()]
                made = (data[a:b] for a, b in zip(stops, stops[1:], strict=False))
            else:
                made = map(self._learn, words)
            yield from (next(made) if own else self._learn(p) for p, own in zip(some, plain, strict=True))

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (32 bits each) of different pieces, remembered ones first."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i in missing:
            found[i] = self.old.get(pieces[i])
        unknown = [i for i in missing if found[i] is None]
        for i, ids in zip(unknown, self._learn_all([pieces[i] for i in unknown]), strict=True):
            found[i] = ids
        self.new.update((pieces[i], found[i]) for i in missing)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and all ids."""
        whole = texts.cast(pa.large_string()).fill_null("")
        n = len(whole)
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(whole.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        if not self.by_pieces or any(s.encode() in data.tobytes() for s in self.specials):
            coded = [self._alone(t) for t in whole.to_pylist()]
            return np.cumsum([0, *map(len, coded)]), np.concatenate([*coded, np.zeros(0, np.int32)])
        text_at = offsets - lo
        kept, starts = split_pieces(data, text_at)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(kept)).astype(np.int32)), pa.py_buffer(kept)])
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._ids(different)
        flat = np.frombuffer(b"".join(found), np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = coded.indices.to_numpy(zero_copy_only=False) if different else np.zeros(0, np.int64)
        first, size = (np.cumsum(sizes) - sizes)[own], sizes[own]
        ends = np.concatenate([[0], np.cumsum(size)])
        # place of every id: the first one of its piece plus a count within the piece
        place = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
        # spaces went, so a text begins where the bytes kept before it end
        before = np.concatenate([[0], np.cumsum(_CLASS[data] != 0)])[text_at]
        return ends[np.searchsorted(starts, before)], flat[place]

    def _alone(self, text: str) -> np.ndarray:
        """One text's ids where special tokens, or an unknown tokenizer, need the library for all of it."""
        if self.by_pieces and not any(s in text for s in self.specials):
            return self.encode(pa.array([text]))[1]
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)


# 0 white space, 1 letters, 2 digits, 3 punctuation, 4 what only the library judges
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
#: Pieces of lower-case letters up to U+00FF.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_letters() -> dict[int, int]:
    """Bytes of the byte-level alphabet: visible Latin-1 stands for itself, the rest for 256 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
#: The same by byte, in UTF-32; spaces stay.
_SPACED = np.array([32 if b == 32 else _BYTE_LETTERS.get(b, b) for b in range(256)], "<u4")


def split_pieces(data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes without ASCII white space, and where pieces start in them.

    Pieces end at white space and where letters up to U+017F (but U+0130), ASCII digits and punctuation meet, as tokens
    do; not after an apostrophe (contractions), nor beside anything else, which stays in one piece
    for the library to split. Pieces of known letters are lower-cased up to U+00FF, as the tokenizer would.
    """
    kinds = _CLASS[data]
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    if len(lead):
        after = data[lead + 1]
        # not the signs U+00D7 and U+00F7, nor U+0130, whose lower case ends in a mark
        letter = np.where(data[lead] == 0xC3, (after != 0x97) & (after != 0xB7), (data[lead] != 0xC4) | (after != 0xB0))
        lead, after = lead[letter], after[letter]
        kinds[lead] = kinds[lead + 1] = 1
        low[(lead + 1)[(data[lead] == 0xC3) & (after <= 0x9E)]] += 32
    if not len(data):
        return data, np.zeros(0, np.int64)
    left, right = kinds[:-1], kinds[1:]
    known = (left > 0) & (left < 4) & (right > 0) & (right < 4)
    cut = np.ones(len(data), bool)
    cut[1:] = (left == 0) | (known & ((left != right) | (left == 2)) & ~((data[:-1] == 39) & (right == 1)))
    cut[text_at[text_at < len(data)]] = True
    cut &= kinds != 0
    starts = np.flatnonzero(cut)
    odd = np.flatnonzero(kinds == 4)
    if len(odd):
        piece = np.cumsum(cut) - 1
        mixed = np.zeros(len(starts), bool)
        mixed[piece[odd]] = True
        back = mixed[piece]
        low[back] = data[back]
    inside = kinds != 0
    return low[inside], (np.cumsum(inside) - 1)[starts]


_KEPT: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder a worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _beyond(text: str, spread: int):
    return F.coalesce(F.length(F.col(f"`{text}`").cast("string")) > spread, F.lit(False))


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, spread: int = SPREAD) -> DataFrame:
    """`row` and `found.ids` of every whole text."""

    def make():
        encoder = encoder_for(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            at, ids = encoder.encode(texts)
            return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]

        return work

    huge = _beyond(text, spread)
    return per_text(docs.where(~huge), text, keep, IDS, make).unionByName(_encode_spread(docs.where(huge), path, text, keep, spread))


def _encode_spread(docs: DataFrame, path: str, text: str, keep: list[str] | None, spread: int) -> DataFrame:
    """Encode runs of pieces, and leaves of pieces that nothing splits, as rows of their own; then join."""
    names = docs.columns if keep is None else list(keep)
    body = F.col(f"`{text}`").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), body.alias("text"), F.sha2(body, 256).alias("key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            for key, whole in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = [(key, no, *x) for no, x in enumerate(encoder.parts(whole, max(1, spread // 16)))]
                for at in range(0, len(rows), 8):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + 8], strict=True)], ["key", "no", "word", "last", "part"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            ids = []
            for word, last, part in zip(*(batch.column(c).to_pylist() for c in ("word", "last", "part")), strict=True):
                ids.append(encoder.encode(pa.array([part]))[1].tolist() if word < 0 else encoder.tree(part, last))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "no", "word", "last")), pa.array(ids, pa.list_(pa.int32()))], ["key", "no", "word", "last", "ids"])

    def join(given: pa.Table) -> pa.Table:
        encoder = encoder_for(path)
        rows = given.sort_by("no").select(["word", "last", "ids"]).to_pydict()
        out: list[int] = []
        leaves: list[list[int]] = []
        for word, last, ids in zip(rows["word"], rows["last"], rows["ids"], strict=True):
            if word < 0:
                out += ids
                continue
            leaves.append(ids)
            if last:
                out += encoder.join_all(leaves)
                leaves = []
        return pa.table({"key": given["key"][:1], "found": pa.StructArray.from_arrays([pa.array([out], pa.list_(pa.int32()))], ["ids"])})

    parts = keyed.select("key", "text").dropDuplicates(["key"]).mapInArrow(cut, "key string, no bigint, word bigint, last boolean, part string")
    dealt = parts.repartition("key", "no").mapInArrow(code, "key string, no bigint, word bigint, last boolean, ids array<int>")
    joined = dealt.groupBy("key").applyInArrow(join, T.StructType([T.StructField("key", T.StringType()), T.StructField("found", IDS)]))
    return keyed.select("row", "key").join(joined, "key").select("row", "found")


def decoder_for(path: str):
    """Texts of lists of ids, special tokens included; kept from task to task."""
    tokenizer = encoder_for(path).tokenizer
    if tokenizer.decoder is not None:
        return lambda lists: pa.array(tokenizer.decode_batch([x or [] for x in lists.to_pylist()], skip_special_tokens=False), pa.string())
    if path not in _TOKENS:
        _TOKENS[path] = pa.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], pa.string())
    tokens = _TOKENS[path]

    def spaced(lists: pa.ListArray) -> pa.Array:
        # without a decoder, a text is its tokens with a space between
        at = lists.offsets.to_numpy()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), tokens.take(lists.flatten())), " ")

    return spaced


_TOKENS: dict[str, pa.Array] = {}


def _decoded(decoder, lists: pa.ListArray) -> Iterator[tuple[int, int, pa.Array]]:
    """(from, to, texts) of runs of lists with about DECODE_IDS ids."""
    ends, at = lists.offsets.to_numpy(), 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODE_IDS, side="right")) - 1)
        yield at, to, decoder(lists.slice(at, to - at))
        at = to


def decode(coded: DataFrame, path: str) -> DataFrame:
    """`row`, `ids` and `text` of what `encode` returns, special tokens included."""
    given = coded.select("row", F.col("found.ids").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_for(path)
        for batch in batches:
            for at, to, texts in _decoded(decoder, batch.column("ids")):
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, texts], ["row", "ids", "text"])

    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, spread: int = SPREAD) -> DataFrame:
    """`row`, `ids` and `text`: `decode` of `encode`, by one worker in one pass; texts beyond `spread` in two."""

    def make():
        encoder, decoder = encoder_for(path), decoder_for(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            at, ids = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            return [lists, pa.concat_arrays([x for *_, x in _decoded(decoder, lists)])]

        return work

    huge = _beyond(text, spread)
    both = T.StructType([*IDS.fields, T.StructField("text", T.StringType())])
    short = per_text(docs.where(~huge), text, keep, both, make).select("row", "found.ids", "found.text")
    return short.unionByName(decode(_encode_spread(docs.where(huge), path, text, keep, spread), path))
