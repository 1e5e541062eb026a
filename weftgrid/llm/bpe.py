"""Byte-pair encoding of texts with a priority queue of merge ranks over a linked list, and decoding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: White space ends every piece of these vocabularies, so what stands between is encoded by itself.
_PART = re.compile(r"[^ \t-\r]+")
#: Remembered parts and words in each of two generations, and their greatest length.
_REMEMBERED, _SHORT = 150_000, 64
#: Fixed value: the word pattern of the vocabulary, for texts of Latin-1 characters only.
_LATIN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Merger:
    """Merges of a byte-level vocabulary whose words end in a suffix."""

    def __init__(self, model: dict) -> None:
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        characters = byte_characters()
        self.inner = [vocabulary.get(c) for c in characters]
        self.last = [vocabulary.get(c + suffix) for c in characters]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: By the left symbol, then the right one: rank (from 1) and new symbol as one number, the rank in the upper bits.
        self.right_of: list[dict[int, int]] = [{} for _ in range(max(vocabulary.values()) + 1)]
        for rank, (a, b) in enumerate(merges, 1):
            self.right_of[vocabulary[a]][vocabulary[b]] = rank << 32 | vocabulary[a + b]

    def __call__(self, word: bytes) -> list[int]:
        """Symbols of a word after all merges, the lowest rank first and from the left among equals.

        The symbols are a doubly linked list.  The queue holds rank and place of pairs; an entry whose pair has changed
        since is skipped when it comes up.
        """
        inner, right_of = self.inner, self.right_of
        symbols = [inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        n = len(symbols)
        # What can be merged at each place now, 0 for nothing.
        pairs = [right_of[a].get(b, 0) for a, b in zip(symbols, symbols[1:])]
        queue = [(pair >> 32) << 32 | at for at, pair in enumerate(pairs) if pair]
        if not queue:
            return symbols
        heapify(queue)
        pairs.append(0)
        after, before = [*range(1, n + 1)], [*range(-1, n)]
        while queue:
            entry = heappop(queue)
            at = entry & 0xFFFFFFFF
            pair = pairs[at]
            if not pair or pair ^ entry > 0xFFFFFFFF:
                continue  # stale: another pair stands here by now, or none
            symbols[at] = new = pair & 0xFFFFFFFF
            right = after[at]
            symbols[right], pairs[right] = -1, 0
            after[at] = following = after[right]
            before[following] = at
            pairs[at] = pair = right_of[new].get(symbols[following], 0) if following < n else 0
            if pair:
                heappush(queue, (pair >> 32) << 32 | at)
            earlier = before[at]
            if earlier >= 0:
                pairs[earlier] = pair = right_of[symbols[earlier]].get(new, 0)
                if pair:
                    heappush(queue, (pair >> 32) << 32 | earlier)
        return [s for s in symbols if s >= 0]


class Memory:
    """Values by key in two generations: when the younger is full it becomes the older one, which is forgotten."""

    def __init__(self) -> None:
        self.young, self.old = {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) < _SHORT:
            if len(self.young) >= _REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[key] = value


class Encoder:
    """Texts to ids: special tokens, normal form and words as the vocabulary file says, then merges.

    Beyond Latin-1 the Unicode tables are those of the tokenizers library, whose normaliser and word pattern are used as they
    are; the merges are our own.  Parts between white space are remembered.
    """

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        described = json.loads(content)
        rules = Tokenizer.from_str(content)
        self.normalizer, self.splitter = rules.normalizer, rules.pre_tokenizer
        self.merge = Merger(described["model"])
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(names)})") if names else None
        self.byte_of = {ord(c): b for b, c in enumerate(byte_characters())}
        # Latin-1 characters are in normal form, and their classes are the same in all versions of Unicode.
        simple = [n.get("pattern", n).get("Regex") if n["type"] == "Replace" else n["type"] for n in described["normalizer"]["normalizers"]]
        split, to_bytes = described["pre_tokenizer"]["pretokenizers"]
        known = simple == ["NFC", r"\s+", "Lowercase"] and split["pattern"]["Regex"] == _LATIN and to_bytes["type"] == "ByteLevel"
        self.latin = regex.compile(_LATIN).findall if known else None
        self.words, self.parts = Memory(), Memory()

    def _words(self, segment: str) -> list[bytes]:
        """Words of a text without white space, as bytes."""
        if self.latin:
            try:
                segment.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return [w.encode() for w in self.latin(segment.lower())]
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(segment))
        return [piece.translate(self.byte_of).encode("latin-1") for piece, _ in pieces]

    def _part(self, part: str) -> bytes:
        ids = []
        for k, segment in enumerate(self.specials.split(part) if self.specials else [part]):
            if k % 2:
                ids.append(array("I", [self.special[segment]]).tobytes())
            elif segment:
                for word in self._words(segment):
                    known = self.words.get(word)
                    if known is None:
                        known = array("I", self.merge(word)).tobytes()
                        self.words.put(word, known)
                    ids.append(known)
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def __call__(self, text: str) -> bytes:
        """Ids of a text, four bytes each, the lowest first."""
        found, parts = [], self.parts
        for part in _PART.findall(text):
            ids = parts.young.get(part)
            if ids is None:
                ids = parts.get(part)
                if ids is None:
                    ids = self._part(part)
                    parts.put(part, ids)
            found.append(ids)
        return b"".join(found)


class Decoder:
    """Ids to text: the vocabulary's strings one after the other, a space between, as the file names no decoder."""

    def __init__(self, content: str) -> None:
        described = json.loads(content)
        named = described["model"]["vocab"] | {t["content"]: t["id"] for t in described["added_tokens"]}
        self.strings = dict(sorted((i, s) for s, i in named.items()))
        if described.get("decoder"):
            raise ValueError("only vocabularies without a decoder of their own are decoded")

    def __call__(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist() if i in strings])


def _content(docs: DataFrame, path: str):
    """The vocabulary file, read once by the driver; its size does not depend on the data.

    A worker process keeps its copy of a broadcast from task to task, and in it the coder with what it remembers.
    """
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast({"content": file.read()})


def _kept(held: dict, coder: type):
    name = coder.__name__
    if name not in held:
        held[name] = coder(held["content"])
    return held[name]


def encode_texts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with ``token_ids``: the ids of each ``text`` as the tokenizers library gives them without special tokens
    added, little-endian, four bytes each.

    The file must be a byte-level BPE vocabulary whose pieces hold no white space; special tokens that stand in a
    text get their ids.  NULL and empty texts have no ids; repeated rows and an empty frame need no care, since
    rows are encoded one by one and nothing is shuffled.  A column of the new name is replaced.
    """
    small_batches(docs.sparkSession)
    content = _content(docs, tokenizer)

    @F.arrow_udf("binary")
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _kept(content.value, Encoder)
        for batch in texts:
            yield pa.array([encode(t.as_py() or "") for t in batch], pa.binary())

    return docs.withColumn("token_ids", encoded("text"))


def decode_ids(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with ``decoded``: the strings of ``token_ids``, special tokens included, joined by spaces.

    NULL and empty ids give an empty text; numbers outside the vocabulary are left out, as in the library.  A column of the new
    name is replaced.
    """
    small_batches(docs.sparkSession)
    content = _content(docs, tokenizer)

    @F.arrow_udf("string")
    def decoded(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = _kept(content.value, Decoder)
        for batch in ids:
            yield pa.array([decode(i.as_py() or b"") for i in batch], pa.string())

    return docs.withColumn("decoded", decoded("token_ids"))


def token_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row."""
    both = decode_ids(encode_texts(docs.select("doc_id", "text"), tokenizer).drop("text"), tokenizer)
    return both.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
