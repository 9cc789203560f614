"""Byte-level BPE: texts to ids and back, with the `tokenizers` library over Arrow batches.

A byte-level vocabulary writes each byte as a printable character (`byte_characters`), so
every text has ids and every list of ids has bytes.  Ids may cut a character in two: their
bytes are joined before they are read as UTF-8, and a cut character belongs to each of the
ids that hold a part of it (`character_spans`).

Texts are cut where no match of the splitting patterns ever reaches across: before single
spaces and around single line breaks between other characters, and where signs follow a
letter at a chunk's end.  The chunks, mostly words, repeat, so their ids are kept until a
task ends, up to a bound after which it starts anew.  The result is that of whole texts;
texts with longer runs of white space are cut more carefully.

Cases: a null text is an empty one, which has no ids; every row gives one row; no rows give
no rows.  Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from hindsight.llm.arrays import slices

#: So many chunks a worker keeps, at about 200 bytes each, and those of one text.
KEPT_CHUNKS = 800_000
LONGEST_KEPT = 48
SIGNS = ".,;:!?"
#: One match of the splitting patterns, and signs after it, which are another.
WORD = re.compile(rf"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([{SIGNS}]*)")
SAFE = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [chr(other.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(t): int(n) for t, n in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def tokenizer_of_ranks(path: str, pattern: str) -> Tokenizer:
    """The tokenizer that a rank file and a splitting pattern describe.

    Any two neighbours whose bytes together have a rank may merge, lowest rank first, so all
    ways to cut a token in two are merges; a whole match that has a rank is that token.
    """
    ranks, letter = read_ranks(path), byte_characters()
    name = {t: "".join(letter[b] for b in t) for t in ranks}
    merges = [
        (name[t[:i]], name[t[i:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    out = Tokenizer(models.BPE(vocab={name[t]: n for t, n in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    ])
    return out


def tokenizer_of_json(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id; special tokens stand for their own text."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * tokenizer.get_vocab_size()
    for token, n in tokenizer.get_vocab().items():
        out[n] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def decode(ids: Sequence[int], table: Sequence[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def character_spans(ids: np.ndarray, table: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First character of each id, and the one after its last; cut characters count whole."""
    sizes = np.array([len(table[i]) for i in ids], dtype=np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    whole = np.frombuffer(decode(ids, table), np.uint8)
    number = np.cumsum((whole & 0xC0) != 0x80)  # of the character that a byte is in, from 1
    if not len(ids):
        return begin, end
    return number[begin] - 1, number[end - 1]


@contextmanager
def _uncollected() -> Iterator[None]:
    """No search for cycles: millions of strings in lists have none, and are looked through again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Kept(dict):
    """Ids of chunks, made when first asked for; None for those that need what stands beside them."""

    def __init__(self, code: Encoder):
        self.code = code

    def __missing__(self, chunk: str) -> bytes | None:
        if word := WORD.fullmatch(chunk):
            core, tail = word.groups()
            ids = self[core] + self[tail] if tail else self.code.word(core)
        elif chunk != "\n" and (not chunk or chunk[-1].isspace() or chunk[1:2].isspace() or chunk[0].isspace() and chunk[0] != " "):
            ids = None
        else:
            core = chunk.rstrip(SIGNS)
            apart = core != chunk and core[-1:].isalpha()
            ids = self[core] + self[chunk[len(core) :]] if apart else self.code.whole(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters = {b: c for b, c in enumerate(byte_characters())}
        self.raw = [n.to_bytes(4, "little") for n in range(max(tokenizer.get_vocab().values(), default=-1) + 1)]
        self.forget()

    def forget(self) -> None:
        self.kept = Kept(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """A word is one match of the splitting patterns, so the merges alone make its ids."""
        if word.isascii():
            name = self.letters[0x20] + word[1:] if word[0] == " " else word
        else:
            name = word.encode().decode("latin-1").translate(self.letters)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(name)])

    def encode(self, texts: list[str]) -> list[bytes]:
        with _uncollected():
            return [self._encode(t) for t in texts]

    def _encode(self, text: str) -> bytes:
        if len(self.kept) > KEPT_CHUNKS:
            self.forget()
        chunks = [""] if "\0" in text else text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        try:
            return b"".join(map(self.kept.__getitem__, chunks))
        except TypeError:  # runs of white space
            return b"".join([self.kept.get(c) or self.whole(c) for c in SAFE.split(text)])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str | None) -> Encoder:
    """One for each worker; `pattern` goes with a rank file, None with a JSON file."""
    return Encoder(tokenizer_of_json(path) if pattern is None else tokenizer_of_ranks(path, pattern))


@lru_cache(maxsize=4)
def byte_table(path: str, pattern: str | None) -> list[bytes]:
    return token_bytes(encoder(path, pattern).tokenizer)


def encode_texts(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, char_begin, char_end: the ids of each text and the characters they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = encoder(path, pattern), byte_table(path, pattern)
        for batch in batches:
            for part, _, _ in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in code.encode(texts)]
                spans = [character_spans(x, table) for x in ids]
                columns = [[x.tolist() for x in ids], [a.tolist() for a, _ in spans], [b.tolist() for _, b in spans]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, pa.list_(pa.int32())) for c in columns]],
                    ["doc_id", "ids", "char_begin", "char_end"],
                )
        code.forget()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, char_begin array<int>, char_end array<int>"
    )


def decode_ids(rows: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path, pattern)
        for batch in batches:
            texts = [decode(x or [], table).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of ids and of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = encoder(path, pattern), byte_table(path, pattern)
        for batch in batches:
            for part, _, _ in slices(batch):
                ids = code.encode([t or "" for t in part.column("text").to_pylist()])
                back = [decode(memoryview(x).cast("I"), table) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([sha256(x).hexdigest() for x in back], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        code.forget()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
