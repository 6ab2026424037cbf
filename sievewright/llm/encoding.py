"""Token ids of whole texts by a tokenizers file, sped up by encoding each different word once."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are encoded in runs of about so many bytes, whatever the batch size.
RUN_BYTES = 4 << 20
#: Words and pieces that each worker keeps; others are encoded again when they come again.
KEPT = 300_000

LETTERS = "a-zß-öø-ÿ"
#: Words for which lower case, normal form and the split into pieces are the same in Python and in the library.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next of U+0100 onwards."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes arrays of texts with add_special_tokens=False. One per process and file: see encoder()."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        #: White space is dropped and every word stands alone: words can be encoded one by one.
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.model = self.tokenizer.model

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            letters = byte_letters()
            found = self.raw([t.id for t in self.model.tokenize("".join([letters[b] for b in piece.encode()]))])
            if len(self.pieces) < KEPT:
                self.pieces[piece] = found
        return found

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and not any(x in word for x in self.added):
            found = b"".join([self.piece(p) for p in PIECE.findall(word.lower())])
        else:
            found = self.raw(self.tokenizer.encode(word, add_special_tokens=False).ids) if word else b""
        if len(self.words) < KEPT:
            self.words[word] = found
        return found

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            found = [x.ids for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), self.dtype, sum(map(len, found))), np.array([len(x) for x in found], np.int64)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known = self.words
        raw = [known.get(w) if w in known else self.word(w) for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in raw], np.int64) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(raw), self.dtype)
        firsts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(firsts[codes] - (ends - each), each) + np.arange(total)]
        offsets = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        upto = np.concatenate([[0], ends])
        return ids, np.diff(upto[offsets])

    def encode(self, texts: pa.Array):
        """Yields (ids, tokens of each text) for runs of consecutive texts; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()).cast(pa.string()) if not pa.types.is_string(texts.type) else texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, "right")))
            yield self.run(texts[at:upto])
            at = upto


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
