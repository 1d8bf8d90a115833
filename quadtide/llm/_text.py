"""Words, and caches of what tokenizers make of them."""

from __future__ import annotations

import re
import unicodedata
from array import array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same expression for Spark SQL and for DuckDB.
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: White space of str.split() beyond [\x20\x09-\x0D].
_WIDE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")


def words(text: str | None) -> list[str]:
    """Runs of anything but ASCII white space; str.split() where it says the same."""
    if not text:
        return []
    return WORD.findall(text) if _WIDE.search(text) else text.split()


class Cache(dict):
    """``make(key)`` by key; forgets all at ``limit`` entries, so that its memory is bounded."""

    def __init__(self, make, limit: int = 800_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordBpe:
    """Ids of the lower-case BPE vocabulary with word ends, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its
    space-separated chunks one after another, and a chunk is encoded once. A chunk of plain Latin letters
    runs through ``tiktoken``'s merge loop (the byte FF stands for the word end); whatever else occurs goes
    through ``tokenizers``. Both give what ``Tokenizer.encode(text, add_special_tokens=False)`` gives.
    """

    def __init__(self, path: str | None = None):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {}
        for token, i in vocab.items():
            if token not in special:
                end = token.endswith("</w>")
                ranks[bytes(byte[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = i
        ranks.setdefault(b"\xff", max(vocab.values()) + 1)
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sa-zA-Z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")
        #: Latin script without the letters and numbers on which the libraries could differ.
        self.plain = re.compile(r"[\x21-\x7e\xa1\xa7\xab\xb0\xb7\xbb\xbf-įı-ǃǍ-ǰȀ-ȟ]*")
        self.chunks = Cache(self.chunk)

    def exact(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        if not self.plain.fullmatch(text):
            return self.exact(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = text.lower()
        if low != text:
            return self.chunks[low]
        if text.isalpha():
            return array("I", self.core.encode_single_piece(text.encode() + b"\xff")).tobytes()
        if text[-1] in ".,!?;:" and text[:-1].isalpha():
            return self.chunks[text[:-1]] + self.chunks[text[-1]]
        ids = array("I")
        for piece in self.split.findall(text):
            ids.extend(self.core.encode_single_piece(piece.encode() + b"\xff"))
        return ids.tobytes()

    def ids(self, text: str) -> bytes:
        if _WIDE.search(text) or any(s in text for s in self.special):
            return self.exact(text)
        chunks = self.chunks
        return b"".join([chunks[w] for w in text.split()])
