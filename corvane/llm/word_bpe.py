"""Token ids of the public word-level BPE vocabulary, for whole corpora.

The vocabulary never joins text across white space, so the ids of a text are those of its space-separated chunks in a row.
Chunks repeat, so each worker remembers the ids of those it has met. A text's new chunks of plain Latin letters are encoded
together by the vocabulary's merges; any other chunk goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
from itertools import compress

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Chunks whose normal form is their lower case: no controls, no special white space, no combining or dotted letters.
PLAIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-įı-ɏ]+")
#: Ends a word in the merge table below; PLAIN text has no such character.
END = "\x01"
#: Chunks to remember in a worker, and the bytes of the longest: what is longer is a text without spaces, which does not come again.
REMEMBERED, LONGEST = 600_000, 64


def byte_of_symbol() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte: itself if printable, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split = next(p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(f"{split}| ")
        self.special = [x["content"] for x in model["added_tokens"]]
        symbols, end = byte_of_symbol(), model["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            body = token.removesuffix(end)
            return bytes(symbols[c] for c in body) + (END.encode() if body != token else b"")

        ids = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        # bytes first, then bytes that end a word, which must form before any other merge, then the merges in their order
        ranks = {bytes([b]): b for b in range(256)}
        for merged in [bytes([b]) + END.encode() for b in range(256)] + [raw("".join(m if isinstance(m, list) else m.split(" "))) for m in model["model"]["merges"]]:
            ranks.setdefault(merged, len(ranks))
        self.id_of_rank = np.zeros(len(ranks), dtype="<u4")
        for token, rank in ranks.items():
            self.id_of_rank[rank] = ids.get(token, 0)
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.space = ranks[b" " + END.encode()]
        self.known: dict[bytes, bytes] = {}

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk. All plain chunks go through the merges together, with spaces as words of their own between them."""
        texts = b" ".join(chunks).decode("utf-8", "replace").split(" ")
        plain = [bool(PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        words = self.words.findall(" ".join(compress(texts, plain)).lower())
        ranks = self.merges.encode_to_numpy(END.join(words) + END) if words else np.zeros(0, dtype=np.uint32)
        ids, ends = self.id_of_rank[ranks].tobytes(), [*(4 * np.flatnonzero(ranks == self.space)).tolist(), 4 * len(ranks)]
        together = (ids[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends))
        return [next(together) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t, p in zip(texts, plain, strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        chunks, known = text.encode("utf-8", "replace").split(), self.known
        if new := list(set(chunks).difference(known)):
            if len(known) > REMEMBERED:
                known.clear()
                new = list(set(chunks))
            known.update(zip(new, self.encode_chunks(new), strict=True))
        ids = b"".join(map(known.__getitem__, chunks))
        for chunk in new:
            if len(chunk) > LONGEST:
                del known[chunk]
        return ids


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
