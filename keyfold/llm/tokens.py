"""Token ids of white-space-delimited words, as the tokenizers library gives them.

No pre-token of the vocabularies used here reaches across white space, so the ids of a text are those of its words in
order. Words of ASCII and accented Latin letters go through a merge table of tiktoken that is built from the same
vocabulary; all others, and those with a special token's string, go through the library itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Bytes that byte-level vocabularies write as themselves; the others are written as code points from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Words of these characters need no normalisation but lower-casing.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Of lower-cased plain words: the vocabulary's pre-tokens, and the blank between words.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+| ")
END, GAP = "\x00", " "


def _byte_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One per process and vocabulary, shared by all tasks of a worker."""
    return WordEncoder(path)


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.table = self._merge_table(spec)
        self.gap = None

    def _merge_table(self, spec: dict):
        """tiktoken's encoding with the same merges, or None where the vocabulary isn't of the kind described above."""
        model = spec["model"]
        if model.get("end_of_word_suffix") != "</w>" or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return None
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            return None
        import tiktoken

        byte = _byte_of()
        ranks = {}
        for token, i in model["vocab"].items():
            end = token.endswith("</w>")
            ranks[bytes(byte[c] for c in (token[:-4] if end else token)) + END.encode() * end] = i
        merged = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if merged != sorted(merged) or len(ranks) != len(model["vocab"]) or any(model["vocab"].get(c + "</w>", merged[0]) >= merged[0] for c in byte):
            return None
        return tiktoken.Encoding("words", pat_str=f"[^{END}{GAP}]+{END}|{GAP}", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, as arrays of little-endian unsigned 32-bit numbers."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts] if self.table else [False] * len(texts)
        out: list = [None] * len(texts)
        fast = [i for i, p in enumerate(plain) if p]
        if fast:
            pieces = PIECES.findall(GAP.join(texts[i] for i in fast).lower() + GAP)
            ids = np.array(self.table.encode_ordinary("".join(p if p == GAP else p + END for p in pieces)), dtype="<u4")
            if self.gap is None:
                self.gap = self.table.encode_ordinary(GAP)[0]
            cuts = np.flatnonzero(ids == self.gap)
            assert len(cuts) == len(fast)
            start = 0
            for i, cut in zip(fast, cuts.tolist()):
                out[i] = ids[start:cut]
                start = cut + 1
        slow = [i for i, p in enumerate(plain) if not p]
        if slow:
            for i, e in zip(slow, self.library.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype="<u4")
        return out
