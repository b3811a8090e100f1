"""Token ids of whole texts by a public byte-level BPE tokenizer file, fast enough for a corpus.

A piece of text between single spaces, with the space before it, is always split off by the tokenizer's pattern (a space that
is followed by a non-space starts a new pre-token, and nothing looks back). So ids are looked up piece by piece in a bounded
cache, and the pieces that are missing are encoded together. Texts that break the rule (a space before white space or at the
end, special tokens, characters whose class may depend on a Unicode version) are encoded whole by the reference library.
"""

from __future__ import annotations

import json
import re

import numpy as np

CACHE = 400_000


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level BPE files: printable bytes for themselves, the others from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the pre-token pattern of byte-level BPE, as in the tokenizer's description.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r" \s| \Z|[^\x00-ɏ]")


class TextIds:
    """ids(texts) gives one uint16 array of little-endian ids a text, as bytes. plain: special tokens' strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if plain:
            self.whole.encode_special_tokens = True
        told = json.loads(self.whole.to_str())
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("vocabularies over 65,536 ids need wider ids than these")
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.special = [] if plain else list(special)
        self.heads: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def _regular(self, text: str) -> bool:
        return not _ODD.search(text) and not any(s in text for s in self.special)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, cache: dict[str, bytes], pieces: set[str], lead: str) -> None:
        new = [p for p in pieces if p not in cache]
        if not new:
            return
        if lead:
            raw = lead + lead.join(new)
            ids = np.array(self.fast.encode_ordinary(raw), np.int64)
            ends = np.cumsum([len(p.encode()) + len(lead) for p in new])
            reached = np.cumsum(self.size[ids])
            cut = np.searchsorted(reached, ends) + 1
            if np.array_equal(reached[cut - 1], ends):
                data, at = ids.astype("<u2").tobytes(), [0, *(2 * cut).tolist()]
                cache.update((p, data[at[i] : at[i + 1]]) for i, p in enumerate(new))
                return
        cache.update((p, np.array(self.fast.encode_ordinary(lead + p), "<u2").tobytes()) for p in new)

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.rest) > CACHE:
            self.rest.clear()
        if len(self.heads) > CACHE // 4:
            self.heads.clear()
        split = [t.split(" ") if self._regular(t) else None for t in texts]
        self._learn(self.heads, {s[0] for s in split if s}, "")
        self._learn(self.rest, {p for s in split if s for p in s[1:]}, " ")
        get = self.rest.__getitem__
        return [self._whole(t) if s is None else self.heads[s[0]] + b"".join(map(get, s[1:])) for t, s in zip(texts, split, strict=True)]


_made: dict[tuple[str, bool], TextIds] = {}


def text_ids(path: str, plain: bool = False) -> TextIds:
    """One for each Python worker, whose cache outlives a task."""
    if (path, plain) not in _made:
        _made[path, plain] = TextIds(path, plain)
    return _made[path, plain]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
